"""Cutting the random insert out of reads.

Reads with exact primers, nearly all of them, are cut by built-in expressions;
only the others pass through an Arrow function that finds the best approximate
occurrence, for a whole batch of reads and all starts at once.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.report import UNABLE, LibraryReport, corrected
from .counting import round_key
from .demultiplex import pair_keys
from .detection import strand


def best_matches(reads: list[str], primer: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and past-end of the primer's best occurrence in each read, -1 where none is close enough.

    Edit distance up to a tenth of the primer. Best: highest
    min(primer length, width) - 2 * errors, then fewest errors, leftmost, longest.
    """
    m = len(primer)
    k = m // 10
    width = max(map(len, reads), default=0)
    if not width or not m:
        return np.full(len(reads), -1), np.full(len(reads), -1)
    text = np.zeros((len(reads), width + m + k + 1), dtype=np.uint8)
    for row, read in enumerate(reads):
        text[row, : len(read)] = np.frombuffer(read.encode("latin-1", "replace"), np.uint8)
    size = np.array([len(r) for r in reads])
    far = 1 << 14
    # band[d]: least edits that turn i primer bases into i + d - k bases from each start
    band = np.full((2 * k + 1, len(reads), width), far, dtype=np.int16)
    for d in range(k, 2 * k + 1):
        band[d] = d - k
    for i in range(1, m + 1):
        new = np.full_like(band, far)
        for d in range(2 * k + 1):
            taken = i + d - k
            if taken < 0:
                continue
            best = np.full(band.shape[1:], far, dtype=np.int16)
            if taken > 0:
                same = text[:, taken - 1 : taken - 1 + width] == ord(primer[i - 1])
                best = band[d] + ~same
            if d + 1 <= 2 * k:
                best = np.minimum(best, band[d + 1] + 1)
            if d > 0:
                best = np.minimum(best, new[d - 1] + 1)
            new[d] = best
        band = new
    start = np.arange(width)
    found, at, to = np.full(len(reads), np.iinfo(np.int64).max), np.full(len(reads), -1), np.full(len(reads), -1)
    for d in range(2 * k + 1):
        taken = m + d - k
        if taken <= 0:
            continue
        errors = band[d].astype(np.int64)
        ok = (errors <= k) & (start + taken <= size[:, None])
        loss = -(min(m, taken) - 2 * errors) + 4 * m
        key = ((loss * 64 + errors) * (width + 1) + start) * 4096 + 4095 - np.minimum(taken, 4095)
        key = np.where(ok, key, np.iinfo(np.int64).max)
        pick = key.argmin(axis=1)
        value = key[np.arange(len(reads)), pick]
        better = value < found
        found[better], at[better], to[better] = value[better], pick[better], pick[better] + taken
    return at, to


def cut_reads(reads: list[str], mode: str, primer_5p: str | None, primer_3p: str | None) -> list[str | None]:
    """Inserts of reads by approximate matching; None where a primer is missing."""
    plain = [r.upper().replace("U", "T") for r in reads]
    begin, end = np.zeros(len(reads), int), np.array([len(r) for r in reads])
    ok = np.ones(len(reads), bool)
    if mode != "THREE_PRIME_ONLY":
        at, to = best_matches(plain, primer_5p.upper().replace("U", "T"))
        ok &= at >= 0
        begin = np.where(at >= 0, to, 0)
    if mode != "FIVE_PRIME_ONLY":
        at, _ = best_matches([r[b:] for r, b in zip(plain, begin, strict=True)], primer_3p.upper().replace("U", "T"))
        ok &= at >= 0
        end = begin + at
    return [r[b:e] if k else None for r, b, e, k in zip(reads, begin, end, ok, strict=True)]


def trimmed(reads: DataFrame, mode: str, primer_5p: str | None, primer_3p: str | None, approximate: bool = True) -> DataFrame:
    """``reads`` with their insert in place of the sequence; reads without the required primers go.

    An exact occurrence always wins over an approximate one and the leftmost exact
    one wins among those, so reads that have their primers exactly need no alignment.
    """
    plain, sequence = F.col("_plain"), F.col("sequence")
    p5, p3 = ((p or "").upper().replace("U", "T") for p in (primer_5p, primer_3p))
    # each step is bound once: inline() keeps what follows from copying expressions into itself
    bind = lambda df, **new: df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))
    marked = bind(reads, _plain=S.normalised("sequence"))
    marked = bind(marked, _begin=F.lit(1) if mode == "THREE_PRIME_ONLY" else F.locate(p5, plain) + len(p5))
    found = F.col("_begin") > (0 if mode == "THREE_PRIME_ONLY" else len(p5))
    if mode == "FIVE_PRIME_ONLY":
        marked = bind(marked, _ok=found, _size=F.length(sequence))
    else:
        marked = bind(marked, _three=F.locate(p3, F.substring(plain, F.col("_begin"), F.length(plain))))
        marked = bind(marked, _ok=found & (F.col("_three") > 0), _size=F.col("_three") - 1)
    names = reads.columns
    exact = marked.filter("_ok").withColumn("sequence", F.substring(sequence, F.col("_begin"), F.col("_size"))).select(*names)
    if not approximate:
        return exact

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["sequence"].str.len().to_numpy()
            order = np.argsort(sizes, kind="stable")
            for part in alike(sizes[order]):
                rows = pdf.iloc[order[part]].copy()
                rows["sequence"] = cut_reads(rows["sequence"].tolist(), mode, primer_5p, primer_3p)
                yield rows[rows["sequence"].notna()][names]

    return exact.unionByName(marked.filter("not coalesce(_ok, false)").select(*names).mapInPandas(align, reads.schema))


def alike(sizes: np.ndarray, most: int = 400_000) -> Iterator[slice]:
    """Runs of ascending read lengths with at most ``most`` cells when padded, or one read."""
    a = 0
    while a < len(sizes):
        b = a + 1
        while b < len(sizes) and (b + 1 - a) * sizes[b] <= most and b - a < 2000:
            b += 1
        yield slice(a, b)
        a = b


def strand_counts(reads: DataFrame, primer_5p: str | None, primer_3p: str | None) -> DataFrame:
    """forward, reverse and ambiguous reads of each round."""
    kind = strand(primer_5p, primer_3p)
    return reads.groupBy("round").agg(*[F.count_if(kind == k).alias(k) for k in ("forward", "reverse", "ambiguous")])


def yields(reads: DataFrame, inserts: DataFrame, key: str = "round") -> DataFrame:
    """input_reads, output_reads and fraction_kept of each round or file; the fraction of an empty one is null."""
    out = inserts.groupBy(key).agg(F.count("*").alias("output_reads"))
    return (
        reads.groupBy(key)
        .agg(F.count("*").alias("input_reads"))
        .join(out, key, "left")
        .select(key, "input_reads", F.coalesce("output_reads", F.lit(0)).alias("output_reads"), (F.coalesce("output_reads", F.lit(0)) / F.nullif(F.col("input_reads"), F.lit(0))).alias("fraction_kept"))
    )


def low_yields(table: DataFrame, key: str = "round", label: str = "round") -> DataFrame:
    """Rounds that kept under half of their reads, or under half of the best round's share, with a message."""
    best = F.max("fraction_kept").over(Window.partitionBy())
    share = table.filter("input_reads > 0").withColumn("_best", best)
    text = F.format_string(f"%s: kept %d of %d reads (%.1f%%; best {label} %.1f%%)", F.col(key), "output_reads", "input_reads", F.col("fraction_kept") * 100, F.col("_best") * 100)
    return share.filter((F.col("fraction_kept") < 0.5) | (F.col("fraction_kept") < 0.5 * F.col("_best"))).select(key, "input_reads", "output_reads", "fraction_kept", text.alias("message"))


@dataclass
class Extraction:
    """Inserts with round, mate, file_index, read_index and sequence, and what is known of each round."""

    mode: str
    full_insert_recovered: bool
    inserts: DataFrame
    per_round: DataFrame
    strands: DataFrame
    report: LibraryReport

    def low_yield_rounds(self) -> dict[str, str]:
        return {r["round"]: r["message"] for r in low_yields(self.per_round).collect()}

    def warn(self) -> None:
        """Warn of rounds whose primers may not fit."""
        low = self.low_yield_rounds()
        if low:
            warnings.warn(f"{len(low)} round(s) lost most reads, or far more than the best round, when inserts were cut; check the primers: " + "; ".join(low[k] for k in sorted(low, key=round_key)), stacklevel=2)


def extract(reads: DataFrame, report: LibraryReport, primer_5p: str | None = None, primer_3p: str | None = None, extraction_mode: str | None = None, approximate: bool = True) -> Extraction:
    """Inserts of all rounds under a report, or under reviewed primers.

    REVERSE libraries are turned around first (the first mate only); reads of MIXED
    ones are taken as they are. Strands are counted before turning. Pairs are kept
    by ``pair_index`` where both mates have their primer.
    """
    report = corrected(report, primer_5p, primer_3p, extraction_mode)
    mode = report.extraction_mode
    if report.status == "UNABLE_TO_INFER" or mode == UNABLE:
        raise ValueError("Nothing can be extracted under this report: it found no usable primers. Pass reviewed ones.")
    r1, r2 = reads.filter("mate = 'R1'"), reads.filter("mate = 'R2'")
    strands = strand_counts(r1, report.primer_5p, report.primer_3p)
    turned = r1.withColumn("sequence", S.reverse_complement_read("sequence")) if report.orientation == "REVERSE" else r1
    if mode == "PAIRED_END_SPLIT_PRIMERS":
        if r2.isEmpty():
            raise ValueError("Split primers stand on both mates; these reads have first mates only.")
        keys = pair_keys(reads)
        left = trimmed(turned, "FIVE_PRIME_ONLY", report.primer_5p, None, approximate)
        right = trimmed(r2, "FIVE_PRIME_ONLY", S.reverse_complement_text(report.primer_3p), None, approximate)
        both = left.select(*keys).join(right.select(*keys), keys)
        inserts = left.join(both, keys, "left_semi").unionByName(right.join(both, keys, "left_semi"))
        kept = inserts.filter("mate = 'R1'")
    else:
        inserts = kept = trimmed(turned, mode, report.primer_5p, report.primer_3p, approximate)
    return Extraction(mode, report.full_insert_recovered, inserts, yields(r1, kept), strands, report)
