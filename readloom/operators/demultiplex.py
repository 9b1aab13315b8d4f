"""Splitting pools by inline barcodes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S


def checked_barcodes(barcodes: dict[str, int], max_mismatches: int = 1) -> dict[str, int]:
    """Upper-case DNA barcodes of one length, too far apart for a read to be near two of them."""
    if not barcodes or any(not isinstance(v, int) or v < 0 for v in barcodes.values()):
        raise ValueError("`barcodes` must map sequences to non-negative round numbers.")
    if not isinstance(max_mismatches, int) or max_mismatches < 0:
        raise ValueError("`max_mismatches` must be one non-negative integer.")
    out = {k.upper().replace("U", "T"): v for k, v in barcodes.items()}
    if len(out) != len(barcodes) or len({len(k) for k in out}) != 1 or any(not re.fullmatch("[ACGT]+", k) for k in out):
        raise ValueError("Barcode names must be equal-length DNA or RNA sequences.")
    for a, b, distance in distances(out):
        if distance < 2 * max_mismatches + 1:
            raise ValueError(f"Barcodes {a} and {b} have distance {distance}; at least {2 * max_mismatches + 1} is required.")
    return out


def distances(barcodes: dict[str, int]) -> list[tuple[str, str, int]]:
    """Differing places of every two barcodes; they are few."""
    return [(a, b, sum(x != y for x, y in zip(a, b, strict=True))) for a, b in combinations(barcodes, 2)]


def mismatches(c: Column, text: str) -> Column:
    """Differing places of two strings of one length."""
    return sum(((F.substring(c, k + 1, 1) != base).cast("int") for k, base in enumerate(text)), F.lit(0))


def assigned(reads: DataFrame, barcodes: dict[str, int], max_mismatches: int = 1) -> DataFrame:
    """``reads`` with ``_to``, the round of the barcode that the read begins with; null without one.

    Checked barcodes are so far apart that no read is near two. The read's head is
    bound once, and inline() keeps filters on the result from evaluating it again.
    """
    width = len(next(iter(barcodes)))
    headed = reads.withColumn("_head", F.substring(S.normalised("sequence"), 1, width))
    head = F.col("_head")

    def close(code: str) -> Column:
        if max_mismatches == 0:
            return head == code
        return S.near(head, code) if max_mismatches == 1 else (F.length(head) == width) & (mismatches(head, code) <= max_mismatches)

    to = F.coalesce(*[F.when(close(code), F.lit(r)) for code, r in barcodes.items()])
    return headed.select(*reads.columns, F.inline(F.array(F.struct(to.alias("_to")))))


@dataclass
class Demultiplexed:
    reads: DataFrame
    unassigned: DataFrame
    summary: DataFrame
    barcodes: dict[str, int]
    max_mismatches: int
    trim_barcode: bool


def demultiplex(reads: DataFrame, barcodes: dict[str, int], max_mismatches: int = 1, trim_barcode: bool = True) -> Demultiplexed:
    """Reads by the round of their barcode; first mates need one pass and no shuffle.

    Second mates follow their first read by ``pair_index`` (of their pool, where
    reads name one), in one join, and stay untrimmed. Pools must have as many of them.
    """
    codes = checked_barcodes(barcodes, max_mismatches)
    width = len(next(iter(codes)))
    name = F.format_string("round_%02d", F.col("_to"))
    first = assigned(reads.filter("mate = 'R1'"), codes, max_mismatches)
    good = first.filter("_to is not null").withColumn("sequence", F.expr(f"substring(sequence, {width + 1})") if trim_barcode else F.col("sequence"))
    rest = first.filter("_to is null").drop("_to")
    second = reads.filter("mate = 'R2'")
    if not second.isEmpty():
        keys = pair_keys(reads)
        mates = second.join(first.select(*keys, "_to"), keys)
        good = good.unionByName(mates.filter("_to is not null").select(*good.columns))
        rest = rest.unionByName(mates.filter("_to is null").select(*reads.columns))
    out = good.withColumn("round", name)
    spark = reads.sparkSession
    rounds = spark.createDataFrame([(f"round_{r:02d}", r) for r in sorted(set(codes.values()))], "round string, round_number int")
    return Demultiplexed(out.drop("_to"), rest, summary(first, rounds), codes, max_mismatches, trim_barcode)


def pair_keys(reads: DataFrame) -> list[str]:
    """The columns that a pair's mates share, after a check that every pool has as many second mates as first ones."""
    if "pair_index" not in reads.columns:
        raise ValueError("Paired reads need `pair_index`; with_pairs() gives it.")
    pool = [c for c in ("round",) if c in reads.columns]
    counts = reads.groupBy(*pool).agg(F.count_if(F.col("mate") == "R1").alias("a"), F.count_if(F.col("mate") == "R2").alias("b"))
    for r in counts.filter("a <> b").limit(1).collect():
        raise ValueError(f"Mates differ in number{f' in {r[0]}' if pool else ''}: {r['a']} first and {r['b']} second ones.")
    return [*pool, "pair_index"]


def summary(first: DataFrame, rounds: DataFrame) -> DataFrame:
    """Assigned reads and their share of all reads for each round, rounds without reads too."""
    counts = first.groupBy("_to").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    per = rounds.join(F.broadcast(counts.filter("_to is not null")), rounds["round_number"] == F.col("_to"), "left").withColumn("assigned_reads", F.coalesce("n", F.lit(0)))
    return per.crossJoin(F.broadcast(total)).select("round", "round_number", "assigned_reads", F.coalesce(F.col("assigned_reads") / F.col("total"), F.lit(0.0)).alias("assigned_fraction"))
