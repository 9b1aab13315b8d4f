"""Quality metrics, round similarity and flags over counts.

Input is the long table (round, sequence, reads). Metrics of a round come from
one aggregation of it; windows run over distinct sequences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..plans.report import LibraryReport
from .counting import round_key, top_rows

#: Thresholds of the flags.
LIMITS = {"nonstandard": 0.001, "truseq": 0.01, "tolerance": 1.1, "strand": 0.2, "primer": 0.4, "adapter": 0.05, "modes": 2}
TRUSEQ = "AGATCGGAAGAGC"


def top_sequences(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most abundant sequences of each round with their rank; equal counts by sequence."""
    rows = counts.filter("reads > 0").select("round", "sequence", F.col("reads").cast("double").alias("reads"))
    return top_rows(rows, ["round"], [F.desc("reads"), F.asc("sequence")], F.xxhash64("sequence"), n)


def basics(counts: DataFrame) -> DataFrame:
    """Totals, entropy, coverage, singletons, alphabet and residue shares of each round, by partial sums."""
    n, total = F.col("reads"), F.col("n_reads")
    rows = counts.filter("reads > 0").select("round", "sequence", n.cast("double").alias("reads"))
    bad = F.upper("sequence").rlike("[^ACGTUN]")
    per = rows.groupBy("round").agg(
        F.sum(n).alias("n_reads"),
        F.count("*").alias("n_unique"),
        F.sum(n * F.log2(n)).alias("_logs"),
        F.avg((n == 1).cast("int")).alias("singleton_fraction"),
        F.max(n).alias("_top"),
        F.sum(F.when(bad, n).otherwise(0.0)).alias("_bad"),
        F.sum(F.when(F.upper("sequence").contains(TRUSEQ), n).otherwise(0.0)).alias("_truseq"),
    )
    best = top_sequences(counts, 100).groupBy("round").agg(F.sum("reads").alias("_best"))
    return per.join(F.broadcast(best), "round").select(
        "round",
        "n_reads",
        "n_unique",
        F.greatest(F.log2(total) - F.col("_logs") / total, F.lit(0.0)).alias("shannon_entropy_bits"),
        "singleton_fraction",
        *[(F.col(c) / total).alias(name) for c, name in (("_top", "top_1_coverage"), ("_best", "top_100_coverage"), ("_bad", "nonstandard_alphabet_fraction"), ("_truseq", "truseq_reads_fraction"))],
    )


def gc_content(counts: DataFrame) -> DataFrame:
    """Read-weighted mean and population deviation of the GC share; empty sequences stand aside."""
    rows = counts.filter("reads > 0 and length(sequence) > 0").select("round", S.gc_share("sequence").alias("gc"), "reads")
    means = rows.groupBy("round").agg((F.sum(F.col("gc") * F.col("reads")) / F.sum("reads")).alias("mean_gc"))
    off = rows.join(means, "round")
    return off.groupBy("round").agg(F.first("mean_gc").alias("mean_gc"), F.sqrt(F.sum((F.col("gc") - F.col("mean_gc")) ** 2 * F.col("reads")) / F.sum("reads")).alias("gc_sd"))


def modal_length(counts: DataFrame) -> DataFrame:
    """The length that most reads have; of equal ones, that of the smallest sequence."""
    by = counts.filter("reads > 0").groupBy("round", F.length("sequence").alias("length")).agg(F.sum("reads").alias("n"), F.min("sequence").alias("first"))
    order = Window.partitionBy("round").orderBy(F.desc("n"), "first")
    return by.withColumn("k", F.row_number().over(order)).filter("k = 1").select("round", F.col("length").cast("double").alias("modal_sequence_length"))


def top_kmer(counts: DataFrame, k: int = 6, most: int = 10_000) -> DataFrame:
    """Share of the most frequent k-mer among the k-mers of the most abundant sequences, weighted by reads."""
    each = top_sequences(counts, most).select("round", "reads", F.explode(S.kmers(F.upper("sequence"), k)).alias("kmer"))
    per = each.groupBy("round", "kmer").agg(F.sum("reads").alias("n"))
    return per.groupBy("round").agg((F.max("n") / F.sum("n")).alias("top_kmer_fraction"))


def kmer_sets(counts: DataFrame, k: int = 6, most: int = 10_000) -> DataFrame:
    """Distinct canonical k-mers of each round's most abundant sequences."""
    each = top_sequences(counts, most).select("round", F.explode(S.kmers(S.normalised("sequence"), k)).alias("kmer"))
    return each.select("round", S.canonical("kmer").alias("kmer")).distinct()


def round_similarity(counts: DataFrame, rounds: list[str], k: int = 6, most: int = 10_000) -> DataFrame:
    """Jaccard distance of the k-mer sets of every two rounds, by a join on the k-mer; two empty sets have none."""
    spark = counts.sparkSession
    sets = kmer_sets(counts, k, most).persist()
    sizes = sets.groupBy("round").agg(F.count("*").alias("n"))
    place = F.create_map(*[x for i, r in enumerate(rounds) for x in (F.lit(r), F.lit(i))]) if rounds else F.create_map()
    a, b = sets.select(F.col("round").alias("from_round"), "kmer"), sets.select(F.col("round").alias("to_round"), "kmer")
    both = a.join(b, "kmer").filter(place[F.col("from_round")] < place[F.col("to_round")]).groupBy("from_round", "to_round").agg(F.count("*").alias("same"))
    pairs = spark.createDataFrame([(x, y) for i, x in enumerate(rounds) for y in rounds[i + 1 :]], "from_round string, to_round string")
    out = pairs.join(F.broadcast(both), ["from_round", "to_round"], "left")
    for side in ("from", "to"):
        out = out.join(F.broadcast(sizes.select(F.col("round").alias(f"{side}_round"), F.col("n").alias(f"{side}_n"))), f"{side}_round", "left")
    same, union = F.coalesce("same", F.lit(0)), F.coalesce("from_n", F.lit(0)) + F.coalesce("to_n", F.lit(0)) - F.coalesce("same", F.lit(0))
    return out.select("from_round", "to_round", F.when(union == 0, 0.0).otherwise(1 - same / union).alias("jaccard_distance"))


def nonmonotonic(similarity: DataFrame, rounds: list[str]) -> DataFrame:
    """Triples in which the next round is farther away than a later one, beyond the tolerance."""
    place = F.create_map(*[x for i, r in enumerate(rounds) for x in (F.lit(r), F.lit(i))]) if rounds else F.create_map()
    gap = place[F.col("to_round")] - place[F.col("from_round")]
    near = similarity.filter(gap == 1).select("from_round", F.col("to_round").alias("neighbour_round"), F.col("jaccard_distance").alias("consecutive_distance"))
    far = similarity.filter(gap >= 2).select("from_round", F.col("to_round").alias("distant_round"), F.col("jaccard_distance").alias("distant_distance"))
    return near.join(far, "from_round").filter(F.col("consecutive_distance") > F.col("distant_distance") * LIMITS["tolerance"])


#: Reads of one sequence that are drawn one by one; more are drawn as a binomial.
ONE_BY_ONE = 256


def rarefied(counts: DataFrame, depth: int, seed: int = 42) -> DataFrame:
    """A sample of ``depth`` reads of each round without replacement, as counts; shallower rounds stay whole.

    Every read is drawn with a chance a little above what is needed (nine standard
    deviations), for a sequence of many reads by one binomial; of those, the first
    ``depth`` in the order of a seeded hash stay. So no task holds a round's reads or
    expands a hot sequence, and the same seed gives the same sample.
    """
    rows = counts.filter("reads > 0").select("round", "sequence", F.col("reads").cast("bigint").alias("reads"))
    depth, seed = int(depth), int(seed)
    wanted = depth + 9 * depth**0.5 + 30
    totals = rows.groupBy("round").agg(F.sum("reads").alias("_total"))
    rows = rows.join(F.broadcast(totals), "round").select("round", "sequence", "reads", F.least(F.lit(1.0), wanted / F.col("_total")).alias("_chance"))
    lot = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("sequence"), k), F.lit(1 << 53)) / float(1 << 53)
    whole = rows.filter("_chance = 1.0").select("round", "sequence", "reads")
    partly = rows.filter("_chance < 1.0")
    few = partly.filter(F.col("reads") <= ONE_BY_ONE)
    few = few.select("round", "sequence", F.size(F.filter(F.sequence(F.lit(1).cast("bigint"), F.col("reads")), lambda k: lot(k) < F.col("_chance"))).cast("bigint").alias("reads"))
    many = partly.filter(F.col("reads") > ONE_BY_ONE).withColumn("_seed", F.xxhash64(F.lit(seed), "round", "sequence"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = [np.random.default_rng(s & (1 << 63) - 1).binomial(n, p) for s, n, p in zip(pdf["_seed"], pdf["reads"], pdf["_chance"], strict=True)]
            yield pdf[["round", "sequence"]].assign(reads=np.array(drawn, dtype=np.int64))

    drawn = whole.unionByName(few).unionByName(many.mapInPandas(draw, rows.select("round", "sequence", "reads").schema)).filter("reads > 0")
    copies = drawn.select("round", "sequence", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("reads"))).alias("copy"))
    order = [F.xxhash64(F.lit(seed + 1), "sequence", "copy"), F.col("sequence"), F.col("copy")]
    return top_rows(copies, ["round"], order, F.xxhash64("copy", "sequence"), depth, "lot").groupBy("round", "sequence").agg(F.count("*").alias("reads"))


def hypergeometric(counts: np.ndarray, depth: int, seed: int = 42) -> np.ndarray:
    """The same draw for one round's counts in memory, without expanding them."""
    counts = np.asarray(counts, dtype=np.int64)
    if depth >= counts.sum():
        return counts
    return np.random.default_rng(seed).multivariate_hypergeometric(counts, depth, method="marginals")


def rarefied_unique(counts: DataFrame, depth: int = 10_000, seed: int = 42) -> tuple[DataFrame, int | None]:
    """Distinct sequences of each round at a common depth: the given one, or the smallest round's total."""
    least = counts.groupBy("round").agg(F.sum("reads").alias("n")).filter("n > 0").agg(F.min("n")).first()[0]
    if least is None:
        return counts.sparkSession.createDataFrame([], "round string, rarefied_unique bigint"), None
    at = int(min(depth, least))
    return rarefied(counts, at, seed).groupBy("round").agg(F.count("*").alias("rarefied_unique")), at


@dataclass
class Quality:
    """Metrics and similarities as DataFrames, flags as (name, severity, evidence)."""

    per_round: DataFrame
    round_similarity: DataFrame
    flags: list[tuple[str, str, dict]]
    settings: dict

    def flags_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, s, json.dumps(e)) for n, s, e in self.flags], "name string, severity string, evidence string")


def per_round(counts: DataFrame, depth: int = 10_000, seed: int = 42, k: int = 6, most: int = 10_000) -> DataFrame:
    """The 14 metrics of each round."""
    unique, _ = rarefied_unique(counts, depth, seed)
    out = basics(counts)
    for more in (unique, modal_length(counts), gc_content(counts), top_kmer(counts, k, most)):
        out = out.join(F.broadcast(more), "round", "left")
    names = "round n_reads n_unique shannon_entropy_bits rarefied_unique singleton_fraction top_1_coverage top_100_coverage modal_sequence_length mean_gc gc_sd nonstandard_alphabet_fraction truseq_reads_fraction top_kmer_fraction"
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("mean_gc", "gc_sd", "top_kmer_fraction")}
    return out.withColumns(zero).select(*names.split())


def qc(
    counts: DataFrame, rounds: list[str] | None = None, report: LibraryReport | None = None, low_total_reads: int = 10_000, rarefaction_depth: int = 10_000,
    rarefaction_seed: int = 42, kmer_size: int = 6, kmer_top_sequences: int = 10_000, input_reads: dict[str, int] | None = None, strands: DataFrame | None = None,
) -> Quality:
    """Metrics, similarities and flags. ``counts`` is long; ``rounds`` also names those without reads."""
    if low_total_reads < 0:
        raise ValueError("`low_total_reads` must be one non-negative number.")
    for name, value in (("rarefaction_depth", rarefaction_depth), ("rarefaction_seed", rarefaction_seed), ("kmer_size", kmer_size), ("kmer_top_sequences", kmer_top_sequences)):
        if not isinstance(value, int) or value < 1:
            raise ValueError(f"`{name}` must be one positive integer.")
    spark = counts.sparkSession
    found = per_round(counts, rarefaction_depth, rarefaction_seed, kmer_size, kmer_top_sequences).toPandas().set_index("round")
    rounds = sorted(set(rounds or ()) | set(found.index), key=round_key)
    table = found.reindex(rounds)
    absent = ["n_reads", "n_unique", "shannon_entropy_bits", "singleton_fraction", "top_1_coverage", "top_100_coverage", "mean_gc", "gc_sd", "nonstandard_alphabet_fraction", "truseq_reads_fraction", "top_kmer_fraction"]
    table[absent] = table[absent].fillna(0)
    rows = [(r, *(None if pd.isna(v) else int(v) if c in ("n_unique", "rarefied_unique") else float(v) for c, v in zip(table.columns, table.loc[r], strict=True))) for r in rounds]
    kinds = ", ".join(f"{c} {'bigint' if c in ('n_unique', 'rarefied_unique') else 'double'}" for c in table.columns)
    metrics = spark.createDataFrame(rows, f"round string, {kinds}")
    similarity = round_similarity(counts, rounds, kmer_size, kmer_top_sequences)
    flags: list[tuple[str, str, dict]] = []

    def add(name: str, evidence: dict, severity: str = "warn") -> None:
        flags.append((name, severity, evidence))

    few = table[table["n_reads"] < low_total_reads]
    if len(few):
        add("low_total_reads", {"threshold": low_total_reads, "rounds": list(few.index), "reads": few["n_reads"].tolist()})
    modes = sorted(table["modal_sequence_length"].dropna().unique().tolist())
    if len(modes) > LIMITS["modes"]:
        add("n_length_variation_across_rounds", {"modal_lengths": [None if pd.isna(x) else x for x in table["modal_sequence_length"]], "distinct_modes": modes})
    unique = table["rarefied_unique"].tolist()
    rises = [{"from_round": rounds[i], "to_round": rounds[i + 1], "rarefied_unique_prev": unique[i], "rarefied_unique_curr": unique[i + 1]} for i in range(len(rounds) - 1) if unique[i + 1] > unique[i]]
    if rises:
        positive = table["n_reads"][table["n_reads"] > 0]
        add("unexpected_rarefied_diversity_increase", {"configured_depth": rarefaction_depth, "effective_depth": min(rarefaction_depth, float(positive.min())), "rarefied_unique_per_round": dict(zip(rounds, unique, strict=True)), "increases": rises})
    for name, column, limit in (("nonstandard_alphabet", "nonstandard_alphabet_fraction", LIMITS["nonstandard"]), ("truseq_residual", "truseq_reads_fraction", LIMITS["truseq"])):
        over = table[table[column] > limit]
        if len(over):
            add(name, {"threshold": limit, "rounds": list(over.index), "fractions": over[column].tolist()})
    if len(rounds) >= 3:
        wrong = [r.asDict() for r in nonmonotonic(similarity, rounds).collect()]
        if wrong:
            add("round_kmer_nonmonotonic", {"tolerance": LIMITS["tolerance"], "violations": wrong})
    if strands is not None:
        mixed = []
        for r in sorted(strands.collect(), key=lambda r: round_key(r["round"])):
            total = r["forward"] + r["reverse"] + r["ambiguous"]
            if total and r["reverse"] / total > LIMITS["strand"]:
                mixed.append({"round": r["round"], "reverse_fraction": r["reverse"] / total, "forward": r["forward"], "reverse": r["reverse"], "ambiguous": r["ambiguous"]})
        if mixed:
            add("strand_mix", {"max_reverse_fraction": LIMITS["strand"], "rounds_above_threshold": mixed})
    if report is not None:
        _report_flags(report, rounds, input_reads, add)
    settings = {"low_total_reads": low_total_reads, "rarefaction_depth": rarefaction_depth, "rarefaction_seed": rarefaction_seed, "kmer_size": kmer_size, "kmer_top_sequences": kmer_top_sequences}
    return Quality(metrics, similarity, flags, settings)


def _report_flags(report: LibraryReport, rounds: list[str], input_reads: dict[str, int] | None, add) -> None:
    low = [side for side, rate in (("5p", report.match_rate_5p), ("3p", report.match_rate_3p)) if rate < LIMITS["primer"]]
    if low:
        add("low_primer_match", {"threshold": LIMITS["primer"], "sides": low})
    if report.required_action == "READ_MERGING_RECOMMENDED":
        add("requires_read_merging_for_full_insert", {"extraction_mode": report.extraction_mode}, "info")
    hits = {k: v for k, v in report.known_adapter_hits.items() if v > 0}
    if hits:
        first = (input_reads or {}).get(min(input_reads or {}, key=round_key, default=None), 0)
        base = first * report.read_fraction_used_for_inference
        if not base:
            add("adapter_contamination_high", {"reason": "denominator_unavailable", "known_adapter_hits": dict(report.known_adapter_hits)}, "info")
        elif over := [{"adapter": k, "hits": v, "fraction_of_reads": v / base} for k, v in hits.items() if v / base > LIMITS["adapter"]]:
            add("adapter_contamination_high", {"max_fraction": LIMITS["adapter"], "denominator": base, "adapters_above_threshold": over})


PANELS = ("retention", "primer_match", "length", "diversity")


def provenance(rates: DataFrame | None, rounds: list[str]) -> dict[str, tuple[float, float]] | None:
    """Reads before and after extraction of every one of ``rounds``; None unless all of them have both."""
    if rates is None:
        return None
    found = {r["round"]: (r["input_reads"], r["output_reads"]) for r in rates.select("round", "input_reads", "output_reads").collect()}
    whole = all(r in found and None not in found[r] for r in rounds)
    return {r: found[r] for r in rounds} if whole else None


def layout(panels: int) -> tuple[int, int]:
    """Rows and columns of a grid for so many panels: one row up to three, two beyond."""
    rows = 1 if panels <= 3 else 2
    return rows, max(1, -(-panels // rows))


@dataclass
class Panel:
    """Data of one plot; without data, ``message`` says what is missing."""

    name: str
    data: DataFrame | None
    message: str | None = None

    @property
    def available(self) -> bool:
        return self.data is not None


def panels(found: Quality, counts: DataFrame | None = None, rates: DataFrame | None = None, report: LibraryReport | None = None, which: tuple[str, ...] = PANELS) -> tuple[list[Panel], tuple[int, int]]:
    """The wanted plots' data and their grid; diversity is three panels of one table.

    Without the reads before extraction, retention shows counted reads and says
    so, and the primers' yield is unavailable; without counts, lengths are.
    """
    if not which or set(which) - set(PANELS):
        raise ValueError(f"`which` must name some of {', '.join(PANELS)}.")
    rounds = [r["round"] for r in found.per_round.select("round").collect()]
    if not rounds:
        raise ValueError("There is no round to plot.")
    known = provenance(rates, rounds)

    def panel(name: str) -> Panel:
        if name == "retention":
            if known:
                return Panel(name, retention(rates))
            return Panel(name, found.per_round.select("round", F.col("n_reads").alias("output_reads")), "Reads before extraction are not known.")
        if name == "primer_match":
            return Panel(name, primer_match(rates, report)) if known else Panel(name, None, "Yields need the reads before extraction.")
        if name == "length":
            return Panel(name, length_distribution(counts)) if counts is not None else Panel(name, None, "Lengths need the counts.")
        return Panel(name, diversity(found.per_round))

    return [panel(name) for name in which], layout(len(which) + 2 * which.count("diversity"))


def retention(rates: DataFrame) -> DataFrame:
    """Plot data: reads before and after extraction."""
    return rates.select("round", "input_reads", "output_reads")


def primer_match(rates: DataFrame, report: LibraryReport | None) -> DataFrame:
    """Plot data: yield of each round beside the report's match rates, null without a report."""
    rate = lambda v: F.lit(None if report is None else float(v)).cast("double")
    return rates.select("round", F.col("fraction_kept").alias("yield"), rate(report and report.match_rate_5p).alias("match_rate_5p"), rate(report and report.match_rate_3p).alias("match_rate_3p"))


def length_distribution(counts: DataFrame) -> DataFrame:
    """Plot data: read-weighted share of every observed length in every round, 0 where a round lacks it."""
    per = counts.filter("reads > 0").groupBy("round", F.length("sequence").alias("length")).agg(F.sum("reads").alias("n"))
    shares = per.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("round")))
    grid = per.select("round").distinct().crossJoin(F.broadcast(per.select("length").distinct()))
    return grid.join(shares, ["round", "length"], "left").select("round", "length", F.coalesce("fraction", F.lit(0.0)).alias("fraction"))


def diversity(metrics: DataFrame) -> DataFrame:
    """Plot data: distinct sequences, entropy and coverage of the 100 most abundant."""
    return metrics.select("round", "n_unique", "shannon_entropy_bits", "top_100_coverage")
