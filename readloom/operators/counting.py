"""Unique-sequence counts, ranks and the multi-round table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = "0.1.0"


def require_sequences(reads: DataFrame) -> DataFrame:
    """Fail at run time if a sequence is null."""
    checked = F.when(F.col("sequence").isNull(), F.raise_error(F.lit("`sequence` must not contain missing values."))).otherwise(F.col("sequence"))
    return reads.withColumn("sequence", checked)


def count_sequences(reads: DataFrame) -> DataFrame:
    """round, sequence, reads, rank, rpm: exact counts, ranked 1..n in each round, equal counts by sequence.

    Sequences are counted as they are: case and alphabet matter, and an empty
    insert is a sequence. One shuffle counts, with partial sums before it; the
    ranking then works on distinct sequences only, range by range.
    """
    counts = require_sequences(reads).groupBy("round", "sequence").agg(F.count("*").alias("reads"))
    return with_ranks(counts)


#: Ranges that a round's sequences are ranked in, hash classes that their bounds are drawn from, and characters of a bound.
RANGES, DRAWN, BOUND = 128, 2048, 64


def with_ranks(counts: DataFrame) -> DataFrame:
    """Ranks and reads per million of (round, sequence, reads), with no task that sorts a round.

    One sequence of each hash class is drawn, which bounds the ranges whatever the
    round's size; ranges are sorted apart and their sizes added up. Bounds come
    from the rows alone, so a part that is computed again falls into the same ones.
    """
    row = F.struct((-F.col("reads")).cast("double").alias("less"), F.substring("sequence", 1, BOUND).alias("head"))
    drawn = counts.groupBy("round", F.pmod(F.xxhash64("sequence"), F.lit(DRAWN)).alias("_class")).agg(F.min(F.struct(F.xxhash64(F.lit(1), "sequence").alias("lot"), row.alias("row")))["row"].alias("row"))
    listed = drawn.groupBy("round").agg(F.sort_array(F.collect_list("row")).alias("_all"))
    step = F.ceil(F.size("_all") / RANGES).cast("int")
    bounds = listed.select(F.col("round").alias("_of"), F.transform(F.sequence(F.lit(0), F.size("_all") - 1, step), lambda i: F.get("_all", i)).alias("_bounds"))
    ranged = counts.join(F.broadcast(bounds), F.col("round").eqNullSafe(F.col("_of"))).select("round", "sequence", "reads", F.size(F.filter("_bounds", lambda b: b <= row)).alias("_range"))
    sizes = ranged.groupBy("round", "_range").agg(F.count("*").alias("n"), F.sum("reads").alias("s"))
    by_round = Window.partitionBy("round")
    before = by_round.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("round").alias("_round"), F.col("_range").alias("_nth"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("s").over(by_round).alias("_total"))
    place = F.row_number().over(Window.partitionBy("round", "_range").orderBy(F.desc("reads"), F.asc("sequence")))
    placed = ranged.withColumn("_place", place).join(F.broadcast(sizes), F.col("round").eqNullSafe(F.col("_round")) & (F.col("_range") == F.col("_nth")))
    return placed.select("round", "sequence", F.col("reads").cast("double").alias("reads"), (F.col("_before") + F.col("_place")).cast("int").alias("rank"), (F.col("reads") / F.col("_total") * 1e6).alias("rpm"))


#: Parts of a group that the first step of top_rows() ranks apart.
PARTS = 64


def top_rows(df: DataFrame, by: list[str], order: list[Column], key: Column, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank: of each part of a group first, so no task sorts a whole one.

    A small ``n`` needs no parts: Spark limits groups before the shuffle by itself.
    """
    if n > 1000:
        part = Window.partitionBy(*by, "_part").orderBy(*order)
        df = df.withColumn("_part", F.pmod(key, F.lit(PARTS))).withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= n).drop("_part", rank)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def experiment(counts: DataFrame) -> DataFrame:
    """The sparse table of all rounds in long form: sequence, round, reads."""
    return counts.filter(F.col("reads") > 0).select("sequence", "round", F.col("reads").cast("bigint").alias("reads"))


def wide(long: DataFrame, rounds: list[str]) -> DataFrame:
    """One row for each distinct sequence and one column for each round, absent ones 0."""
    return long.groupBy("sequence").pivot("round", rounds).agg(F.sum("reads")).fillna(0, subset=rounds)


def round_names(df: DataFrame, column: str = "round") -> list[str]:
    """Names of the rounds in their order; rounds are few by nature."""
    names = [r[0] for r in df.select(column).distinct().collect()]
    return sorted(names, key=round_key)


def round_key(name: str) -> tuple:
    digits = len(name) - len(name.rstrip("0123456789"))
    return (not digits, int(name[len(name) - digits :]) if digits else 0, name)
