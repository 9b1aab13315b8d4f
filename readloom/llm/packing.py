"""Optimal length buckets and token-budget batches.

Dynamic programming over the global histogram of token counts chooses the bucket
widths that minimise padding; inside each bucket, rows are numbered without a sort
of the whole bucket (hashed shards, then offsets from the shards' counts) and cut
into batches of as many rows as the token budget allows at that width.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged
from .wordpiece import Counter, count_tokens

#: Rows of one numbering shard.
SHARD_ROWS = 50_000


def _layer(best: np.ndarray, lengths: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: least padding of the first j lengths, and where the last bucket begins.

    A longer prefix never begins its last bucket earlier, so each half of the
    prefixes searches one side of its middle's choice: m log m costs, level by level.
    """
    m = len(lengths)
    new, choice = np.full(m + 1, _FAR), np.zeros(m + 1, dtype=np.int64)
    new[0] = 0
    low, high, left, right = (np.array([x]) for x in (1, m, 0, m - 1))
    while len(low):
        middle = (low + high) // 2
        size = np.minimum(right, middle - 1) - left + 1
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(begin - left, size)
        j = np.repeat(middle, size)
        cost = best[at] + lengths[j - 1] * (count[j] - count[at]) - (total[j] - total[at])
        least = np.minimum.reduceat(cost, begin)
        first = np.minimum.reduceat(np.where(cost == np.repeat(least, size), at, m), begin)
        new[middle], choice[middle] = least, first
        low, high, left, right = np.concatenate([low, middle + 1]), np.concatenate([middle - 1, high]), np.concatenate([left, first]), np.concatenate([first, right])
        on = low <= high
        low, high, left, right = low[on], high[on], left[on], right[on]
    return new, choice


_FAR = np.int64(1 << 60)


def optimal_widths(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Widths of at most ``buckets`` buckets that minimise padding, for ascending distinct ``lengths``; each is a length that occurs."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    m = len(lengths)
    if not m:
        return []
    count, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best, choice = np.full(m + 1, _FAR), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        best, at = _layer(best, lengths, count, total)
        choice.append(at)
    widths, j = [], m
    for at in reversed(choice):
        if j:
            widths.append(int(lengths[j - 1]))
            j = at[j]
    return widths[::-1]


def pack(df: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """Every row's bucket and batch: id, length, bucket, width, batch, slot.

    ``batch`` counts from 0 inside its bucket and ``slot`` inside its batch. All
    batches of a bucket but its last hold ``max(1, budget // width)`` rows, so a
    text longer than the budget stands alone, whole. A null length counts as 0.
    Rows with the same or a null id each take a place of their own; an empty table
    has no batch. A width is the longest length of its bucket.

    The driver holds the histogram: one entry for each length that occurs, at most
    as many as the longest length or the root of twice all tokens.
    """
    rows = staged(df.select(df[id_col].alias("_id"), F.coalesce(length.cast("bigint"), F.lit(0)).alias("_length")))
    hist = rows.groupBy("_length").agg(F.count("*").alias("n")).orderBy("_length").toArrow()
    lengths, counts = (hist.column(c).to_numpy() for c in ("_length", "n"))
    widths = optimal_widths(lengths, counts, buckets)
    shards = max(1, int(counts.sum()) // SHARD_ROWS)
    bucket = F.lit(len(widths) - 1)
    width = F.lit(widths[-1] if widths else 0)
    for k in range(len(widths) - 2, -1, -1):
        bucket = F.when(F.col("_length") <= widths[k], k).otherwise(bucket)
        width = F.when(F.col("_length") <= widths[k], widths[k]).otherwise(width)
    dealt = rows.select(
        "_id", "_length", bucket.alias("_bucket"), width.cast("bigint").alias("_width"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("_shard")
    )
    before = Window.partitionBy("_bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_bucket", "_shard").agg(F.count("*").alias("n")).select("_bucket", "_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    numbered = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_bucket", "_shard").orderBy("_length", "_id"))).join(offsets, ["_bucket", "_shard"])
    place = F.col("_offset") + F.col("_nth") - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("_width"), F.lit(1)))).cast("bigint")
    return numbered.select(
        F.col("_id").alias(id_col),
        F.col("_length").alias("length"),
        F.col("_bucket").cast("int").alias("bucket"),
        F.col("_width").alias("width"),
        F.floor(place / fits).cast("bigint").alias("batch"),
        (place % fits).cast("bigint").alias("slot"),
    )


def pack_texts(df: DataFrame, counter: Counter, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8, budget: int = 65_536) -> DataFrame:
    """pack() by the tokens of every whole text and one end token; a null text has only the end."""
    return pack(count_tokens(df, counter, id_col, text_col), F.col("n_tokens") + 1, id_col, buckets, budget)


def batches(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each batch: bucket, batch, width, ids in the order of their slots, tokens and padding.

    A batch holds no more rows than its budget has tokens, so its list is bounded.
    """
    listed = packed.groupBy("bucket", "batch").agg(F.max("width").alias("width"), F.sort_array(F.collect_list(F.struct("slot", id_col))).alias("_of"), F.sum("length").alias("tokens"))
    return listed.select("bucket", "batch", "width", F.col(f"_of.{id_col}").alias("ids"), "tokens", (F.size("_of") * F.col("width") - F.col("tokens")).alias("padding"))
