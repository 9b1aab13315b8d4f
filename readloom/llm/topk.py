"""Exact top-k by integer inner product with norm-bucketed pruning.

Candidates are dealt into shards and queries into blocks; a task meets one shard
with one block. It orders its candidates by length, cuts them into buckets of
similar length and goes from the longest down. The k-th score so far, divided by
both lengths, is a query's local cosine threshold in a bucket: above one, the
bucket and all shorter ones are skipped; if high, candidates must lie in the
feasible range of the query's largest coordinates; if low, only lengths prune.
What is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

SHARD_ROWS, BLOCK_ROWS, BUCKET_ROWS = 16_384, 2_048, 256
#: From this local cosine threshold on, coordinates prune; how many of them.
STEEP, FOCUS = 0.6, 5


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Valid vectors as floor(scale * x) in packed 64-bit integers, with a row number."""
    picked = df.select(df[id_col].cast("long").alias("_id"), df[vector_col].cast("array<double>").alias("_v")).filter(
        F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = np.floor(column.flatten().to_numpy() * scale)
            if (np.abs(flat) >= 2.0**62).any():
                raise OverflowError("A component is too large for 64-bit integers at this scale.")
            flat = flat.astype(np.int64)
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["_id", "_v"])

    return staged(picked.mapInArrow(run, "_id bigint, _v binary")).withColumn("_row", F.monotonically_increasing_id())


def _matrix(packed: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), dtype=np.int64)
    for k, p in enumerate(packed):
        v = np.frombuffer(p, np.int64)
        out[k, : len(v)] = v
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point only where every partial sum is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**52:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("A score can be too large for a 64-bit integer at this scale.")
    return q @ c.T


def search(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best among the candidates, ties to smaller ids."""
    lengths = np.sqrt((c.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    q_len = np.maximum(np.sqrt((q.astype(float) ** 2).sum(axis=1)), 1e-12)
    unit_q = q / q_len[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    theta = np.full(len(q), -np.inf)
    best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))
    alive = np.arange(len(q))
    for a in range(0, len(order), BUCKET_ROWS):
        own = order[a : a + BUCKET_ROWS]
        top = lengths[own[0]]
        local = np.where(top > 0, theta[alive] / np.maximum(q_len[alive] * top, 1e-12), np.where(theta[alive] > 0, np.inf, -np.inf))
        alive, local = alive[local <= 1 + 1e-9], local[local <= 1 + 1e-9]
        if not len(alive):
            break
        unit = c[own] / np.maximum(lengths[own], 1e-12)[:, None]
        found_q, found_c, found_s = [], [], []
        steep = local >= STEEP
        for i, t in zip(alive[steep], local[steep], strict=True):
            t = min(t, 1.0)
            f = focus[i]
            slack = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - unit_q[i, f] ** 2)) + 1e-7
            at = t * unit_q[i, f]
            # a candidate whose cosine reaches t lies within slack of t*q_f, or beyond it on q_f's side
            upper = np.where(unit_q[i, f] >= t, 1.0 + 1e-7, at + slack)
            lower = np.where(unit_q[i, f] <= -t, -1.0 - 1e-7, at - slack)
            ok = own[((unit[:, f] >= lower) & (unit[:, f] <= upper)).all(axis=1)]
            if len(ok):
                s = _products(q[i : i + 1], c[ok])[0]
                hit = s >= theta[i]
                found_q.append(np.full(int(hit.sum()), i))
                found_c.append(ok[hit])
                found_s.append(s[hit])
        flat = alive[~steep]
        if len(flat):
            need = theta[flat] / q_len[flat]
            reach = int((lengths[own] >= need.min() - 1e-9).sum()) if np.isfinite(need.min()) else len(own)
            s = _products(q[flat], c[own[:reach]])
            i, j = np.nonzero(s >= theta[flat][:, None])
            found_q.append(flat[i])
            found_c.append(own[j])
            found_s.append(s[i, j])
        if not found_q:
            continue
        fq, fc, fs = np.concatenate(found_q), np.concatenate(found_c), np.concatenate(found_s)
        other = q_row[fq] != c_row[fc]
        touched = np.zeros(len(q), dtype=bool)
        touched[fq] = True
        old = touched[best[0]]
        fq, fc, fs = np.concatenate([best[0][old], fq[other]]), np.concatenate([best[1][old], fc[other]]), np.concatenate([best[2][old], fs[other]])
        by = np.lexsort((c_id[fc], -fs, fq))
        fq, fc, fs = fq[by], fc[by], fs[by]
        start = np.searchsorted(fq, fq)
        keep = np.arange(len(fq)) - start < k
        fq, fc, fs = fq[keep], fc[keep], fs[keep]
        last = np.arange(len(fq)) - np.searchsorted(fq, fq) == k - 1
        theta[fq[last]] = fs[last]
        best = tuple(np.concatenate([b[~old], x]) for b, x in zip(best, (fq, fc, fs), strict=True))
    return best


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of every query row with all rows but its own.

    Returns query_id, rank, vec_id, score; ``is_query`` is a condition on the id
    column. Ties go to the smaller id. Null vectors, empty ones and those with a
    null or non-finite component take no part; shorter vectors count as padded
    with zeros. Rows that share an id are rows of their own. Null ids are never
    queries and rank behind equal scores. Only the two named columns are read.
    Components or scores beyond 64-bit integers are an error, not a wrong score.
    """
    vectors = quantised(df, scale, id_col, vector_col)
    queries = vectors.withColumnRenamed("_id", id_col).filter(is_query).withColumnRenamed(id_col, "_id")
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.length("_v")).alias("bytes")).first()
    n_queries = queries.count()
    dims = int(sizes["bytes"] or 8) // 8
    shards, blocks = max(6, -(-sizes["n"] // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    deal = F.xxhash64("_row")
    left = vectors.select(F.pmod(deal, F.lit(shards)).alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(False).alias("_asks"), "_row", "_id", "_v")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("_shard"), F.pmod(deal, F.lit(blocks)).cast("int").alias("_block"), F.lit(True).alias("_asks"), "_row", "_id", "_v")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["_asks"].to_numpy(dtype=bool)
        q, c = pdf[asks], pdf[~asks]
        c_id = c["_id"].fillna(np.iinfo(np.int64).max).to_numpy(dtype=np.int64)
        i, j, s = search(_matrix(q["_v"], dims), q["_row"].to_numpy(), _matrix(c["_v"], dims), c["_row"].to_numpy(), c_id, k)
        return pd.DataFrame({"_row": q["_row"].to_numpy()[i], "query_id": q["_id"].to_numpy()[i], "vec_id": c["_id"].to_numpy()[j], "score": s})

    found = left.unionByName(right).groupBy("_shard", "_block").applyInPandas(meet, "_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
