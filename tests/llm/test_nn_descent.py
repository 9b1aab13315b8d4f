import pickle

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import nn_descent
from readloom.llm.nn_descent import nearest
from readloom.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.01"


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF1}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got = {}
    for r in QUERIES["op8_nn_descent"](spark, SF1).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        best = sorted((i for i in vectors if i != q), key=lambda i: (-(vectors[q] @ vectors[i]), i))[:20]
        hits += len(set(best) & {r.vec_id for r in found})
    assert hits >= 0.9 * 20 * len(got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0]), (100, [0.0, 1.0]), (101, [nan, 1.0]), (102, [inf, 1.0]), (103, None), (104, [0.0, 0.0]), (105, [1.0, None]), (None, [1.0, 0.0]), (106, []), (107, [2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=5, rounds=1, steps=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 20, 40, 100]
    assert sorted(got[0]) == [(1, 107, 2.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, 4, 1.0)]
    assert sorted(got[20])[1:] == [(2, 0, 1.0), (3, 1, 1.0), (4, 2, 1.0), (5, 3, 1.0)]
    assert [x[1] for x in sorted(got[100])] == [0, 1, 2, 3, 4]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0, rounds=1, steps=1).collect() == []


def found_share(spark, vectors, every, **options):
    """Share of the 10 true nearest that are found, for every ``every``-th vector."""
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % every == 0, k=10, **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    g = vectors[::every] @ vectors.T
    g[np.arange(len(g)), np.arange(0, len(vectors), every)] = -np.inf
    best = np.argpartition(-g, 10, axis=1)[:, :10]
    return np.mean([len(got.get(q * every, set()) & set(b.tolist())) / 10 for q, b in enumerate(best)])


def test_the_graph_finds_neighbours_that_random_links_do_not(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(20_000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    few = {"steps": 2, "expand": 8}
    assert found_share(spark, vectors, 100, rounds=0, **few) < 0.3
    assert found_share(spark, vectors * 1e7, 100, **few) >= 0.9


def test_hubs_are_told_in_turns_and_lose_no_link():
    owner, other = np.arange(200), np.full(200, 777)
    fresh = np.ones(200, bool)
    sent = nn_descent._turn(owner, other, fresh, 1)
    assert sent.sum() == nn_descent.TOLD
    for seed in range(2, 30):
        fresh &= ~sent
        sent = nn_descent._turn(owner, other, fresh, seed)
        assert sent.sum() == nn_descent.TOLD and (sent & fresh).sum() == min(nn_descent.TOLD, fresh.sum())
    assert not fresh.any()


def test_every_new_link_of_a_pivot_is_joined():
    rng = np.random.default_rng(5)
    ids, vectors = np.arange(1, 121), rng.normal(size=(120, 16)).astype(np.float16)
    pushed = {"ids": ids, "vectors": vectors, "scale": np.ones(120, np.float32), "least": np.full(120, -np.inf, np.float32), "pivot": np.full(120, 999), "member": np.arange(120, dtype=np.int32), "fresh": np.ones(120, bool)}
    rows = [pickle.loads(body) for _, kind, body in nn_descent._join(1, 101)(0, [(nn_descent.PUSHED, pushed)]) if kind == nn_descent.PROPOSED]
    got = {}
    for m in rows:
        for a, b in zip(m["a"].tolist(), m["b"].tolist(), strict=True):
            got.setdefault(a, set()).add(b)
    g = vectors.astype(np.float32) @ vectors.astype(np.float32).T
    np.fill_diagonal(g, -np.inf)
    for k in range(120):
        assert got[k + 1] == set((np.argsort(-g[k], kind="stable")[: nn_descent.NEIGHBOURS] + 1).tolist())


def test_old_links_meet_new_ones_only():
    vectors = np.eye(4, dtype=np.float16) + np.float16(0.5)
    pushed = {"ids": np.arange(4), "vectors": vectors, "scale": np.ones(4, np.float32), "least": np.full(4, -np.inf, np.float32), "pivot": np.full(4, 9), "member": np.arange(4, dtype=np.int32), "fresh": np.array([False, False, True, False])}
    rows = [pickle.loads(body) for _, kind, body in nn_descent._join(1, 101)(0, [(nn_descent.PUSHED, pushed)])]
    assert sorted((a, b) for m in rows for a, b in zip(m["a"].tolist(), m["b"].tolist(), strict=True)) == [(0, 2), (1, 2), (2, 0), (2, 1), (2, 3), (3, 2)]
