from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import byte_cnn, nbsvm
from readloom.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    out = QUERIES["op5_byte_cnn"](spark, SF1).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    assert len(out) == len(true)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) > 0.97 * len(held)


def test_quality_held_out_accuracy(spark):
    out = {r.doc_id: r for r in QUERIES["op6_nbsvm"](spark, SF1).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    held = [out[i] for i in labels if i in out and out[i].held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out.values())


def test_pooled_responses_are_convolutions():
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (5, byte_cnn.WINDOW)).astype(np.uint8)
    net = byte_cnn.fit(windows, np.array([0, 1, 0, 1, 1]), ["x", "y"], epochs=2)
    embedded = net.embed[windows]
    plain = []
    for w, shift in zip(net.filters, net.shift, strict=True):
        each = [[np.tensordot(e[k : k + len(w)], w, ([0, 1], [0, 1])) + shift for k in range(byte_cnn.WINDOW - len(w) + 1)] for e in embedded]
        plain.append(np.maximum(np.array(each).max(axis=1), 0))
    assert np.allclose(byte_cnn._pooled(windows, net.tables()), np.concatenate(plain, axis=1), atol=1e-4)
    text = bytes(rng.integers(97, 123, 700).astype(np.uint8))
    p = byte_cnn.probabilities(net, net.tables(), np.frombuffer(text, np.uint8), np.array([0, 700]))[0]
    total, weight = np.zeros(2), 0.0
    for a in range(0, 700, byte_cnn.WINDOW):
        piece = np.frombuffer(text[a : a + byte_cnn.WINDOW].ljust(byte_cnn.WINDOW, b"\0"), np.uint8)[None]
        z = byte_cnn._pooled(piece, net.tables()) @ net.dense + net.bias
        e, n = np.exp(z - z.max()), min(byte_cnn.WINDOW, 700 - a) + 1e-3
        total, weight = total + e[0] / e.sum() * n, weight + n
    assert np.allclose(p, total / weight, atol=1e-6)


def test_ratios_and_descent_match_plain_versions():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.choice(30, rng.integers(2, 9)) + 10 * int(k % 2)) for k in range(40)]
    y = np.where(np.arange(40) % 2 == 0, 1.0, -1.0)
    ratio, cost = rng.normal(0, 1, 64), np.full(40, 0.7)
    w, b = nbsvm._descend(rows, y, ratio, cost, 400, 1)
    x = np.zeros((40, 65))
    for i, r in enumerate(rows):
        x[i, r], x[i, 64] = ratio[r] / np.sqrt(len(r)), 1
    alpha = np.zeros(40)
    q = (x * y[:, None]) @ (x * y[:, None]).T
    for _ in range(60_000):  # projected gradient on the same dual
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    assert np.allclose((x * y[:, None]).T @ alpha, np.append(w / np.where(ratio == 0, 1, ratio), b), atol=2e-2)
    up, down = np.ones(nbsvm.BUCKETS), np.ones(nbsvm.BUCKETS)
    for r, s in zip(rows, y, strict=True):
        for k in r:
            (up if s > 0 else down)[k] += 1
    plain = np.log((up / up.sum()) / (down / down.sum()))
    model = nbsvm.fit(rows, (y > 0).astype(int), blend=0.0)
    used = model.weights != 0
    assert used.any() and np.ptp(model.weights[used] / plain[used]) < 1e-9


def test_odd_rows(spark):
    long = "the cat sat on the mat and then went home again " * 9000
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "12 34 !!", None, "x"), (4, long, "en", "x"), (4, long, "en", "x"), (None, "le chat est dans la maison avec nous", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = byte_cnn.train(df, F.lit(True))
    got = byte_cnn.identify(df, net).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0.0
    assert by[4].lang_pred in ("en", "fr")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (3, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    model = nbsvm.train(df, labels, F.lit(True))
    scored = nbsvm.classify(df, model).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    clash = df.withColumnRenamed("score", "_text").withColumns({c: F.lit(c) for c in ("_letter", "a.b", "__text", "predicted")})
    for out in (byte_cnn.identify(clash, net), nbsvm.classify(clash, model)):
        assert set(clash.columns) - {"predicted"} <= set(out.columns) and out.count() == 6
        assert {(r["_text"], r["_letter"], r["__text"]) for r in out.collect()} == {("x", "_letter", "__text")}
    assert {(r.doc_id, r.lang_pred, r.score) for r in byte_cnn.identify(clash, net).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in got}
    empty = df.limit(0)
    assert byte_cnn.identify(empty, byte_cnn.train(empty, F.lit(True))).count() == 0
    assert nbsvm.classify(empty, nbsvm.train(empty, labels, F.lit(True))).count() == 0
