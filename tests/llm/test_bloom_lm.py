import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import bloom_lm as B
from readloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_base_scores_match_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter()
    for i, t in docs.items():
        if crc32(str(i).encode()) % 5 != 1:
            counts.update([*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    name = next(k for k in QUERIES if k.startswith("op10_"))
    out = QUERIES[name](spark, sf).collect()
    assert len(out) == len(docs)
    bigrams, history = Counter(), Counter()
    for i, t in docs.items():
        if crc32(str(i).encode()) % 5 != 1:
            seq = ["", *WORD.findall(lower(t)), None]
            bigrams.update(zip(seq[:-1], seq[1:], strict=True))
            history.update(seq[:-1])

    def stands_for(c):
        return B.VALUES[B.level(np.array([c]))[0]]

    def exact(text):
        seq, total = ["", *WORD.findall(lower(text)), None], 0.0
        for h, w in zip(seq[:-1], seq[1:], strict=True):
            single = (stands_for(counts[w]) + 0.5) / (n + 0.5 * (v + 1))
            pair, rest = stands_for(bigrams[h, w]), stands_for(history[h])
            total += math.log10((min(pair, rest) + 20 * single) / (rest + 20))
        return total

    gain, off, size = [], [], []
    for r in out:
        tokens = [*WORD.findall(lower(docs[r.doc_id])), None]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert r.train_tokens == n and r.n_tokens == len(tokens)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 1)
        off.append(abs(r.score - exact(docs[r.doc_id])))
        size.append(r.n_tokens)
        if r.held_out:
            gain.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gain) > 0.2
    # the filter takes the count of a pair or a history for higher now and then
    assert sum(off) < 0.005 * sum(size) and np.mean(np.array(off) < 0.5 + 0.005 * np.array(size)) > 0.9


def test_levels_survive_the_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    counts = rng.integers(1, 3000, 5000)
    shards = (keys >> np.uint64(60)).astype(int)
    pieces = {s: B.build_piece([(B.WORD, keys[shards == s], counts[shards == s])]).tobytes() for s in range(16)}
    found = B.Filter({s: len(p) // 8 for s, p in pieces.items()}, pieces.items(), 4)
    got = found.levels(keys, B.WORD)
    assert (got >= B.level(counts)).all() and (got == B.level(counts)).mean() > 0.98
    other = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (found.levels(other, B.WORD) > 0).mean() < 0.02


def test_nulls_repeats_clashes_and_slices(spark):
    rows = [(1, "a b a b", "x"), (1, "a b a b", "x"), (None, "a b", None), (2, None, None), (3, "", None), (4, "zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(1)
    whole = {(r.doc_id, r.n_tokens): r for r in B.score_texts(df, df).collect()}
    parts = B.score_texts(df, df, most_broadcast=64).collect()
    assert len(parts) == 6
    for r in parts:
        assert abs(r.score - whole[r.doc_id, r.n_tokens].score) < 1e-9
    assert B.score_texts(df.limit(0), df.limit(0)).collect() == []
    named = df.withColumnsRenamed({"score": "_row"}).withColumns({"_id": F.lit(1), "_text": F.lit("other")})
    assert sorted(map(str, B.score_texts(named, named).collect())) == sorted(map(str, B.score_texts(df, df).collect()))
    cold = B.score_texts(df, df.filter(F.lit(False))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in cold)


def test_rare_words_stay_in_a_sliced_filter(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(0, 400, 20)] + [(1000, "w1 w2 never w399"), (1001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole = {r.doc_id: r.score for r in B.score_texts(df, df).collect()}
    parts = {r.doc_id: r.score for r in B.score_texts(df, df, most_broadcast=256).collect()}
    assert whole.keys() == parts.keys() and all(abs(parts[i] - whole[i]) < 1e-9 for i in whole)


def test_a_pair_seen_once_counts(spark):
    rows = [(k, f"left{k} right{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "left7 right7"), (2, "left7 right8")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in B.score_texts(asked, df).collect()}
    assert got[1] > got[2] + 0.5


def test_look_ups_in_many_shards_and_salts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("_text"))
    rows = docs.select(*B.row_name(F.col("doc_id"), F.col("_text")), "_text")
    counts = B.staged(B.gather_counts(docs.select("_text"), 6))
    few, many = ({r._row: (r.base_score, r.n_known) for r in B.base_scores(rows, counts, 6, 10**6, 10**5, *most).collect()} for most in ((1 << 20, 24 << 20), (1000, 1000)))
    assert few.keys() == many.keys() and len(few) == docs.distinct().count()
    assert all(abs(few[k][0] - many[k][0]) < 1e-6 * abs(few[k][0]) and few[k][1] == many[k][1] for k in few)


def test_a_shard_is_never_held_with_all_its_flushes(spark, monkeypatch):
    rows = [(" ".join(f"hot w{(7 * i + k) % 60}" for k in range(30)),) for i in range(400)]
    texts = spark.createDataFrame(rows, "_text string").repartition(4)
    for name, value in {"CHUNK": 1000, "FLUSH": 50, "MERGE_KEYS": 100}.items():
        monkeypatch.setattr(B, name, value, raising=False)
    runs = B._runs

    def bounded(keys, counts):
        assert len(keys) < 400, f"{len(keys)} keys at once"  # no shard has that many distinct ones, but its flushes do together
        return runs(keys, counts)

    monkeypatch.setattr(B, "_runs", bounded)
    got = B.gather_counts(texts, 4).collect()
    expected = Counter(w for (t,) in rows for w in [*t.split(), None])
    assert len({(r.kind, r.shard) for r in got}) == len(got)
    assert sorted(n for r in got if r.kind == B.WORD for n in np.frombuffer(r.counts, np.uint64)) == sorted(expected.values())
    assert sum(r.total for r in got if r.kind == B.PAIR) == sum(expected.values())
    for r in got:
        keys = np.frombuffer(r["keys"], np.uint64)
        assert len(keys) == r.types and (keys[1:] > keys[:-1]).all()
        assert r.total == np.frombuffer(r.counts, np.uint64).sum() and set((keys >> np.uint64(60)).tolist()) == {r.shard}
