import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import packing, topk, wordpiece
from readloom.llm.queries import QUERIES, tokenizer_path

SF1 = "/root/testdata/sf0.01"


def brute_top(rows, k, every):
    out = []
    for q, v in rows:
        if q % every == 0:
            best = sorted((-int(np.dot(v, w)), c) for c, w in rows if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in spark.read.parquet(f"{SF1}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op2_top_k"](spark, SF1).collect()))
    assert got == brute_top(rows, 5, 50)


def test_search_prunes_without_loss():
    rng = np.random.default_rng(1)
    for spread in (0.1, 3.0):
        c = (rng.normal(0, 40, (1500, 12)) * np.exp(rng.normal(0, spread, 1500))[:, None]).astype(np.int64)
        c[700:720] = c[3] + rng.integers(-1, 2, (20, 12))
        q, ids = c[::40], np.arange(1500)
        i, j, s = topk.search(q, ids[::40], c, ids, ids, 7)
        got = sorted(zip(ids[::40][i], j, s, strict=True))
        p = q @ c.T
        want = []
        for n in range(len(q)):
            order = [x for x in np.lexsort((ids, -p[n])) if x != ids[::40][n]][:7]
            want += [(ids[::40][n], x, p[n, x]) for x in order]
        assert got == sorted(want)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (5, []), (None, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [9.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(2 * [(0, 1, 7), (0, 2, 0), (0, 3, 1)])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    named = df.withColumnRenamed("score", "_row").withColumns({c: F.lit(1) for c in ("_v", "_id", "_shard", "rank")})
    assert sorted(map(str, topk.top_k(named, F.col("vec_id") % 50 == 0, k=3).collect())) == sorted(map(str, got))
    for far in (1e17, 1e12):
        with pytest.raises(Exception, match="too large"):
            topk.top_k(spark.createDataFrame([(0, [far, 1.0]), (1, [far, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()


def test_widths_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(5):
        n = rng.integers(1, 9, 7)
        lengths = np.sort(rng.choice(60, 7, replace=False)) + 1
        got = packing.optimal_widths(lengths, n, 3)
        pad = lambda widths: sum(c * (min(w for w in widths if w >= x) - x) for x, c in zip(lengths, n, strict=True))
        from itertools import combinations

        assert pad(got) == min(pad((*cut, lengths[-1])) for cut in combinations(lengths[:-1], 2))


def slow_widths(lengths, counts, buckets):
    """Least padding by the plain quadratic recurrence."""
    best = {0: 0}
    for _ in range(min(buckets, len(lengths))):
        best = {j: min(b + sum(counts[k] * (lengths[j - 1] - lengths[k]) for k in range(i, j)) for i, b in best.items() if i < j) for j in range(1, len(lengths) + 1)} | {0: 0}
    return best[len(lengths)]


def test_widths_of_many_lengths():
    rng = np.random.default_rng(12)
    for m, buckets in ((1, 4), (2, 8), (40, 4), (60, 8)):
        lengths, n = np.sort(rng.choice(5000, m, replace=False)) + 1, rng.integers(1, 50, m)
        got = packing.optimal_widths(lengths, n, buckets)
        assert set(got) <= set(lengths.tolist()) and got[-1] == lengths[-1] and len(got) <= buckets
        assert sum(int(c) * (min(w for w in got if w >= x) - int(x)) for x, c in zip(lengths, n, strict=True)) == slow_widths(lengths.tolist(), n.tolist(), buckets)
    lengths = np.unique(rng.integers(1, 3_000_000, 300_000))
    assert len(packing.optimal_widths(lengths, np.ones(len(lengths)), 8)) == 8


def test_packing_covers_every_row_within_budget(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    got = QUERIES["op3_packing"](spark, SF1).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    counted = {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](spark, SF1).collect()}
    batches, last = defaultdict(list), Counter()
    longest = defaultdict(int)
    for r in got:
        assert r.length == counted[r.doc_id] + 1 <= r.width
        longest[r.bucket, r.width] = max(longest[r.bucket, r.width], r.length)
        batches[r.bucket, r.batch].append(r)
        last[r.bucket] = max(last[r.bucket], r.batch)
    assert all(width == most for (_, width), most in longest.items()) and len(longest) == 8
    listed = {(r.bucket, r.batch): r for r in packing.batches(spark.createDataFrame(got)).collect()}
    assert all(list(listed[k].ids) == [r.doc_id for r in sorted(rows, key=lambda r: r.slot)] and listed[k].padding == sum(r.width - r.length for r in rows) for k, rows in batches.items())
    for (bucket, batch), rows in batches.items():
        fits = max(1, 65536 // rows[0].width)
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == fits or (batch == last[bucket] and len(rows) < fits)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "x " * 100_000), (3, "")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("n_tokens", "bucket", "_id", "_length", "_shard")})
    got = packing.pack_texts(df, wordpiece.build([b"a", b"b", b"x"], [b"y"]), buckets=2, budget=10).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 3), (1, 1), (1, 1), (2, 100_001), (3, 1)]
    assert {r.width for r in got} == {3, 100_001}
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == 5
    assert packing.pack(df.limit(0), F.length("text")).collect() == []


def greedy(word, initial, continuing):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        step = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not step:
            return 1
        n, at, pieces = n + 1, at + step, continuing
    return n


def test_counts_match_greedy_pieces(spark, sf):
    initial, continuing = map(set, wordpiece.byte_level_pieces(tokenizer_path("byte_bpe_50k.json")))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_token_counts"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[:60]:
        found = re.findall(rb"[^\x20\x09-\x0D]+", texts[r.doc_id].encode())
        assert r.n_words == len(found) and r.n_tokens == sum(greedy(w, initial, continuing) for w in found)


def test_counts_odd_rows(spark):
    counter = wordpiece.build([b"ab", b"a"], [b"b", b"ab"])
    long = "a" + "b" * 1_000_000
    rows = [(1, None), (1, ""), (2, " \t\n"), (None, "ab ab"), (3, "ab abb ba"), (3, "ab abb ba"), (4, long), (5, long + "a"), (6, "ab " * 200_000)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens int, _text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in wordpiece.count_tokens(df, counter).collect())
    assert got == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 3, 4), (3, 3, 4), (4, 1, 1_000_000), (5, 1, 1), (6, 200_000, 200_000)]
    assert wordpiece.count_tokens(df.limit(0), counter).collect() == []


def test_long_words_count_like_short_ones():
    rng = np.random.default_rng(6)
    counter = wordpiece.build({b"a", b"ab", b"cab"}, {b"a", b"b", b"c", b"bca", b"aab", b"cc"})
    found = [bytes(rng.choice([97, 98, 99], n)) for n in (1, 5, 40, 511, 512, 513, 3000)]
    raw, ends = np.frombuffer(b"".join(found), np.uint8), np.cumsum([len(w) for w in found])
    each = [greedy(w, {b"a", b"ab", b"cab"}, {b"a", b"b", b"c", b"bca", b"aab", b"cc"}) for w in found]
    assert counter.count(raw, ends - [len(w) for w in found], ends).tolist() == each == [counter.count_one(w) for w in found]


def test_counts_of_any_vocabulary():
    rng = np.random.default_rng(4)
    for _ in range(40):
        make = lambda n: {bytes(rng.choice([97, 98, 99], rng.integers(1, 6))) for _ in range(n)}
        initial, continuing = make(8), make(12)
        counter = wordpiece.build(initial, continuing)
        found = [bytes(rng.choice([97, 98, 99], rng.integers(1, 12))) for _ in range(60)]
        raw = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum([len(w) for w in found])
        assert counter.count(raw, ends - [len(w) for w in found], ends).tolist() == [greedy(w, initial, continuing) for w in found]
