import corpus_pipeline
from pyspark.sql import functions as F
from test_near_dup import brute

from readloom.llm.queries import byte_level_counter
from readloom.llm.wordpiece import count_tokens

SF1 = "/root/testdata/sf0.01"


def test_stages_filter_and_pack(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF1).cache()
        assert docs.columns == names
        after = {r.doc_id for r in docs.collect()}
        assert after <= set(before) and docs.count() == len(after)
        if "quality" in name:
            assert sum(i in after for i, q in labels.items() if q == 1) > 0.97 * sum(q == 1 for q in labels.values())
            assert sum(i in after for i, q in labels.items() if q == 0) < 0.1 * sum(q == 0 for q in labels.values())
        if "near" in name:
            assert after == {i for i, _, _, kept in brute(before, 5, 80) if kept}
        sizes.append(len(after))
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF1).collect()
    lengths = {r.doc_id: r.n_tokens + 1 for r in count_tokens(docs, byte_level_counter()).collect()}
    assert {r.doc_id: r.length for r in packed} == lengths
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed)


def test_odd_rows(spark):
    long = "the cat sat on the mat and then it went home again " * 3000
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 9), (3, long, "en", "s", 9), (None, "the cat sat on the mat by the door of the house", "en", "s", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from readloom.llm.near_dup import without_duplicates

    left = without_duplicates(docs)
    assert sorted((r.doc_id or -1, len(r.text or "")) for r in left.collect()) == sorted([(1, 0), (2, 0), (3, len(long)), (-1, 47), (-1, 0)])
    real = spark.read.parquet(f"{SF1}/documents.parquet")
    odd = spark.createDataFrame([(10**9 + (i or 0) if i else None, *r) for i, *r in rows], docs.schema)
    clash = {c: F.lit(c) for c in ("_text", "_letter", "_row", "_twin", "score", "predicted", "lang_pred", "a.b")}
    mixed, kept = real.unionByName(odd).withColumns(clash), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, mixed, SF1)
        if name != "packing":
            assert out.columns == mixed.columns and all(r[c] == c for r in out.limit(5).collect() for c in clash)
        else:
            assert out.filter("doc_id is null").count() == 2
        kept[name] = sorted(r.doc_id for r in out.filter(F.col("doc_id") > 10**9).collect())
    assert kept["language ID"] in ([], [10**9 + 3] * 2) and kept["MinHash near-dedup"] == [10**9 + k for k in (1, 2, 3)]
    assert kept["packing"] == [10**9 + k for k in (1, 2, 3, 3)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF1).count() == 0
