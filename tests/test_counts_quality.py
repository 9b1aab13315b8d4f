import math

import numpy as np
import pytest

from readloom.operators import counting, quality
from readloom.plans.pipeline import reads_from
from readloom.sources.counts_io import format_of, read_counts, validated, write_counts


def test_counts_rank_and_rpm(spark):
    got = counting.count_sequences(reads_from(spark, [["TTTT", "ACGT", "GGGG", "ACGT", "ACGT"]])).orderBy("rank").collect()
    assert [(r.sequence, r.reads, r["rank"], r.rpm) for r in got] == [("ACGT", 3.0, 1, 600000.0), ("GGGG", 1.0, 2, 200000.0), ("TTTT", 1.0, 3, 200000.0)]
    cased = counting.count_sequences(reads_from(spark, [["acgt", "ACGT", "", "ACGU"]]))
    assert cased.count() == 4
    with pytest.raises(Exception, match="missing values"):
        counting.count_sequences(spark.createDataFrame([("r", None)], "round string, sequence string")).collect()
    assert sorted(["round_10", "round_2", "input", "b1"], key=counting.round_key) == ["b1", "round_2", "round_10", "input"]


def test_sparse_and_wide(spark):
    long = counting.experiment(counting.count_sequences(reads_from(spark, {"round_00": ["A", "A", "C"], "round_01": ["C"]})))
    assert sorted(map(tuple, long.collect())) == [("A", "round_00", 2), ("C", "round_00", 1), ("C", "round_01", 1)]
    assert sorted(map(tuple, counting.wide(long, ["round_00", "round_01"]).collect())) == [("A", 2, 0), ("C", 1, 1)]


def test_count_files(spark, tmp_path):
    counts = counting.count_sequences(reads_from(spark, [["ACGT", "ACGT", "", "GG"]])).drop("round")
    for kind in ("tsv", "csv", "parquet"):
        path = str(tmp_path / f"c.{kind}")
        write_counts(counts, path)
        assert sorted(map(tuple, read_counts(spark, path).collect())) == sorted(map(tuple, counts.collect()))
    assert open(tmp_path / "c.tsv").readline() == "sequence\treads\trank\trpm\n"
    assert format_of("X.TSV") == "tsv"
    with pytest.raises(ValueError, match="extension"):
        format_of("x.rds")
    for rows, said in (([("A", 1.0, 2, 1e6)], "consecutive"), ([("A", 1.0, 1, 5.0)], "agree"), ([("A", float("nan"), 1, 1e6)], "finite")):
        with pytest.raises(ValueError, match=said):
            validated(spark.createDataFrame(rows, "sequence string, reads double, rank int, rpm double"))


def counts_of(spark, rounds):
    return spark.createDataFrame([(r, s, n) for r, c in rounds.items() for s, n in c.items()], "round string, sequence string, reads long")


def test_metrics(spark):
    c = counts_of(spark, {"round_00": {"ACGT": 2, "GGGG": 1, "TTXT": 1}, "round_01": {"AAAA": 8}})
    rows = {r["round"]: r for r in quality.per_round(c, depth=4, k=2).collect()}
    a, b = rows["round_00"], rows["round_01"]
    assert (a.n_reads, a.n_unique, a.shannon_entropy_bits, a.singleton_fraction, a.top_1_coverage, a.top_100_coverage) == (4.0, 3, 1.5, 2 / 3, 0.5, 1.0)
    assert (b.shannon_entropy_bits, b.rarefied_unique, a.rarefied_unique, a.modal_sequence_length) == (0.0, 1, 3, 4.0)
    gc = np.array([0.5, 0.5, 1.0, 0.0])
    assert math.isclose(a.mean_gc, gc.mean()) and math.isclose(a.gc_sd, gc.std()) and a.nonstandard_alphabet_fraction == 0.25
    assert math.isclose(b.top_kmer_fraction, 1.0) and math.isclose(a.top_kmer_fraction, 3 / 12)


def test_rarefaction(spark):
    c = counts_of(spark, {"round_00": {f"S{k}": k + 1 for k in range(30)}})
    one, two = (sorted(map(tuple, quality.rarefied(c, 50, 7).collect())) for _ in range(2))
    assert one == two and sum(r[2] for r in one) == 50 and all(r[2] <= int(r[1][1:]) + 1 for r in one)
    assert sorted(map(tuple, quality.rarefied(c, 10_000, 7).collect())) == sorted(map(tuple, c.collect()))
    drawn = quality.hypergeometric([5, 1, 9], 7)
    assert drawn.sum() == 7 and (drawn <= [5, 1, 9]).all()
    assert quality.rarefied_unique(c.limit(0))[1] is None


def test_hot_sequences_are_rarefied_without_being_expanded(spark):
    c = counts_of(spark, {"round_00": {"HOT": 3_000_000_000, **{f"S{k}": 1 + k % 9 for k in range(500)}, "WARM": 1_000_000_000}})
    got = {r.sequence: r.reads for r in quality.rarefied(c, 10_000, 3).collect()}
    assert sum(got.values()) == 10_000 and abs(got["HOT"] - 7500) < 300
    even = counts_of(spark, {"round_00": {f"S{k}": 200 + 200 * (k % 2) for k in range(200)}})
    drawn = [r.reads for r in quality.rarefied(even, 30_000, 5).collect()]
    assert sum(drawn) == 30_000 and max(drawn) <= 400
    many = sum(r.reads for r in quality.rarefied(even, 30_000, 5).collect() if int(r.sequence[1:]) % 2)
    assert abs(many - 20_000) < 400


def test_ranks_over_many_ranges(spark):
    rows = [("a", f"s{k:05d}", 1 + k % 3) for k in range(6000)] + [("b", "x" * 70 + str(k), 1) for k in range(300)] + [(None, "n", 2), ("c", "", 5)]
    got = counting.with_ranks(spark.createDataFrame(rows, "round string, sequence string, reads long")).collect()
    want, totals = {}, {}
    for name in ("a", "b", None, "c"):
        own = sorted((-n, s) for r, s, n in rows if r == name)
        totals[name] = -sum(n for n, _ in own)
        want |= {(name, s): k + 1 for k, (_, s) in enumerate(own)}
    assert {(r["round"], r.sequence): r["rank"] for r in got} == want and len(got) == len(rows)
    assert all(math.isclose(r.rpm, r.reads / totals[r["round"]] * 1e6) for r in got)


def test_top_rows_in_two_steps(spark):
    df = spark.range(20_000).selectExpr("id % 2 as g", "id * 7919 % 20011 as v", "id")
    got = counting.top_rows(df, ["g"], [df["v"].desc()], df["id"], 2500).collect()
    for g in (0, 1):
        best = sorted((k * 7919 % 20011 for k in range(g, 20_000, 2)), reverse=True)[:2500]
        assert sorted((r["rank"], r.v) for r in got if r.g == g) == list(enumerate(best, 1))


def test_panels(spark):
    c = counts_of(spark, {"round_00": {"AAAA": 3, "CC": 1}, "round_01": {"CC": 2}})
    found = quality.qc(c, low_total_reads=0)
    bare, grid = quality.panels(found)
    assert grid == (2, 3) and [(p.name, p.available, p.message is None) for p in bare] == [("retention", True, False), ("primer_match", False, False), ("length", False, False), ("diversity", True, True)]
    rates = spark.createDataFrame([("round_00", 8, 4, 0.5), ("round_01", 4, 2, 0.5)], "round string, input_reads long, output_reads long, fraction_kept double")
    full, _ = quality.panels(found, c, rates)
    assert all(p.available and p.message is None for p in full) and quality.provenance(rates, ["round_00", "round_07"]) is None
    assert [quality.layout(n) for n in (1, 2, 3, 4, 5, 6)] == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 3)]
    with pytest.raises(ValueError, match="which"):
        quality.panels(found, which=("other",))


def test_similarity_and_flags(spark):
    c = counts_of(spark, {"round_00": {"AAAAAAAA": 5}, "round_01": {"CCCCCCCCA": 5}, "round_02": {"AAAAAAAA": 4, "AAAAAAAC": 1}})
    sim = {(r.from_round, r.to_round): r.jaccard_distance for r in quality.round_similarity(c, ["round_00", "round_01", "round_02"]).collect()}
    assert sim["round_00", "round_01"] == 1.0 and math.isclose(sim["round_00", "round_02"], 0.5)
    got = quality.qc(c, low_total_reads=6)
    assert [f[0] for f in got.flags] == ["low_total_reads", "unexpected_rarefied_diversity_increase", "round_kmer_nonmonotonic"]
    assert got.flags_frame(spark).count() == 3
    empty = quality.qc(c.limit(0), ["round_00", "round_01"])
    assert [r.n_reads for r in empty.per_round.collect()] == [0.0, 0.0] and empty.round_similarity.first().jaccard_distance == 0.0
    with pytest.raises(ValueError, match="kmer_size"):
        quality.qc(c, kmer_size=0)


def test_plot_data(spark):
    c = counts_of(spark, {"round_00": {"AAAA": 3, "CC": 1}, "round_01": {"CC": 2}})
    got = {(r["round"], r["length"]): r.fraction for r in quality.length_distribution(c).collect()}
    assert got == {("round_00", 4): 0.75, ("round_00", 2): 0.25, ("round_01", 4): 0.0, ("round_01", 2): 1.0}
    assert quality.diversity(quality.per_round(c)).count() == 2
