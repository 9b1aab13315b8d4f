import warnings

import pytest

from readloom.functions.sequences import reverse_complement_text as rc
from readloom.operators.demultiplex import checked_barcodes, demultiplex
from readloom.operators.extraction import best_matches, cut_reads, extract, low_yields
from readloom.plans.pipeline import reads_from
from readloom.plans.report import LibraryReport
from readloom.sources.fastq import with_pairs

P5, P3 = "GGTAATACGACTCACTATAGGG", "CCATGCATGCATGCATGCAT"


def report(mode, p5=P5, p3=P3, **more):
    return LibraryReport(primer_5p=p5, primer_3p=p3, extraction_mode=mode, full_insert_recovered=mode.startswith("BOTH"), status="HIGH", confidence=0.9, required_action="NONE", **more)


def inserts(spark, pools, rep, mates=None, mate="R1", **more):
    got = extract(reads_from(spark, pools, mates), rep, **more)
    return [r.sequence for r in got.inserts.filter(f"mate = '{mate}'").orderBy("round", "read_index").collect()], got


def test_mismatches_and_missing_primers(spark):
    one = "A" + P5[1:] + "TTTT" + P3
    p = list(P5)
    p[0], p[7] = "A", "T"
    two = "".join(p)
    p[11] = "A"
    reads = [P5 + "ACGTACGT" + P3, one, two + "CCCC" + P3, "".join(p) + "AAAA" + P3, P5 + "GGGGGGGG"]
    found, got = inserts(spark, {"round_00": reads}, report("BOTH_PRIMERS_SINGLE_READ"))
    assert found == ["ACGTACGT", "TTTT", "CCCC"]
    row = got.per_round.first()
    assert (row.input_reads, row.output_reads, row.fraction_kept) == (5, 3, 0.6)


def test_indels(spark):
    a, b = "ACGTCAGTACGATCGTACGA", "TGCATCGACTGACGTAGCTA"
    reads = ["NN" + a[:6] + a[7:] + "AAAA" + b + "NN", "GG" + a[:7] + "T" + a[7:] + "CCCC" + b + "TT", "TT" + a + "GGGG" + b[:8] + b[9:] + "AA", "CC" + a + "TTTT" + b[:9] + "A" + b[9:] + "GG"]
    assert inserts(spark, {"round_00": reads}, report("BOTH_PRIMERS_SINGLE_READ", a, b))[0] == ["AAAA", "CCCC", "GGGG", "TTTT"]


def test_alphabet_case_sides_and_strand(spark):
    a, b = "ACGUUAGUACGAUCGUACGA", "UGCAUCGACUGACGUAGCUA"
    read = a.replace("U", "T") + "ACGU" + b.replace("U", "T")
    assert inserts(spark, {"round_00": [read, read.lower()]}, report("BOTH_PRIMERS_SINGLE_READ", a, b))[0] == ["ACGU", "acgu"]
    assert inserts(spark, {"round_00": [P5 + "ACGT", "CCCC", P5]}, report("FIVE_PRIME_ONLY", p3=None))[0] == ["ACGT", ""]
    assert inserts(spark, {"round_00": ["ACGT" + P3, "CCCC"]}, report("THREE_PRIME_ONLY", p5=None))[0] == ["ACGT"]
    back = rc(P3) + "AACC" + rc(P5)
    assert inserts(spark, {"round_00": [back]}, report("BOTH_PRIMERS_SINGLE_READ", orientation="REVERSE"))[0] == ["GGTT"]
    found, got = inserts(spark, {"round_00": [back, P5 + "AA" + P3]}, report("BOTH_PRIMERS_SINGLE_READ", orientation="MIXED"))
    assert found == ["AA"] and tuple(got.strands.first())[1:] == (1, 1, 0)


def two_files(spark, streams):
    """Reads of one round from two pairs of files."""
    rows, file_index = [], 0
    for mate, files in streams.items():
        for reads in files:
            rows += [("round_00", mate, file_index, k, s) for k, s in enumerate(reads)]
            file_index += 1
    return spark.createDataFrame(rows, "round string, mate string, file_index int, read_index bigint, sequence string")


def test_pairs_need_both_primers(spark):
    r1 = [P5 + "AAA", P5 + "CCC", "TTT"]
    r2 = [rc(P3) + "GGG", "GGG", rc(P3) + "TTT"]
    rep = report("PAIRED_END_SPLIT_PRIMERS")
    assert inserts(spark, {"round_00": r1}, rep, {"round_00": r2})[0] == ["AAA"]
    assert inserts(spark, {"round_00": r1}, rep, {"round_00": r2}, mate="R2")[0] == ["GGG"]
    two = with_pairs(two_files(spark, {"R1": [r1, r1[::-1]], "R2": [r2, r2[::-1]]}))
    kept = extract(two, rep).inserts
    assert sorted((r.file_index, r.mate, r.sequence) for r in kept.collect()) == [(0, "R1", "AAA"), (1, "R1", "AAA"), (2, "R2", "GGG"), (3, "R2", "GGG")]
    with pytest.raises(ValueError, match="pair_index"):
        extract(two.drop("pair_index"), rep)
    with pytest.raises(ValueError, match="Mates differ"):
        extract(reads_from(spark, {"round_00": r1}, {"round_00": r2[:2]}), rep)
    with pytest.raises(ValueError, match="first mates only"):
        extract(reads_from(spark, {"round_00": r1}), rep)


def test_refusal_and_overrides(spark):
    reads = reads_from(spark, {"round_00": [P5 + "ACGT" + P3]})
    with pytest.raises(ValueError, match="Nothing can be extracted"):
        extract(reads, LibraryReport())
    assert [r.sequence for r in extract(reads, LibraryReport(), primer_5p=P5, primer_3p=P3).inserts.collect()] == ["ACGT"]


def test_low_yields(spark):
    table = spark.createDataFrame([("round_00", 100, 90, 0.9), ("round_01", 100, 44, 0.44), ("round_02", 10, 6, 0.6), ("round_03", 0, 0, None)], "round string, input_reads int, output_reads int, fraction_kept double")
    assert [r.message for r in low_yields(table).collect()] == ["round_01: kept 44 of 100 reads (44.0%; best round 90.0%)"]
    got = extract(reads_from(spark, {"round_00": [P5 + "A"] * 3, "round_01": ["CCCC"] * 3}), report("FIVE_PRIME_ONLY", p3=None))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got.warn()
    assert any("1 round(s) lost most reads" in str(w.message) for w in said)


def slow_best(read, primer):
    k, best = len(primer) // 10, None
    for i in range(len(read)):
        for j in range(i + 1, min(len(read), i + len(primer) + k) + 1):
            row = list(range(j - i + 1))
            for p in primer:
                new = [row[0] + 1]
                for c, t in enumerate(read[i:j]):
                    new.append(min(row[c] + (p != t), row[c + 1] + 1, new[c] + 1))
                row = new
            if row[-1] <= k:
                key = (-(min(len(primer), j - i) - 2 * row[-1]), row[-1], i, -j)
                best = min(best or (key, i, j), (key, i, j))
    return best[1:] if best else (-1, -1)


def test_alignment_matches_brute_force():
    import random

    rng = random.Random(6)
    primer = "ACGTTGCAACGT"
    reads = []
    for _ in range(60):
        p = list(primer)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(p))
            p[at : at + 1] = rng.choice([[], ["A"], ["C", "G"]])
        reads.append("".join(rng.choices("ACGT", k=rng.randrange(8))) + "".join(p) + "".join(rng.choices("ACGT", k=rng.randrange(8))))
    at, to = best_matches([*reads, ""], primer)
    assert [(a, b) for a, b in zip(at.tolist(), to.tolist(), strict=True)] == [slow_best(r, primer) for r in [*reads, ""]]
    assert cut_reads(["", "ACGT"], "FIVE_PRIME_ONLY", primer, None) == [None, None]


def test_demultiplex(spark):
    got = demultiplex(reads_from(spark, {"pool": ["AAAAACCCCC", "AAAATGGGGG", "TTTTTACGTA", "GGGGGAAAAA", "AAA"]}), {"AAAAA": 0, "TTTTT": 1})
    assert [(r.round, r.sequence) for r in got.reads.orderBy("read_index").collect()] == [("round_00", "CCCCC"), ("round_00", "GGGGG"), ("round_01", "ACGTA")]
    assert [r.sequence for r in got.unassigned.orderBy("read_index").collect()] == ["GGGGGAAAAA", "AAA"]
    assert [(r.round, r.assigned_reads, r.assigned_fraction) for r in got.summary.orderBy("round").collect()] == [("round_00", 2, 0.4), ("round_01", 1, 0.2)]
    paired = demultiplex(reads_from(spark, {"p": ["AAAAACCCCC", "TTTTTGGGGG", "CCCCCAAAAA"]}, {"p": ["R2_A", "R2_B", "R2_C"]}), {"AAAAA": 0, "UUUUU": 1})
    assert [(r.round, r.sequence) for r in paired.reads.filter("mate = 'R2'").orderBy("round").collect()] == [("round_00", "R2_A"), ("round_01", "R2_B")]
    assert [r.sequence for r in paired.unassigned.filter("mate = 'R2'").collect()] == ["R2_C"]
    streams = {"R1": [["AAAAAC", "TTTTTC", "GGGGGC"], ["TTTTTG", "GGGGGG", "AAAAAG"]], "R2": [["m0", "m1", "m2"], ["m3", "m4", "m5"]]}
    got = demultiplex(with_pairs(two_files(spark, streams)), {"AAAAA": 0, "TTTTT": 1})
    assert sorted((r.round, r.mate, r.sequence) for r in got.reads.collect()) == [(f"round_0{k}", m, s) for k, m, s in ((0, "R1", "C"), (0, "R1", "G"), (0, "R2", "m0"), (0, "R2", "m5"), (1, "R1", "C"), (1, "R1", "G"), (1, "R2", "m1"), (1, "R2", "m3"))]
    assert sorted(r.sequence for r in got.unassigned.filter("mate = 'R2'").collect()) == ["m2", "m4"]
    with pytest.raises(ValueError, match="Mates differ"):
        demultiplex(with_pairs(two_files(spark, {"R1": [["AAAAAC"]], "R2": [["m", "n"]]})), {"AAAAA": 0})
    with pytest.raises(ValueError, match="pair_index"):
        demultiplex(two_files(spark, streams), {"AAAAA": 0, "TTTTT": 1})
    far = demultiplex(reads_from(spark, {"p": ["AAAACCG", "AAAAAAG", "CCCCGGG", "AACCAA"]}), {"AAAAAA": 0, "CCCCCC": 1}, max_mismatches=2)
    assert [(r.round, r.sequence) for r in far.reads.orderBy("read_index").collect()] == [("round_00", "G"), ("round_00", "G"), ("round_01", "G"), ("round_00", "")]
    for bad in ({"AAAAA": 0, "AAAAT": 1}, {}, {"AAAA": 0, "CCCCC": 1}, {"AANAA": 0}, {"AAAAA": -1}):
        with pytest.raises(ValueError):
            checked_barcodes(bad)
