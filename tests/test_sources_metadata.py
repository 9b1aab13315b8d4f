import gzip
import hashlib
import json

import pytest

from readloom.operators.catalog import load, search
from readloom.operators.rounds import infer_rounds, key_confidence, rounds_with_several_samples
from readloom.plans import manifest as manifests
from readloom.plans.pipeline import reads_from, run, run_files
from readloom.plans.report import LibraryReport
from readloom.sources import archive
from readloom.sources.fastq import mate_of, read_fastq, read_inputs

P5, P3 = "GGTAATACGACTCACTATAGGG", "CCATGCATGCATGCATGCAT"


def fastq(path, reads):
    text = "".join(f"@r{k}\n{s}\n+\n{'@' * len(s)}\n" for k, s in enumerate(reads))
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def pool(n, p5=P5, p3=P3, width=16):
    return [p5 + "".join("ACGT"[(i * 7 + j * 13) % 4] for j in range(width)) + p3 for i in range(n)]


def test_fastq(spark, tmp_path):
    a, b, c = fastq(tmp_path / "a.fastq", ["ACGU", "nnaa", "TT"]), fastq(tmp_path / "b.fq.gz", ["GG", "CC"]), fastq(tmp_path / "c.fastq", [])
    rows = sorted(map(tuple, read_fastq(spark, [a, b, c]).collect()))
    assert rows == [(0, 0, "ACGU"), (0, 1, "nnaa"), (0, 2, "TT"), (1, 0, "GG"), (1, 1, "CC")]
    assert sorted(r.sequence for r in read_fastq(spark, [a, b], max_reads=1).collect()) == ["ACGU", "GG"]
    (tmp_path / "d.fastq").write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="Malformed"):
        read_fastq(spark, str(tmp_path / "d.fastq")).collect()
    with pytest.raises(FileNotFoundError):
        read_fastq(spark, "/nowhere.fastq")
    assert [mate_of(x) for x in ("x_R1.fq", "r2.fastq.gz", "s_1.fastq", "a.b.R2.fq", "R12.fq")] == ["R1", "R2", "R1", "R2", None]


def test_inputs(spark, tmp_path):
    a, b = fastq(tmp_path / "s_R1.fastq", ["AA", "CC"]), fastq(tmp_path / "s_R2.fastq", ["GG", "TT"])
    got = read_inputs(spark, [a, b], round=3)
    assert got.read_source == "R1_AND_R2" and {(r["round"], r.mate) for r in got.reads.collect()} == {("round_03", "R1"), ("round_03", "R2")}
    row = got.files.filter("mate = 'R1'").first()
    assert row.reads_loaded == 2 and row.sha256 == hashlib.sha256(open(a, "rb").read()).hexdigest()
    c = fastq(tmp_path / "t_R2.fastq", ["GG"])
    for files, said in (([a, c], "different read counts"), ([c], "needs both"), ([a, a], "unique")):
        with pytest.raises(ValueError, match=said):
            read_inputs(spark, files, round=0)
    with pytest.raises(ValueError, match="non-negative"):
        read_inputs(spark, [a])


def test_run_and_files(spark, tmp_path):
    paths = {f"round_{r}": fastq(tmp_path / f"x{r}.fastq", pool(500)) for r in range(2)}
    out = run_files(spark, paths, low_total_reads=10)
    assert out.report.status == "HIGH" and sum(r.reads for r in out.counts.collect()) == 1000
    assert set(out.manifest["input_sha256"]) == {"round_00/R1/001_x0.fastq", "round_01/R1/001_x1.fastq"}
    assert sorted(map(tuple, out.input_yields.select("input_reads", "output_reads", "fraction_kept").collect())) == [(500, 500, 1.0)] * 2
    path = str(tmp_path / "m.json")
    assert manifests.write(out.manifest, path) == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert manifests.read(path)["flags"] == list(out.manifest["flags"])
    old = json.loads(open(path).read())
    for bad in (old | {"manifest_version": "x"}, old | {"read_source": "R2"}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            manifests.read(str(tmp_path / "bad.json"))


def test_split_libraries_are_not_counted(spark):
    from readloom.functions.sequences import reverse_complement_text

    r1 = {f"round_{r}": pool(500, P5, "", 80) for r in range(2)}
    r2 = {f"round_{r}": pool(500, reverse_complement_text(P3), "", 80) for r in range(2)}
    out = run(reads_from(spark, r1, r2), "R1_AND_R2")
    assert out.counting_skipped and out.qc is None and out.counts.count() == 0
    assert out.manifest["flags"] == ["requires_read_merging_for_full_insert"]


def test_rounds(spark):
    rows = [("A", "Target Round 3", [], (3, "HIGH")), ("B", "Round 1 Round 2", [], (1, "MEDIUM")), ("C", "ROUND 4", [], (None, "NONE")), ("D", "DNAFOXR00", [], (0, "HIGH")), ("E", "Selex_7_cyc", [], (7, "HIGH")),
            ("F", "R9", [("selex round", "2")], (2, "HIGH")), ("G", "", [("pcr cycles", "2"), ("cycle", "x")], (None, "NONE")), ("H", "", [("PCR-cycle", "R2")], (2, "MEDIUM")), ("I", "(R3) TFR1 RV04", [], (None, "NONE")), ("J", "x", [("round", "1"), ("cycle", "5")], (1, "MEDIUM")), ("K", "R1", [], (8, "HIGH"))]
    runs = spark.createDataFrame([r[:3] for r in rows], "run_accession string, sample_title string, sample_attributes array<struct<key:string,value:string>>")
    got = {r.run_accession: r for r in infer_rounds(runs, {"K": 8}).collect()}
    for name, _, _, want in rows:
        assert (got[name].round_number, got[name].confidence) == want, name
    assert list(got["B"].round_candidates) == [1, 2] and got["A"].target_hint == "Target" and got["A"].matched_pattern == "round_word_digit"
    assert got["A"].parser_notes == "matched 'round_word_digit' in sample_title: 'Target Round 3'" and got["K"].source_field == "seed_override"
    keys = spark.createDataFrame([("Characteristics [Selection Round]",), ("round number",), ("pcr-cycle",), ("round cycle",), ("age",)], "k string")
    assert [r[0] for r in keys.select(key_confidence(keys["k"])).collect()] == ["HIGH", "HIGH", "MEDIUM", None, None]


REPORT = "\t".join(archive.FIELDS) + "\n" + "\n".join(
    "\t".join([f"RUN{k}", "PRJ1", "Study", "SELEX", "SYNTHETIC", f"lib{k}", "exp", f"sel R{k}", f"SAM{k}", "10", "100", "5d41402abc4b2a76b9719d911017c592;", "5;x", f"ftp.host/a/RUN{k}_1.fastq.gz?q=1"]) for k in (1, 2)
)
SAMPLES = b"<S><SAMPLE accession='SAM1'><SAMPLE_ATTRIBUTE><TAG>round</TAG><VALUE>6</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>round</TAG><VALUE>7</VALUE></SAMPLE_ATTRIBUTE><SAMPLE_ATTRIBUTE><TAG>ENA-X</TAG><VALUE>1</VALUE></SAMPLE_ATTRIBUTE></SAMPLE></S>"


def test_archive(spark, tmp_path):
    waits, answers = [], [(200, b"ERROR occurred"), (200, REPORT.encode()), (404, b""), (200, SAMPLES), (404, b"")]
    found = archive.inspect(spark, "PRJ1", transport=lambda url, t: answers.pop(0), sleep=waits.append)
    assert waits == [1.0] and not answers and found.bioproject_id == "PRJ1"
    plan = {r.run_accession: r for r in archive.fetch_plan(found).collect()}
    assert plan["RUN1"].round_number == 6 and plan["RUN2"].round_number == 2 and plan["RUN1"].file_name == "RUN1_1.fastq.gz"
    assert plan["RUN1"].url == "https://ftp.host/a/RUN1_1.fastq.gz?q=1" and plan["RUN1"].expected_bytes == 5.0
    assert archive.fetch(found, str(tmp_path)).dry_run
    got = archive.fetch(found, str(tmp_path), dry_run=False, transport=lambda url, t: (200, b"hello"))
    assert len(got.downloaded) == 2 and [r["round_number"] for r in archive.input_rows(got)] == [6, 2]
    with pytest.raises(FileExistsError):
        archive.fetch(found, str(tmp_path), dry_run=False, transport=lambda url, t: (200, b"hello"))
    with pytest.raises(RuntimeError, match="MD5"):
        archive.fetch(found, str(tmp_path), dry_run=False, overwrite=True, transport=lambda url, t: (200, b"other"))
    with pytest.raises(RuntimeError, match="HTTP status 500"):
        archive.report_text("X", transport=lambda url, t: (500, b""))
    with pytest.raises(RuntimeError, match="busy 4 times"):
        archive.report_text("X", transport=lambda url, t: (200, b"ERROR occurred"), sleep=waits.append)
    bodies = {"RUN1": b"hello", "RUN2": b"hello"}
    for name, body in bodies.items():
        (tmp_path / f"{name}_far.gz").write_bytes(body)
    local = lambda url, timeout, path: archive.save(f"file://{tmp_path}/{url.split('/')[-1][:4]}_far.gz", timeout, path)
    assert len(archive.fetch(found, str(tmp_path / "streamed"), dry_run=False, download=local).downloaded) == 2
    with pytest.raises(RuntimeError, match="HTTP status 404"):
        archive.fetch(found, str(tmp_path / "none"), dry_run=False, transport=lambda url, t: (404, b""))
    assert list((tmp_path / "none").iterdir()) == []
    unsafe = archive.parse_report(spark, REPORT.replace("sel R1", "none"), "PRJ1")
    with pytest.raises(ValueError, match="Nothing was downloaded"):
        archive.fetch(unsafe, str(tmp_path))
    with pytest.warns(UserWarning, match="no sample attributes"):
        archive.enriched(archive.parse_report(spark, REPORT, "PRJ1"), transport=lambda url, t: (500, b""))


def test_several_samples_and_catalog(spark):
    runs = spark.createDataFrame([("A", "S1", "R1"), ("B", "S2", "R1"), ("C", "", "R2"), ("D", "S4", "R3 R4")], "run_accession string, sample_accession string, sample_title string")
    assert [(r.round_number, list(r.runs)) for r in rounds_with_several_samples(runs, infer_rounds(runs)).collect()] == [(1, ["A", "B"])]
    table = spark.createDataFrame([("P1", "100%_match", None), ("P2", "Other", "thrombin")], "bioproject_id string, study_title string, target string")
    assert [r.bioproject_id for r in search(table, "0%_M").collect()] == ["P1"] and search(table).count() == 2 and search(table, "THROMB").count() == 1


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('bioproject_id,study_title,target\nP1,"a, ""b""",FGF-9\nP2,x,\n')
    table = load(spark, str(tmp_path / "c.csv"))
    assert [r.study_title for r in search(table, "fgf-9").collect()] == ['a, "b"'] and load(spark, str(tmp_path / "c.csv")) is table
    table.write.parquet(str(tmp_path / "c.parquet"))
    assert search(load(spark, str(tmp_path / "c.parquet"))).count() == 2
    (tmp_path / "d.tsv").write_text("bioproject_id\ttarget\nP1\tx\n")
    with pytest.raises(ValueError, match="study_title"):
        load(spark, str(tmp_path / "d.tsv"))
    with pytest.raises(ValueError, match="query"):
        search(table, "")


def test_fastq_splits_and_stores(spark, tmp_path):
    reads = ["ACGT" * (1 + k % 5) for k in range(400)]
    plain, packed = fastq(tmp_path / "a.fastq", reads), fastq(tmp_path / "b.fastq.gz", reads[:50])
    want = sorted([(0, k, s) for k, s in enumerate(reads)] + [(1, k, s) for k, s in enumerate(reads[:50])])
    for size in (1 << 20, 1000, 333):
        got = read_fastq(spark, [f"file://{plain}", packed], split_bytes=size)
        assert sorted(map(tuple, got.select("file_index", "read_index", "sequence").collect())) == want
    assert read_fastq(spark, plain, split_bytes=333).rdd.getNumPartitions() > 1
    assert read_fastq(spark, f"file://{plain}", max_reads=7, split_bytes=100).count() == 7
    got = read_inputs(spark, {"r1": f"file://{plain}"}).files.first()
    assert (got.reads_loaded, got.sha256) == (400, hashlib.sha256(open(plain, "rb").read()).hexdigest())
    with pytest.raises(FileNotFoundError):
        read_fastq(spark, "file:///nowhere.fastq")


def test_streaming_counts(spark, tmp_path):
    from readloom.streaming.counts import running_counts, start

    df = spark.createDataFrame([("r0", "AC"), ("r0", "AC"), ("r1", "G")], "round string, sequence string")
    df.write.parquet(str(tmp_path / "in"))
    q = start(running_counts(spark, str(tmp_path / "in"), "round string, sequence string"), "landed", str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("landed").collect())) == [("r0", "AC", 2), ("r1", "G", 1)]


def test_manifest_of_a_report():
    m = manifests.build(LibraryReport(), parameters={"b": 1, "a": "x"})
    assert m["manifest_version"] == manifests.VERSION and m["parameters"] == {"b": "1", "a": "x"} and m["accession"] is None
