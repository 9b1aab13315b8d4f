"""Reports must equal known ones byte for byte; the digests are those of reviewed files."""

import hashlib
import json
import random

import pytest

from readloom.functions.sequences import reverse_complement_text
from readloom.operators import detection as D
from readloom.plans.pipeline import reads_from
from readloom.plans.report import corrected, read_report, to_json, write_report

P5, P3 = "GGTAATACGACTCACTATAGGG", "CCATGCATGCATGCATGCAT"


def pool(n, width, round_, p5="", p3=""):
    return [p5 + "".join("ACGT"[((i + round_ * 1000) * 7 + j * 13) % 4] for j in range(width)) + p3 for i in range(n)]


def three(n, width, p5="", p3=""):
    return {f"round_{r:02d}": pool(n, width, r, p5, p3) for r in range(3)}


CASES = {
    "both": (three(500, 30, P5, P3), None, "e6cc473e74fb0269eb779b93871bfdccff0ee943fedd7ef7ab49ef00597ac627"),
    "five": (three(1000, 30, P5), None, "47035ac609795c2acbc77cab1629644780d27c70f5d21eb9597f050ccc7062cd"),
    "three": (three(1000, 30, "", P3), None, "0c817aa1ae705a9e2c4af7dfca3575ab893ea317ab7138970f36a89e29b298fc"),
    "paired": (three(1000, 80, P5), three(1000, 80, reverse_complement_text(P3)), "d5d499ce4f1c39bf2310db39b954804e0028155d50d4b3439238abef73acd17b"),
    "unable": ({"round_00": pool(100, 30, 0)}, None, "5cf6c206cc65bf3ba212a86a53e36ec2e9cb0ffaa4da83ac1a77eb02d0d726fe"),
}


@pytest.mark.parametrize("name", CASES)
def test_known_reports(spark, tmp_path, name):
    reads, mates, digest = CASES[name]
    report = D.detect(reads_from(spark, reads, mates), "R1_AND_R2" if mates else "R1")
    path = str(tmp_path / "report.json")
    assert write_report(report, path) == digest
    assert read_report(path).payload() == report.payload()


def inserts(seed, edge=False):
    g, out = random.Random(seed), []
    for i in range(600):
        s = "".join(g.choice("ACGT") for _ in range(40))
        out.append("CGATGCGGTACC" + s[12:28] + "CAGACGACTCGC" if edge and i % 5 in (0, 1, 2) else s)
    return out


@pytest.mark.parametrize("edge", [False, True])
def test_run_specific_tags_are_cut_off(spark, edge):
    tags = [("ACTGAG", "GCATG"), ("TAAGCG", "CTGTC"), ("GTCAATG", "GTTAGATG")]
    pools = {f"round_{r:02d}": [a + "AGGACGATGCGGTACC" + x + "CAGACGACTCGCTGAGGATC" + b for x in inserts(r, edge and r > 0)] for r, (a, b) in enumerate(tags)}
    payload = D.detect(reads_from(spark, pools)).payload()
    assert payload["primer_5p"] == "GAGGACGATGCGGTACC"
    assert hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest() == "d2daa1b2b29ae0a1a8115bc455b8b692f881e27dbed00a25c79d81e630926875"


def test_empty_and_flanks_that_meet(spark):
    assert D.detect(reads_from(spark, {})).failure_reason == "No sequences provided"
    report = D.detect(reads_from(spark, {"round_00": [P5 + P3] * 600}))
    assert report.status == "UNABLE_TO_INFER" and "0 nt" in report.failure_reason
    capped = D.detect(reads_from(spark, three(500, 30, P5, P3)), max_reads_per_round=499)
    assert "fewer than 500" in capped.failure_reason


def test_decisions():
    assert D.classify(0.39, 0.39, 1, False, True, 1)["failure_reason"] == "Both primer match rates below 0.40 (5'=0.39, 3'=0.39)"
    assert D.classify(0.7, 0.7, 1, False, True, 1)["failure_reason"].startswith("Ambiguous primer evidence")
    assert D.classify(0.9, 0.1, 0.8, False, True, 1)["failure_reason"].endswith("(0.80) <= threshold (0.80)")
    assert D.classify(0.9, 0.1, 0.81, False, False, 1)["status"] == "MEDIUM"
    assert D.classify(0.9, 0.9, 1, True, True, 0.9)["extraction_mode"] == "PAIRED_END_SPLIT_PRIMERS"
    assert D.boundary([1.0] * 60) == 60 and D.boundary([1.0] * 20 + [0.3] * 40) == 20 and D.boundary([0.3] * 60) == 0
    assert D.first_seen_mode([("b", 2, 5), ("a", 2, 9), ("c", 1, 0)]) == ("b", 2)
    assert D.agree("ACGTACGT", "CGTA") and D.agree("ACGT", "ACGA") and not D.agree("AAAA", "TTTT")
    assert D.persistence_score([0.9]) is None and D.persistence_score([0.5, 0.5]) == 1.0


def test_corrections():
    from readloom.plans.report import LibraryReport

    base = LibraryReport()
    fixed = corrected(base, primer_5p="acgu")
    assert (fixed.extraction_mode, fixed.primer_5p, fixed.status, fixed.confidence) == ("FIVE_PRIME_ONLY", "ACGU", "LOW", 0.0)
    assert corrected(base) is base
    for bad in ({"primer_5p": "AXC"}, {"primer_3p": ""}, {"extraction_mode": "NO"}, {"extraction_mode": "BOTH_PRIMERS_SINGLE_READ", "primer_5p": "ACGT"}):
        with pytest.raises(ValueError):
            corrected(base, **bad)
    assert to_json({"a": 1.0, "b": {}}) == '{\n  "a": 1.0,\n  "b": {}\n}\n'
