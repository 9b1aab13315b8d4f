"""From reads to counts, quality and a manifest."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.counting import count_sequences, experiment, round_names
from ..operators.detection import detect
from ..operators.extraction import Extraction, extract, low_yields, yields
from ..operators.quality import Quality, qc
from ..sources.fastq import ReadInputs, hash_paths, read_inputs, with_pairs
from . import manifest as manifests
from .report import LibraryReport, corrected

READS = "round string, mate string, file_index int, read_index bigint, sequence string"


def reads_from(spark: SparkSession, pools: dict[str, list[str]] | list[list[str]], mates: dict[str, list[str]] | None = None) -> DataFrame:
    """In-memory pools as a reads table; unnamed ones are round_00, round_01, ..."""
    named = pools if isinstance(pools, dict) else {f"round_{k:02d}": p for k, p in enumerate(pools)}
    if any(not name for name in named):
        raise ValueError("Pools must have unique, non-empty round names.")
    rows = [(name, mate, None, k, s) for mate, source in (("R1", named), ("R2", mates or {})) for name, pool in source.items() for k, s in enumerate(pool)]
    return spark.createDataFrame(rows, READS).withColumn("pair_index", F.col("read_index"))


@dataclass
class Run:
    report: LibraryReport
    extraction: Extraction
    counts: DataFrame
    experiment: DataFrame
    qc: Quality | None
    manifest: dict
    counting_skipped: bool
    input_yields: DataFrame | None = None
    low_yield_files: dict[str, str] = field(default_factory=dict)


def run(
    reads: DataFrame, read_source: str = "R1", accession: str | None = None, sampling_seed: int = 42, max_reads_per_round: int | None = None, low_total_reads: int = 10_000,
    primer_5p: str | None = None, primer_3p: str | None = None, extraction_mode: str | None = None,
) -> Run:
    """Detect, extract, count and check one library.

    Each stage ends in an action on what it made, so that its time is its own.
    Split-primer libraries are extracted but not counted: their mates need merging first.
    """
    took: dict[str, float] = {}
    clock = time.monotonic()

    def lap(stage: str) -> None:
        nonlocal clock
        now = time.monotonic()
        took[stage], clock = now - clock, now

    reads = reads.persist()
    report = corrected(detect(reads, read_source, sampling_seed, max_reads_per_round), primer_5p, primer_3p, extraction_mode)
    lap("detect")
    got = extract(reads, report)
    got.inserts = got.inserts.persist()
    input_reads = {r["round"]: r["input_reads"] for r in got.per_round.collect()}
    got.warn()
    lap("extract")
    skipped = report.extraction_mode == "PAIRED_END_SPLIT_PRIMERS"
    counts = count_sequences(got.inserts.filter(F.lit(not skipped))).persist()
    counts.count()
    lap("count")
    found = None if skipped else qc(counts, list(input_reads), report, low_total_reads, input_reads=input_reads, strands=got.strands)
    lap("qc")
    flags = [name for name, _, _ in found.flags] if found else ["requires_read_merging_for_full_insert"] if report.required_action == "READ_MERGING_RECOMMENDED" else []
    manual = any(x is not None for x in (primer_5p, primer_3p, extraction_mode))
    parameters = {"read_source": read_source, "sampling_seed": sampling_seed, "max_reads_per_round": "all" if max_reads_per_round is None else max_reads_per_round, "low_total_reads": low_total_reads, "manual_primer_override": "true" if manual else "false"}
    manifest = manifests.build(report, accession=accession, parameters=parameters, runtime_seconds_per_stage=took, flags=flags)
    out = Run(report, got, counts, experiment(counts), found, manifest, skipped)
    if not reads.filter("file_index is not null").isEmpty():
        out.input_yields = file_yields(reads, got.inserts)
    return out


def file_yields(reads: DataFrame, inserts: DataFrame) -> DataFrame:
    """Reads before and after extraction of each first-mate file."""
    first = lambda df: df.filter("mate = 'R1' and file_index is not null")
    return yields(first(reads), first(inserts), "file_index")


def run_files(spark: SparkSession, files, round=None, mate=None, max_reads_per_file: int | None = None, **options) -> Run:
    """run() over FASTQ files, with the yield of each file, empty ones too, and the files' hashes in the manifest."""
    inputs: ReadInputs = read_inputs(spark, files, round, mate, max_reads_per_file)
    out = run(with_pairs(inputs.reads), inputs.read_source, **options)
    table = inputs.files.filter("mate = 'R1'").select("file_index", "path", "round_number", "mate", "run_accession", F.col("reads_loaded").alias("input_reads"))
    kept = file_yields(inputs.reads, out.extraction.inserts).select("file_index", "output_reads", "fraction_kept")
    out.input_yields = table.join(kept, "file_index", "left").withColumn("output_reads", F.coalesce("output_reads", F.lit(0)))
    out.low_yield_files = {r["path"]: r["message"] for r in low_yields(out.input_yields, "path", "file").collect()}
    place = F.row_number().over(Window.partitionBy("round_number", "mate").orderBy("file_index"))
    hashed = inputs.files.withColumn("_k", place).collect()
    keys = {f"round_{r['round_number']:02d}/{r['mate']}/{r['_k']:03d}_{r['path'].rsplit('/', 1)[-1]}": r["sha256"] for r in hashed}
    out.manifest = out.manifest | {"input_sha256": keys, "runs": sorted({r["run_accession"] for r in hashed if r["run_accession"]})}
    return out


__all__ = ["Run", "file_yields", "hash_paths", "reads_from", "round_names", "run", "run_files"]
