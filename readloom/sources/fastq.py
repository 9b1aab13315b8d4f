"""A Spark data source for FASTQ files, plain or gzip, and round-aware inputs."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_index int, split int, read_index bigint, sequence string"
_ARROW = pa.schema([("file_index", pa.int32()), ("split", pa.int32()), ("read_index", pa.int64()), ("sequence", pa.string())])
FILES = "file_index int, path string, round_number int, mate string, run_accession string"
#: Bytes of one split of a plain text file.
SPLIT_BYTES = 128 << 20


def store_of(path: str):
    """(file system, path in it) of an address such as s3://, gs://, hdfs:// or file://; None for a local path."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        return None
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def opened(path: str) -> io.BufferedReader:
    """A file's bytes, from a local disk or from a store that all workers reach; can seek."""
    store = store_of(path)
    return open(path, "rb") if store is None else io.BufferedReader(store[0].open_input_file(store[1]), 1 << 20)


def size_of(path: str) -> int | None:
    """Bytes of a file, None if there is none."""
    store = store_of(path)
    if store is None:
        return os.path.getsize(path) if os.path.isfile(path) else None
    info = store[0].get_file_info(store[1])
    return info.size if info.is_file else None


def zipped(path: str) -> bool:
    """Gzip is told by its first bytes."""
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


class Part(InputPartition):
    def __init__(self, index: int, path: str, split: int, begin: int, end: int | None):
        self.index, self.path, self.split, self.begin, self.end = index, path, split, begin, end


class FastqReader(DataSourceReader):
    """One partition for each gzip file, which cannot be split, and for each split of a plain one.

    ``read_index`` counts the records of a split. A cap on reads needs their order, so it keeps files whole.
    """

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        most = options.get("maxreads")
        self.most = int(most) if most not in (None, "", "None") else None
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        out = []
        for k, p in enumerate(self.paths):
            size = size_of(p) or 0
            if self.most is not None or size <= self.split_bytes or zipped(p):
                out.append(Part(k, p, 0, 0, None))
            else:
                out += [Part(k, p, n, at, min(size, at + self.split_bytes)) for n, at in enumerate(range(0, size, self.split_bytes))]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        found: list[str] = []
        at = 0
        for sequence in records(partition.path, self.most, partition.begin, partition.end):
            found.append(sequence)
            if len(found) == 8192:
                yield batch(partition, at, found)
                at += len(found)
                found = []
        if found:
            yield batch(partition, at, found)


def batch(part: Part, at: int, found: list[str]) -> pa.RecordBatch:
    n = len(found)
    return pa.RecordBatch.from_arrays([pa.array([part.index] * n, pa.int32()), pa.array([part.split] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(found, pa.string())], schema=_ARROW)


def first_record(f: io.BufferedReader, begin: int) -> int:
    """Where the first record from ``begin`` on starts: a line of @ whose next but one is of +, as no sequence line is."""
    f.seek(max(0, begin - 1))
    if begin:
        f.readline()
    lines = [(f.tell(), f.readline()) for _ in range(3)]
    while lines[0][1]:
        if lines[0][1][:1] == b"@" and lines[2][1][:1] == b"+":
            return lines[0][0]
        at = lines[2][0] + len(lines[2][1])
        lines = [*lines[1:], (at, f.readline())]
    return lines[0][0]


def records(path: str, most: int | None = None, begin: int = 0, end: int | None = None) -> Iterator[str]:
    """Sequences of the four-line records that start in the given bytes, in order."""
    n, packed = 0, zipped(path)
    with opened(path) as raw:
        at = first_record(raw, begin) if begin else 0
        raw.seek(at)
        f = gzip.open(raw, "rb") if packed else raw
        while (most is None or n < most) and (end is None or at < end):
            lines = [f.readline()]
            if not lines[0].strip():
                if lines[0]:
                    at += len(lines[0])
                    continue
                return
            lines += [f.readline() for _ in range(3)]
            at += sum(map(len, lines))
            name, sequence, plus, quality = (x.rstrip(b"\r\n") for x in lines)
            if name[:1] != b"@" or plus[:1] != b"+" or len(quality) != len(sequence):
                raise ValueError(f"Malformed FASTQ record {n + 1} in {path}.")
            yield sequence.decode("latin-1")
            n += 1


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, paths: str | list[str], max_reads: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file_index, read_index and sequence of the files' records; ``max_reads`` is a cap for each file.

    Paths are local, or addresses of a store that all workers reach. Large plain
    files are read in splits, whose records are counted first.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    sizes = [size_of(p) for p in paths]
    for p, n in zip(paths, sizes, strict=True):
        if n is None:
            raise FileNotFoundError(f"No FASTQ file at {p}")
    if max_reads is not None and (not isinstance(max_reads, int) or max_reads < 1):
        raise ValueError("`max_reads` must be one positive integer.")
    spark.dataSource.register(FastqSource)
    options = {"paths": "\n".join(paths), "splitbytes": str(split_bytes)} | ({} if max_reads is None else {"maxreads": str(max_reads)})
    found = spark.read.format("fastq").options(**options).load()
    if max_reads is not None or all(n <= split_bytes or zipped(p) for p, n in zip(paths, sizes, strict=True)):
        return found.drop("split")
    before = Window.partitionBy("file_index").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("file_index", "split").agg(F.count("*").alias("n")).select("file_index", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return found.join(F.broadcast(starts), ["file_index", "split"]).select("file_index", (F.col("start") + F.col("read_index")).alias("read_index"), "sequence")


def mate_of(path: str) -> str | None:
    """R1 or R2 from a file's name, or None."""
    stem = re.sub(r"(?i)\.(fastq|fq)(\.gz)?$", "", os.path.basename(path))
    m = re.search(r"(?i)(?:^|[._-])R([12])(?:[._-]|$)", stem) or re.search(r"(?:^|[._-])([12])$", stem)
    return f"R{m[1]}" if m else None


def round_of(label: str) -> int | None:
    m = re.search(r"([0-9]+)$", label or "")
    return int(m[1]) if m else None


@dataclass
class ReadInputs:
    """Reads with their rounds and the table of their files."""

    reads: DataFrame
    files: DataFrame
    read_source: str


def checked_mates(mates: list[str | None], paths: list[str]) -> list[str]:
    known = {"1": "R1", "2": "R2", "R1": "R1", "R2": "R2"}
    named = [known.get(str(m).upper()) if m not in (None, "") else mate_of(p) for m, p in zip(mates, paths, strict=True)]
    if any(m not in (None, "") and str(m).upper() not in known for m in mates):
        raise ValueError("`mate` must be R1 or R2.")
    if None in named and "R2" in named:
        raise ValueError("Mates must be given for every file when an R2 file is present.")
    return [m or "R1" for m in named]


def read_inputs(spark: SparkSession, files: list[dict] | dict[str, str] | list[str], round=None, mate=None, max_reads_per_file: int | None = None) -> ReadInputs:
    """Files by round and mate as one reads table.

    ``files`` are paths, a mapping of labels that end in round numbers to paths, or
    rows with path, round_number and optionally mate and run_accession. Every round
    with an R2 file needs R1 files with as many reads.
    """
    if isinstance(files, dict):
        rows = [{"path": p, "round_number": round_of(label)} for label, p in files.items()]
    else:
        rows = [dict(f) if isinstance(f, dict) else {"path": f} for f in files]
    if not rows:
        raise ValueError("At least one FASTQ file is required.")
    scalar = lambda v, k: v[k] if isinstance(v, list | tuple) else v
    for k, r in enumerate(rows):
        if round is not None:
            r["round_number"] = scalar(round, k)
        if mate is not None:
            r["mate"] = scalar(mate, k)
        n = r.get("round_number")
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("`round` must give a non-negative integer for every file.")
        if not r.get("path") or size_of(r["path"]) is None:
            raise FileNotFoundError(f"No FASTQ file at {r.get('path')}")
    paths = [r["path"] if store_of(r["path"]) else os.path.realpath(r["path"]) for r in rows]
    if len(set(paths)) < len(paths):
        raise ValueError("FASTQ paths must be unique.")
    mates = checked_mates([r.get("mate") for r in rows], paths)
    for n in {r["round_number"] for r in rows}:
        own = {m for m, r in zip(mates, rows, strict=True) if r["round_number"] == n}
        if "R2" in mates and own != {"R1", "R2"}:
            raise ValueError(f"Round {n} needs both R1 and R2 files.")
    table = spark.createDataFrame([(k, p, r["round_number"], m, r.get("run_accession")) for k, (p, m, r) in enumerate(zip(paths, mates, rows, strict=True))], FILES)
    reads = read_fastq(spark, paths, max_reads_per_file).join(F.broadcast(table), "file_index").select(
        F.format_string("round_%02d", "round_number").alias("round"), "round_number", "mate", "file_index", "read_index", "sequence"
    )
    loaded = reads.groupBy("file_index").agg(F.count("*").cast("int").alias("reads_loaded"))
    files_frame = table.join(F.broadcast(loaded), "file_index", "left").withColumn("reads_loaded", F.coalesce("reads_loaded", F.lit(0))).join(F.broadcast(hashes(table)), "file_index")
    order = ["round_number", "mate", "file_index"]
    files_frame = files_frame.select("file_index", "path", "round_number", "mate", "run_accession", "reads_loaded", "file_size", "md5", "sha256").orderBy(*order)
    if "R2" in mates:
        sums = files_frame.groupBy("round_number").agg(F.sum(F.when(F.col("mate") == "R1", F.col("reads_loaded"))).alias("a"), F.sum(F.when(F.col("mate") == "R2", F.col("reads_loaded"))).alias("b"))
        for r in sums.filter("a <> b").collect():
            raise ValueError(f"Round {r['round_number']} has different read counts in R1 and R2.")
    source = "R1_AND_R2" if "R2" in mates else "R1"
    return ReadInputs(reads, files_frame, source)


def with_pairs(reads: DataFrame) -> DataFrame:
    """``pair_index``: the place of a read among its round's reads of one mate, in the order of files."""
    sizes = reads.groupBy("round", "mate", "file_index").agg(F.count("*").alias("n"))
    before = Window.partitionBy("round", "mate").orderBy("file_index").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("round", "mate", "file_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return reads.join(F.broadcast(starts), ["round", "mate", "file_index"]).withColumn("pair_index", F.col("start") + F.col("read_index")).drop("start")


def hashes(files: DataFrame) -> DataFrame:
    """Size, MD5 and SHA-256 of each file, streamed where the file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for index, path in zip(pdf["file_index"], pdf["path"], strict=True):
                md5, sha = hashlib.md5(usedforsecurity=False), hashlib.sha256()
                size = 0
                with opened(path) as f:
                    while block := f.read(1 << 20):
                        md5.update(block)
                        sha.update(block)
                        size += len(block)
                rows.append((index, size, md5.hexdigest(), sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["file_index", "file_size", "md5", "sha256"])

    return files.select("file_index", "path").mapInPandas(run, "file_index int, file_size bigint, md5 string, sha256 string")


def hash_paths(paths: list[str], root: str | None = None) -> dict[str, str]:
    """SHA-256 of files by their path below ``root``, or by name."""
    out: dict[str, str] = {}
    base = os.path.realpath(root) + os.sep if root else None
    for p in map(os.path.realpath, paths):
        key = p[len(base) :] if base and p.startswith(base) else os.path.basename(p)
        if key in out:
            raise ValueError("Paths produce duplicated hash keys.")
        with open(p, "rb") as f:
            out[key] = hashlib.file_digest(f, "sha256").hexdigest()
    return out
