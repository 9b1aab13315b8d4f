"""Count files: delimited text or Parquet by extension, with a validated contract."""

from __future__ import annotations

import glob
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "sequence string, reads double, rank int, rpm double"
COLUMNS = ["sequence", "reads", "rank", "rpm"]


def format_of(path: str) -> str:
    kinds = {".tsv": "tsv", ".txt": "tsv", ".csv": "csv", ".parquet": "parquet"}
    kind = kinds.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError("Unsupported count-file extension; use .tsv, .csv or .parquet.")
    return kind


def validated(counts: DataFrame) -> DataFrame:
    """The count contract: columns in order, finite values, ranks 1..n, rpm that fits the reads. One aggregate checks it all."""
    if counts.columns != COLUMNS:
        raise ValueError("Count tables must have the columns sequence, reads, rank, rpm.")
    c = counts.select("sequence", F.col("reads").cast("double"), F.col("rank").cast("int"), F.col("rpm").cast("double"))
    total = c.agg(F.sum("reads").alias("t")).first()["t"] or 0.0
    fits = F.col("reads") / F.lit(total or 1.0) * 1e6
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)
    r = c.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sequence").isNull() | bad(F.col("reads")) | bad(F.col("rpm")) | F.col("rank").isNull()).alias("missing"),
        F.count_distinct("rank").alias("ranks"),
        F.min("rank").alias("low"),
        F.max("rank").alias("high"),
        F.count_distinct("sequence").alias("distinct"),
        F.count_if(F.abs(F.col("rpm") - fits) > 1e-7 * F.greatest(F.lit(1.0), F.col("rpm"))).alias("off"),
    ).first()
    if r["missing"]:
        raise ValueError("Count tables must hold finite, non-negative values.")
    if r["n"] and (r["ranks"] != r["n"] or r["low"] != 1 or r["high"] != r["n"]):
        raise ValueError("`rank` must be consecutive from 1.")
    if r["distinct"] != r["n"]:
        raise ValueError("`sequence` must be unique.")
    if r["off"]:
        raise ValueError("`rpm` does not agree with `reads`.")
    return c


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    kind = format_of(path)
    if kind == "parquet":
        return validated(spark.read.parquet(path))
    with open(path, encoding="utf-8") as f:
        head = f.readline().rstrip("\r\n").split("\t" if kind == "tsv" else ",")
    if head != COLUMNS:
        raise ValueError("Count tables must have the columns sequence, reads, rank, rpm.")
    df = spark.read.schema(SCHEMA).csv(path, sep="\t" if kind == "tsv" else ",", header=True, quote="", emptyValue="", nullValue="\0")
    return validated(df.withColumn("sequence", F.coalesce("sequence", F.lit(""))))


def write_counts(counts: DataFrame, path: str) -> None:
    """One file in rank order, unquoted, with a header."""
    kind = format_of(path)
    one = validated(counts).orderBy("rank").coalesce(1)
    folder = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".counts-")
    try:
        out = os.path.join(folder, "out")
        if kind == "parquet":
            one.write.parquet(out)
        else:
            one.write.csv(out, sep="\t" if kind == "tsv" else ",", header=True, quote="", emptyValue="")
        (part,) = glob.glob(os.path.join(out, "part-*"))
        if os.path.exists(path):
            os.remove(path)
        os.rename(part, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def ranks_consecutive(counts: DataFrame) -> DataFrame:
    """Rows whose rank is not their place by abundance in the round."""
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.desc("reads"), "sequence"))
    return counts.withColumn("_place", place).filter(F.col("_place") != F.col("rank"))
