"""Reading tables, staging results on shared storage and null-safe helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; only a local master may do without one, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share.")
        root = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/readloom-{uuid.uuid4().hex}"


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, survives lost executors.

    With ``by``, a folder for each value of that column, so that a filter on it reads no other.
    """
    spark = df.sparkSession
    path = stage_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*/readloom-[0-9a-f]{32}(?=/)", f))}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_name(*columns: Column) -> list[Column]:
    """128 bits that tell rows apart by their values, as two columns ``_row`` and ``_twin``."""
    return [F.xxhash64(*columns).alias("_row"), F.xxhash64(F.lit(0x7EA1), *columns).alias("_twin")]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with as many underscores before it as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def quoted(name: str) -> str:
    """A column name as it is, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def numbered(names: list[str]) -> list[Column]:
    """Columns under names that clash with nothing and that any operator takes."""
    return [F.col(quoted(n)).alias(f"_{k}") for k, n in enumerate(names)]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more; rounds would pile them up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, where the C library can; workers live on between stages."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def fold_of(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts


def fold(value: int, parts: int) -> int:
    return crc32(str(value).encode()) % parts


#: Rows and bytes of one Arrow batch at most, so that long texts don't pile up in a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH where they are higher or off."""
    for key, most in BATCH.items():
        now = re.match(r"-?\d+", str(spark.conf.get(key)))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


_MOVES = re.compile(r"^[\s:+|-]*(Join|Aggregate|Sort|Window|Repartition|RebalancePartitions|Deduplicate|Distinct|FlatMapGroups|GlobalLimit|Generate)", re.M)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly when a scan alone gives fewer partitions than there are cores.

    A plan with a shuffle in it stays as it is: asking for its partitions would run it.
    """
    small_batches(df.sparkSession)
    if _MOVES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
