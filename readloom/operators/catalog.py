"""A catalog of public studies: loading and search."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCHED = ("bioproject_id", "study_title", "target")


_loaded: dict[tuple[str, str], DataFrame] = {}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a .csv, .tsv or Parquet table, read and cached once a session; it must have the searched columns."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _loaded:
        kind = os.path.splitext(path.rstrip("/"))[1].lower()
        if kind in (".csv", ".tsv"):
            found = spark.read.csv(path, sep="\t" if kind == ".tsv" else ",", header=True, multiLine=True, escape='"')
        else:
            found = spark.read.parquet(path)
        missing = [c for c in SEARCHED if c not in found.columns]
        if missing:
            raise ValueError(f"The catalog lacks the columns {', '.join(missing)}.")
        _loaded[key] = found.cache()
    return _loaded[key]


def search(catalog: DataFrame, query: str | None = None, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows that contain the query as it stands, in any case, anywhere in the searched columns; all rows without one."""
    if query is None:
        return catalog
    if not isinstance(query, str) or not query:
        raise ValueError("`query` must be None or a text that is not empty.")
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return catalog.filter(text.contains(query.lower()))
