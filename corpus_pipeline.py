"""From raw documents to training batches.

Four stages, each on all that the one before kept: reject low quality, reject
texts of no clear language, keep one document of each group of near duplicates,
and lay the rest out in token-budget batches of optimal length buckets. Null and
empty texts fall to the first two stages at the latest; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import byte_cnn, near_dup, nbsvm, packing
from readloom.llm.queries import byte_level_counter
from readloom.llm.shared import fold_of, free_name, quoted, staged, table

#: A document stays if its quality score is at least the first, and its language's mean probability the second.
QUALITY, CERTAIN = 0.7, 0.35


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have no feature to speak for them and score by the model's
    bias alone. Each row is judged by itself: repeated ones, ties at the threshold
    (kept) and very long texts need no rule of their own. All columns stay.
    """
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    out = (free_name(docs, "score"), free_name(docs, "predicted"))
    return nbsvm.classify(docs, model, threshold=QUALITY, out=out).filter(F.col(out[1]) == 1).select(*map(quoted, docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear.

    Null texts and those without a letter have none and go. Repeated rows are
    judged alike, a score at the threshold stays, long texts are read whole.
    """
    net = byte_cnn.train(docs, fold_of("doc_id", 4) != 2)
    out = (free_name(docs, "lang_pred"), free_name(docs, "score"))
    found = byte_cnn.identify(docs, net, out=out)
    return found.filter((F.col(out[0]) != byte_cnn.UNDETERMINED) & (F.col(out[1]) >= CERTAIN)).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets with a similarity of 0.8 or more.

    The smallest id stays, of repeated rows one; a null id stays only where its
    class has no other. Texts without a word are like no other and stay.
    """
    return near_dup.without_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket and batch of every document left by its tokens: doc_id, length, bucket, width, batch, slot.

    A null or empty text is its end token. Repeated rows take a slot each; a text
    longer than the budget is a batch by itself, whole.
    """
    return packing.pack_texts(docs, byte_level_counter())


STAGES = [("quality classifier", quality), ("language ID", language), ("MinHash near-dedup", near_duplicates), ("packing", pack)]

#: No stage's model or search can be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
