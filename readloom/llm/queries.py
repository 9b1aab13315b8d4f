"""The registered queries of this subpackage, ``opN_<name>``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level_counter():
    """The automaton of the byte-level vocabulary, for token counts and packing."""
    from .wordpiece import build, byte_level_pieces

    return build(*byte_level_pieces(tokenizer_path("byte_bpe_50k.json")))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import tokenize

    return tokenize(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
) WHERE rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents"), byte_level_counter())


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_cnn import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    found = identify(docs, train(docs, ~held_out), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import classify, train

    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return classify(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract, train

    return extract(table(spark, sf_dir, "pages"), train())


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), byte_level_counter())


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_lm import score_texts

    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 5) == 1
    return score_texts(docs, docs.filter(~held_out)).withColumn("held_out", held_out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_top_k": op2_top_k,
    "op3_packing": op3_packing,
    "op4_chosen_path": op4_chosen_path,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_nbsvm": op6_nbsvm,
    "op7_html_lstm": op7_html_lstm,
    "op8_nn_descent": op8_nn_descent,
    "op9_token_counts": op9_token_counts,
    "op10_bloom_lm": op10_bloom_lm,
}

ORACLE: dict[str, str] = {"op2_top_k": OP2_SQL}
