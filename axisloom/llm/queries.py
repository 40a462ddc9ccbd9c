"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from axisloom.llm._io import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.lang_id import identify, train

    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.html_main import extract

    return extract(read(spark, sf_dir, "pages"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.bpe_codec import round_trip

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.secrets import secret_spans

    return secret_spans(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.token_store import read_store, write_store

    return read_store(write_store(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.knn_join import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axisloom.llm.ngram_join import linked_documents

    return linked_documents(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query, for the entry module."""
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    from axisloom.llm import decontaminate, knn_join, line_dedup, secrets

    return {"op1_decontamination": decontaminate.ORACLE, "op5_secret_spans": secrets.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op9_knn_join": knn_join.ORACLE}
