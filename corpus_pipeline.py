"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of ``documents``:

1. ``language_id`` drops documents whose language can't be identified;
2. ``line_dedup`` takes site boilerplate lines out of the texts (``n_chars`` follows);
3. ``ngram_join`` keeps one document, that of the smallest id, of each group of linked ones;
4. ``decontamination`` drops documents that hold a benchmark item;
5. ``bpe`` encodes and decodes what is left and returns counts and digests.

Rows with a null id are never dropped by stages 3 and 4, which can't name them. Null and empty texts and
texts without letters go in stage 1, and so do all rows where no labelled row is there to learn from. An empty table gives empty
tables. Columns beyond those of ``documents`` stay, whatever their names, until stage 5.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisloom.llm._io import drop_table, read, table
from axisloom.llm.bpe_codec import round_trip
from axisloom.llm.decontaminate import without_items
from axisloom.llm.lang_id import keep_identified, train
from axisloom.llm.line_dedup import drop_boilerplate
from axisloom.llm.ngram_join import linked_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; all rows of an id are judged one by one, null ids too."""
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that are boilerplate on their source; exact copies count once for that.

    A null source is a source of its own; null texts stay null, with null ``n_chars``; a text that loses all lines is empty.
    """
    cut = drop_boilerplate(docs, copies=False).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones; of rows that repeat an id, one (the same one each time). Null ids all stay."""
    groups = linked_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(groups, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    nth = "nth" + "_" * max(map(len, docs.columns))  # a name that no column has
    one = named.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return one.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null ids stay."""
    return without_items(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, one row for each document; a null text has no tokens."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("bpe", bpe)]

#: No SQL: stages run a trained classifier and a tokenizer library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents of ``sf_dir``."""
    docs = before = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = table(stage(spark, before, sf_dir), f"pipeline-{k}-{name}")
        if k:
            drop_table(before)
        before = docs
    return docs
