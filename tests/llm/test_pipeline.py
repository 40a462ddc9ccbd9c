import collections
import hashlib
import os
import zlib

import duckdb
import public_tokenizers as P
import pytest

import corpus_pipeline as pipeline
from axisloom.llm import _io, queries
from axisloom.llm._vocab import library
from brute import brute_components

SMALL = "/root/testdata/sf0.001"


def test_pipeline_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        assert seen[-1] <= rows
        rows = seen[-1]
    assert seen[1] == seen[0] and docs.filter("n_chars <> length(text)").count() == 0
    before = spark.read.parquet(f"{tmp_path}/line_dedup")
    want = {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()]) if d == c}
    assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/ngram_join").collect()} == want
    last = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    tok = library(P.path("byte_bpe_50k.json"))
    for r in docs.collect():
        ids = tok.encode(r["text"], add_special_tokens=False).ids
        assert last[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (None, "the cat sat on the mat", "en", "s", 22), (3, "the cat sat on the mat", "en", "s", 22), (3, "the cat sat on the mat", "en", "s", 22)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    more = docs.selectExpr("*", "doc_id AS nth", "1 AS N_lines", "'x' AS component_id", "2 AS id", "text AS body", "doc_id AS leak")
    for data in (docs, docs.limit(0), more):
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, data, SMALL)
            assert out.count() <= len(rows), name
            assert k == 4 or out.columns == data.columns
    long = docs.selectExpr("doc_id", "repeat(text, 60000) AS text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, long, SMALL).count() == (0, 5, 4, 5, 5)[k] or k == 0


def test_run_drops_the_tables_between_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_io, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert pipeline.run(spark, SMALL).count() > 50
    assert [f.split("-")[2] for f in os.listdir(tmp_path) if f.startswith("pipeline-")] == ["bpe"]


def test_a_much_copied_page_keeps_its_text(spark):
    page = "a first line of its own\na second line of its own"
    rows = [(d, page + "\nshared", "en", "s", 0) for d in range(20)] + [(100 + d, f"text {d} alone\nshared", "en", "s", 0) for d in range(40)]
    out = pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), SMALL).collect()
    assert len(out) == 60 and all(r["text"] == (page if r["doc_id"] < 20 else f"text {r['doc_id'] - 100} alone") for r in out)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name, tmp_path):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    columns = ", ".join(sorted(df.columns))
    df.write.parquet(f"{tmp_path}/out")
    want, got = c.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})"), c.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    assert collections.Counter(map(repr, want.fetchall())) == collections.Counter(map(repr, got.fetchall()))


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
