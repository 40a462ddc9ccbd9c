import collections
import math
import random

import duckdb
import pytest

from axisloom import plan_queries  # noqa: F401
from axisloom.queries import CATALOGUE

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_matches_its_sql(spark, db, name, tmp_path):
    query, sql = CATALOGUE[name]
    df = query(spark, SMALL)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    df.write.parquet(f"{tmp_path}/out")
    expected, got = db.sql(f"SELECT {columns} FROM ({sql})"), db.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    assert list(map(str, expected.types)) == list(map(str, got.types))
    assert collections.Counter(map(repr, expected.fetchall())) == collections.Counter(map(repr, got.fetchall()))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_contraction_covers_every_vector(spark, tmp_path):
    rng = random.Random(3)
    rows = [(v, [float(rng.randint(-9, 9)) for _ in range(4)], v % 3) for v in [*range(60), 10**6]]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i"], r["k"]): r["dot"] for r in CATALOGUE["contraction"][0](spark, str(tmp_path)).collect()}
    mean = {k: [math.floor(1000 * (sum(xs) / len(xs))) / 1000 for xs in zip(*[e for _, e, c in rows if c == k], strict=True)] for k in range(3)}
    assert set(got) == {(v, k) for v, _, _ in rows for k in range(3)}
    assert all(abs(got[v, k] - sum(x * y for x, y in zip(e, mean[k], strict=True))) < 1e-3 for v, e, _ in rows for k in range(3))
