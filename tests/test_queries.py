"""Every query against its SQL at the smallest size."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(spark, db, sf_dir, query, sql):
    rows = [r.asDict() for r in query(spark, sf_dir).collect()]
    other = db.sql(sql)
    names = sorted(other.columns)
    want = sorted(tuple(plain(dict(zip(other.columns, r))[n]) for n in names) for r in other.fetchall())
    assert not rows or sorted(rows[0]) == names
    assert sorted(tuple(plain(r[n]) for n in names) for r in rows) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, db, sf_dir, name):
    same(spark, db, sf_dir, entry.queries()[name], queries.SQL[name])


def test_unit_vectors_that_round_to_zero(spark, tmp_path):
    """Small negative values become -0.0 in both; halves, zero vectors, nulls and NaN."""
    rows = [(0, [1.0, -3e-7, 3e-7, -0.0]), (1, [-1.0, -4.999e-7, -5.001e-7, 0.5]), (2, [127.0, -15.0, 5.0, -2.0, 1.0]), (3, [0.0, -0.0]), (4, []), (5, None), (6, [math.nan, 1.0]), (7, [-1e-30, 2e-30])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    same(spark, c, str(tmp_path), queries.l2_normalize, queries.SQL["l2_normalize"])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
