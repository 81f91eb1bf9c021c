"""The engine's named queries against their SQL, on the driver's smallest tables."""

import os

import duckdb
import pytest

from loomgraph.plans import code_queries, engine_queries, language_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


QUERIES = code_queries.QUERIES | language_queries.QUERIES | engine_queries.QUERIES
ORACLES = code_queries.ORACLES | language_queries.ORACLES | engine_queries.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_engine_against_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = sql.sql(ORACLES[name]).select(*[f'"{c}"' for c in columns])
    assert sorted(sql.sql(ORACLES[name]).columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_a_replaced_table_gives_new_rows(spark, tmp_path):
    """The engine that queries share is made again once the files of its table are others."""
    parts = spark.read.parquet(f"{SF}/part.parquet")
    counts = []
    for most in (20, 60):
        parts.where(f"p_partkey < {most}").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
        counts.append(code_queries.QUERIES["code_symbols"](spark, str(tmp_path)).where("kind = 'function' and not is_test").count())
    assert counts == [20, 60]
