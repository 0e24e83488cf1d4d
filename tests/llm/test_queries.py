"""The registered queries against their SQL, whole tables."""

from __future__ import annotations

import duckdb
import pytest

from portlens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, rows.select(*columns).collect()))) == sorted(map(repr, expected))
