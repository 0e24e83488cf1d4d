"""The driver contract, every registered query against its DuckDB SQL, and
properties of the scored tables over the derived banners."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from portlens.operators.rollup import org_scores
from portlens.operators.score import score_fused, score_relational
from portlens.operators.transform import explode_vulns, flatten, latest_per_key
from portlens.plans.catalog import QUERIES
from portlens.plans.oracle import ORACLE_SQL
from portlens.sources.banners import driver_banner_lines
from portlens.sources.ndjson import parse_ndjson
from tools.oracle_check import TABLES, digest, type_diff

from .conftest import SF_SMALL


def test_entry_smoke(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["org", "total_ips", "total_open_ports", "max_risk_score", "avg_risk_score",
                          "countries", "combined_risk_score"]


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(contract.oracle_sql()[name])
    assert type_diff(df.schema, rel.columns, rel.types) == {}
    cur = duck.execute(contract.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.fixture(scope="module")
def deduped(spark):
    return latest_per_key(flatten(parse_ndjson(driver_banner_lines(spark, SF_SMALL)))).cache()


def _set(df):
    return sorted((tuple(r) for r in df.drop("vulns").collect()), key=repr)


def test_fused_equals_relational(deduped):
    assert _set(score_fused(deduped)) == _set(score_relational(deduped, explode_vulns(deduped)))


def test_dedup_idempotent(deduped):
    again = latest_per_key(deduped.withColumn("hash", F.lit(0).cast("long")))
    assert _set(again) == _set(deduped)


def test_dedup_invariant_under_input_order(spark, deduped):
    shuffled = parse_ndjson(driver_banner_lines(spark, SF_SMALL)).repartition(7).sortWithinPartitions(F.rand(3))
    assert _set(latest_per_key(flatten(shuffled))) == _set(deduped)


def test_score_properties(deduped):
    scored = score_fused(deduped)
    assert scored.where("ip_risk_score > 100").count() == 0
    assert scored.where("is_excluded = TRUE AND ip_risk_score <> 0").count() == 0
    assert scored.groupBy("ip_str", "port").count().where("count > 1").count() == 0
    orgs = org_scores(scored)
    assert orgs.where("combined_risk_score > 100").count() == 0
    assert orgs.where("total_open_ports < total_ips").count() == 0
