"""Catalog tables: either form dropped, rebuilt tables, defaults, keys, the serving refresh."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from portlens.operators.rollup import org_scores
from portlens.plans import tables
from portlens.plans.etl import run_etl
from portlens.plans.serving import PUBLISHED, publish, serve
from portlens.schema import pitch_schema
from portlens.session import scratch_path
from portlens.sources.parquet import read_table


@pytest.fixture
def database(spark):
    path = scratch_path(spark, "test-db")
    return tables.ensure_database(spark, f"test_{path.rsplit('-', 1)[-1]}", path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_drop_any(spark, database):
    name = f"{database}.thing"
    tables.drop_any(spark, name)
    spark.sql(f"CREATE VIEW {name} AS SELECT 1 AS a")
    tables.drop_any(spark, name)
    assert not spark.catalog.tableExists(name)
    spark.sql(f"CREATE TABLE {name} (a INT) USING parquet")
    tables.drop_any(spark, name)
    assert not spark.catalog.tableExists(name)
    spark.range(1).createOrReplaceTempView("a_temp_view_of_this_test")
    tables.drop_any(spark, "a_temp_view_of_this_test")
    assert not spark.catalog.tableExists("a_temp_view_of_this_test")


@pytest.mark.parametrize("old", [None, "VIEW", "TABLE"])
def test_create_table_as_replaces_either_form(spark, database, old):
    name = f"{database}.result"
    if old == "VIEW":
        spark.sql(f"CREATE VIEW {name} AS SELECT 'x' AS other")
    if old == "TABLE":
        spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT 'x' AS other")
    assert _rows(tables.create_table_as(spark, name, spark.range(3))) == [(0,), (1,), (2,)]
    assert spark.catalog.getTable(name).tableType == "MANAGED"
    again = tables.create_table_as(spark, name, spark.table(name).where("id > 0"))  # reads what it replaces
    assert _rows(again) == [(1,), (2,)]


def test_a_failed_rebuild_leaves_the_old_table(spark, database):
    name = f"{database}.result"
    tables.create_table_as(spark, name, spark.range(3))
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    for _ in range(2):
        with pytest.raises(PySparkException):
            tables.create_table_as(spark, name, broken)
        assert _rows(spark.table(name)) == [(0,), (1,), (2,)]
    assert _rows(tables.create_table_as(spark, name, spark.range(1))) == [(0,)]


def test_written_codec_is_snappy(spark, database):
    tables.create_table_as(spark, f"{database}.coded", spark.range(3))
    assert all(".snappy.parquet" in f for f in spark.table(f"{database}.coded").inputFiles())


def test_defaults_keys_and_upserts(spark, database):
    name = f"{database}.ai_pitches"
    for _ in range(2):  # the second call finds the table
        tables.create_if_absent(spark, name, pitch_schema, "org", {"generated_at": "current_timestamp()", "tone": "'plain'"})
    spark.sql(f"INSERT INTO {name} (org, pitch_text) VALUES ('a', 'v1')")
    assert tables.table_key(spark, name) == ["org"]
    row = spark.table(name).withColumn("age", F.current_timestamp().cast("double") - F.col("generated_at").cast("double")).first()
    assert 0 <= row["age"] < 600 and row["tone"] == "plain" and row["focus_area"] is None
    then = dt.datetime(2024, 1, 1)
    more = spark.createDataFrame([("b", "v1", then), ("a", "v2", then), ("a", "v3", dt.datetime(2024, 1, 2)), (None, "v9", then)],
                                 "org string, pitch_text string, generated_at timestamp")
    got = tables.upsert(spark, name, more, order_by="generated_at")
    assert _rows(got.select("org", "pitch_text", "tone")) == [("a", "v3", "plain"), ("b", "v1", "plain")]
    late = tables.upsert(spark, name, spark.createDataFrame([("b", "v2")], "org string, pitch_text string"))
    assert {r["org"]: (r["pitch_text"], r["generated_at"] > dt.datetime(2024, 6, 1)) for r in late.collect()} == {"a": ("v3", False), "b": ("v2", True)}
    spark.sql(f"INSERT INTO {name} (org, pitch_text) VALUES ('c', 'v1')")  # the default outlives the rewrites
    assert spark.table(name).where("org = 'c' AND tone = 'plain' AND generated_at IS NOT NULL").count() == 1
    assert tables.table_key(spark, name) == ["org"]


def test_upsert_needs_a_key(spark, database):
    tables.create_table_as(spark, f"{database}.plain", spark.range(1))
    with pytest.raises(ValueError):
        tables.upsert(spark, f"{database}.plain", spark.range(2))


def test_serve(spark, tmp_path, edge_input, database):
    root, t0 = str(tmp_path / "out"), dt.datetime(2024, 5, 1)
    assert serve(spark, root, database, now=t0) is False  # nothing written yet
    assert spark.catalog.tableExists(f"{database}.ai_pitches")
    spark.sql(f"CREATE TABLE {database}.scans (old INT) USING parquet")
    out = run_etl(spark, edge_input, root)
    later = lambda s: t0 + dt.timedelta(seconds=s)
    assert serve(spark, root, database, now=t0) is True
    assert serve(spark, root, database, now=later(600)) is False
    assert serve(spark, root, database, now=later(601)) is True
    assert serve(spark, root, database, now=later(602), force=True) is True
    tables.upsert(spark, f"{database}.db_metadata", spark.createDataFrame([("last_refresh_time", "no time")], "key string, value string"))
    assert serve(spark, root, database, now=later(603)) is True
    scans = read_table(spark, out.scans_path)
    assert _rows(spark.table(f"{database}.org_scores")) == _rows(org_scores(scans))
    assert spark.table(f"{database}.scans").count() == scans.count()
    assert spark.table(f"{database}.vulns").count() == read_table(spark, out.vulns_path).count()
    assert [r["value"] for r in spark.table(f"{database}.db_metadata").collect()] == [later(603).isoformat()]


def test_serve_without_vulns(spark, tmp_path, edge_input, database):
    out = run_etl(spark, edge_input, str(tmp_path / "out"))
    read_table(spark, out.scans_path).write.parquet(str(tmp_path / "only" / "scans"))
    assert serve(spark, str(tmp_path / "only"), database) is True
    vulns = spark.table(f"{database}.vulns")
    assert vulns.count() == 0 and vulns.columns == ["ip_str", "port", "org", "cve_id", "cvss", "epss", "cve_summary", "cve_verified"]


def test_tables_are_published_together_or_not_at_all(spark, tmp_path, edge_input, database):
    out = run_etl(spark, edge_input, str(tmp_path / "out"))
    serve(spark, str(tmp_path / "out"), database)
    target = f"{database}_published"
    assert publish(spark, database, target) == ["scans", "vulns", "org_scores"]
    state = lambda: {n: _rows(spark.table(f"{target}.{n}").drop("vulns", "tags")) for n in PUBLISHED}
    before = state()
    assert len(before["scans"]) == read_table(spark, out.scans_path).count()
    # a third table that fails leaves the other two as they were
    broken = spark.table(f"{database}.org_scores").withColumn("org", F.raise_error(F.lit("lost")).cast("string"))
    news = {f"{target}.scans": spark.table(f"{database}.scans").where("port = 80"), f"{target}.vulns": spark.table(f"{database}.vulns").limit(1), f"{target}.org_scores": broken}
    with pytest.raises(PySparkException):
        tables.create_tables_as(spark, news)
    assert state() == before
    tables.drop_any(spark, f"{database}.vulns")
    assert publish(spark, database, target) == ["scans", "org_scores"]
    assert state() == before
