"""Work that grows with the events only: lines parsed once, even tasks, updates computed once."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from portlens.plans import catalog, tables
from portlens.plans.refresh import keyed_upsert
from portlens.sources.banners import driver_banner_lines
from portlens.sources.ndjson import parse_ndjson
from portlens.sources.parquet import write_table

from .conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("extended")
    return buf.getvalue().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def one_row_group(spark, tmp_path_factory):
    """20,000 events in one row group, which a reader of small splits takes for many partitions."""
    root = str(tmp_path_factory.mktemp("events"))
    e = F.col("id")
    events = spark.range(20_000).coalesce(1).select(
        e.alias("event_id"), (e * 7 % 1500).alias("user_id"), (e % 100).cast("double").alias("value"),
        F.timestamp_seconds(e + 1_700_000_000).cast("timestamp_ntz").alias("ts"))
    events.write.parquet(f"{root}/events.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{root}/nation.parquet")
    return root


def test_a_line_is_made_and_parsed_once(spark):
    text = plan(parse_ndjson(driver_banner_lines(spark, SF_SMALL)))
    assert text.count("from_json(") == 1 and text.count("StructsToJsonEvaluator") == 1


def test_blank_malformed_and_array_lines_are_read_as_before(spark):
    lines = [None, "", " \t", "[]", "not json", "5", '{"ip_str": "a"}', '[{"ip_str": "b"}, {"ip_str": "c"}]']
    rows = parse_ndjson(spark.createDataFrame([(x,) for x in lines], "value string")).select("ip_str").collect()
    assert sorted(str(r[0]) for r in rows) == ["None", "None", "a", "b", "c"]


@pytest.mark.parametrize("frame", [driver_banner_lines, lambda s, d: catalog._snapshot_lines(s, d, earlier=True)])
def test_events_of_one_row_group_are_dealt_to_all_tasks(spark, one_row_group, frame):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "4096")
        lines = frame(spark, one_row_group)
        counts = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert sum(counts) == 20_000 and max(counts) <= 20_000 / cores + cores


def test_scans_read_twice_are_stored(spark):
    for query in (catalog.q_org_deep_dive, catalog.q_outreach_context, catalog.q_org_cves, catalog.q_scored_scans):
        assert "from_json(" not in plan(query(spark, SF_SMALL))


def counted(spark, keys: int):
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    return seen, spark.range(keys).select(F.col("id").alias("k"), F.udf(mark, "int")(F.lit(2)).alias("v"))


def test_keyed_upsert_computes_the_updates_once(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(10, 60).select(F.col("id").alias("k"), F.lit(1).alias("v")), path)
    seen, updates = counted(spark, 20)
    rows = {r["k"]: r["v"] for r in keyed_upsert(spark, path, updates, "k").collect()}
    assert rows == {k: 2 if k < 20 else 1 for k in range(60)} and seen.value == 20


def test_catalog_upsert_computes_the_updates_once(spark):
    database = catalog._database(spark, "growth")
    name = f"{database}.t"
    tables.create_if_absent(spark, name, spark.range(1).select(F.col("id").alias("k"), F.lit(1).alias("v")).schema, "k")
    tables.upsert(spark, name, spark.range(10, 60).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    seen, updates = counted(spark, 20)
    rows = {r["k"]: r["v"] for r in tables.upsert(spark, name, updates).collect()}
    assert rows == {k: 2 if k < 20 else 1 for k in range(60)} and seen.value == 20
