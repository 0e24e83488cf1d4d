"""Bucketed joins, Bloom filters, observed metrics, map levels, sorted exports, drifting schemas."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, FloatType, IntegerType, LongType, NullType, StringType, StructField, StructType, TimestampType

from portlens.operators import prospects
from portlens.operators.score import score_relational
from portlens.operators.transform import explode_vulns, flatten, latest_per_key
from portlens.plans import colocated, tables
from portlens.plans.etl import run_etl, scored_scans
from portlens.session import scratch_path
from portlens.sources.ndjson import parse_ndjson, read_ndjson
from portlens.sources.parquet import _widened, read_widened, write_scans, write_table

from .conftest import edge_banners


def _rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------- co-located tables


def test_scores_of_bucketed_tables_exchange_nothing(spark, edge_input):
    path = scratch_path(spark, "test-db")
    database = tables.ensure_database(spark, f"test_{path.rsplit('-', 1)[-1]}", path)
    deduped = latest_per_key(flatten(read_ndjson(spark, edge_input)))
    for _ in range(2):  # the second time replaces the tables
        colocated.write_colocated(spark, database, deduped, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = colocated.score_colocated(spark, database)
        plan = _plan(scored)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert _rows(scored.drop("vulns")) == _rows(score_relational(deduped, explode_vulns(deduped)).drop("vulns"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ------------------------------------------------------------ Bloom filters


def _read_rows(df):
    """Rows that the Parquet scan of a collected frame gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_lookups_of_an_ip_skip_row_groups(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.concat_ws(".", F.lit("10"), F.col("id") % 7, F.col("id") % 11, F.col("id")).alias("ip_str"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("port", "int"), ("transport", "string"), ("org", "string"), ("product", "string"), ("version", "string"), ("ip_risk_score", "long"))])
    rows = rows.repartition(8, F.rand(1))
    write_table(rows, str(tmp_path / "with"), lookup_columns=("ip_str",))
    write_table(rows, str(tmp_path / "without"))
    read = {}
    for name in ("with", "without"):
        for ip, found in (("10.3.5.38", 1), ("10.3.5.99999", 0)):
            got = prospects.ip_services(spark.read.parquet(str(tmp_path / name)), [ip])
            assert got.count() == found
            read[name, found] = _read_rows(prospects.ip_services(spark.read.parquet(str(tmp_path / name)), [ip]))
    assert read["without", 1] == read["without", 0] == 20_000
    assert read["with", 1] < 8_000 and read["with", 0] < 8_000


def test_written_scans_have_the_filters(spark, tmp_path, edge_input):
    write_scans(scored_scans(read_ndjson(spark, edge_input)), str(tmp_path / "scans"), partitions=2)
    us = spark.read.parquet(str(tmp_path / "scans")).where("country_code = 'US'")
    assert _read_rows(prospects.ip_services(us, ["1.0.0.1"])) > 0
    assert _read_rows(prospects.ip_services(us, ["1.0.0.11x"])) == 0  # between the least and the largest


# --------------------------------------------------------- observed metrics


def test_metrics_of_the_batch_job(spark, tmp_path, edge_input):
    out = run_etl(spark, edge_input, str(tmp_path / "out"))
    scans = spark.read.parquet(out.scans_path)
    banners = read_ndjson(spark, edge_input)
    assert out.metrics == {
        "n_banners": banners.count(), "n_without_key": banners.where("ip_str IS NULL OR port IS NULL").count(),
        "n_scans": scans.count(), "n_excluded": scans.where("is_excluded").count(),
        "n_exclusion_unknown": scans.where("is_excluded IS NULL").count(), "n_cves": spark.read.parquet(out.vulns_path).count()}
    empty = run_etl(spark, None, str(tmp_path / "empty"), lines=spark.createDataFrame([], "value string"))
    assert set(empty.metrics.values()) == {0}


# ------------------------------------------------------------------ levels


def test_levels_equal_direct_grids(spark):
    points = [(-90.0, -180.0, 1), (90.0, 180.0, 2), (0.0, 0.0, 3), (-0.001, -0.001, 4), (48.1, 11.5, 70), (48.1001, 11.5, None), (51.5, -0.1, 40), (91.0, 200.0, 5), (None, 1.0, 9), (1.0, None, 9)]
    scans = spark.createDataFrame(points, "latitude double, longitude double, ip_risk_score long")
    got = {(r["zoom"], r["quadkey"]): (r["n_services"], r["max_risk_score"], r["avg_risk_score"]) for r in prospects.geo_levels(scans, 6).collect()}
    expected: dict = {}
    for lat, lon, score in points:
        if lat is None or lon is None:
            continue
        for zoom in range(7):
            side = 1 << zoom
            x, y = (min(side - 1, max(0, int((v + s / 2) // (s / side)))) for v, s in ((lon, 360.0), (lat, 180.0)))
            key = "".join(str(2 * (y >> (zoom - i) & 1) + (x >> (zoom - i) & 1)) for i in range(1, zoom + 1))
            expected.setdefault((zoom, key), []).append(score)
    assert set(got) == set(expected)
    for cell, scores in expected.items():
        known = [s for s in scores if s is not None]
        assert got[cell][0] == len(scores) and got[cell][1] == max(known, default=None)
        assert got[cell][2] == (pytest.approx(sum(known) / len(known)) if known else None)
    assert all(any(k[0] == z - 1 and key.startswith(k[1]) for k in got) for z, key in got if z)
    plan = prospects.geo_levels(scans, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1


# ----------------------------------------------------------------- exports


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_sorted_export(spark, tmp_path, file_format):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("key"), F.concat(F.lit("a,\"b\"\n"), "id").alias("text")).repartition(6)
    order = [F.col("key").desc()]
    prospects.export_sorted(rows, str(tmp_path / "out"), order, file_format, file_bytes=20_000, file_rows=300)
    files = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    assert len(files) > 10
    reader = spark.read.schema(rows.schema)
    if file_format == "csv":
        reader = reader.option("header", True).option("multiLine", True)
    keys = []
    for f in files:
        part = [r["key"] for r in reader.format(file_format).load(str(tmp_path / "out" / f)).collect()]
        assert 0 < len(part) <= 300
        keys += part
    assert keys == list(range(4_999, -1, -1))


# ------------------------------------------------------------ schema drift


def test_widening():
    s = lambda *fields: StructType([StructField(n, t) for n, t in fields])
    cases = [
        (IntegerType(), LongType(), LongType()), (LongType(), IntegerType(), LongType()), (IntegerType(), FloatType(), DoubleType()),
        (LongType(), DoubleType(), DoubleType()), (DateType(), TimestampType(), TimestampType()), (IntegerType(), StringType(), StringType()),
        (NullType(), IntegerType(), IntegerType()), (ArrayType(IntegerType()), ArrayType(LongType()), ArrayType(LongType())),
        (s(("a", IntegerType())), s(("b", StringType()), ("a", LongType())), s(("a", LongType()), ("b", StringType()))), (DateType(), IntegerType(), StringType()),
    ]
    for a, b, expected in cases:
        assert _widened(a, b) == expected


def test_batches_with_other_types_and_columns(spark, tmp_path):
    big = 1 << 40
    spark.createDataFrame([(1, "a", 1.5)], "k int, `odd.name` string, x float").write.parquet(str(tmp_path / "1"))
    spark.createDataFrame([(big, 7)], "k long, extra int").write.parquet(str(tmp_path / "2"))
    spark.createDataFrame([("t", None)], "extra string, k int").write.parquet(str(tmp_path / "3"))
    got = read_widened(spark, [str(tmp_path / n) for n in "123"])
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("k", "bigint"), ("odd.name", "string"), ("x", "float"), ("extra", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", 1.5, None), (big, None, None, "7"), (None, None, None, "t")], key=repr)
    assert "PushedFilters: [IsNotNull(k), EqualTo(k," in _plan(got.where(F.col("k") == big))


def test_parse_is_unchanged_by_observing(spark):
    lines = spark.createDataFrame([(x,) for x in edge_banners()], "value string")
    assert parse_ndjson(lines).count() == 18
