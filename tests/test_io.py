"""Round trips through storage: NDJSON (plain/gz/zst), partitioned Parquet,
optional tables, keyed upsert, TTL refresh and publish."""

from __future__ import annotations

import datetime as dt
import gzip
import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from portlens.config import Options
from portlens.plans.etl import run_etl, scored_scans
from portlens.plans.refresh import ensure_table, keyed_upsert, refresh_org_scores
from portlens.schema import metadata_schema, pitch_schema, vulns_schema
from portlens.sources.ndjson import read_ndjson, write_ndjson_zst
from portlens.sources.parquet import publish, read_optional, read_table, write_scans, write_version

from .conftest import edge_banners


def _rows(df, cols=None):
    cols = cols or sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_compressed_inputs_read_the_same(spark, tmp_path, edge_input):
    text = ("\n".join(edge_banners()) + "\n").encode()
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "b.json.gz").write_bytes(gzip.compress(text))
    (tmp_path / "zst").mkdir()
    with pafs.LocalFileSystem().open_output_stream(str(tmp_path / "zst" / "b.json.zst"), compression="zstd") as f:
        f.write(text)
    plain = read_ndjson(spark, edge_input).drop("vulns")
    for sub in ("gz", "zst"):
        assert _rows(read_ndjson(spark, str(tmp_path / sub)).drop("vulns")) == _rows(plain)


def test_zst_sink_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in edge_banners()], "value string").repartition(3)
    n = write_ndjson_zst(lines, str(tmp_path / "out"))
    assert n == 18
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".json.zst")]) == 3
    assert read_ndjson(spark, str(tmp_path / "out")).count() == 18


def test_partitioned_scans_round_trip(spark, tmp_path, edge_input):
    scored = scored_scans(read_ndjson(spark, edge_input))
    write_scans(scored, str(tmp_path / "scans"), partitions=4)
    back = read_table(spark, str(tmp_path / "scans"))
    parts = sorted(p for p in os.listdir(tmp_path / "scans") if p.startswith("country_code="))
    # NULL -> 'unknown'; '' becomes Hive's default partition and reads back NULL
    assert "country_code=unknown" in parts and "country_code=__HIVE_DEFAULT_PARTITION__" in parts
    expected = scored.withColumn("country_code", F.coalesce("country_code", F.lit("unknown")))
    expected = expected.withColumn("country_code", F.when(F.col("country_code") != "", F.col("country_code")))
    assert _rows(back.drop("vulns")) == _rows(expected.drop("vulns"))


def test_empty_country_option(spark, tmp_path, edge_input):
    scored = scored_scans(read_ndjson(spark, edge_input))
    write_scans(scored, str(tmp_path / "scans"), Options(empty_country_as_unknown=True), partitions=2)
    parts = [p for p in os.listdir(tmp_path / "scans") if p.startswith("country_code=")]
    assert "country_code=__HIVE_DEFAULT_PARTITION__" not in parts


def test_etl_outputs_agree(spark, tmp_path, edge_input):
    out = run_etl(spark, edge_input, str(tmp_path / "out"))
    scans = read_table(spark, out.scans_path)
    vulns = read_table(spark, out.vulns_path)
    assert scans.count() == 14 and vulns.count() == 9
    # every CVE row belongs to a written scan row (same dedup decision)
    keyed = vulns.where("ip_str IS NOT NULL").join(scans, ["ip_str", "port"], "left_anti")
    assert keyed.count() == 0


def test_optional_table(spark, tmp_path):
    df = read_optional(spark, str(tmp_path / "missing"), vulns_schema)
    assert df.count() == 0 and df.columns == [f.name for f in vulns_schema.fields]


def test_merge_schema_read(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, a string").write.parquet(str(tmp_path / "t" / "part=1"))
    spark.createDataFrame([(2, "b", 3.0)], "k int, a string, extra double").write.parquet(str(tmp_path / "t" / "part=2"))
    back = read_table(spark, str(tmp_path / "t"))
    assert set(back.columns) == {"k", "a", "extra", "part"}
    assert sorted(tuple(r) for r in back.select("k", "extra").collect()) == [(1, None), (2, 3.0)]


def test_keyed_upsert_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "pitches")
    ensure_table(spark, path, pitch_schema)
    t = dt.datetime(2024, 1, 1)
    keyed_upsert(spark, path, spark.createDataFrame([("a", "v1", t, "x", "y"), ("b", "v1", t, "x", "y")],
                                                    pitch_schema), "org")
    out = keyed_upsert(spark, path, spark.createDataFrame([("b", "v2", t, "x", "y"), ("c", "v1", t, "x", "y")],
                                                          pitch_schema), "org")
    assert sorted((r.org, r.pitch_text) for r in out.collect()) == [("a", "v1"), ("b", "v2"), ("c", "v1")]


def test_refresh_ttl(spark, tmp_path, edge_input):
    root = str(tmp_path / "serving")
    run_etl(spark, edge_input, root)
    t0 = dt.datetime(2024, 5, 1, 12, 0, 0)
    assert refresh_org_scores(spark, root, now=t0) is True                                   # table missing
    assert refresh_org_scores(spark, root, now=t0 + dt.timedelta(seconds=599)) is False      # fresh
    assert refresh_org_scores(spark, root, now=t0 + dt.timedelta(seconds=599), force=True)   # forced
    t1 = t0 + dt.timedelta(seconds=599)
    assert refresh_org_scores(spark, root, now=t1 + dt.timedelta(seconds=601)) is True       # stale
    # unreadable stamp -> rebuild
    keyed_upsert(spark, f"{root}/db_metadata",
                 spark.createDataFrame([("last_refresh_time", "not a time")], metadata_schema), "key")
    assert refresh_org_scores(spark, root, now=t1) is True
    assert read_table(spark, f"{root}/org_scores").count() == 3
    meta = read_table(spark, f"{root}/db_metadata").collect()
    assert len(meta) == 1 and meta[0].value == t1.isoformat()


def test_publish_skips_absent_optional(spark, tmp_path, edge_input):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    out = run_etl(spark, edge_input, src)
    refresh_org_scores(spark, src, force=True)
    assert publish(spark, src, dst) == ["scans", "vulns", "org_scores"]
    assert read_table(spark, f"{dst}/scans").count() == 14
    # without a vulns table the copy still succeeds
    src2, dst2 = str(tmp_path / "src2"), str(tmp_path / "dst2")
    read_table(spark, out.scans_path).write.partitionBy("country_code").parquet(f"{src2}/scans")
    read_table(spark, f"{src}/org_scores").write.parquet(f"{src2}/org_scores")
    assert publish(spark, src2, dst2) == ["scans", "org_scores"]


def test_hot_country_is_split_across_files(spark, tmp_path):
    """One country with most rows is written by several tasks (AQE splits
    the rebalance partition by measured size) and no row is lost."""
    rows = spark.range(40000).select(
        F.when(F.col("id") % 10 != 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), (F.col("id") % 5).cast("string")))
        .alias("country_code"),
        F.concat(F.lit("org-"), (F.col("id") % 7).cast("string")).alias("org"),
        F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("ip_str"),
        (F.col("id") % 1000).cast("int").alias("port"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_scans(rows, str(tmp_path / "scans"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    hot = [f for f in os.listdir(tmp_path / "scans" / "country_code=HOT") if f.endswith(".parquet")]
    assert len(hot) > 1
    back = read_table(spark, str(tmp_path / "scans"))
    assert back.count() == 40000 and back.where("country_code = 'HOT'").count() == 36000


def test_refresh_age_ignores_time_zones(spark, tmp_path):
    from portlens.plans.refresh import last_refresh_age_seconds

    path = str(tmp_path / "meta")
    t0 = dt.datetime(2024, 5, 1, 12, 0, 0)
    keyed_upsert(spark, path, spark.createDataFrame([("last_refresh_time", t0.isoformat())], metadata_schema), "key")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert last_refresh_age_seconds(spark, path, t0 + dt.timedelta(seconds=601)) == 601.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_single_compressed_file_parsed_in_parallel(spark, tmp_path, edge_input):
    """One big .zst is one scan task; with min_partitions the lines are spread
    before parsing, and the rows equal the plain reader's (blank lines too)."""
    text = ("\n".join(edge_banners()[:8] + ["", "   "] + edge_banners()[8:]) + "\n\n").encode()
    (tmp_path / "one").mkdir()
    with pafs.LocalFileSystem().open_output_stream(str(tmp_path / "one" / "b.json.zst"), compression="zstd") as f:
        f.write(text)
    direct = read_ndjson(spark, str(tmp_path / "one"))
    spread = read_ndjson(spark, str(tmp_path / "one"), min_partitions=4)
    assert spread.rdd.getNumPartitions() == 4
    assert _rows(spread.drop("vulns")) == _rows(direct.drop("vulns")) == _rows(read_ndjson(spark, edge_input).drop("vulns"))
    assert direct.count() == 18


def test_refresh_without_scans_builds_nothing_but_pitch_table(spark, tmp_path):
    root = str(tmp_path / "empty")
    assert refresh_org_scores(spark, root, force=True) is False
    assert os.path.isdir(tmp_path / "empty" / "ai_pitches")
    assert not os.path.exists(tmp_path / "empty" / "org_scores")


def test_serving_views(spark, tmp_path, edge_input):
    from portlens.plans.refresh import serving_views

    root = str(tmp_path / "serve")
    run_etl(spark, edge_input, root)
    refresh_org_scores(spark, root)
    frames = serving_views(spark, root)
    assert set(frames) == {"scans", "vulns", "org_scores", "ai_pitches"}
    assert spark.sql("SELECT COUNT(*) FROM org_scores").first()[0] == 3
    assert spark.sql("SELECT COUNT(*) FROM scans WHERE country_code = 'unknown'").first()[0] > 0


def test_versions_switch_at_once(spark, tmp_path):
    """A reader that began keeps its state, a failed write changes nothing, older states go."""
    path = str(tmp_path / "t")
    write_version(spark, spark.range(1), path)
    first = read_table(spark, path)
    write_version(spark, spark.range(2), path)
    assert first.count() == 1 and read_table(spark, path).count() == 2
    with pytest.raises(Exception, match="no good"):
        write_version(spark, spark.range(3).selectExpr("raise_error('no good') AS id"), path)
    assert read_table(spark, path).count() == 2
    write_version(spark, read_table(spark, path).unionByName(spark.range(5)), path)
    assert read_table(spark, path).count() == 7
    assert len([n for n in os.listdir(path) if n.startswith("_v-")]) == 2
