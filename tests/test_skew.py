"""A key or organisation holding a third of all rows: results stay whole and
exact (the map-side limits and partial aggregates do the heavy lifting)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portlens.operators.rollup import org_scores
from portlens.operators.transform import latest_per_key

N = 60000


def _flat(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(N).repartition(16).select(
        F.when(hot, F.lit("9.9.9.9")).otherwise(F.concat(F.lit("10.0."), F.col("id").cast("string"))).alias("ip_str"),
        F.when(hot, F.lit(443)).otherwise((F.col("id") % 1000).cast("int")).alias("port"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % N).alias("timestamp"),
        F.when(hot, F.lit("HotOrg")).otherwise(F.concat(F.lit("org-"), (F.col("id") % 50).cast("string")))
        .alias("org"),
        F.col("id").alias("hash"),
    )


def test_hot_key_dedup(spark):
    flat = _flat(spark)
    kept = latest_per_key(flat, drop_tie_break=False)
    assert kept.count() == N - N // 3 + 1
    hot = kept.where("ip_str = '9.9.9.9'").collect()
    expected = (flat.where("ip_str = '9.9.9.9'")
                .orderBy(F.col("timestamp").desc(), F.col("hash").desc()).first())
    assert len(hot) == 1 and hot[0].hash == expected.hash


def test_hot_org_rollup(spark):
    scans = latest_per_key(_flat(spark).withColumn("hash", F.col("hash")), drop_tie_break=True).select(
        "org", "ip_str", "port",
        (F.length("ip_str") % 7).cast("long").alias("ip_risk_score"),
        F.lit(False).alias("is_excluded"),
        F.lit("X").alias("country_name"),
    )
    rows = {r.org: r for r in org_scores(scans).collect()}
    assert rows["HotOrg"].total_ips == 1 and rows["HotOrg"].total_open_ports == 1
    assert sum(r.total_open_ports for r in rows.values()) == scans.count()


def test_hot_org_join_is_split_by_aqe(spark, tmp_path):
    """Deep dive over a materialized org_scores table with broadcasts off:
    AQE's skew join splits the dominant organisation's partition."""
    import contextlib
    import io

    from portlens.operators import prospects
    from portlens.sources.parquet import read_table, write_table

    hot = F.col("id") % 3 == 0
    scans = spark.range(200000).repartition(16).select(
        F.when(hot, F.lit("HotOrg")).otherwise(F.concat(F.lit("org-"), (F.col("id") % 500).cast("string")))
        .alias("org"),
        F.concat(F.lit("10.0."), F.col("id").cast("string")).alias("ip_str"),
        (F.col("id") % 1000).cast("int").alias("port"), F.lit("tcp").alias("transport"),
        F.lit(None).cast("string").alias("product"), F.lit(None).cast("string").alias("version"),
        (F.col("id") % 100).alias("ip_risk_score"), F.lit(False).alias("is_excluded"),
        F.lit("X").alias("country_name"),
    )
    write_table(org_scores(scans), str(tmp_path / "orgs"))
    orgs = read_table(spark, str(tmp_path / "orgs"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = prospects.org_infrastructure(scans, orgs)
        assert len(df.collect()) == 200000
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        assert "SortMergeJoin(skew=true)" in buf.getvalue()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
