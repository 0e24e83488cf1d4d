"""Scan banners derived from the driver's `events` and `nation` tables.

The driver data holds no internet-scan records, so each event becomes one
banner by fixed arithmetic on ``event_id`` (e) and ``user_id`` (u). The
record is serialised to one NDJSON line, exactly what the ingest step reads
from files, so every query exercises the real JSON parse. The derivation is
a narrow projection plus a lookup join against the 25-row nation table,
which Catalyst broadcasts on its own size statistics.

The same rules are written in SQL in ``portlens.plans.oracle`` for the
independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed derivation tables (test-data rules, positional by e % len).
PORT_CYCLE = (22, 23, 80, 443, 3389, 3306, 5432, 8291, 27017, 6379, 1521, 8080)
PRODUCT_CYCLE = ("Fortinet FortiGate", "DrayTek Vigor", "nginx", "HIKVISION cam")
EVENT_COLUMNS = ("event_id", "user_id", "ts", "value")
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _s(x) -> Column:
    return x.cast("string")


def _str_array(*values) -> Column:
    return F.array(*[F.lit(v).cast("string") for v in values]).cast("array<string>")


def _cve_count(e: Column, u: Column) -> Column:
    density = (u % 37) % 4
    return F.when(density == 0, e % 8).when(density == 1, e % 3).otherwise(F.lit(0)).cast("int")


def _vulns(e: Column, u: Column) -> Column:
    n = _cve_count(e, u)

    def entry(k: Column) -> Column:
        kk = k.cast("long")
        detail = F.struct(
            F.when((e + kk) % 10 != 9, ((e * 13 + kk * 29) % 101) / 10).alias("cvss"),
            (((e * 17 + kk * 31) % 100) / 100).alias("epss"),
            F.concat(F.lit("finding "), _s((e + kk) % 50)).alias("summary"),
            ((e + kk) % 5 == 0).alias("verified"),
        )
        return F.struct(F.concat(F.lit("CVE-2024-"), _s((e * 7 + kk * 3) % 1000)).alias("key"), detail.alias("value"))

    ks = F.sequence(F.lit(0), n - 1)  # read only where n > 0
    return F.when(n > 0, F.map_from_entries(F.transform(ks, entry)))


def banner_records(events: DataFrame, nation: DataFrame) -> DataFrame:
    """One nested banner struct column ``banner`` per event."""
    e, u = F.col("event_id"), F.col("user_id")
    nat = nation.select(F.col("n_nationkey").cast("long").alias("_nk"), F.col("n_name").alias("_nname"))
    ev = events.select(*EVENT_COLUMNS).join(
        nat, (F.col("user_id") % 25) == F.col("_nk"), "left"
    )
    has_country = (u % 7) != 6
    port = F.element_at(F.array(*[F.lit(p) for p in PORT_CYCLE]), (e % len(PORT_CYCLE) + 1).cast("int"))
    # NULL past the end of the cycle (e % 7 in 4..6)
    product = F.try_element_at(F.array(*[F.lit(p) for p in PRODUCT_CYCLE]), (e % 7 + 1).cast("int"))
    tag_case = e % 8
    tags = (
        F.when(tag_case == 1, _str_array())
        .when(tag_case == 2, _str_array("cdn"))
        .when(tag_case == 3, _str_array("honeypot"))
        .when(tag_case == 4, _str_array("self-signed"))
        .when(tag_case == 5, _str_array("cloud", None))
        .when(tag_case == 6, _str_array("self-signed", "cdn"))
        .when(tag_case == 7, _str_array("vpn"))
    )
    ssl_case = e % 5
    ssl_versions = (
        F.when(ssl_case == 0, _str_array("SSLv3"))
        .when(ssl_case == 1, _str_array("TLSv1.0", "TLSv1.2"))
        .when(ssl_case == 2, _str_array("TLSv1.2"))
        .when(ssl_case == 3, _str_array())
    )
    expired = F.when(F.col("value") > 60, F.lit(True)).when(F.col("value") > 20, F.lit(False))
    web = port.isin(80, 443, 8080)
    timestamp = (
        F.when(e % 89 != 0, F.date_format(F.col("ts"), TIMESTAMP_FORMAT))
        .when(e % 2 == 1, F.lit("garbage"))
    )
    org = (
        F.when(u % 11 == 0, F.lit(None).cast("string"))
        .when(u % 13 == 0, F.lit("Linode"))
        .when(u % 17 == 0, F.lit("Google LLC"))
        .otherwise(F.concat(F.lit("Org-"), _s(u % 37)))
    )
    banner = F.struct(
        F.when(e % 97 != 0, F.concat(F.lit("10."), _s(u % 4), F.lit("."), _s(u % 8), F.lit("."), _s(u))).alias("ip_str"),
        port.alias("port"),
        F.when(e % 50 == 0, F.lit("udp")).otherwise(F.lit("tcp")).alias("transport"),
        timestamp.alias("timestamp"),
        org.alias("org"),
        F.concat(F.lit("ISP-"), _s(u % 5)).alias("isp"),
        F.concat(F.lit("AS"), _s(u % 37 + 64500)).alias("asn"),
        product.alias("product"),
        F.when(e % 9 == 0, F.concat(F.lit("1."), _s(e % 5))).alias("version"),
        F.when(e % 16 == 0, F.concat(F.lit("banner "), _s(e))).alias("info"),
        tags.alias("tags"),
        F.struct(
            F.when(has_country, F.concat(F.lit("City-"), _s(u % 25))).alias("city"),
            F.when(has_country, F.concat(F.lit("C"), _s(u % 25))).alias("country_code"),
            F.when(has_country, F.col("_nname")).alias("country_name"),
            F.when(has_country, ((u * 7) % 180 - 90).cast("double")).alias("latitude"),
            F.when(has_country, ((u * 13) % 360 - 180).cast("double")).alias("longitude"),
        ).alias("location"),
        F.struct(
            F.when(u % 3 == 0, F.lit("aws")).when(u % 3 == 1, F.lit("gcp")).alias("provider"),
        ).alias("cloud"),
        F.struct(F.struct(expired.alias("expired")).alias("cert"), ssl_versions.alias("versions")).alias("ssl"),
        F.when(web, F.struct(F.concat(F.lit("page "), _s(e)).alias("title"), product.alias("server"))).alias("http"),
        _vulns(e, u).alias("vulns"),
        e.alias("hash"),
    )
    return ev.select(banner.alias("banner"))


def banner_lines(events: DataFrame, nation: DataFrame) -> DataFrame:
    """NDJSON text, one banner per row in column ``value`` (as ``spark.read.text``)."""
    return banner_records(events, nation).select(F.to_json("banner").alias("value"))


def load_driver_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sf_dir = sf_dir.rstrip("/")
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet"),
        spark.read.parquet(f"{sf_dir}/nation.parquet"),
    )


EVENT_BYTES = 1 << 20  # of the scan, by its statistics, for a task that builds lines: some 100 MB of NDJSON


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over tasks of about ``EVENT_BYTES``, at least one a core.

    The scan's own partitions say little: a row group is read whole by one of
    the splits it spans and the others are empty, so a file of few row groups
    has few working tasks. The narrow rows move before they become lines."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // EVENT_BYTES)))


def driver_banner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, nation = load_driver_tables(spark, sf_dir)
    return banner_lines(spread(events.select(*EVENT_COLUMNS)), nation)
