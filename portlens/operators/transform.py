"""Flatten, latest-per-key dedup and CVE explode (DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_OPTIONS, Options

# The output contract's columns, in its order.
PASS_THROUGH = ("ip_str", "port", "transport", "timestamp", "org", "isp", "asn",
                "product", "version", "info", "tags")

NESTED = (
    ("location.city", "city"),
    ("location.country_name", "country_name"),
    ("location.country_code", "country_code"),
    ("location.latitude", "latitude"),
    ("location.longitude", "longitude"),
    ("ssl.cert.expired", "ssl_expired"),
    ("ssl.versions", "ssl_versions"),
    ("http.server", "http_server"),
    ("http.title", "http_title"),
    ("cloud.provider", "cloud_provider"),
    ("cloud.service", "cloud_service"),
)


def parse_timestamp(col: str = "timestamp"):
    """ISO-8601 text -> timestamp in the session zone; bad text -> NULL
    (also under ANSI mode, where a plain cast would fail the job)."""
    return F.try_to_timestamp(F.col(col))


def flatten(banners: DataFrame, keep: tuple[str, ...] = ("hash",)) -> DataFrame:
    """Project the banner to the 23 flat columns (+ ``keep``, e.g. the
    tie-break column) and parse the timestamp."""
    extra = [c for c in keep if c in banners.columns]
    cols = [F.col(c) for c in PASS_THROUGH]
    cols += [F.col(path).alias(alias) for path, alias in NESTED]
    cols += [F.col("vulns")] + [F.col(c) for c in extra]
    return banners.select(*cols).withColumn("timestamp", parse_timestamp("timestamp"))


def latest_per_key(flat: DataFrame, options: Options = DEFAULT_OPTIONS, drop_tie_break: bool = True) -> DataFrame:
    """Keep the newest scan per (ip_str, port): timestamp DESC NULLS LAST,
    then the tie-break column DESC so the choice is deterministic.

    ``transport`` is not part of the key (tcp and udp on one port collapse);
    NULL keys form their own group. Catalyst turns ``row_number() = 1`` into
    a WindowGroupLimit that also runs before the shuffle, so each map task
    sends at most one row per key - a key holding a large share of all rows
    costs one row per map task in the exchange, not its full volume.
    """
    order = [F.col("timestamp").desc_nulls_last()]
    tie = options.tie_break
    if tie and tie in flat.columns:
        order.append(F.col(tie).desc_nulls_last())
    w = Window.partitionBy("ip_str", "port").orderBy(*order)
    out = flat.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if drop_tie_break and tie and tie in out.columns:
        out = out.drop(tie)
    return out


# Output name of each field taken from a CVE's detail.
CVE_FIELDS = {"cvss": "cvss", "epss": "epss", "summary": "cve_summary", "verified": "cve_verified"}


def explode_vulns(scans: DataFrame, *carried: str) -> DataFrame:
    """One row per (ip_str, port, cve_id), with the columns ``carried`` last; a NULL or empty map gives no row."""
    value = F.col("_cve.value")
    entries = scans.select("ip_str", "port", "org", *carried, F.explode(F.map_entries("vulns")).alias("_cve"))
    return entries.select("ip_str", "port", "org", F.col("_cve.key").alias("cve_id"),
                          *[value.getField(name).alias(out) for name, out in CVE_FIELDS.items()], *carried)
