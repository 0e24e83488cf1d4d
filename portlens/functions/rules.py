"""The scoring model as Column expressions (all JVM built-ins, no UDFs).

Each base rule is a (name, predicate, points) triple; ``score_base`` is their
sum. A predicate that evaluates to NULL contributes 0, as a CASE WHEN does.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def base_rules() -> list[tuple[str, Column, int]]:
    tags, versions, port = F.col("tags"), F.col("ssl_versions"), F.col("port")
    weak_tls = reduce(lambda a, b: a | b, [F.array_contains(versions, v) for v in C.WEAK_TLS_VERSIONS])
    return [
        ("rule_version", F.col("version").isNotNull(), C.POINTS_VERSION),
        ("rule_expired_cert", F.col("ssl_expired") == F.lit(True), C.POINTS_EXPIRED_CERT),
        ("rule_self_signed", F.array_contains(tags, C.SELF_SIGNED_TAG), C.POINTS_SELF_SIGNED),
        ("rule_weak_tls", weak_tls, C.POINTS_WEAK_TLS),
        ("rule_admin_port", port.isin(list(C.ADMIN_PORTS)), C.POINTS_ADMIN_PORT),
        ("rule_db_port", port.isin(list(C.DB_PORTS)), C.POINTS_DB_PORT),
        ("rule_device", F.col("product").rlike(C.DEVICE_PRODUCT_PATTERN), C.POINTS_DEVICE),
        ("rule_honeypot", F.array_contains(tags, C.HONEYPOT_TAG), C.POINTS_HONEYPOT),
    ]


def rule_points(predicate: Column, points: int) -> Column:
    return F.when(predicate, F.lit(points)).otherwise(F.lit(0))


def score_base() -> Column:
    """Integer sum of the base rules; range (-inf, 100] (no lower clamp)."""
    return reduce(add, [rule_points(p, pts) for _, p, pts in base_rules()], F.lit(0))


def is_excluded() -> Column:
    """Three-valued: listed org OR a 'cdn' tag; NULL when neither is TRUE and
    either side is unknown (NULL org, NULL tags, or a NULL tag element)."""
    return F.col("org").isin(list(C.EXCLUDED_ORGS)) | F.array_contains(F.col("tags"), C.EXCLUDED_TAG)


def cve_score(cvss: Column, epss: Column, verified: Column) -> Column:
    """First matching CVSS band plus EPSS and verified bonuses (the bonuses
    apply whatever the CVSS is, NULL included)."""
    band = None
    for threshold, points in C.CVSS_BANDS:
        band = F.when(cvss >= threshold, F.lit(points)) if band is None else band.when(cvss >= threshold, F.lit(points))
    band = band.otherwise(F.lit(0))
    return (
        band
        + rule_points(epss >= C.EPSS_THRESHOLD, C.POINTS_EPSS)
        + rule_points(verified == F.lit(True), C.POINTS_VERIFIED)
    )


def fused_vuln_score_total(vulns: Column | str = "vulns") -> Column:
    """Sum of CVE scores over the row's own ``vulns`` map, as a bigint.

    Equivalent to explode -> score -> sum per (ip_str, port) -> left join on
    (ip_str, port) -> NULL as 0, for input that is unique per (ip_str, port):
    a NULL key never matches the join, so such rows get 0; a NULL or empty
    map gives 0; a NULL map value scores 0.
    """
    vulns = F.col(vulns) if isinstance(vulns, str) else vulns
    total = F.aggregate(
        F.map_values(vulns),
        F.lit(0).cast("long"),
        lambda acc, v: acc + cve_score(v.getField("cvss"), v.getField("epss"), v.getField("verified")),
    )
    keyed = F.col("ip_str").isNotNull() & F.col("port").isNotNull()
    return F.when(keyed, F.coalesce(total, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def capped_risk(score_base_col: Column, vuln_total_col: Column, excluded_col: Column) -> Column:
    """least(100, base + vulns), zeroed only when excluded is TRUE (bigint)."""
    capped = F.least(F.lit(C.SCORE_CAP), score_base_col + vuln_total_col)
    return F.when(excluded_col == F.lit(True), F.lit(0)).otherwise(capped)


def risk_band(score: Column) -> Column:
    """Map colour band: red / orange / blue."""
    return (
        F.when(score >= C.HIGH_RISK_THRESHOLD, F.lit("red"))
        .when(score >= C.ORANGE_RISK_THRESHOLD, F.lit("orange"))
        .otherwise(F.lit("blue"))
    )
