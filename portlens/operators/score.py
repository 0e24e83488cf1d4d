"""Per-service risk score, in the relational form (explode, aggregate, join)
and the fused form (one pass over the row's own CVE map)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def with_base_score(scans: DataFrame, explain_rules: bool = False) -> DataFrame:
    """Add ``score_base`` and the three-valued ``is_excluded``; with
    ``explain_rules`` also one points column per rule."""
    out = scans
    if explain_rules:
        out = out.withColumns({name: rules.rule_points(pred, pts) for name, pred, pts in rules.base_rules()})
    return out.withColumns({"score_base": rules.score_base(), "is_excluded": rules.is_excluded()})


def with_cve_score(cves: DataFrame) -> DataFrame:
    return cves.withColumn("cve_score", rules.cve_score(F.col("cvss"), F.col("epss"), F.col("cve_verified")))


def vuln_totals(cves: DataFrame) -> DataFrame:
    """Sum of CVE scores per (ip_str, port) (partial aggregation map-side)."""
    return with_cve_score(cves).groupBy("ip_str", "port").agg(F.sum("cve_score").alias("vuln_score_total"))


def score_relational(scans: DataFrame, cves: DataFrame) -> DataFrame:
    """base score -> left join CVE totals on (ip_str, port) -> NULL as 0 ->
    cap at 100 -> zero excluded rows. Both sides are hash-partitioned on the
    join keys, which the dedup already did for ``scans``."""
    scored = with_base_score(scans)
    joined = scored.join(vuln_totals(cves), on=["ip_str", "port"], how="left")
    return _finish(joined.withColumn("vuln_score_total", F.coalesce(F.col("vuln_score_total"), F.lit(0).cast("long"))))


def score_fused(scans: DataFrame) -> DataFrame:
    """Same result as ``score_relational(scans, explode_vulns(scans))`` when
    (ip_str, port) is unique, without the explode, the aggregate, the second
    scan of the input and the join: a pure projection."""
    scored = with_base_score(scans).withColumn("vuln_score_total", rules.fused_vuln_score_total("vulns"))
    return _finish(scored)


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "ip_risk_score",
        rules.capped_risk(F.col("score_base"), F.col("vuln_score_total"), F.col("is_excluded")),
    )
