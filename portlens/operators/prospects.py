"""Dashboard and prospecting queries over `org_scores`, `scans` and `vulns`.

The original describes these pages only in prose, so thresholds and column
choices are parameters; defaults are in ``portlens.config``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.rules import risk_band
from .rollup import eligible_scans


def kpis(org_scores: DataFrame, high_risk: float = C.HIGH_RISK_THRESHOLD) -> DataFrame:
    """One row: organisations, their IPs, high-risk count, mean combined score
    (rounded to 6 places so the float sum order does not show)."""
    score = F.col("combined_risk_score")
    return org_scores.agg(
        F.count(F.lit(1)).alias("total_orgs"),
        F.coalesce(F.sum("total_ips"), F.lit(0).cast("long")).alias("total_ips"),
        F.count_if(score >= high_risk).alias("high_risk_orgs"),
        F.round(F.avg(score), 6).alias("avg_combined_score"),
    )


def top_orgs(org_scores: DataFrame, n: int = C.TOP_ORGS) -> DataFrame:
    """The n riskiest organisations (ties by name): a top-k, planned as
    TakeOrderedAndProject - each task keeps n rows, one task merges them."""
    return org_scores.orderBy(F.col("combined_risk_score").desc(), F.col("org").asc()).limit(n)


def score_histogram(org_scores: DataFrame, width: float = C.HISTOGRAM_WIDTH) -> DataFrame:
    """Organisations per score bucket; a bucket is named by its lower edge
    (an integer when the width is a whole number)."""
    index = F.floor(F.col("combined_risk_score") / F.lit(float(width)))
    if float(width).is_integer():
        bucket = index * F.lit(int(width))
    else:
        bucket = index.cast("double") * F.lit(float(width))
    return org_scores.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_orgs"))


def prospect_filter(org_scores: DataFrame, min_score: float = 0.0, min_ips: int = 0,
                    country: str | None = None) -> DataFrame:
    cond = (F.col("combined_risk_score") >= min_score) & (F.col("total_ips") >= min_ips)
    if country is not None:
        cond = cond & F.array_contains(F.col("countries"), country)
    return org_scores.where(cond)


def export_view(org_scores: DataFrame, sort_by: str = "combined_risk_score", descending: bool = True) -> DataFrame:
    """Flat, export-ready rows (countries as text), globally sorted with a
    range exchange (no single-task sort)."""
    key = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return org_scores.select(
        "org", "total_ips", "total_open_ports", "max_risk_score", "avg_risk_score",
        F.array_join(F.col("countries"), ";", "unknown").alias("countries"),
        "combined_risk_score",
    ).orderBy(key, F.col("org").asc())


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


EXPORT_FILE_BYTES = 256 << 20
EXPORT_FILE_ROWS = 1_000_000


def export_sorted(rows: DataFrame, path: str, order: list[Column], file_format: str = "csv",
                  file_bytes: int = EXPORT_FILE_BYTES, file_rows: int = EXPORT_FILE_ROWS) -> None:
    """Write ``rows`` so that reading the files by name gives ``order``.

    The number of ranges follows the plan's size estimate; a range that turns out
    larger goes on in further files of at most ``file_rows`` rows, whose names
    follow in order. No task sorts more than a range.
    """
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(1, min(-(-estimate // file_bytes), 100_000))
    out = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    writer = out.write.mode("overwrite").option("maxRecordsPerFile", file_rows)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.format(file_format).save(path)


def org_selector(org_scores: DataFrame) -> DataFrame:
    """Organisation names for a picker (org is the rollup's group key, so
    already distinct: no extra shuffle)."""
    return org_scores.select("org").orderBy("org")


def org_infrastructure(scans: DataFrame, org_scores: DataFrame, org: str | None = None) -> DataFrame:
    """Exposed services of every rolled-up organisation (or one) with the
    organisation's combined score. The right side has one row per org: AQE
    broadcasts it when its measured size is small, and otherwise splits a
    skewed organisation's partition of `scans` (skew join). The split needs
    a plain shuffle on both sides, so pass the materialized `org_scores`
    table (as the refresh writes it), not a rollup computed in the same
    query."""
    rows = eligible_scans(scans)
    summary = org_scores.select("org", "combined_risk_score", "total_ips")
    if org is not None:
        rows = rows.where(F.col("org") == org)
        summary = summary.where(F.col("org") == org)
    return rows.select("org", "ip_str", "port", "transport", "product", "version", "ip_risk_score").join(
        summary, "org", "inner"
    )


def org_cves(vulns: DataFrame, scans: DataFrame, org: str | None = None) -> DataFrame:
    """CVE rows of services that count toward an organisation's rollup (the
    `vulns` table also holds excluded services). For one organisation they
    are ordered by CVSS (NULL last), id; for all, in no order: no global sort."""
    cves, services = vulns, eligible_scans(scans)
    if org is not None:
        cves, services = cves.where(F.col("org") == org), services.where(F.col("org") == org)
    keys = services.select(F.col("ip_str").alias("_ip"), F.col("port").alias("_port"))
    match = F.col("ip_str").eqNullSafe(F.col("_ip")) & F.col("port").eqNullSafe(F.col("_port"))
    out = cves.join(keys, match, "left_semi")
    if org is None:
        return out
    return out.orderBy(F.col("cvss").desc_nulls_last(), F.col("cve_id"), F.col("ip_str"), F.col("port"))


def geo_points(scans: DataFrame, min_score: int = 0) -> DataFrame:
    return scans.where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("ip_risk_score") >= min_score)
    ).select("ip_str", "port", "org", "latitude", "longitude", "ip_risk_score",
             risk_band(F.col("ip_risk_score")).alias("risk_band"))


def geo_grid(scans: DataFrame, cell: float = C.GEO_CELL_DEGREES) -> DataFrame:
    """Marker clusters as a grid rollup (partial aggregation per cell)."""
    lat_cell = F.floor(F.col("latitude") / F.lit(cell)).cast("long")
    lon_cell = F.floor(F.col("longitude") / F.lit(cell)).cast("long")
    return (
        scans.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(lat_cell.alias("lat_cell"), lon_cell.alias("lon_cell"))
        .agg(
            F.count(F.lit(1)).alias("n_services"),
            F.max("ip_risk_score").alias("max_risk_score"),
            F.avg("ip_risk_score").alias("avg_risk_score"),
        )
        .withColumn("risk_band", risk_band(F.col("max_risk_score")))
    )


GEO_LEVELS = 8


def geo_levels(scans: DataFrame, levels: int = GEO_LEVELS) -> DataFrame:
    """Marker clusters for each zoom from 0 (one cell) to ``levels`` (2 ** levels columns and rows).

    The scans are read and shuffled once, into cells of the finest level; all
    other levels are rolled up from those cells, by prefixes of their key.
    ``quadkey`` has a digit a level: twice the row's bit and the column's bit.
    """
    side = 1 << levels

    def place(degrees: Column, span: float) -> Column:
        at = F.floor((degrees + F.lit(span / 2)) / F.lit(span) * F.lit(side)).cast("long")
        return F.least(F.greatest(at, F.lit(0)), F.lit(side - 1))

    risk = F.col("ip_risk_score")
    finest = (
        scans.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(place(F.col("longitude"), 360.0).alias("x"), place(F.col("latitude"), 180.0).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(risk).alias("top"), F.sum(risk).alias("total"), F.count(risk).alias("scored"))
    )
    zoomed = finest.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(levels) - F.col("zoom")).alias(c)
    cells = zoomed.select("zoom", up("x"), up("y"), "n", "top", "total", "scored").groupBy("zoom", "x", "y").agg(
        F.sum("n").alias("n_services"), F.max("top").alias("max_risk_score"),
        F.try_divide(F.sum("total"), F.sum("scored")).alias("avg_risk_score"))
    bit = lambda c, i: F.call_function("shiftright", F.col(c), F.col("zoom") - i) % 2
    digits = F.transform(F.sequence(F.lit(1), F.col("zoom")), lambda i: (2 * bit("y", i) + bit("x", i)).cast("string"))
    key = F.when(F.col("zoom") > 0, F.array_join(digits, "")).otherwise(F.lit(""))
    return cells.select("zoom", key.alias("quadkey"), "n_services", "max_risk_score", "avg_risk_score",
                        risk_band(F.col("max_risk_score")).alias("risk_band"))


def ip_services(scans: DataFrame, ips: list[str]) -> DataFrame:
    """Services of some IPs. The equality on ``ip_str`` reaches the Parquet reader,
    where the column's Bloom filters (`write_scans`) skip row groups without them."""
    return scans.where(F.col("ip_str").isin(ips)).select(
        "ip_str", "port", "transport", "org", "product", "version", "ip_risk_score")


def cloud_segments(scans: DataFrame) -> DataFrame:
    """Cloud vs on-premises segmentation of scored services."""
    segment = F.coalesce(F.col("cloud_provider"), F.lit("on-prem"))
    return scans.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n_services"),
        F.count_distinct("ip_str").alias("n_ips"),
        F.avg("ip_risk_score").alias("avg_risk_score"),
        F.count_if(F.col("is_excluded") == F.lit(True)).alias("n_excluded"),
    )


def risk_bands(org_scores: DataFrame) -> DataFrame:
    return org_scores.select("org", "combined_risk_score",
                             risk_band(F.col("combined_risk_score")).alias("risk_band"))
