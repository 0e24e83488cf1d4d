"""Per-organisation rollup of scored services (`org_scores`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import COMBINED_SCORE_SQL, DEFAULT_OPTIONS, Options


def distinct_with_nulls(col: str):
    """Distinct values of ``col`` as a sorted array that keeps a NULL value
    (``collect_set`` alone drops it). Sorted ascending, NULL last."""
    return F.array_sort(F.transform(F.collect_set(F.struct(F.col(col).alias("v"))), lambda x: x.getField("v")))


def eligible_scans(scans: DataFrame, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """Rows that count toward an organisation: org known and not excluded.
    ``is_excluded = FALSE`` drops NULL rows too unless the option says otherwise."""
    excluded = F.col("is_excluded")
    if options.null_excluded_as_false:
        keep = F.coalesce(excluded, F.lit(False)) == F.lit(False)
    else:
        keep = excluded == F.lit(False)
    return scans.where(F.col("org").isNotNull() & keep)


def org_cells(scans: DataFrame, options: Options = DEFAULT_OPTIONS, by: tuple[str, ...] = ()) -> DataFrame:
    """Mergeable state of the rollup: one row per (org, ip_str, country_name) and
    the columns ``by``, without ``keys_unique`` also per port.

    The filter runs before the shuffle, so the excluded cloud providers (the
    biggest organisations) never reach it, and a big organisation is spread over
    its IPs. Cells of disjoint sets of scans can be put together by a union.
    """
    risk = F.col("ip_risk_score")
    keys = ["org", "ip_str", "country_name", *by] + ([] if options.keys_unique else ["port"])
    return eligible_scans(scans, options).groupBy(*keys).agg(
        F.max(risk).alias("top"), F.sum(risk).alias("total"), F.count(risk).alias("n"),
        F.count_if(F.col("ip_str").isNotNull() & F.col("port").isNotNull()).alias("ports"))


def scores_of_cells(cells: DataFrame, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """``org_scores`` from ``org_cells``.

    The first cell of an IP is marked, so that counting marks counts distinct
    IPs (and, without ``keys_unique``, distinct "ip:port") with no distinct
    aggregate and no row-doubling Expand. Then come sums by (org, country_name),
    then by org over a few rows a country, where the country list is collected.
    """
    ip = F.col("ip_str")
    order = ["country_name"] + ([] if options.keys_unique else ["port"])
    by_ip = Window.partitionBy("org", "ip_str").orderBy(*order)
    ips = ((F.row_number().over(by_ip) == 1) & ip.isNotNull()).cast("long")
    if options.keys_unique:
        ports = F.col("ports")
    else:
        by_port = Window.partitionBy("org", "ip_str", "port").orderBy("country_name")
        ports = ((F.row_number().over(by_port) == 1) & ip.isNotNull() & F.col("port").isNotNull()).cast("long")
    marked = cells.select("org", "country_name", "top", "total", "n", ips.alias("ips"), ports.alias("ports"))
    sums = [F.max("top").alias("top"), *[F.sum(c).alias(c) for c in ("total", "n", "ips", "ports")]]
    places = marked.groupBy("org", "country_name").agg(*sums)
    base = places.groupBy("org").agg(*sums, distinct_with_nulls("country_name").alias("countries")).select(
        "org", F.col("ips").alias("total_ips"), F.col("ports").alias("total_open_ports"),
        F.col("top").alias("max_risk_score"), F.try_divide("total", "n").alias("avg_risk_score"), "countries")
    # SQL text keeps 0.7 / 0.3 / 0.5 as decimal literals, as the original SQL does.
    return base.selectExpr("*", f"{COMBINED_SCORE_SQL} AS combined_risk_score")


def org_scores(scans: DataFrame, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """org, total_ips, total_open_ports, max/avg risk, countries, combined score.

    In levels, each a hash aggregate over primitive values with a map-side part:
    ``org_cells``, then ``scores_of_cells``.
    """
    return scores_of_cells(org_cells(scans, options), options)


def org_scores_sql(spark: SparkSession, view: str = "scans") -> DataFrame:
    """The same levels as SQL text over the registered view ``view``; "ip:port"
    is counted distinct, whether or not the view's keys are unique."""
    return spark.sql(f"""
        WITH cells AS (
            SELECT org, ip_str, port, country_name,
                   max(ip_risk_score) AS top, sum(ip_risk_score) AS total, count(ip_risk_score) AS n
            FROM {view}
            WHERE org IS NOT NULL AND NOT is_excluded
            GROUP BY org, ip_str, port, country_name
        ), marked AS (
            SELECT org, country_name, top, total, n,
                   ip_str IS NOT NULL
                       AND row_number() OVER (PARTITION BY org, ip_str ORDER BY port, country_name) = 1 AS new_ip,
                   ip_str IS NOT NULL AND port IS NOT NULL
                       AND row_number() OVER (PARTITION BY org, ip_str, port ORDER BY country_name) = 1 AS new_port
            FROM cells
        ), places AS (
            SELECT org, country_name, max(top) AS top, sum(total) AS total, sum(n) AS n,
                   count_if(new_ip) AS ips, count_if(new_port) AS ports
            FROM marked
            GROUP BY org, country_name
        ), orgs AS (
            SELECT org, sum(ips) AS total_ips, sum(ports) AS total_open_ports, max(top) AS max_risk_score,
                   try_divide(sum(total), sum(n)) AS avg_risk_score,
                   array_sort(transform(collect_list(struct(country_name)), c -> c.country_name)) AS countries
            FROM places
            GROUP BY org
        )
        SELECT *, {COMBINED_SCORE_SQL} AS combined_risk_score FROM orgs
    """)
