"""Incremental load: a batch of new scans is merged into the tables of a database.

    scans       latest scan per (ip_str, port), partitioned by country
    vulns       its CVE rows, same partitions
    org_cells   mergeable state of the organisation rollup, same partitions
    org_scores  the rollup, partitioned by a hash of the organisation

A batch rewrites only the countries it touches: those of its own rows and those
that hold an older scan of one of its keys (a service may move to another
country). Of the rollup only organisations with a touched scan are computed
again, from the cells of all countries, and only their hash partitions are
written. After each batch the tables equal a full rebuild from all batches.

Loading is idempotent: a batch that failed half-way is loaded again. What a load
is about to touch is kept in the table `pending` until it is done, so the next
load also takes up what a failed one left. A database has one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_OPTIONS, Options
from ..operators.rollup import org_cells, scores_of_cells
from ..operators.transform import explode_vulns, latest_per_key
from ..session import scratch_folder
from ..sources.parquet import read_table, with_country_partition, write_table
from .etl import scored_scans
from .tables import create_partitioned, create_table_as, drop_any, ensure_database, in_partitions, overwrite_partitions

COUNTRY = "country_code"
ORG_PARTS = 64  # hash partitions of org_scores


@dataclass
class Loaded:
    """What a batch touched. None among the countries is the partition of empty codes."""

    countries: set[str | None]
    emptied: set[str | None]
    org_parts: set[str]


def load_batch(spark: SparkSession, database: str, banners: DataFrame, options: Options = DEFAULT_OPTIONS) -> Loaded:
    """Merge raw banner rows into the tables of ``database``, which are created if absent.

    The batch is deduplicated, scored and stored once; all later steps read that
    table. An empty batch changes nothing.
    """
    ensure_database(spark, database)
    with scratch_folder(spark, "batch") as scratch:
        fresh = with_country_partition(scored_scans(banners, options, drop_tie_break=False), options)
        fresh = fresh.withColumn(COUNTRY, F.nullif(COUNTRY, F.lit("")))  # as a partition it is NULL
        write_table(fresh, f"{scratch}/batch")
        batch = read_table(spark, f"{scratch}/batch", merge_schema=False)
        scans = create_partitioned(spark, f"{database}.scans", [(f.name, f.dataType) for f in batch.schema], COUNTRY)

        pending = f"{database}.pending"
        touched = _touched(scans, batch)
        if spark.catalog.tableExists(pending):
            touched = touched.unionByName(spark.table(pending)).distinct()
        touched = create_table_as(spark, pending, touched)
        countries = {r[0] for r in touched.select(COUNTRY).distinct().collect()}  # partition values
        if not countries:
            drop_any(spark, pending)
            return Loaded(set(), set(), set())
        merged = _merged(scans, batch, countries, options)
        emptied = countries - overwrite_partitions(merged, f"{database}.scans", COUNTRY, countries)

        now = in_partitions(spark.table(f"{database}.scans"), COUNTRY, countries)
        vulns = explode_vulns(now, COUNTRY)
        create_partitioned(spark, f"{database}.vulns", [(f.name, f.dataType) for f in vulns.schema], COUNTRY)
        overwrite_partitions(vulns.hint("rebalance", COUNTRY), f"{database}.vulns", COUNTRY, countries)
        loaded = Loaded(countries, emptied, _roll_up(spark, database, now, touched, countries, options))
        drop_any(spark, pending)
        return loaded


def _touched(scans: DataFrame, batch: DataFrame) -> DataFrame:
    """(country_code, org) of the batch's rows and of the stored scans with one of its keys; three narrow columns are read."""
    keys = batch.select(F.col("ip_str").alias("_ip"), F.col("port").alias("_port"))
    same = F.col("ip_str").eqNullSafe(F.col("_ip")) & F.col("port").eqNullSafe(F.col("_port"))
    replaced = scans.select("ip_str", "port", COUNTRY, "org").join(keys, same, "left_semi")
    return replaced.select(COUNTRY, "org").unionByName(batch.select(COUNTRY, "org")).distinct()


def _merged(scans: DataFrame, batch: DataFrame, countries: set[str | None], options: Options) -> DataFrame:
    """Latest of the touched countries' scans and the batch, as it is written: AQE
    splits a big country and puts small ones together, and rows sorted by
    organisation let lookups skip row groups."""
    both = in_partitions(scans, COUNTRY, countries).unionByName(batch)
    merged = latest_per_key(both, options, drop_tie_break=False)
    return merged.hint("rebalance", COUNTRY).sortWithinPartitions(COUNTRY, "org", "ip_str", "port")


def _roll_up(spark: SparkSession, database: str, now: DataFrame, touched: DataFrame, countries: set[str | None],
             options: Options) -> set[str]:
    cells = org_cells(now, options, by=(COUNTRY,))
    create_partitioned(spark, f"{database}.org_cells", [(f.name, f.dataType) for f in cells.schema], COUNTRY)
    overwrite_partitions(cells.hint("rebalance", COUNTRY).sortWithinPartitions(COUNTRY, "org"), f"{database}.org_cells", COUNTRY, countries)

    part = F.pmod(F.xxhash64("org"), F.lit(ORG_PARTS)).cast("string")
    changed = touched.select("org").where("org IS NOT NULL").distinct()
    parts = {r[0] for r in changed.select(part).distinct().collect()}  # at most ORG_PARTS
    stored = spark.table(f"{database}.org_cells").join(changed, "org", "left_semi")
    scores = scores_of_cells(stored, options).withColumn("org_part", part)
    held = create_partitioned(spark, f"{database}.org_scores", [(f.name, f.dataType) for f in scores.schema], "org_part")
    kept = in_partitions(held, "org_part", parts).join(changed, "org", "left_anti").select(*held.columns)
    if parts:
        overwrite_partitions(kept.unionByName(scores).hint("rebalance", "org_part"), f"{database}.org_scores", "org_part", parts)
    return parts


def current_scans(spark: SparkSession, database: str, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """`scans` with the columns of the batch job's table."""
    return spark.table(f"{database}.scans").drop(*[c for c in (options.tie_break,) if c])


def current_vulns(spark: SparkSession, database: str) -> DataFrame:
    return spark.table(f"{database}.vulns").drop(COUNTRY)


def current_org_scores(spark: SparkSession, database: str) -> DataFrame:
    return spark.table(f"{database}.org_scores").drop("org_part")
