"""Services and CVE rows bucketed by their join key, so that the score's join and
its aggregate read buckets side by side and exchange nothing.

For tables that are scored again and again (a changed rule, another cut of the
CVEs): the exchange on (ip_str, port) is paid once, when the tables are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.score import score_relational
from ..operators.transform import explode_vulns
from .tables import drop_any, ensure_database

KEYS = ("ip_str", "port")


def write_colocated(spark: SparkSession, database: str, deduped: DataFrame, buckets: int) -> None:
    """Tables ``services`` (one row per key) and ``cves`` (its CVE rows), each with one sorted file a bucket.

    ``deduped`` has one row per (ip_str, port), so no key makes a bucket large;
    choose ``buckets`` by ``session.exchange_width``. Old tables are replaced.
    """
    ensure_database(spark, database)
    _write(spark, deduped.repartition(buckets, *KEYS), f"{database}.services", buckets)
    # read back bucketed: the CVE rows of a bucket are written by the task that reads it
    _write(spark, explode_vulns(spark.table(f"{database}.services")).repartition(buckets, *KEYS), f"{database}.cves", buckets)


def _write(spark: SparkSession, rows: DataFrame, name: str, buckets: int) -> None:
    drop_any(spark, name)
    rows.write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)


def score_colocated(spark: SparkSession, database: str) -> DataFrame:
    """``score_relational`` over the two tables: no exchange, neither for the totals nor for the join."""
    return score_relational(spark.table(f"{database}.services"), spark.table(f"{database}.cves"))
