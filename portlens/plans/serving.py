"""The serving tier in a database of the session catalog: persistent views of the
batch job's output, the rollup as a table rebuilt by age, metadata and the pitch
cache as keyed tables with column defaults.

``refresh`` does the same over plain folders, for sessions whose catalog has no
metastore behind it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_OPTIONS, REFRESH_METADATA_KEY, ROLLUP_TTL_SECONDS, Options
from ..operators.rollup import org_scores
from ..schema import metadata_schema, pitch_schema, vulns_schema
from .refresh import stamp_age_seconds, table_exists
from .tables import create_if_absent, create_table_as, create_tables_as, drop_any, ensure_database, upsert, view_over

PUBLISHED = ("scans", "vulns", "org_scores")


def serve(spark: SparkSession, root: str, database: str, ttl_s: float = ROLLUP_TTL_SECONDS, force: bool = False,
          now: dt.datetime | None = None, options: Options = DEFAULT_OPTIONS) -> bool:
    """Register the folders under ``root`` and bring the tables up to date; whether the rollup was rebuilt.

    Views ``scans`` and ``vulns`` (empty when the folder is absent) replace
    whatever had their names. ``org_scores`` is rebuilt when forced, missing, or
    when its stamp in ``db_metadata`` is missing, unreadable or older than
    ``ttl_s``. ``ai_pitches`` is created if absent; its ``generated_at`` defaults
    to the time of the insert. Without a `scans` folder nothing is served yet.
    """
    root = root.rstrip("/")
    ensure_database(spark, database)
    create_if_absent(spark, f"{database}.ai_pitches", pitch_schema, "org", {"generated_at": "current_timestamp()"})
    create_if_absent(spark, f"{database}.db_metadata", metadata_schema, "key")
    if not table_exists(spark, f"{root}/scans"):
        return False
    view_over(spark, f"{database}.scans", f"{root}/scans")
    if table_exists(spark, f"{root}/vulns"):
        view_over(spark, f"{database}.vulns", f"{root}/vulns")
    else:
        drop_any(spark, f"{database}.vulns")
        columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in vulns_schema)
        spark.sql(f"CREATE VIEW `{database}`.vulns AS SELECT * FROM (SELECT {columns}) WHERE FALSE")
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rebuild = force or not spark.catalog.tableExists(f"{database}.org_scores")
    if not rebuild:
        age = stamp_age_seconds(spark.table(f"{database}.db_metadata"), now)
        rebuild = age is None or age > ttl_s
    if rebuild:
        create_table_as(spark, f"{database}.org_scores", org_scores(spark.table(f"{database}.scans"), options))
        stamp = spark.range(1).select(F.lit(REFRESH_METADATA_KEY).alias("key"), F.lit(now.isoformat()).alias("value"))
        upsert(spark, f"{database}.db_metadata", stamp)
    return rebuild


def publish(spark: SparkSession, source: str, target: str, optional: tuple[str, ...] = ("vulns",)) -> list[str]:
    """Copy the serving tables of one database to another, together: a reader of
    ``target`` finds the old ones until all are written. Absent optional tables
    are left out. Returns the names copied."""
    names = [n for n in PUBLISHED if n not in optional or spark.catalog.tableExists(f"{source}.{n}")]
    ensure_database(spark, target)
    tables = {f"{target}.{n}": spark.table(f"{source}.{n}") for n in names}
    # a file holds few countries, so lookups of one skip the others by row-group statistics
    tables[f"{target}.scans"] = tables[f"{target}.scans"].hint("rebalance", "country_code").sortWithinPartitions("country_code", "org")
    create_tables_as(spark, tables)
    return names
