"""Materialised rollup with a time-to-live, keyed upserts and create-if-absent
tables, all as Parquet directories in a shared folder.

A keyed upsert and a rebuild write a new version of their table beside the old
one and then switch a pointer: a reader sees one state or the other, and a
failed write leaves the old one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..config import DEFAULT_OPTIONS, REFRESH_METADATA_KEY, ROLLUP_TTL_SECONDS, Options
from ..operators.rollup import org_scores
from ..schema import metadata_schema, pitch_schema, vulns_schema
from ..session import scratch_folder
from ..sources.parquet import read_optional, read_table, register_views, write_table, write_version


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        read_table(spark, path, merge_schema=False).schema  # noqa: B018 - resolves the path only
        return True
    except AnalysisException:
        return False


def ensure_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Create an empty table with ``schema`` if none exists; return the table."""
    if not table_exists(spark, path):
        write_table(spark.createDataFrame([], schema), path)
    return read_table(spark, path)


def keyed_upsert(spark: SparkSession, path: str, updates: DataFrame, key: str | list[str],
                 schema: StructType | None = None, order_by: str | None = None) -> DataFrame:
    """Insert-or-replace by key: rows of ``updates`` win, other old rows stay.

    The table holds one row per key. Of update rows with one key the one with
    the largest ``order_by`` stays (ties, and without it: by a hash of the
    row, so a rerun chooses alike). A key with a NULL part can't be a primary
    key: such update rows are left out.

    Both sides are hash-partitioned on the key for the anti join; AQE
    broadcasts ``updates`` when it is measured small. With ``schema`` the
    update rows are first conformed to the table's declared columns and
    types. Returns the new table.
    """
    if schema is not None:
        updates = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    updates = one_per_key(updates, key, order_by)
    if not table_exists(spark, path):
        write_version(spark, updates, path)
        return read_table(spark, path)
    with scratch_folder(spark, "updates") as stored:  # the merge reads them twice
        write_table(updates, stored)
        fresh = spark.read.schema(updates.schema).parquet(stored)
        write_version(spark, upsert_merge(read_table(spark, path), fresh, key), path)
    return read_table(spark, path)


def one_per_key(rows: DataFrame, key: str | list[str], order_by: str | None = None) -> DataFrame:
    """One row for each key without a NULL part; see ``keyed_upsert``."""
    keys = [key] if isinstance(key, str) else list(key)
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    order = ([F.col(order_by).desc_nulls_last()] if order_by else []) + [F.xxhash64(*plain).desc()]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.dropna(subset=keys).withColumn("_rn", first).where(F.col("_rn") == 1).drop("_rn")


def upsert_merge(old: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """The merge rule of ``keyed_upsert`` without the storage step."""
    keys = [key] if isinstance(key, str) else list(key)
    return old.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def last_refresh_age_seconds(spark: SparkSession, metadata_path: str, now: dt.datetime) -> float | None:
    """Seconds since the stored refresh stamp; None when missing or unreadable
    (a table without the two columns, or files that aren't Parquet, included)."""
    try:
        meta = read_optional(spark, metadata_path, metadata_schema).select("key", "value")
    except AnalysisException:
        return None
    return stamp_age_seconds(meta, now)


def stamp_age_seconds(meta: DataFrame, now: dt.datetime) -> float | None:
    """Seconds since the refresh stamp among the (key, value) rows; None when missing or unreadable."""
    # Both instants go through the same parser in the session time zone, so
    # the difference does not depend on any zone setting.
    stamp = F.try_to_timestamp(F.col("value"))
    current = F.try_to_timestamp(F.lit(now.isoformat()))
    age = (F.unix_micros(current) - F.unix_micros(stamp)) / F.lit(1_000_000.0)
    row = meta.where(F.col("key") == REFRESH_METADATA_KEY).select(age.alias("age")).limit(1).collect()
    if not row or row[0]["age"] is None:
        return None
    return float(row[0]["age"])


def refresh_org_scores(spark: SparkSession, root: str, ttl_s: float = ROLLUP_TTL_SECONDS, force: bool = False,
                       now: dt.datetime | None = None, options: Options = DEFAULT_OPTIONS) -> bool:
    """Rebuild ``<root>/org_scores`` from ``<root>/scans`` when forced, when
    the table is missing, when no (readable) refresh stamp exists, or when
    the stamp is older than ``ttl_s``. Returns whether it rebuilt.

    Without a `scans` table there is nothing to serve yet: nothing is built.
    The pitch cache table is created if absent either way.
    """
    root = root.rstrip("/")
    ensure_table(spark, f"{root}/ai_pitches", pitch_schema)
    if not table_exists(spark, f"{root}/scans"):
        return False
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    org_path, meta_path = f"{root}/org_scores", f"{root}/db_metadata"
    rebuild = force or not table_exists(spark, org_path)
    if not rebuild:
        age = last_refresh_age_seconds(spark, meta_path, now)
        rebuild = age is None or age > ttl_s
    if rebuild:
        write_version(spark, org_scores(read_table(spark, f"{root}/scans", merge_schema=False), options), org_path)
        stamp = spark.createDataFrame([(REFRESH_METADATA_KEY, now.isoformat())], metadata_schema)
        if table_exists(spark, meta_path) and set(read_table(spark, meta_path).columns) != set(metadata_schema.names):
            write_version(spark, stamp, meta_path)  # metadata of another shape is replaced
        else:
            keyed_upsert(spark, meta_path, stamp, "key", metadata_schema)
    return rebuild


def serving_views(spark: SparkSession, root: str, register: bool = True) -> dict[str, DataFrame]:
    """The serving tables under ``root``: `scans` (partitions discovered,
    part-file schemas merged), `vulns` (empty when absent), `org_scores` and
    `ai_pitches` when present; optionally registered as temp views of the
    same names (replacing older ones)."""
    root = root.rstrip("/")
    frames = {"scans": read_table(spark, f"{root}/scans"),
              "vulns": read_optional(spark, f"{root}/vulns", vulns_schema)}
    for name in ("org_scores", "ai_pitches"):
        if table_exists(spark, f"{root}/{name}"):
            frames[name] = read_table(spark, f"{root}/{name}")
    if register:
        register_views(spark, frames)
    return frames
