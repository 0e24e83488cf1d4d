"""Tables and views of the session catalog: create-table-as, persistent views,
create-if-absent with a key and column defaults, keyed upserts, and rewriting
chosen partitions of a table.

Names are ``database.table`` or plain names of the current database. With a
metastore behind the catalog everything here lives on after the session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import observed, scratch_folder
from ..sources.parquet import write_table
from .refresh import one_per_key, upsert_merge

KEY_PROPERTY = "portlens.key"


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> str:
    """Create the database if there is none; its tables live below ``location``."""
    at = f" LOCATION '{_text(location)}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}{at}")
    return name


def drop_any(spark: SparkSession, name: str) -> None:
    """Drop the table, the persistent view or the temp view of that name, whichever there is."""
    while spark.catalog.tableExists(name):
        kind = spark.catalog.getTable(name).tableType
        if kind == "TEMPORARY":
            spark.catalog.dropTempView(name)
        else:
            spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} {_quoted(name)}")


def view_over(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A persistent view of a Parquet folder, in place of whatever had the name."""
    drop_any(spark, name)
    spark.sql(f"CREATE VIEW {_quoted(name)} AS SELECT * FROM parquet.`{path.replace('`', '``')}`")
    return spark.table(name)


def create_table_as(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """Rebuild a table from ``rows``, in place of a table or view of the name.

    The rows are written to a table beside it first, then the names are
    exchanged: a failed write leaves the old table, and ``rows`` may read it.
    """
    create_tables_as(spark, {name: rows})
    return spark.table(name)


def create_tables_as(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Rebuild several tables that belong together (a publication).

    All are written beside the old ones before the first takes its name: if one
    fails, every old table is still there. Exchanging the names touches no data.
    The tables have no partitions: a catalog may keep a partition's folder by its
    full path, which a new name would leave behind.
    """
    for name, rows in tables.items():
        following = f"{name}__next"
        drop_any(spark, following)
        rows.write.format("parquet").option("compression", "snappy").saveAsTable(following)
    for name in tables:
        _take_name(spark, f"{name}__next", name)


def create_if_absent(spark: SparkSession, name: str, schema: StructType, key: str | list[str] | None = None,
                     defaults: dict[str, str] | None = None) -> DataFrame:
    """The table, created empty if there is none.

    ``key`` is kept as a table property and enforced by ``upsert``; ``defaults``
    are SQL expressions that stand in for columns an insert leaves out.
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    columns = ", ".join(
        f"{_quoted(f.name)} {f.dataType.simpleString()}"
        + ("" if f.nullable else " NOT NULL")
        + (f" DEFAULT {defaults[f.name]}" if f.name in (defaults or {}) else "")
        for f in schema.fields)
    properties = f" TBLPROPERTIES ('{KEY_PROPERTY}' = '{_text(','.join(keys))}')" if keys else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns}) USING parquet{properties}")
    return spark.table(name)


def table_key(spark: SparkSession, name: str) -> list[str]:
    """The key columns that ``create_if_absent`` was given."""
    row = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").where(F.col("key") == KEY_PROPERTY).first()
    return row["value"].split(",") if row else []


def upsert(spark: SparkSession, name: str, updates: DataFrame, order_by: str | None = None) -> DataFrame:
    """Insert-or-replace by the table's key; rules as in ``refresh.keyed_upsert``.

    Columns that ``updates`` lacks get the table's defaults. The new state is
    written to a table beside the old one, then the names are exchanged.
    """
    keys = table_key(spark, name)
    if not keys:
        raise ValueError(f"{name} has no key")
    old = spark.table(name)
    given = {c.lower() for c in updates.columns}
    columns = [
        (F.col(f.name) if f.name.lower() in given else F.expr(f.metadata.get("CURRENT_DEFAULT", "NULL"))).cast(f.dataType).alias(f.name)
        for f in old.schema.fields]
    fresh = one_per_key(updates.select(*columns), keys, order_by)
    following = f"{name}__next"
    drop_any(spark, following)
    spark.sql(f"CREATE TABLE {_quoted(following)} LIKE {_quoted(name)} TBLPROPERTIES ('{KEY_PROPERTY}' = '{_text(','.join(keys))}')")
    with scratch_folder(spark, "updates") as stored:  # the merge reads them twice
        write_table(fresh, stored)
        fresh = spark.read.schema(fresh.schema).parquet(stored)
        upsert_merge(old, fresh, keys).select(*old.columns).write.insertInto(following)
    return _take_name(spark, following, name)


def _take_name(spark: SparkSession, following: str, name: str) -> DataFrame:
    drop_any(spark, name)
    spark.sql(f"ALTER TABLE {_quoted(following)} RENAME TO {_quoted(name)}")
    return spark.table(name)


# ------------------------------------------------------------- partitions


def create_partitioned(spark: SparkSession, name: str, columns: Iterable[tuple[str, DataType]], partition: str) -> DataFrame:
    """A Parquet table partitioned by one string column, created empty if there is none."""
    listed = ", ".join(f"{_quoted(c)} {t.simpleString()}" for c, t in columns if c != partition)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({listed}, {_quoted(partition)} string) "
              f"USING parquet PARTITIONED BY ({_quoted(partition)})")
    return spark.table(name)


@contextmanager
def _only_written_partitions(spark: SparkSession) -> Iterator[None]:
    """Overwrites replace the partitions that get rows and no other."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def overwrite_partitions(rows: DataFrame, name: str, partition: str, values: set[str | None]) -> set[str | None]:
    """Replace the partitions ``values`` of a table by ``rows``, which hold no others.

    Files of other partitions stay as they are. Which partitions get rows is
    observed while they are written; of the rest the old state is dropped. The
    rows may read the table itself. Returns the values that got rows.
    """
    spark = rows.sparkSession
    seen = Observation()
    absent = ""  # no partition has this value: an empty one is stored as NULL
    parts = F.collect_set(F.coalesce(F.col(partition), F.lit(absent)))
    out = rows.select(*spark.table(name).columns).observe(seen, parts.alias("parts"))
    with _only_written_partitions(spark):
        out.write.mode("overwrite").insertInto(name)
    written = {None if v == absent else v for v in observed(seen, {"parts": []})["parts"] or []}
    for value in values - written:
        spec = "NULL" if value is None else f"'{_text(value)}'"
        spark.sql(f"ALTER TABLE {_quoted(name)} DROP IF EXISTS PARTITION ({_quoted(partition)} = {spec})")
    return written


def in_partitions(table: DataFrame, partition: str, values: set[str | None]) -> DataFrame:
    """The rows of the partitions ``values``; other partitions are not read."""
    known = [v for v in values if v is not None]
    chosen = F.col(partition).isin(known) if known else F.lit(False)
    return table.where(chosen | F.col(partition).isNull() if None in values else chosen)


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")
