"""Parquet tables in and out, temp-view registration and table publishing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, NullType, StringType, StructField, StructType, TimestampType

from ..config import DEFAULT_OPTIONS, UNKNOWN_COUNTRY, Options

# --------------------------------------------------------------------- read


def read_table(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """Parquet directory with Hive partitions discovered and part-file
    schemas merged by column name (a column missing from some files reads
    as NULL there). Partition values stay strings (see session conf). Of a
    table written in versions the current one is read."""
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(current_version(spark, path))


# A table that is replaced while it is read keeps each state in a folder of its
# own; a one-line pointer file names the current one. Both names are hidden from
# Spark's readers.
POINTER, VERSION = "_CURRENT", "_v-"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str:
    """The folder that holds the table's current state: ``path`` itself unless a pointer names another."""
    jvm, pointer, fs = _file_system(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(pointer):
        return path
    stream = fs.open(pointer)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def write_version(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a new state of the table, then switch the pointer to it by one rename.

    Until the switch readers see the old state, and a failed write changes
    nothing. The state before is kept for readers that have begun; older ones
    are deleted. A table has one writer at a time."""
    path = path.rstrip("/")
    before = current_version(spark, path)
    name = f"{VERSION}{uuid.uuid4().hex}"
    write_table(df, f"{path}/{name}")
    jvm, pointer, fs = _file_system(spark, f"{path}/{POINTER}")
    _, fresh, _ = _file_system(spark, f"{path}/_next-{name}")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, pointer, options)
    keep = {name, before.rsplit("/", 1)[-1]}
    for status in fs.listStatus(pointer.getParent()):
        old = status.getPath()
        if old.getName().startswith(VERSION) and old.getName() not in keep:
            fs.delete(old, True)


def read_optional(spark: SparkSession, path: str, schema: StructType, merge_schema: bool = True) -> DataFrame:
    """Like ``read_table`` but an absent path yields an empty frame of ``schema``."""
    try:
        return read_table(spark, path, merge_schema)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return spark.createDataFrame([], schema)
        raise


#: Number types from narrow to wide. Of two that differ the wider one is taken.
_WIDTH = {t: i for i, t in enumerate(("tinyint", "smallint", "int", "bigint", "float", "double"))}


def _widened(a: DataType, b: DataType) -> DataType:
    """A type that holds the values of both: the wider number, a timestamp for a date, else text."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, StructType) and isinstance(b, StructType):
        return _reconciled([a, b])
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(_widened(a.elementType, b.elementType))
    names = {a.simpleString(), b.simpleString()}
    if names <= set(_WIDTH):
        # a float or an int of 32 bits doesn't hold the other's values, nor does a float a bigint's
        wide = max(names, key=_WIDTH.get)
        return DoubleType() if wide == "float" and names & {"int", "bigint"} else a if a.simpleString() == wide else b
    if names == {"date", "timestamp"}:
        return TimestampType()
    return StringType()


def _reconciled(schemas: list[StructType]) -> StructType:
    """All columns by name, in the order in which they first come, each wide enough for every schema."""
    types: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema:
            types[f.name] = _widened(types[f.name], f.dataType) if f.name in types else f.dataType
    return StructType([StructField(name, t) for name, t in types.items()])


def read_widened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union by name of folders (batches) whose columns differ, also in type.

    One folder has one schema, read from its footers. Each folder's columns are
    cast to the reconciled types where it is read, and columns it lacks are NULL;
    filters still reach its files.
    """
    parts = [spark.read.parquet(p) for p in paths]
    schema = _reconciled([p.schema for p in parts])

    def conformed(part: DataFrame) -> DataFrame:
        own = set(part.columns)
        columns = [(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        return part.select(*columns)

    return reduce(DataFrame.unionByName, map(conformed, parts))


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """(Re)register temp views; an older view or temp table of the same name is replaced."""
    for name, df in frames.items():
        spark.catalog.dropTempView(name)
        df.createOrReplaceTempView(name)


# -------------------------------------------------------------------- write


def write_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None,
                max_records_per_file: int | None = None, lookup_columns: tuple[str, ...] = ()) -> None:
    """Overwrite a Parquet directory (Snappy). Overwrite already removes the
    old content, so no separate delete step. ``lookup_columns`` get a Bloom
    filter a row group, as large as its distinct values need."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    for column in lookup_columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.adaptive.enabled#{column}", "true")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def with_country_partition(scored: DataFrame, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    """NULL country code -> 'unknown' (an empty code stays, as in the original,
    unless ``empty_country_as_unknown``)."""
    cc = F.col("country_code")
    missing = cc.isNull()
    if options.empty_country_as_unknown:
        missing = missing | (cc == "")
    return scored.withColumn("country_code", F.when(missing, F.lit(UNKNOWN_COUNTRY)).otherwise(cc))


def write_scans(scored: DataFrame, path: str, options: Options = DEFAULT_OPTIONS,
                partitions: int | None = None, max_records_per_file: int = 5_000_000) -> None:
    """Hive-partitioned `scans` output, one directory per country.

    A REBALANCE on country_code hash-partitions the rows, and AQE then
    splits any partition over the advisory size (a country holding a large
    share of all rows is written by many tasks) and merges small ones (small
    countries share a task), from the measured map output. No sampling pass
    is needed, so the upstream (dedup) output is read once. Within a task,
    rows are sorted by country then organisation: the writer needs the
    country order anyway, and the organisation order gives Parquet row-group
    stats that let per-organisation lookups skip the rest of a file.
    """
    filled = with_country_partition(scored, options)
    hint = ("rebalance", partitions, "country_code") if partitions else ("rebalance", "country_code")
    out = filled.hint(*hint).sortWithinPartitions("country_code", "org", "ip_str", "port")
    write_table(out, path, partition_by="country_code", max_records_per_file=max_records_per_file, lookup_columns=("ip_str",))


def publish(spark: SparkSession, source_root: str, target_root: str,
            tables: tuple[str, ...] = ("scans", "vulns", "org_scores"),
            optional: tuple[str, ...] = ("vulns",)) -> list[str]:
    """Full copy of each table to another location; absent optional tables
    are skipped. Returns the names copied."""
    copied = []
    for name in tables:
        src = f"{source_root.rstrip('/')}/{name}"
        try:
            df = read_table(spark, src)
        except AnalysisException as exc:
            if name in optional and "PATH_NOT_FOUND" in str(exc):
                continue
            raise
        parts = [c for c in ("country_code",) if c in df.columns and name == "scans"]
        write_table(df, f"{target_root.rstrip('/')}/{name}", partition_by=parts or None)
        copied.append(name)
    return copied
