"""NDJSON scan records in: plain, gzip or zstd text, always with an explicit schema.

Compressed files are decoded by extension (``.gz``, ``.zst``). Neither codec
is splittable, so one compressed file is read by one task. With
``min_partitions`` a scan that yields fewer tasks reads raw lines instead,
spreads them round-robin and parses them in parallel: only decompression
stays in the single task, the JSON parse (the expensive part) does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..schema import scan_schema


COMPRESSED = (".gz", ".zst", ".bz2")
EXPANSION = 10  # bytes of NDJSON that a byte of a compressed file is taken for


def input_bytes(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of text below ``path``, from the scan's plan statistics: files are listed, none is read."""
    files = spark.read.text(path)
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size * EXPANSION if any(f.endswith(COMPRESSED) for f in files.inputFiles()) else size


def read_ndjson(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType = scan_schema,
    min_partitions: int | None = None,
) -> DataFrame:
    """Permissive read: a malformed line becomes an all-NULL row and a
    wrong-typed field becomes NULL while the rest of the row is kept.

    Every read goes through ``parse_ndjson``, whatever the number of
    partitions, so ``min_partitions`` spreads the parse and changes nothing
    else."""
    return parse_ndjson(read_lines(spark, path, min_partitions), schema)


def read_lines(spark: SparkSession, path: str | list[str], min_partitions: int | None = None) -> DataFrame:
    """The text lines below ``path`` in column ``value``, spread when the scan yields fewer tasks than ``min_partitions``."""
    lines = spark.read.text(path)
    if min_partitions and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    return lines


def parse_ndjson(lines: DataFrame, schema: StructType = scan_schema, column: str = "value") -> DataFrame:
    """Parse a text column of NDJSON lines as Spark's JSON file reader does:
    an object is one row, a top-level array one row per element, a malformed
    line one all-NULL row, and a line of JSON white space (or NULL) none."""
    # One expression under the explode: a filter on the parsed records would be
    # pushed below their projection, and each of its uses parse the line again.
    text = F.col(column)
    records = F.from_json(text, ArrayType(schema), {"mode": "PERMISSIVE"})
    null_record = F.array(F.lit(None).cast(schema))
    rows = F.when(text.rlike(r"[^ \t\r\n]"), F.coalesce(records, null_record))
    each = lines.select(F.explode(rows).alias("_rec"))
    return each.select([F.col("_rec").getField(f.name).alias(f.name) for f in schema.fields])


REJECTED = "_rejected"
_CORRUPT = "_corrupt_record"


def parse_checked(lines: DataFrame, schema: StructType = scan_schema, column: str = "value") -> DataFrame:
    """The rows of ``parse_ndjson`` and, from the same parse, a column REJECTED:
    struct(line, position, reason), NULL where the record is as the schema says.

    Reasons: ``malformed`` (no JSON: an all-NULL row), ``not_an_object`` (JSON,
    but no record: an all-NULL row) and ``wrong_type`` (at least one field is
    NULL because its type differs; the rest of the row is kept). ``line`` is the
    whole input line, ``position`` the record's place in an array line, else 0.
    """
    text = F.col(column)
    checked = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    parse = lambda t: F.from_json(t, checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    array_of_records = text.rlike(r"^[ \t\r\n]*\[") & F.from_json(text, ArrayType(schema), {"mode": "PERMISSIVE"}).isNotNull()
    records = (
        F.when(text.rlike(r"^[ \t\r\n]*\{"), F.array(parse(text)))
        .when(array_of_records, F.transform(F.from_json(text, "array<string>"), parse))
        .otherwise(F.array(F.lit(None).cast(checked)))
    )
    each = lines.where(text.rlike(r"[^ \t\r\n]")).select(text.alias("_line"), F.posexplode(records).alias("_pos", "_rec"))
    record, corrupt = F.col("_rec"), F.col("_rec").getField(_CORRUPT)
    reason = (
        F.when(F.try_parse_json("_line").isNull(), "malformed")
        .when(record.isNull(), "not_an_object")
        .otherwise("wrong_type")
    )
    entry = F.struct(F.col("_line").alias("line"), F.col("_pos").alias("position"), reason.alias("reason"))
    fields = [record.getField(f.name).alias(f.name) for f in schema.fields]
    return each.select(*fields, F.when(record.isNull() | corrupt.isNotNull(), entry).alias(REJECTED))


def accepted(parsed: DataFrame, malformed_as_null_row: bool = True) -> DataFrame:
    """The rows of a checked parse that go on: all, or without those that hold no record."""
    if not malformed_as_null_row:
        reason = F.col(REJECTED).getField("reason")
        parsed = parsed.where(reason.isNull() | (reason == "wrong_type"))
    return parsed.drop(REJECTED)


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """line, position, reason of a checked parse."""
    return parsed.where(F.col(REJECTED).isNotNull()).select(f"{REJECTED}.*")


def write_ndjson(lines: DataFrame, path: str, compression: str = "none", column: str = "value") -> None:
    """Write a text column of NDJSON lines (codecs Spark ships: gzip, bzip2, ...)."""
    lines.select(column).write.mode("overwrite").option("compression", compression).text(path)


def _arrow_uri(path: str) -> str:
    """A URI pyarrow understands for a Spark/Hadoop path ("file:/x" -> "file:///x")."""
    import os

    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    if "://" not in path:
        return "file://" + os.path.abspath(path)
    return path


def write_ndjson_zst(lines: DataFrame, path: str, column: str = "value") -> int:
    """Write one ``.json.zst`` file per partition.

    Spark's text writer has no zstd codec without native Hadoop libraries,
    so each task streams its own lines through Arrow's zstd output stream
    into a hidden per-attempt file, then renames it to a name that depends
    only on the partition index: a retried or speculative attempt replaces
    the part with identical content, never a partial one. Returns the
    number of lines.
    """
    target_uri = _arrow_uri(path)

    def compress(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part = ctx.partitionId()
        fs, root = pafs.FileSystem.from_uri(target_uri)
        fs.create_dir(root, recursive=True)
        final = f"{root}/part-{part:05d}.json.zst"
        # Hidden (dot-prefixed, ignored by readers) and unique per attempt, so
        # a failed or speculative attempt never leaves a half-written part.
        staging = f"{root}/.part-{part:05d}-{ctx.taskAttemptId()}.tmp"
        n = 0
        # The stream compresses with zstd (named explicitly, not by extension).
        with fs.open_output_stream(staging, compression="zstd", buffer_size=1 << 20) as out:
            for batch in batches:
                for v in batch.column(0).to_pylist():
                    if v is not None:
                        out.write(v.encode("utf-8") + b"\n")
                        n += 1
        fs.move(staging, final)
        yield pa.RecordBatch.from_pydict({"lines": [n]})

    counts = lines.select(column).mapInArrow(compress, "lines long")
    return int(counts.agg(F.sum("lines")).first()[0] or 0)
