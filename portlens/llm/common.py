"""Helpers shared by the operators of this package.

Every operator reads only the columns it names, so further columns (also ones
with clashing names) never reach it. Columns that a map-style operator adds to
whole rows get a name that the input doesn't have (`fresh_name`).
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portlens.session import shared_root

WORD_RULE = r"[^\x20\x09-\x0D]+"  # words: what bytes.split() gives for UTF-8 bytes
BLANK = b" \t\n\x0b\x0c\r"

_scratch: dict[str, str] = {}


BATCH_ROWS = 500  # rows of an Arrow batch: Spark's own 10,000 texts of 100 KB would be 1 GB a task


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever case it uses."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def _scratch_root(spark: SparkSession) -> str:
    """One folder an application under the shared folder, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = f"{shared_root(spark)}/portlens-llm/{app}-{uuid.uuid4().hex}"
        _scratch[app] = root

        def remove() -> None:
            try:
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # noqa: BLE001 - the session may be gone; the cluster cleans its folder
                pass

        atexit.register(remove)
    return _scratch[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a re-read, not a rerun of
    what made the table.
    """
    spark = df.sparkSession
    path = f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
