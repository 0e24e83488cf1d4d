"""Session-level helpers: recommended settings and the shared work folder.

Nothing here creates a session for library code; every function takes the
caller's ``SparkSession``. ``local_session`` exists for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

# Settings the engine relies on. Parquet partition values stay strings so a
# country code such as "01" is not turned into an integer on read-back.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.compression.codec": "snappy",
}


def apply_recommended_conf(spark: SparkSession) -> None:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)


_MB = 1 << 20
_GB = 1 << 30


def exchange_width(input_bytes: int, projected_fraction: float = 0.5, reducer_bytes: int = 512 * _MB) -> int:
    """Reducers that get about ``reducer_bytes`` of projected rows each, without an upper clamp."""
    return max(1, -(-int(input_bytes * projected_fraction) // reducer_bytes))


@contextmanager
def widened_exchange(spark: SparkSession, reducers: int) -> Iterator[None]:
    """At least ``reducers`` shuffle partitions for the queries run inside; the setting before comes back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), reducers)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scale_conf(input_bytes: int, projected_fraction: float = 0.5) -> dict[str, str]:
    """Split and shuffle sizing for an NDJSON input of ``input_bytes``.

    - Input splits grow with the input (128 MB up to 1 TB, 512 MB up to
      20 TB, 1 GB beyond), so the map side stays at most ~100k tasks.
    - Shuffle partitions target ~512 MB of projected rows each, 200 at least
      and with no upper clamp, so that a reducer's share doesn't grow with the
      input. AQE coalesces toward the advisory size at runtime.
    """
    split = 128 * _MB if input_bytes < 1024 * _GB else 512 * _MB if input_bytes < 20 * 1024 * _GB else _GB
    reducers = max(200, exchange_width(input_bytes, projected_fraction))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(reducers),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * _MB),
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int) -> dict[str, str]:
    conf = scale_conf(input_bytes)
    for key, value in conf.items():
        spark.conf.set(key, value)
    return conf


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "portlens") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC clock)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PORTLENS_DRIVER_MEMORY", "8g"))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is a distributed file system path visible to every
    executor. Only when nothing is configured (a local test session) is a
    local folder created and registered as the checkpoint directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="portlens-ckpt-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{shared_root(spark)}/portlens/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A ``scratch_path`` that is deleted at the end."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def observed(observation: Observation, if_empty: dict) -> dict:
    """The observed values, ``if_empty`` where the optimizer took the observed rows for none and left them out of the plan."""
    try:
        return observation.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return if_empty
