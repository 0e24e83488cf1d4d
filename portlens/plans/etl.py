"""The batch job: NDJSON banners -> `scans` (partitioned) + `vulns` Parquet.

Plan shape (one JSON scan, two exchanges):

    JSON scan (trimmed schema) -> flatten (project) -> dedup (WindowGroupLimit
    map-side, exchange on ip_str/port, final window) -> fused score (project)
    -> rebalance exchange on country_code (AQE splits hot countries, merges
    small ones) -> partitioned write of `scans`;
    then  `scans` Parquet (4 columns read) -> explode -> `vulns`.

The JSON is parsed and deduplicated once. `vulns` is derived from the
written `scans` table: the lineage is cut at a table in the shared folder,
and both outputs always agree.
"""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_OPTIONS, Options
from ..operators.score import score_fused, score_relational
from ..operators.transform import explode_vulns, flatten, latest_per_key
from ..session import exchange_width, observed, scratch_folder, widened_exchange
from ..sources.ndjson import REJECTED, accepted, input_bytes, parse_checked, parse_ndjson, read_lines, rejected_lines
from ..sources.parquet import write_scans, write_table


def scored_scans(banners: DataFrame, options: Options = DEFAULT_OPTIONS, fused: bool = True,
                 drop_tie_break: bool = True) -> DataFrame:
    """Raw banner rows -> deduplicated, scored `scans` rows (before the
    country-code fill used for partitioning)."""
    deduped = latest_per_key(flatten(banners), options, drop_tie_break)
    if fused:
        return score_fused(deduped)
    return score_relational(deduped, explode_vulns(deduped))


@dataclass
class EtlResult:
    scans_path: str
    vulns_path: str
    rejected_path: str | None = None
    metrics: dict[str, int] = field(default_factory=dict)


def run_etl(
    spark: SparkSession,
    input_path: str | list[str] | None,
    output_root: str,
    options: Options = DEFAULT_OPTIONS,
    lines: DataFrame | None = None,
    min_input_partitions: int | None = None,
    output_partitions: int | None = None,
    quarantine: bool = False,
) -> EtlResult:
    """Ingest -> flatten -> dedup -> score -> export.

    Pass either an NDJSON ``input_path`` (plain/.gz/.zst files) or a frame of
    NDJSON ``lines``. When the file scan yields fewer tasks than
    ``min_input_partitions`` (default: the cluster's default parallelism),
    e.g. one big ``.json.zst``, raw lines are spread before the JSON parse.
    For files the exchanges get at least the width that their size asks for
    (``exchange_width``), whatever the session's setting.
    Nothing is cached: a lost executor's shuffle output or partially written
    task is recomputed from lineage by Spark's task retry, and the second
    output reads the first from storage.

    ``metrics`` of the result are counted while `scans` is written, without a
    job of their own (a map task that runs again after a lost executor is
    counted again).

    With ``quarantine`` lines that hold no record and records with a field of
    another type are also kept with their text in ``<root>/rejected``; the parse
    is then stored once, the rows to be rejected apart, and read by both outputs.
    """
    reducers = 1
    if lines is None:
        wanted = min_input_partitions or spark.sparkContext.defaultParallelism
        reducers = exchange_width(input_bytes(spark, input_path))
        lines = read_lines(spark, input_path, min_partitions=wanted)
    root = output_root.rstrip("/")
    result = EtlResult(f"{root}/scans", f"{root}/vulns", f"{root}/rejected" if quarantine else None)
    with widened_exchange(spark, reducers), ExitStack() as held:
        if quarantine:
            parsed_path = held.enter_context(scratch_folder(spark, "parsed"))
            checked = parse_checked(lines).withColumn("_bad", F.col(REJECTED).isNotNull().cast("int"))
            write_table(checked, parsed_path, partition_by="_bad")
            parsed = spark.read.schema(checked.schema).parquet(parsed_path)
            write_table(rejected_lines(parsed.where("_bad = 1")), result.rejected_path)
            banners = accepted(parsed.drop("_bad"), options.malformed_as_null_row)
        else:
            banners = parse_ndjson(lines)
        parsed_, scored_ = Observation("parsed"), Observation("scored")
        no_key = F.col("ip_str").isNull() | F.col("port").isNull()
        banners = banners.observe(parsed_, F.count(F.lit(1)).alias("n_banners"), F.count_if(no_key).alias("n_without_key"))
        scored = scored_scans(banners, options).observe(
            scored_, F.count(F.lit(1)).alias("n_scans"), F.count_if("is_excluded").alias("n_excluded"),
            F.count_if(F.col("is_excluded").isNull()).alias("n_exclusion_unknown"),
            F.coalesce(F.sum(F.greatest(F.size("vulns"), F.lit(0))), F.lit(0)).cast("long").alias("n_cves"))
        write_scans(scored, result.scans_path, options, partitions=output_partitions)
        none = dict.fromkeys(("n_banners", "n_without_key"), 0), dict.fromkeys(("n_scans", "n_excluded", "n_exclusion_unknown", "n_cves"), 0)
        result.metrics = observed(parsed_, none[0]) | observed(scored_, none[1])
    # our own output, one known schema, also where there is no row and so no file
    scans = spark.read.schema(scored.schema).parquet(result.scans_path).select("ip_str", "port", "org", "vulns")
    write_table(explode_vulns(scans), result.vulns_path)
    return result
