"""Named queries over the driver tables: each takes (spark, sf_dir).

Every query starts from the full `events` and `nation` tables: the banners
derived from them are serialised to NDJSON and parsed back, then run through
the same operators the batch job uses. Output columns drop the nested
`vulns` map (it is checked through the CVE queries) so results compare as
plain columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_OPTIONS, HIGH_RISK_THRESHOLD, Options
from ..functions import rules
from ..operators import outreach, prospects, rollup
from ..operators.score import score_relational, vuln_totals, with_base_score, with_cve_score
from ..operators.transform import explode_vulns, flatten, latest_per_key
from ..schema import pitch_schema, vulns_schema
from ..session import scratch_path
from ..sources.banners import EVENT_COLUMNS, banner_lines, driver_banner_lines, load_driver_tables, spread
from ..sources.ndjson import parse_ndjson, read_ndjson, write_ndjson, write_ndjson_zst
from ..sources.parquet import publish, read_optional, read_table, read_widened, register_views, write_table
from . import colocated, incremental, tables
from .etl import run_etl, scored_scans
from .refresh import ensure_table, keyed_upsert, refresh_org_scores
from .serving import publish as publish_tables
from .serving import serve

# Event-time split used by the incremental queries: events before the cutoff
# form the earlier snapshot, the rest (NULL time included) the later batch.
SNAPSHOT_CUTOFF = "2024-01-16 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def _banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_ndjson(driver_banner_lines(spark, sf_dir))


def _deduped(spark: SparkSession, sf_dir: str, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    return latest_per_key(flatten(_banners(spark, sf_dir)), options)


def _scans(spark: SparkSession, sf_dir: str, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    return scored_scans(_banners(spark, sf_dir), options)


def _org_scores(spark: SparkSession, sf_dir: str, options: Options = DEFAULT_OPTIONS) -> DataFrame:
    return rollup.org_scores(_scans(spark, sf_dir, options), options)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder: a query that reads its scans more than once parses the lines once."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _no_map(df: DataFrame) -> DataFrame:
    return df.drop("vulns")


# ------------------------------------------------------------------ ETL core


def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _no_map(flatten(_banners(spark, sf_dir)))


def q_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _no_map(_deduped(spark, sf_dir))


def q_explode_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_vulns(_deduped(spark, sf_dir))


def q_base_score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_base_score(_deduped(spark, sf_dir), explain_rules=True)
    rule_cols = [name for name, _, _ in rules.base_rules()]
    return scored.select("ip_str", "port", *rule_cols, "score_base")


def q_exclusion_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_base_score(_deduped(spark, sf_dir)).select("ip_str", "port", "org", "tags", "is_excluded")


def q_cve_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cve_score(explode_vulns(_deduped(spark, sf_dir)))


def q_vuln_score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vuln_totals(explode_vulns(_deduped(spark, sf_dir)))


def q_scored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = _stored(_deduped(spark, sf_dir), "deduped")
    return _no_map(score_relational(deduped, explode_vulns(deduped)))


def q_scored_scans_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _no_map(_scans(spark, sf_dir))


def q_org_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _org_scores(spark, sf_dir)


def q_ingest_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read by the permissive parse, and how many came back without a
    key part (ip_str or port NULL)."""
    banners = _banners(spark, sf_dir)
    return banners.agg(
        F.count(F.lit(1)).alias("n_banners"),
        F.count_if(F.col("ip_str").isNull() | F.col("port").isNull()).alias("n_without_key"),
    )


# ------------------------------------------------------------ serving queries


def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.kpis(_org_scores(spark, sf_dir))


def q_top10_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.top_orgs(_org_scores(spark, sf_dir))


def q_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.score_histogram(_org_scores(spark, sf_dir))


def q_prospect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.prospect_filter(_org_scores(spark, sf_dir), min_score=40.0, min_ips=2)


def q_prospect_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.export_view(_org_scores(spark, sf_dir), sort_by="total_ips")


def q_org_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.org_selector(_org_scores(spark, sf_dir))


def q_org_deep_dive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _stored(_scans(spark, sf_dir), "scored")
    return prospects.org_infrastructure(scans, rollup.org_scores(scans))


def q_org_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _stored(_scans(spark, sf_dir), "scored")
    return prospects.org_cves(explode_vulns(scans), scans)


def q_geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.geo_points(_scans(spark, sf_dir), min_score=0)


def q_geo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.geo_grid(_scans(spark, sf_dir))


def q_cloud_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.cloud_segments(_scans(spark, sf_dir))


def q_risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.risk_bands(_org_scores(spark, sf_dir))


# ------------------------------------------------------------------ outreach


def _before_cutoff():
    return F.coalesce(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{SNAPSHOT_CUTOFF}'"), F.lit(False))


def _snapshot_lines(spark, sf_dir, earlier: bool):
    events, nation = load_driver_tables(spark, sf_dir)
    cond = _before_cutoff()
    return banner_lines(spread(events.where(cond if earlier else ~cond).select(*EVENT_COLUMNS)), nation)


def q_outreach_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _stored(_scans(spark, sf_dir), "scored")
    return outreach.outreach_context(scans, rollup.org_scores(scans))


def q_outreach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _stored(_scans(spark, sf_dir), "scored")
    return outreach.outreach_text(outreach.outreach_context(scans, rollup.org_scores(scans)))


def _materialized(spark, lines, label):
    """Run the batch job and the rollup refresh into a fresh shared folder;
    return the written (scans, org_scores) tables."""
    root = scratch_path(spark, label)
    out = run_etl(spark, None, root, lines=lines)
    refresh_org_scores(spark, root, force=True)
    return read_table(spark, out.scans_path), read_table(spark, f"{root}/org_scores")


def q_outreach_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier refresh (events before the cutoff) generated pitches for
    its high-risk organisations; list the organisations eligible now that
    still lack one. Each snapshot is materialized once, as in production."""
    prev_scans, prev_scores = _materialized(spark, _snapshot_lines(spark, sf_dir, earlier=True), "prev")
    prev_texts = outreach.outreach_text(outreach.outreach_context(prev_scans, prev_scores))
    high = prev_scores.where(F.col("combined_risk_score") >= HIGH_RISK_THRESHOLD).select("org")
    generated_at = F.expr(f"TIMESTAMP '{SNAPSHOT_CUTOFF}'")
    new_pitches = outreach.pitch_rows(prev_texts.join(high, "org", "left_semi"), generated_at)
    path = scratch_path(spark, "ai_pitches")
    ensure_table(spark, path, pitch_schema)
    cache = keyed_upsert(spark, path, new_pitches, "org", pitch_schema)
    _, scores = _materialized(spark, driver_banner_lines(spark, sf_dir), "current")
    eligible = outreach.eligible_orgs(scores)
    return outreach.pitches_needed(eligible, cache).select("org", "pitch_rank", "combined_risk_score")


# ------------------------------------------------------- storage round trips


def q_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ndjson-gz")
    write_ndjson(driver_banner_lines(spark, sf_dir), path, compression="gzip")
    return _no_map(flatten(read_ndjson(spark, path)))


def q_zst_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ndjson-zst")
    write_ndjson_zst(driver_banner_lines(spark, sf_dir), path)
    return _no_map(latest_per_key(flatten(read_ndjson(spark, path))))


def q_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_etl(spark, None, scratch_path(spark, "etl"), lines=driver_banner_lines(spark, sf_dir))
    return read_table(spark, out.scans_path).drop("vulns")


def q_optional_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "etl")
    out = run_etl(spark, None, root, lines=driver_banner_lines(spark, sf_dir))
    missing = read_optional(spark, f"{root}/no_such_table", vulns_schema)
    return read_optional(spark, out.vulns_path, vulns_schema).unionByName(missing)


def q_merge_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older part files lack two columns; a merged read fills them with NULL."""
    scans = _stored(_no_map(_scans(spark, sf_dir)), "scored")
    old = F.coalesce(F.col("timestamp") < F.expr(f"TIMESTAMP '{SNAPSHOT_CUTOFF}'"), F.lit(False))
    path = scratch_path(spark, "merge")
    write_table(scans.where(old).drop("http_title", "cloud_service"), f"{path}/batch=1")
    write_table(scans.where(~old), f"{path}/batch=2")
    return read_table(spark, path, merge_schema=True).drop("batch")


def q_org_scores_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving tier through the SQL API: write the ETL output, register views
    over the Parquet directories (replacing older ones), run the rollup SQL."""
    out = run_etl(spark, None, scratch_path(spark, "views"), lines=driver_banner_lines(spark, sf_dir))
    register_views(spark, {
        "portlens_scans": read_table(spark, out.scans_path),
        "portlens_vulns": read_optional(spark, out.vulns_path, vulns_schema),
    })
    return rollup.org_scores_sql(spark, "portlens_scans")


def q_refresh_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First refresh builds the rollup (table missing); an immediate second
    one finds a fresh stamp and keeps it."""
    root = scratch_path(spark, "serving")
    run_etl(spark, None, root, lines=driver_banner_lines(spark, sf_dir))
    refresh_org_scores(spark, root)
    refresh_org_scores(spark, root)
    return read_table(spark, f"{root}/org_scores")


def q_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-organisation rollup of the earlier snapshot, then insert-or-replace
    with the rollup of the later batch (the later batch wins per org)."""
    path = scratch_path(spark, "org_snapshot")
    earlier = rollup.org_scores(scored_scans(parse_ndjson(_snapshot_lines(spark, sf_dir, earlier=True))))
    later = rollup.org_scores(scored_scans(parse_ndjson(_snapshot_lines(spark, sf_dir, earlier=False))))
    write_table(earlier, path)
    return keyed_upsert(spark, path, later, "org")


def _published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    src, dst = scratch_path(spark, "local"), scratch_path(spark, "published")
    run_etl(spark, None, src, lines=driver_banner_lines(spark, sf_dir))
    refresh_org_scores(spark, src, force=True)
    publish(spark, src, dst)
    return read_table(spark, f"{dst}/{name}")


def q_publish_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "org_scores")


def q_publish_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "scans").drop("vulns")


def q_publish_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, "vulns")


def q_etl_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job over files: every line written, some again as an array of
    two (the same scan twice, which the dedup takes back), with lines of blanks
    and tabs and malformed and truncated ones, which have no key."""
    lines = driver_banner_lines(spark, sf_dir)
    again = F.pmod(F.xxhash64("value"), F.lit(50)) == 0
    arrays = lines.where(again).select(F.concat(F.lit("["), "value", F.lit(","), "value", F.lit("]")).alias("value"))
    odd = spark.createDataFrame([("",), (" \t",), ("not json",), ('{"ip_str": "1.2.3',), ("[]",)], "value string")
    path = scratch_path(spark, "ndjson-files")
    write_ndjson(lines.unionByName(arrays).unionByName(odd), path)
    out = run_etl(spark, path, scratch_path(spark, "etl-files"))
    return read_table(spark, out.scans_path).drop("vulns").where(F.col("ip_str").isNotNull() | F.col("port").isNotNull())


def q_refresh_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the refresh decides with no, a fresh and a stale stamp, forced, and with metadata of another shape."""
    root = scratch_path(spark, "decision")
    run_etl(spark, None, root, lines=driver_banner_lines(spark, sf_dir))
    now = dt.datetime(2024, 3, 1)
    later = lambda s: now + dt.timedelta(seconds=s)
    steps = [("1 missing", refresh_org_scores(spark, root, now=now)),
             ("2 fresh", refresh_org_scores(spark, root, now=later(600))),
             ("3 stale", refresh_org_scores(spark, root, now=later(601))),
             ("4 forced", refresh_org_scores(spark, root, now=later(602), force=True))]
    write_table(spark.createDataFrame([(1,)], "other int"), f"{root}/db_metadata")
    steps.append(("5 bad metadata", refresh_org_scores(spark, root, now=later(603))))
    return spark.createDataFrame(steps, "step string, rebuilt boolean")


# --------------------------------------------------- batches, quarantine, catalog


def _database(spark: SparkSession, label: str) -> str:
    """A fresh database whose tables live under the shared folder."""
    path = scratch_path(spark, label)
    return tables.ensure_database(spark, f"portlens_{path.rsplit('-', 1)[-1]}", path)


def _loaded(spark: SparkSession, sf_dir: str) -> str:
    """A database loaded with the earlier snapshot, then with the later batch."""
    database = _database(spark, "incremental")
    for earlier in (True, False):
        incremental.load_batch(spark, database, parse_ndjson(_snapshot_lines(spark, sf_dir, earlier)))
    return database


def q_incremental_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _no_map(incremental.current_scans(spark, _loaded(spark, sf_dir)))


def q_incremental_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.current_vulns(spark, _loaded(spark, sf_dir))


def q_incremental_org_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.current_org_scores(spark, _loaded(spark, sf_dir))


def _damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banner lines in which four of 101 events hold a damaged line instead."""
    events, nation = load_driver_tables(spark, sf_dir)
    case, e = F.col("event_id") % 101, F.col("event_id").cast("string")
    damage = (
        F.when(case == 0, F.concat(F.lit('{"ip_str": "10.9.9.'), e))
        .when(case == 1, F.concat(F.lit('{"ip_str": "10.9.9.9", "port": "p'), e, F.lit('"}')))
        .when(case == 2, F.concat(F.lit('[{"port": 1}, {"port": "q'), e, F.lit('"}]')))
        .when(case == 3, e)
    )
    whole = banner_lines(spread(events.where(case > 3).select(*EVENT_COLUMNS)), nation)
    return whole.unionByName(events.where(case <= 3).select(damage.alias("value")))


def _quarantined(spark: SparkSession, sf_dir: str):
    path, root = scratch_path(spark, "damaged"), scratch_path(spark, "quarantine")
    write_ndjson(_damaged_lines(spark, sf_dir), path)
    return run_etl(spark, path, root, Options(malformed_as_null_row=False), quarantine=True)


def q_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a record and records with a wrong-typed field, with their text."""
    return read_table(spark, _quarantined(spark, sf_dir).rejected_path, merge_schema=False)


def q_quarantined_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans of the same run: lines without a record leave no row, wrong-typed fields a NULL."""
    return read_table(spark, _quarantined(spark, sf_dir).scans_path, merge_schema=False).drop("vulns")


def _served(spark: SparkSession, lines: DataFrame, database: str) -> None:
    root = scratch_path(spark, "served")
    run_etl(spark, None, root, lines=lines)
    serve(spark, root, database, force=True)


def q_catalog_org_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup as a catalog table, where a view of that name stood, over persistent views."""
    database = _database(spark, "catalog")
    spark.sql(f"CREATE VIEW {database}.org_scores AS SELECT 1 AS old")
    spark.sql(f"CREATE TABLE {database}.scans (old INT) USING parquet")
    _served(spark, driver_banner_lines(spark, sf_dir), database)
    return spark.table(f"{database}.org_scores")


def q_catalog_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch table: a text for every organisation of the earlier snapshot, then
    new ones for those at high risk now. The insert time is the column's default."""
    database = _database(spark, "pitches")
    name = f"{database}.ai_pitches"
    for earlier in (True, False):
        lines = _snapshot_lines(spark, sf_dir, True) if earlier else driver_banner_lines(spark, sf_dir)
        _served(spark, lines, database)
        scores = spark.table(f"{database}.org_scores")
        texts = outreach.outreach_text(outreach.outreach_context(spark.table(f"{database}.scans"), scores))
        high = scores.where(F.col("combined_risk_score") >= HIGH_RISK_THRESHOLD).select("org")
        chosen = texts if earlier else texts.join(high, "org", "left_semi")
        tables.upsert(spark, name, chosen.select("org", F.col("fallback_text").alias("pitch_text")))
    stamped = F.col("generated_at").between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp())
    return spark.table(name).select("org", "pitch_text", stamped.alias("stamped"))


def q_publish_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three tables published to another database, over older ones."""
    source, target = _database(spark, "source"), _database(spark, "target")
    for lines in (_snapshot_lines(spark, sf_dir, earlier=True), driver_banner_lines(spark, sf_dir)):
        _served(spark, lines, source)
        names = publish_tables(spark, source, target)
    counts = [spark.table(f"{target}.{n}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    return reduce(DataFrame.unionByName, counts)


def q_scored_scans_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational score over two tables bucketed by its join key."""
    database = _database(spark, "colocated")
    colocated.write_colocated(spark, database, _deduped(spark, sf_dir), buckets=8)
    return _no_map(colocated.score_colocated(spark, database))


def q_etl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch job counted while it wrote."""
    out = run_etl(spark, None, scratch_path(spark, "metrics"), lines=driver_banner_lines(spark, sf_dir))
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in out.metrics.items()])


def q_geo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prospects.geo_levels(_scans(spark, sf_dir))


LOOKUP_IPS = ["10.0.0.8", "10.1.1.1", "10.2.2.50", "10.3.3.999999", "none"]


def q_ip_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of a few IPs out of the written `scans`."""
    out = run_etl(spark, None, scratch_path(spark, "lookup"), lines=driver_banner_lines(spark, sf_dir))
    return prospects.ip_services(read_table(spark, out.scans_path, merge_schema=False), LOOKUP_IPS)


def q_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospects of one country exported as sorted CSV and read back with their types."""
    path = scratch_path(spark, "export")
    chosen = prospects.prospect_filter(_org_scores(spark, sf_dir), country="FRANCE")
    rows = prospects.export_view(chosen)
    order = [F.col("combined_risk_score").desc(), F.col("org").asc()]
    prospects.export_sorted(rows, path, order, file_rows=100)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


def q_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of scans: the older one with narrower ports, scores as text and without two columns."""
    scans = _stored(_no_map(_scans(spark, sf_dir)), "scored")
    old = F.coalesce(F.col("timestamp") < F.expr(f"TIMESTAMP '{SNAPSHOT_CUTOFF}'"), F.lit(False))
    path = scratch_path(spark, "drift")
    older = scans.where(old).drop("http_title", "isp").withColumns(
        {"port": F.col("port").cast("long"), "ip_risk_score": F.col("ip_risk_score").cast("int"),
         "score_base": F.col("score_base").cast("string"), "latitude": F.col("latitude").cast("float")})
    write_table(older, f"{path}/old")
    write_table(scans.where(~old), f"{path}/new")
    return read_widened(spark, [f"{path}/old", f"{path}/new"])


QUERIES: dict[str, Query] = {
    "ingest_count": q_ingest_count,
    "flatten": q_flatten,
    "dedup_latest": q_dedup_latest,
    "explode_vulns": q_explode_vulns,
    "base_score_rules": q_base_score_rules,
    "exclusion_flag": q_exclusion_flag,
    "cve_score": q_cve_score,
    "vuln_score_total": q_vuln_score_total,
    "scored_scans": q_scored_scans,
    "scored_scans_fused": q_scored_scans_fused,
    "org_scores": q_org_scores,
    "kpis": q_kpis,
    "top10_orgs": q_top10_orgs,
    "score_histogram": q_score_histogram,
    "prospect_filter": q_prospect_filter,
    "prospect_sort": q_prospect_sort,
    "org_selector": q_org_selector,
    "org_deep_dive": q_org_deep_dive,
    "org_cves": q_org_cves,
    "geo_points": q_geo_points,
    "geo_grid": q_geo_grid,
    "cloud_segments": q_cloud_segments,
    "risk_bands": q_risk_bands,
    "outreach_context": q_outreach_context,
    "outreach_text": q_outreach_text,
    "outreach_pending": q_outreach_pending,
    "json_roundtrip": q_json_roundtrip,
    "zst_scan": q_zst_scan,
    "partitioned_roundtrip": q_partitioned_roundtrip,
    "optional_vulns": q_optional_vulns,
    "merge_schema": q_merge_schema,
    "org_scores_sql": q_org_scores_sql,
    "refresh_ttl": q_refresh_ttl,
    "metadata_upsert": q_metadata_upsert,
    "publish_copy": q_publish_copy,
    "publish_scans": q_publish_scans,
    "publish_vulns": q_publish_vulns,
    "etl_from_files": q_etl_from_files,
    "refresh_decision": q_refresh_decision,
    "incremental_scans": q_incremental_scans,
    "incremental_vulns": q_incremental_vulns,
    "incremental_org_scores": q_incremental_org_scores,
    "rejected_lines": q_rejected_lines,
    "quarantined_scans": q_quarantined_scans,
    "catalog_org_scores": q_catalog_org_scores,
    "catalog_pitches": q_catalog_pitches,
    "publish_together": q_publish_together,
    "scored_scans_colocated": q_scored_scans_colocated,
    "etl_metrics": q_etl_metrics,
    "geo_levels": q_geo_levels,
    "ip_lookup": q_ip_lookup,
    "export_csv": q_export_csv,
    "schema_drift": q_schema_drift,
}
