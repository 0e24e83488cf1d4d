"""Benchmark: the batch job and the serving queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.

Untimed: the whole sequence once on sf0.001 (JVM/codegen warm-up).
Timed steps:
  stage_ndjson    banners derived from `events` written as NDJSON files (the
                  job's input; the original reads NDJSON files)
  etl             NDJSON files -> parse -> flatten -> dedup -> score ->
                  partitioned `scans` + `vulns` Parquet
  org_scores      rollup read from the written `scans`, written back (refresh)
  the rest        dashboard / outreach queries over the written tables,
                  each executed in full into Spark's no-op sink
Reported apart: etl_replay_* = the ETL over the staged NDJSON listed 10
times (per-byte throughput once fixed per-stage costs are amortised);
score_form_seconds = fused vs relational CVE scoring from the same input.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from portlens.operators import outreach, prospects  # noqa: E402
from portlens.operators.transform import explode_vulns  # noqa: E402
from portlens.plans.etl import run_etl, scored_scans  # noqa: E402
from portlens.plans.refresh import refresh_org_scores  # noqa: E402
from portlens.session import local_session, scratch_path  # noqa: E402
from portlens.sources.banners import driver_banner_lines  # noqa: E402
from portlens.sources.ndjson import read_ndjson, write_ndjson  # noqa: E402
from portlens.sources.parquet import read_table  # noqa: E402


REPLAY = 10


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def run_all(spark, sf_dir: str, times: dict[str, float]) -> tuple[int, str]:
    lines = driver_banner_lines(spark, sf_dir)
    root = scratch_path(spark, "bench")
    staged = f"{root}/input"

    t = time.perf_counter()
    write_ndjson(lines, staged)
    times["stage_ndjson"] = time.perf_counter() - t

    t = time.perf_counter()
    out = run_etl(spark, staged, root)
    times["etl"] = time.perf_counter() - t

    t = time.perf_counter()
    refresh_org_scores(spark, root, force=True)
    times["org_scores"] = time.perf_counter() - t

    scans = read_table(spark, out.scans_path)
    vulns = read_table(spark, out.vulns_path)
    orgs = read_table(spark, f"{root}/org_scores")
    serving = {
        "kpis": lambda: prospects.kpis(orgs),
        "top10_orgs": lambda: prospects.top_orgs(orgs),
        "score_histogram": lambda: prospects.score_histogram(orgs),
        "prospect_filter": lambda: prospects.prospect_filter(orgs, 40.0, 2),
        "org_deep_dive": lambda: prospects.org_infrastructure(scans, orgs),
        "org_cves": lambda: prospects.org_cves(vulns, scans),
        "geo_grid": lambda: prospects.geo_grid(scans),
        "cloud_segments": lambda: prospects.cloud_segments(scans),
        "cve_rows": lambda: explode_vulns(scans),
        "outreach_text": lambda: outreach.outreach_text(outreach.outreach_context(scans, orgs)),
    }
    for name, build in serving.items():
        t = time.perf_counter()
        _run(build())
        times[name] = time.perf_counter() - t
    return int(spark.read.text(staged).agg(F.sum(F.length("value"))).first()[0] or 0), staged


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="portlens-bench")
    sf = os.path.basename(sf_dir).replace("sf", "")

    warm = "/root/testdata/sf0.001"
    run_all(spark, warm if os.path.isdir(warm) else sf_dir, {})  # warm-up, untimed
    times: dict[str, float] = {}
    input_bytes, staged = run_all(spark, sf_dir, times)
    total = sum(times.values())

    # Steady-state throughput (reported apart from the query times): the same
    # staged NDJSON listed REPLAY times, so the ETL parses REPLAY x the bytes
    # (the copies collapse in the dedup). At sf0.1 one pass is mostly fixed
    # per-stage cost; this shows the per-byte rate.
    t = time.perf_counter()
    run_etl(spark, [staged] * REPLAY, scratch_path(spark, "bench-replay"))
    replay_s = time.perf_counter() - t

    # Design check (also apart): fused CVE score vs the relational form
    # (explode -> aggregate -> left join), both from the staged NDJSON.
    forms = {}
    for form, fused in (("fused", True), ("relational", False)):
        t = time.perf_counter()
        _run(scored_scans(read_ndjson(spark, staged), fused=fused))
        forms[form] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "ndjson_mb": round(input_bytes / 1e6, 2),
        "etl_mb_per_s": round(input_bytes / 1e6 / times["etl"], 2) if times["etl"] else None,
        "etl_replay_x": REPLAY,
        "etl_replay_seconds": round(replay_s, 3),
        "etl_replay_mb_per_s": round(REPLAY * input_bytes / 1e6 / replay_s, 2),
        "score_form_seconds": forms,
    }))


if __name__ == "__main__":
    main()
