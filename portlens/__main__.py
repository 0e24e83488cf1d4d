"""Command line: ``python -m portlens <command> ...`` (via spark-submit on a cluster).

    etl INPUT OUTPUT_ROOT         NDJSON (plain/.gz/.zst) -> scans/ + vulns/
    refresh ROOT [--force]        rebuild ROOT/org_scores when stale (TTL)
    publish SOURCE_ROOT TARGET    copy scans, vulns (if present), org_scores

The session comes from the environment (master, memory and the shared
``spark.checkpoint.dir`` are deployment settings). The Spark web UI is off
unless ``PORTLENS_SPARK_UI=true``.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .config import ROLLUP_TTL_SECONDS, Options
from .plans.etl import run_etl
from .plans.refresh import refresh_org_scores
from .session import apply_recommended_conf, apply_scale_conf
from .sources.parquet import publish


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="portlens")
    sub = parser.add_subparsers(dest="command", required=True)
    etl = sub.add_parser("etl")
    etl.add_argument("input", nargs="+")
    etl.add_argument("output_root")
    etl.add_argument("--min-input-partitions", type=int, default=None)
    etl.add_argument("--input-gb", type=float, default=None,
                     help="input size; sizes splits too (session.scale_conf); exchanges size themselves")
    etl.add_argument("--null-excluded-as-false", action="store_true")
    etl.add_argument("--rejected", action="store_true", help="keep bad lines with their text in OUTPUT_ROOT/rejected")
    etl.add_argument("--drop-malformed", action="store_true",
                     help="with --rejected: lines without a record leave no all-NULL row in scans")
    etl.add_argument("--empty-country-as-unknown", action="store_true")
    ref = sub.add_parser("refresh")
    ref.add_argument("root")
    ref.add_argument("--force", action="store_true")
    ref.add_argument("--ttl", type=float, default=ROLLUP_TTL_SECONDS)
    ref.add_argument("--null-excluded-as-false", action="store_true")
    pub = sub.add_parser("publish")
    pub.add_argument("source_root")
    pub.add_argument("target_root")
    args = parser.parse_args(argv)

    # The web UI is a server; it stays off unless the operator asks for it.
    ui = os.environ.get("PORTLENS_SPARK_UI", "false")
    spark = (SparkSession.builder.appName(f"portlens-{args.command}")
             .config("spark.ui.enabled", ui).getOrCreate())
    apply_recommended_conf(spark)
    if args.command == "etl":
        if args.input_gb:
            print("sizing:", apply_scale_conf(spark, int(args.input_gb * (1 << 30))))
        opts = Options(null_excluded_as_false=args.null_excluded_as_false,
                       empty_country_as_unknown=args.empty_country_as_unknown,
                       malformed_as_null_row=not args.drop_malformed)
        out = run_etl(spark, args.input, args.output_root, opts, min_input_partitions=args.min_input_partitions,
                      quarantine=args.rejected)
        print(f"wrote {out.scans_path} and {out.vulns_path}")
    elif args.command == "refresh":
        opts = Options(null_excluded_as_false=args.null_excluded_as_false)
        rebuilt = refresh_org_scores(spark, args.root, ttl_s=args.ttl, force=args.force, options=opts)
        print("rebuilt org_scores" if rebuilt else "org_scores is fresh")
    else:
        print("copied " + ", ".join(publish(spark, args.source_root, args.target_root)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
