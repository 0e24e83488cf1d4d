"""Print the physical-plan trees of the main jobs (for PLANS.md).

Usage: python tools/show_plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from portlens.operators import outreach, prospects  # noqa: E402
from portlens.operators.rollup import org_scores  # noqa: E402
from portlens.plans.etl import run_etl, scored_scans  # noqa: E402
from portlens.session import local_session, scratch_path  # noqa: E402
from portlens.sources.banners import driver_banner_lines  # noqa: E402
from portlens.sources.ndjson import read_ndjson, write_ndjson  # noqa: E402
from portlens.sources.parquet import read_table, with_country_partition  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue().split("\n\n")[0]
    return re.sub(r"#\d+L?", "", text).replace("== Physical Plan ==\n", "")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    root = scratch_path(spark, "plans")
    write_ndjson(driver_banner_lines(spark, sf_dir), f"{root}/input")
    banners = read_ndjson(spark, f"{root}/input")
    scored = with_country_partition(scored_scans(banners)).hint("rebalance", "country_code")
    sections = [("ETL: NDJSON -> dedup -> fused score -> rebalance for the per-country write",
                 scored.sortWithinPartitions("country_code", "org", "ip_str", "port")),
                ("For comparison: the relational score (explode -> aggregate -> left join)",
                 scored_scans(banners, fused=False))]
    out = run_etl(spark, f"{root}/input", root)
    scans = read_table(spark, out.scans_path)
    orgs = org_scores(scans)
    sections += [
        ("Rollup: org_scores from `scans`", orgs),
        ("Top 10 organisations", prospects.top_orgs(orgs)),
        ("Deep dive of one organisation (pushed filter)", prospects.org_infrastructure(scans, orgs, org="Org-1")),
        ("Outreach context for the top 500", outreach.outreach_context(scans, orgs)),
    ]
    for title, df in sections:
        print(f"### {title}\n\n```\n{tree(df).rstrip()}\n```\n")


if __name__ == "__main__":
    main()
