"""portlens: network-exposure analytics on Spark.

Scan banners (NDJSON) -> flat, deduplicated, risk-scored services -> per
organisation rollup -> prospecting queries. DataFrame and SQL built-ins only.

The main entry points are re-exported here.
"""

from .config import DEFAULT_OPTIONS, Options
from .operators.rollup import org_scores
from .operators.score import score_fused, score_relational
from .operators.transform import explode_vulns, flatten, latest_per_key
from .plans.etl import run_etl, scored_scans
from .plans.refresh import keyed_upsert, refresh_org_scores
from .sources.ndjson import parse_ndjson, read_ndjson
from .sources.parquet import publish, read_table

__all__ = [
    "DEFAULT_OPTIONS", "Options",
    "read_ndjson", "parse_ndjson", "read_table", "publish",
    "flatten", "latest_per_key", "explode_vulns",
    "score_fused", "score_relational", "scored_scans", "org_scores",
    "run_etl", "refresh_org_scores", "keyed_upsert",
]
