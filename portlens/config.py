"""Constants of the scoring model and the options that make its quirks explicit.

Everything under "Fixed values" must stay exactly as written: the risk scores,
the exclusion flag and the organisation rollup depend on these literals.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the original pipeline's for identical results)
# ---------------------------------------------------------------------------

EXCLUDED_ORGS = (
    "Google LLC",
    "Amazon.com, Inc.",
    "Cloudflare, Inc.",
    "Microsoft Corporation",
    "DigitalOcean, LLC",
    "OVH SAS",
    "Hetzner Online AG",
    "Linode",
    "Incapsula Inc",
    "Fastly, Inc.",
    "Akamai Technologies",
)
EXCLUDED_TAG = "cdn"

ADMIN_PORTS = (22, 23, 3389, 8291)
DB_PORTS = (3306, 5432, 1521, 27017, 6379)
DEVICE_PRODUCT_PATTERN = "(?i)fortinet|hikvision|draytek"
WEAK_TLS_VERSIONS = ("SSLv3", "TLSv1.0")
SELF_SIGNED_TAG = "self-signed"
HONEYPOT_TAG = "honeypot"

POINTS_VERSION = 10
POINTS_EXPIRED_CERT = 12
POINTS_SELF_SIGNED = 8
POINTS_WEAK_TLS = 8
POINTS_ADMIN_PORT = 5
POINTS_DB_PORT = 8
POINTS_DEVICE = 10
POINTS_HONEYPOT = -100

# CVE score: first matching CVSS band, plus additive EPSS and verified bonuses.
CVSS_BANDS = ((9.0, 25), (7.0, 15), (4.0, 8))
EPSS_THRESHOLD = 0.5
POINTS_EPSS = 10
POINTS_VERIFIED = 5

SCORE_CAP = 100

# Organisation rollup: combined = least(100, 0.7*max + 0.3*avg + least(10, 0.5*total_ips)).
# Kept as SQL text so the literals are decimals, as in the original SQL.
COMBINED_SCORE_SQL = (
    "LEAST(100.0, (max_risk_score * 0.7) + (avg_risk_score * 0.3)"
    " + LEAST(10.0, total_ips * 0.5))"
)

ROLLUP_TTL_SECONDS = 600
PITCH_ELIGIBLE_TOP_N = 500
REFRESH_METADATA_KEY = "last_refresh_time"
UNKNOWN_COUNTRY = "unknown"

# ---------------------------------------------------------------------------
# Choices for behaviour the original leaves open (dashboard pages are absent)
# ---------------------------------------------------------------------------

HIGH_RISK_THRESHOLD = 70.0
ORANGE_RISK_THRESHOLD = 40.0
HISTOGRAM_WIDTH = 10.0
GEO_CELL_DEGREES = 1.0
TOP_ORGS = 10


@dataclass(frozen=True)
class Options:
    """Switches for the original's NULL and tie behaviour.

    The defaults reproduce the original results exactly.
    """

    # Q2: the rollup keeps only ``is_excluded = FALSE``; NULL rows drop out.
    null_excluded_as_false: bool = False
    # Q7: column that breaks timestamp ties in the latest-per-key dedup.
    tie_break: str | None = "hash"
    # Q16: treat an empty country code like a missing one when partitioning.
    empty_country_as_unknown: bool = False
    # Q8: a line that holds no record becomes an all-NULL row; off: such lines
    # are only in the rejected lines of a quarantining run.
    malformed_as_null_row: bool = True
    # A3: after dedup (ip_str, port) is unique, so the distinct count of
    # "ip:port" equals a conditional count (one distinct aggregate fewer).
    keys_unique: bool = True


DEFAULT_OPTIONS = Options()
