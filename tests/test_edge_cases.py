"""Hand-written edge cases through the real path: NDJSON file -> permissive
parse -> flatten -> dedup -> score -> rollup (expected values worked out by
hand from the scoring rules)."""

from __future__ import annotations

import pytest

from portlens.config import Options
from portlens.operators.rollup import org_scores
from portlens.operators.score import score_fused, score_relational
from portlens.operators.transform import explode_vulns, flatten, latest_per_key
from portlens.sources.ndjson import read_ndjson

# (ip_str, port) -> (score_base, is_excluded, vuln_score_total, ip_risk_score)
EXPECTED_SCANS = {
    (None, None): (0, None, 0, 0),
    (None, 80): (0, False, 0, 0),
    ("1.0.0.1", 22): (15, False, 0, 15),
    ("1.0.0.2", 443): (28, False, 0, 28),
    ("1.0.0.3", 3306): (8, None, 0, 8),
    ("1.0.0.4", 3389): (-95, False, 15, -80),
    ("1.0.0.5", 80): (0, True, 25, 0),
    ("1.0.0.6", 80): (10, True, 0, 0),
    ("1.0.0.7", 8291): (15, None, 0, 15),
    ("1.0.0.8", 6379): (28, False, 103, 100),
    ("1.0.0.9", 80): (0, False, 0, 0),
    ("1.0.0.10", None): (0, False, 0, 0),
    ("1.0.0.11", 81): (0, None, 0, 0),
    ("1.0.0.12", 82): (0, False, 0, 0),
}

EXPECTED_ORGS = {
    "Acme": (3, 3, 28, -12.333333333333334, ["Germany", "United States"], 17.400000000000002),
    "Beta": (1, 1, 100, 50.0, ["France"], 85.5),
    "Gamma": (3, 2, 0, 0.0, [None], 1.5),
}


@pytest.fixture(scope="module")
def deduped(spark, edge_input):
    return latest_per_key(flatten(read_ndjson(spark, edge_input)))


def _scan_map(df):
    return {(r.ip_str, r.port): (r.score_base, r.is_excluded, r.vuln_score_total, r.ip_risk_score)
            for r in df.collect()}


def test_parse_is_permissive(spark, edge_input):
    rows = read_ndjson(spark, edge_input).collect()
    assert len(rows) == 18
    bad = [r for r in rows if all(v is None for v in r)]
    assert len(bad) == 2  # both malformed lines
    quoted_port = [r for r in rows if r.hash == 13][0]
    assert quoted_port.port is None and quoted_port.ip_str == "1.0.0.10"


def test_dedup_keeps_latest_with_tie_break(spark, edge_input):
    kept = latest_per_key(flatten(read_ndjson(spark, edge_input)), drop_tie_break=False)
    by_key = {(r.ip_str, r.port): r for r in kept.collect()}
    assert len(by_key) == 14
    assert by_key[("1.0.0.1", 22)].hash == 2 and by_key[("1.0.0.1", 22)].transport == "udp"
    assert by_key[("1.0.0.9", 80)].hash == 12  # garbage time parses NULL and sorts last
    assert by_key[("1.0.0.12", 82)].hash == 16  # timestamp tie: higher hash wins
    assert by_key[(None, None)].hash is None


def test_fused_scores(deduped):
    assert _scan_map(score_fused(deduped)) == EXPECTED_SCANS


def test_relational_scores(deduped):
    assert _scan_map(score_relational(deduped, explode_vulns(deduped))) == EXPECTED_SCANS


def test_cve_rows(deduped):
    cves = explode_vulns(deduped).collect()
    # CVE-A, CVE-B, CVE-D and the six of 1.0.0.8; the empty map gives none
    assert len(cves) == 9
    c4 = [r for r in cves if r.cve_id == "C4"][0]
    assert c4.cvss is None and c4.cve_verified is None


def test_org_rollup(deduped):
    rows = {r.org: r for r in org_scores(score_fused(deduped)).collect()}
    assert set(rows) == set(EXPECTED_ORGS)
    for org, (ips, ports, mx, avg, countries, combined) in EXPECTED_ORGS.items():
        r = rows[org]
        assert (r.total_ips, r.total_open_ports, r.max_risk_score) == (ips, ports, mx)
        assert r.avg_risk_score == avg
        assert r.countries == countries
        assert r.combined_risk_score == combined


def test_null_excluded_option(deduped):
    opts = Options(null_excluded_as_false=True)
    rows = {r.org: r for r in org_scores(score_fused(deduped), opts).collect()}
    assert rows["Acme"].total_ips == 4  # 1.0.0.3 (NULL flag) now counts
    assert rows["Beta"].total_ips == 2  # 1.0.0.7 (NULL flag) now counts


def test_distinct_count_form_matches(deduped):
    scored = score_fused(deduped)
    a = {r.org: tuple(r) for r in org_scores(scored).collect()}
    b = {r.org: tuple(r) for r in org_scores(scored, Options(keys_unique=False)).collect()}
    assert a == b


def test_duplicate_cve_key_counts_twice(spark, tmp_path):
    """A JSON object repeating a CVE id keeps both entries: both explode and
    both score, in the relational and the fused form alike."""
    line = ('{"ip_str": "2.0.0.1", "port": 80, "org": "Dup", "tags": [], "timestamp": "2024-01-01T00:00:00",'
            ' "vulns": {"CVE-X": {"cvss": 9.5}, "CVE-X": {"cvss": 4.5}}}')
    path = tmp_path / "dup.json"
    path.write_text(line + "\n")
    deduped = latest_per_key(flatten(read_ndjson(spark, str(path))))
    assert explode_vulns(deduped).count() == 2
    fused = score_fused(deduped).first()
    relational = score_relational(deduped, explode_vulns(deduped)).first()
    assert fused.vuln_score_total == relational.vuln_score_total == 25 + 8


def test_full_banner_schema_gives_same_scores(spark, edge_input):
    from portlens.schema import banner_schema

    full = latest_per_key(flatten(read_ndjson(spark, edge_input, banner_schema)))
    assert _scan_map(score_fused(full)) == EXPECTED_SCANS
