"""Dashboard and outreach operators on the edge-case banners (expected values
follow from the org rollup: Acme 17.4, Beta 85.5, Gamma 1.5)."""

from __future__ import annotations

import pytest

from portlens.operators import outreach, prospects
from portlens.operators.rollup import org_scores, org_scores_sql
from portlens.plans.etl import run_etl
from portlens.sources.parquet import read_table, register_views


@pytest.fixture(scope="module")
def tables(spark, edge_input, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("prospects"))
    out = run_etl(spark, edge_input, root)
    scans = read_table(spark, out.scans_path)
    vulns = read_table(spark, out.vulns_path)
    return scans, vulns, org_scores(scans)


def test_kpis(tables):
    _, _, orgs = tables
    r = prospects.kpis(orgs).first()
    assert (r.total_orgs, r.total_ips, r.high_risk_orgs) == (3, 7, 1)
    assert r.avg_combined_score == pytest.approx(34.8)


def test_top_and_histogram(tables):
    _, _, orgs = tables
    assert [r.org for r in prospects.top_orgs(orgs, 2).collect()] == ["Beta", "Acme"]
    hist = {r.bucket: r.n_orgs for r in prospects.score_histogram(orgs).collect()}
    assert hist == {0: 1, 10: 1, 80: 1}
    fine = {r.bucket: r.n_orgs for r in prospects.score_histogram(orgs, 2.5).collect()}
    assert fine == {0.0: 1, 15.0: 1, 85.0: 1}


def test_prospect_filter_and_country(tables):
    _, _, orgs = tables
    assert [r.org for r in prospects.prospect_filter(orgs, min_score=10, min_ips=2).collect()] == ["Acme"]
    assert [r.org for r in prospects.prospect_filter(orgs, country="France").collect()] == ["Beta"]


def test_export_view_and_csv(spark, tables, tmp_path):
    _, _, orgs = tables
    view = prospects.export_view(orgs)
    rows = {r.org: r.countries for r in view.collect()}
    assert rows == {"Acme": "Germany;United States", "Beta": "France", "Gamma": "unknown"}
    assert [r.org for r in view.collect()] == ["Beta", "Acme", "Gamma"]
    prospects.export_csv(view, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 3


def test_selector_and_bands(tables):
    _, _, orgs = tables
    assert [r.org for r in prospects.org_selector(orgs).collect()] == ["Acme", "Beta", "Gamma"]
    bands = {r.org: r.risk_band for r in prospects.risk_bands(orgs).collect()}
    assert bands == {"Acme": "blue", "Beta": "red", "Gamma": "blue"}


def test_single_org_views(tables):
    scans, vulns, orgs = tables
    infra = prospects.org_infrastructure(scans, orgs, org="Beta").collect()
    assert sorted((r.ip_str or "", r.port) for r in infra) == [("", 80), ("1.0.0.8", 6379)]
    assert {r.combined_risk_score for r in infra} == {85.5}
    cves = prospects.org_cves(vulns, scans, org="Beta").collect()
    assert len(cves) == 7 and cves[0].cve_id == "CVE-D"
    assert [r.cvss for r in cves][-1] is None  # NULL CVSS sorts last


def test_segments(tables):
    scans, _, _ = tables
    rows = prospects.cloud_segments(scans).collect()
    assert [(r.segment, r.n_services) for r in rows] == [("on-prem", 14)]


def test_sql_rollup_equals_dataframe_rollup(spark, tables):
    scans, _, orgs = tables
    register_views(spark, {"edge_scans": scans})
    register_views(spark, {"edge_scans": scans})  # replacing an existing view is fine
    a = sorted(tuple(r) for r in org_scores_sql(spark, "edge_scans").collect())
    b = sorted(tuple(r) for r in orgs.collect())
    assert a == b


def test_outreach_text_and_pending(spark, tables):
    scans, _, orgs = tables
    ctx = {r.org: r for r in outreach.outreach_context(scans, orgs).collect()}
    assert ctx["Beta"].pitch_rank == 1
    assert ctx["Beta"].cve_details.splitlines()[0].startswith("- CVE-D (CVSS 9.9")
    assert ctx["Gamma"].cve_details == "none known"
    assert ctx["Acme"].open_ports_summary == "22 (1), 443 (1), 3389 (1)"
    texts = {r.org: r for r in outreach.outreach_text(outreach.outreach_context(scans, orgs)).collect()}
    assert "**Risk Score:** 85.5/100" in texts["Beta"].user_prompt
    assert texts["Acme"].fallback_text.endswith("high risk score of 17.4. Let's chat.")
    with_sys = outreach.outreach_text(outreach.outreach_context(scans, orgs), with_system_prompt=True).first()
    assert with_sys.system_prompt == outreach.SYSTEM_PROMPT
    cached = spark.createDataFrame([("Beta",)], "org string")
    pending = outreach.pitches_needed(outreach.eligible_orgs(orgs), cached)
    assert sorted(r.org for r in pending.collect()) == ["Acme", "Gamma"]
    assert outreach.pitches_needed(outreach.eligible_orgs(orgs), cached, force=True).count() == 3
