"""Truth tables for the scoring rules and the three-valued exclusion flag."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portlens.functions import rules

FLAT_DDL = ("org string, tags array<string>, version string, ssl_expired boolean, "
            "ssl_versions array<string>, port int, product string")


def _row(org="X", tags=(), version=None, ssl_expired=None, ssl_versions=None, port=1, product=None):
    return (org, list(tags) if tags is not None else None, version, ssl_expired,
            list(ssl_versions) if ssl_versions is not None else None, port, product)


def _eval(spark, rows, col):
    df = spark.createDataFrame(rows, FLAT_DDL)
    return [r[0] for r in df.select(col).collect()]


@pytest.mark.parametrize("row, expected", [
    (_row(version="1.0"), 10),
    (_row(ssl_expired=True), 12),
    (_row(ssl_expired=False), 0),
    (_row(tags=["self-signed"]), 8),
    (_row(ssl_versions=["SSLv3", "TLSv1.0"]), 8),  # weak TLS counts once
    (_row(ssl_versions=["TLSv1.2", None]), 0),      # NULL predicate -> 0
    (_row(port=22), 5), (_row(port=8291), 5),
    (_row(port=27017), 8), (_row(port=1521), 8),
    (_row(product="FortiGate FORTINET"), 10), (_row(product="hikvision"), 10), (_row(product="nginx"), 0),
    (_row(tags=["honeypot"]), -100),
    (_row(tags=None, port=None, product=None), 0),
    (_row(version="x", ssl_expired=True, tags=["self-signed", "honeypot"], ssl_versions=["SSLv3"], port=3306,
          product="DrayTek"), 10 + 12 + 8 + 8 + 8 + 10 - 100),
])
def test_score_base(spark, row, expected):
    assert _eval(spark, [row], rules.score_base()) == [expected]


@pytest.mark.parametrize("org, tags, expected", [
    ("Linode", None, True),
    ("Acme", None, None),          # unknown tags, org not listed
    (None, ["vpn"], None),         # unknown org, no cdn
    ("Acme", ["x", None], None),   # NULL element, no cdn
    ("Acme", [], False),
    (None, ["cdn"], True),         # cdn wins even with NULL org
    ("Google LLC", ["cdn"], True),
    ("google llc", [], False),     # exact match only
])
def test_is_excluded_three_valued(spark, org, tags, expected):
    assert _eval(spark, [_row(org=org, tags=tags)], rules.is_excluded()) == [expected]


@pytest.mark.parametrize("cvss, epss, verified, expected", [
    (9.0, None, None, 25), (8.99, None, None, 15), (7.0, None, None, 15), (4.0, None, None, 8),
    (3.99, None, None, 0), (None, None, None, 0),
    (None, 0.5, True, 15),    # bonuses apply even without CVSS
    (2.0, 0.49, False, 0),
    (9.8, 0.97, True, 40),
])
def test_cve_score(spark, cvss, epss, verified, expected):
    df = spark.createDataFrame([(cvss, epss, verified)], "cvss double, epss double, v boolean")
    out = df.select(rules.cve_score(F.col("cvss"), F.col("epss"), F.col("v"))).first()[0]
    assert out == expected


@pytest.mark.parametrize("base, vulns, excluded, expected", [
    (10, 5, False, 15), (90, 50, False, 100), (-100, 5, False, -95), (50, 50, True, 0), (50, 50, None, 100),
])
def test_capped_risk(spark, base, vulns, excluded, expected):
    df = spark.createDataFrame([(base, vulns, excluded)], "b int, v long, e boolean")
    assert df.select(rules.capped_risk(F.col("b"), F.col("v"), F.col("e"))).first()[0] == expected


def test_risk_band(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (40.0,), (39.9,), (-5.0,)], "s double")
    assert [r[0] for r in df.select(rules.risk_band(F.col("s"))).collect()] == \
        ["red", "orange", "orange", "blue", "blue"]


def test_fused_vuln_total_guards_null_keys(spark):
    ddl = "ip_str string, port int, vulns map<string, struct<cvss:double, epss:double, verified:boolean>>"
    rows = [
        ("a", 1, {"x": (9.5, 0.9, True), "y": None}),
        (None, 1, {"x": (9.5, 0.9, True)}),
        ("b", None, {"x": (9.5, 0.9, True)}),
        ("c", 2, None),
        ("d", 3, {}),
    ]
    df = spark.createDataFrame(rows, ddl)
    assert [r[0] for r in df.select(rules.fused_vuln_score_total()).collect()] == [40, 0, 0, 0, 0]
