from __future__ import annotations

import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from portlens.session import local_session

    session = local_session("*", shuffle_partitions=8, app="portlens-tests")
    yield session


US = {"country_code": "US", "country_name": "United States"}
DE = {"country_code": "DE", "country_name": "Germany"}
FR = {"country_code": "FR", "country_name": "France"}
T0 = "2024-01-01T00:00:00"


def edge_banners() -> list[str]:
    """The hand-written edge cases (one NDJSON line each, two malformed)."""

    def rec(h, ip, port, org, tags=None, ts=T0, **kw):
        r = {"hash": h, "ip_str": ip, "port": port, "org": org, "timestamp": ts, "transport": "tcp"}
        if tags is not None:
            r["tags"] = tags
        r.update(kw)
        return {k: v for k, v in r.items() if v is not None or k == "ip_str"}

    rows = [
        rec(1, "1.0.0.1", 22, "Acme", [], ts="2024-01-01T00:00:00.000000", location=US),
        rec(2, "1.0.0.1", 22, "Acme", [], ts="2024-01-02T00:00:00.000000", transport="udp", version="7.4",
            location=US),
        rec(3, "1.0.0.2", 443, "Acme", ["self-signed"], location=DE,
            ssl={"cert": {"expired": True}, "versions": ["TLSv1.0", "SSLv3"], "cipher": {"bits": 128}}),
        rec(4, "1.0.0.3", 3306, "Acme", None, location={"country_code": None}),
        rec(5, "1.0.0.4", 3389, "Acme", ["honeypot"], location=US,
            vulns={"CVE-A": {"cvss": 3.9, "epss": 0.5, "verified": True}}),
        rec(6, "1.0.0.5", 80, "Linode", None, location=US, vulns={"CVE-B": {"cvss": 9.8, "epss": 0.1}}),
        rec(7, "1.0.0.6", 80, "Beta", ["cdn"], version="1.0", location=FR),
        rec(8, "1.0.0.7", 8291, "Beta", ["x", None], product="HIKVISION camera",
            location={"country_code": "", "country_name": ""}),
        rec(9, "1.0.0.8", 6379, "Beta", ["vpn"], product="DrayTek", version="2.1", location=FR, vulns={
            "C1": {"cvss": 9.0, "epss": 0.9, "verified": True},
            "C2": {"cvss": 7.0, "epss": 0.5},
            "C3": {"cvss": 4.0},
            "C4": None,
            "C5": {"cvss": None, "epss": 0.5},
            "C6": {"cvss": 8.9, "verified": True},
        }),
        rec(10, None, 80, "Beta", [], location=FR, vulns={"CVE-D": {"cvss": 9.9}}),
        rec(11, "1.0.0.9", 80, "Gamma", [], ts="garbage", version="1"),
        rec(12, "1.0.0.9", 80, "Gamma", [], ts="2023-01-01T00:00:00"),
        rec(13, "1.0.0.10", "443", "Gamma", []),
        rec(14, "1.0.0.11", 81, None, ["vpn"], vulns={}),
        rec(15, "1.0.0.12", 82, "Gamma", [], version="9"),
        rec(16, "1.0.0.12", 82, "Gamma", []),
    ]
    lines = [json.dumps(r) for r in rows]
    return lines + ["not json", "{broken"]


@pytest.fixture(scope="session")
def edge_input(tmp_path_factory):
    d = tmp_path_factory.mktemp("edge")
    path = d / "banners.json"
    path.write_text("\n".join(edge_banners()) + "\n")
    return str(path)
