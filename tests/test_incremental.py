"""Batches merged into the tables of a database against a full rebuild."""

from __future__ import annotations

import json
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from portlens.operators.rollup import org_scores
from portlens.operators.transform import explode_vulns
from portlens.plans import incremental, tables
from portlens.plans.etl import scored_scans
from portlens.session import scratch_path
from portlens.sources.ndjson import parse_ndjson

from .conftest import edge_banners


def banner(h, ip, port, country="US", org="Acme", day=1, **more):
    return json.dumps({"hash": h, "ip_str": ip, "port": port, "org": org, "tags": [], "transport": "tcp",
                       "timestamp": f"2024-01-{day:02d}T00:00:00",
                       "location": {"country_code": country, "country_name": country}, **more})


FIRST = [
    banner(1, "1.0.0.1", 80), banner(2, "1.0.0.2", 80, "DE"), banner(3, "1.0.0.3", 80, "FR", "Beta"),
    banner(4, "1.0.0.4", 80, "ES", "Gamma"), banner(5, "1.0.0.5", 80, "IT", "Delta", vulns={"C1": {"cvss": 9.9}}),
    banner(6, "1.0.0.6", 80, None, "Beta"), banner(7, "1.0.0.7", 80, "", "Beta"), banner(8, None, 80, "US", "Beta"),
    banner(9, "1.0.0.9", 80, "O'Hare \\", "Acme", vulns={"C2": {"cvss": 5.0}}), banner(10, "1.0.1.0", 80, "GB", "Solo"),
]
SECOND = [
    banner(11, "1.0.0.1", 80, "US", version="2", day=2),        # newer, same country
    banner(12, "1.0.0.2", 80, "FR", day=2),                     # moved: DE is left empty
    banner(13, "1.0.0.3", 80, "CA", "Beta", day=1),             # tie on the time, higher hash: moved
    banner(0, "1.0.0.4", 80, "ES", "Gamma", day=1, version="0"),  # tie, lower hash: loses
    banner(14, "1.0.0.9", 80, "GB", "Acme", day=3),             # moved out of the odd country, without its CVE
    banner(15, None, 80, "US", "Beta", day=2),                  # the group of keys without an IP
    banner(16, "1.0.0.7", 80, "PT", "Beta", day=2),             # moved out of the empty code
    banner(17, "9.9.9.9", 443, "PT", "New", day=1),
    banner(18, "1.0.1.0", 80, "GB", "Linode", day=2),           # its organisation has no eligible scan left
    "not json",
]


@pytest.fixture
def database(spark):
    path = scratch_path(spark, "test-db")
    return tables.ensure_database(spark, f"test_{path.rsplit('-', 1)[-1]}", path)


def _banners(spark, lines):
    return parse_ndjson(spark.createDataFrame([(x,) for x in lines], "value string"))


def _rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def _same_as_rebuild(spark, database, lines):
    full = scored_scans(_banners(spark, lines))
    written = full.withColumn("country_code", F.nullif(F.coalesce("country_code", F.lit("unknown")), F.lit("")))
    assert _rows(incremental.current_scans(spark, database).drop("vulns")) == _rows(written.drop("vulns"))
    assert _rows(incremental.current_vulns(spark, database)) == _rows(explode_vulns(full))
    assert _rows(incremental.current_org_scores(spark, database)) == _rows(org_scores(full))


def _files(spark, name):
    """File -> time of change."""
    paths = ["/" + unquote(p.removeprefix("file:")).lstrip("/") for p in spark.table(name).inputFiles()]
    return {p: os.stat(p).st_mtime_ns for p in paths}


def test_two_batches_equal_a_rebuild(spark, database):
    first = incremental.load_batch(spark, database, _banners(spark, FIRST))
    assert first.countries == {"US", "DE", "FR", "ES", "IT", "unknown", None, "O'Hare \\", "GB"} and not first.emptied
    _same_as_rebuild(spark, database, FIRST)
    before = {t: _files(spark, f"{database}.{t}") for t in ("scans", "vulns", "org_cells")}
    second = incremental.load_batch(spark, database, _banners(spark, SECOND))
    assert second.countries == {"US", "DE", "FR", "CA", "ES", "GB", "PT", "O'Hare \\", None, "unknown"}
    assert second.emptied == {"DE", "O'Hare \\", None}
    _same_as_rebuild(spark, database, FIRST + SECOND)
    after = {t: _files(spark, f"{database}.{t}") for t in before}
    untouched = {t: {p for p in files if "country_code=IT" in p} for t, files in before.items()}
    assert all(untouched.values())
    for t, files in untouched.items():
        assert all(after[t].get(p) == before[t][p] for p in files)
        assert not any(p in after[t] for p in before[t] if p not in files)


def test_loading_again_and_an_empty_batch_change_nothing(spark, database):
    for lines in (FIRST, SECOND, SECOND, FIRST):
        incremental.load_batch(spark, database, _banners(spark, lines))
        assert incremental.load_batch(spark, database, _banners(spark, [])) == incremental.Loaded(set(), set(), set())
    _same_as_rebuild(spark, database, FIRST + SECOND)


def test_edge_banners_in_any_cut(spark, database):
    lines = edge_banners()
    for part in (lines[9:], lines[4:9], lines[:4]):
        incremental.load_batch(spark, database, _banners(spark, part))
    _same_as_rebuild(spark, database, lines)


def test_a_load_that_fails_half_way_is_repaired_by_loading_again(spark, database, monkeypatch):
    incremental.load_batch(spark, database, _banners(spark, FIRST))
    write = incremental.overwrite_partitions

    def fails_at(table):
        def failing(rows, name, *rest):
            if name.endswith(table):
                raise RuntimeError("lost")
            return write(rows, name, *rest)
        return failing

    for table in ("scans", "vulns", "org_cells", "org_scores"):
        monkeypatch.setattr(incremental, "overwrite_partitions", fails_at(table))
        with pytest.raises(RuntimeError):
            incremental.load_batch(spark, database, _banners(spark, SECOND))
    monkeypatch.setattr(incremental, "overwrite_partitions", write)
    incremental.load_batch(spark, database, _banners(spark, SECOND))
    _same_as_rebuild(spark, database, FIRST + SECOND)


def test_only_touched_partitions_are_read(spark, database):
    incremental.load_batch(spark, database, _banners(spark, FIRST))
    scans = spark.table(f"{database}.scans")
    chosen = tables.in_partitions(scans, "country_code", {"US", None})
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "country_code" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in chosen.select("country_code").distinct().collect()} == {"US", None}
    assert tables.in_partitions(scans, "country_code", set()).count() == 0


def test_a_batch_without_cves(spark, database):
    plain = [x for x in FIRST if "vulns" not in x]
    incremental.load_batch(spark, database, _banners(spark, plain))
    assert incremental.current_vulns(spark, database).count() == 0
    incremental.load_batch(spark, database, _banners(spark, FIRST))
    incremental.load_batch(spark, database, _banners(spark, [banner(99, "1.0.0.5", 80, "IT", "Delta", day=9)]))
    _same_as_rebuild(spark, database, FIRST + [banner(99, "1.0.0.5", 80, "IT", "Delta", day=9)])
