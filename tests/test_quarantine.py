"""Lines that are kept with their text, and the main output beside them."""

from __future__ import annotations

import pytest

from portlens.config import Options
from portlens.plans.etl import run_etl
from portlens.sources.ndjson import accepted, parse_checked, parse_ndjson, rejected_lines
from portlens.sources.parquet import read_table

from .conftest import edge_banners

MALFORMED = ["not json", "{broken", '[{"port": 1},', '{"port": 1,, "org": "x"}']
NO_RECORD = ["5", '"abc"', "null", "true", '[1, {"port": 1}]', "[null]", '[[{"port": 2}]]']
WRONG_TYPE = ['{"tags": "x", "port": 3}', '{"port": 1.5}', ' {"location": 7, "ip_str": "1.1.1.1"}', '{"hash": 99999999999999999999}']
FINE = ["{}", "{'port': 1}", "[]", "", " \t", None, '{"port": 1, "more": [1]}', '[{"port": 1}, {"port": 2}]', '{"ip_str": "a\\u0000b"}', ' {"port": 7} ']
PARTLY = '[{"port": 1}, {"port": "x"}, {"port": 2}, {"tags": 1}]'


@pytest.fixture(scope="module")
def lines(spark):
    every = MALFORMED + NO_RECORD + WRONG_TYPE + FINE + [PARTLY] + edge_banners()
    return spark.createDataFrame([(x,) for x in every], "value string").repartition(3)


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_same_rows_as_the_plain_parse(lines):
    assert _rows(accepted(parse_checked(lines))) == _rows(parse_ndjson(lines))


def test_reasons(lines):
    got = sorted((r["line"], r["position"], r["reason"]) for r in rejected_lines(parse_checked(lines)).collect())
    edge = edge_banners()
    expected = [(x, 0, "malformed") for x in MALFORMED + edge[-2:]] + [(x, 0, "not_an_object") for x in NO_RECORD]
    expected += [(x, 0, "wrong_type") for x in WRONG_TYPE + [edge[12]]] + [(PARTLY, k, "wrong_type") for k in (1, 3)]
    assert got == sorted(expected)


def test_quarantining_run(spark, tmp_path, edge_input):
    plain = run_etl(spark, edge_input, str(tmp_path / "plain"))
    kept = run_etl(spark, edge_input, str(tmp_path / "kept"), quarantine=True)
    assert plain.rejected_path is None
    for a, b in ((plain.scans_path, kept.scans_path), (plain.vulns_path, kept.vulns_path)):
        left, right = read_table(spark, a), read_table(spark, b)
        left, right = (d.drop("vulns").select(*sorted(c for c in d.columns if c != "vulns")) for d in (left, right))
        assert _rows(left) == _rows(right)
    assert sorted(r["reason"] for r in read_table(spark, kept.rejected_path).collect()) == ["malformed", "malformed", "wrong_type"]
    without = run_etl(spark, edge_input, str(tmp_path / "without"), Options(malformed_as_null_row=False), quarantine=True)
    assert read_table(spark, without.scans_path).count() == read_table(spark, plain.scans_path).count() - 1
    assert read_table(spark, without.scans_path).where("ip_str IS NULL AND port IS NULL").count() == 0


def test_nothing_rejected_and_no_lines(spark, tmp_path):
    for k, rows in enumerate(([('{"ip_str": "1.1.1.1", "port": 1}',)], [])):
        out = run_etl(spark, None, str(tmp_path / str(k)), lines=spark.createDataFrame(rows, "value string"), quarantine=True)
        rejected = read_table(spark, out.rejected_path)
        assert rejected.count() == 0 and rejected.columns == ["line", "position", "reason"]
        assert read_table(spark, out.vulns_path).count() == 0
        if rows:
            assert read_table(spark, out.scans_path).count() == 1
