"""Physical-plan shape: the properties that matter at scale, read from the
public ``explain()`` text."""

from __future__ import annotations

import contextlib
import gzip
import io
import os

import pytest

from portlens.config import Options
from portlens.operators import outreach, prospects
from portlens.operators.rollup import org_scores
from portlens.operators.score import score_fused, score_relational
from portlens.operators.transform import explode_vulns, flatten, latest_per_key
from portlens.plans.etl import run_etl
from portlens.session import exchange_width, widened_exchange
from portlens.sources.ndjson import input_bytes, read_ndjson
from portlens.sources.parquet import read_table, with_country_partition


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def deduped(spark, edge_input):
    return latest_per_key(flatten(read_ndjson(spark, edge_input)))


def test_dedup_exchange_widens_with_the_input(spark, tmp_path):
    """The width follows the files' bytes, reaches the plan, and the session's setting comes back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    widths = []
    for n in (1000, 4000):
        path = tmp_path / f"in{n}.json"
        path.write_text('{"ip_str": "1.2.3.4", "port": 80}\n' * n)
        size = input_bytes(spark, str(path))
        assert size == path.stat().st_size
        widths.append(exchange_width(size, reducer_bytes=1000))
        with widened_exchange(spark, widths[-1]):
            assert "hashpartitioning(ip_str" in (text := plan(latest_per_key(flatten(read_ndjson(spark, str(path)))))) and f", {widths[-1]})" in text
    assert widths == [17, 68] and spark.conf.get("spark.sql.shuffle.partitions") == before
    with gzip.open(tmp_path / "one.json.gz", "wb") as out:
        out.write(b"{}\n")
    packed = str(tmp_path / "one.json.gz")
    assert input_bytes(spark, packed) == 10 * os.path.getsize(packed)


@pytest.fixture(scope="module")
def written(spark, edge_input, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    out = run_etl(spark, edge_input, root)
    scans = read_table(spark, out.scans_path)
    return scans, org_scores(scans)


def test_json_scan_reads_only_used_fields(spark, edge_input):
    text = plan(read_ndjson(spark, edge_input))
    read_schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    for unused in ("data:", "_shodan", "hostnames", "cipher", "subject", "components"):
        assert unused not in read_schema


def test_dedup_limits_before_the_shuffle(deduped):
    text = plan(deduped)
    tree = text.split("\n\n")[0]
    lines = [ln.strip("+-: ") for ln in tree.splitlines()]
    exchange = next(i for i, ln in enumerate(lines) if ln.startswith("Exchange"))
    below = lines[exchange + 1:]
    assert any(ln.startswith("WindowGroupLimit") for ln in below), tree
    assert "row_number(), 1, Partial" in text


def test_fused_score_has_no_join_or_generate(deduped):
    fused = plan(score_fused(deduped))
    # the parse has one Generate of its own (records of a line); the score adds none
    assert "Join" not in fused and fused.count("Generate") == plan(deduped).count("Generate")
    relational = plan(score_relational(deduped, explode_vulns(deduped)))
    assert "Join" in relational and "Generate" in relational


def test_rollup_avoids_second_distinct(deduped):
    scored = score_fused(deduped)
    for options in (Options(), Options(keys_unique=False)):
        text = plan(org_scores(scored, options))
        assert "Expand" not in text
        # only the last level, a few rows a country, collects objects
        tree = text.split("\n\n")[0]
        assert tree.count("ObjectHashAggregate") == 2 and tree.count(" HashAggregate") == 4


def test_scans_output_is_rebalanced_by_country(deduped):
    out = with_country_partition(score_fused(deduped)).hint("rebalance", "country_code")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(out)


def test_org_lookup_pushes_filter_to_parquet(written):
    scans, orgs = written
    text = plan(prospects.org_infrastructure(scans, orgs, org="Acme"))
    assert "PushedFilters: [IsNotNull(org), EqualTo(org,Acme)" in text or "EqualTo(org,Acme)" in text


def test_outreach_one_expand_and_bounded_broadcast(written):
    scans, orgs = written
    text = plan(outreach.outreach_context(scans, orgs))
    assert text.count("Expand (") == 1
    assert "BroadcastExchange" in text
    # the top-k set is computed once (checkpointed), not re-derived per branch
    assert "TakeOrderedAndProject" not in text and "Scan ExistingRDD" in text
    assert text.split("\n\n")[0].count("Scan parquet") == 2  # in the tree: scans read twice


def test_top_orgs_is_take_ordered(written):
    _, orgs = written
    assert "TakeOrderedAndProject" in plan(prospects.top_orgs(orgs))


def test_country_filter_prunes_partitions(written):
    scans, _ = written
    text = plan(scans.where("country_code = 'US'").select("ip_str", "port"))
    assert "PartitionFilters: [isnotnull(country_code" in text and "(country_code" in text
    read_schema = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert "vulns" not in read_schema and "org" not in read_schema
