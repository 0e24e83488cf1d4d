"""The filter audit against applying every order of the filters to every document."""

from __future__ import annotations

from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from portlens.llm import interaction

from .helpers import ROWS, SCHEMA, words

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _failed(rows):
    """For each row the set of filters that it fails."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = words(t)
        failed = set()
        if len(w) < 100:
            failed.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            failed.add("C")
        if any(c in "#$%&*|" for c in t):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            failed.add("E")
        out.append(failed)
    return out


def _brute(rows, labels):
    """(part, order, step) -> COLUMNS."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for (i, _, lang), failed in zip(rows, _failed(rows), strict=True):
        parts.setdefault(lang or "", []).append((i, failed))
    out = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = [d for d in docs if f in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
        for (p, _, _), values in out.items():
            if p == part:
                values[-1] = shapley[values[-1]] if isinstance(values[-1], str) else values[-1]
    return {k: tuple(v) for k, v in out.items()}


def _got(rows):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows.collect()}


def _audit(docs, labels):
    return interaction.audit(interaction.mask_counts(interaction.failure_masks(docs), labels))


MORE = [
    (30, "word " * 120, "en"),
    (31, "word " * 120, "fr"),
    (29, "word " * 120, None),
    (31, "word " * 120, "fr"),
    (32, " ".join(f"w{i}" for i in range(150)), "en"),
    (33, " ".join(f"W{i}" for i in range(150)), "en"),
    (34, "SHOUT $$ " * 60, "fr"),
    (35, "", "es"),
    (None, "word " * 120, "de"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (9, None, 1), (30, 1, 1), (31, 1, 0), (31, 1, 0), (34, 0, 1), (None, 1, 1), (77, 1, 1)]


def test_audit(spark):
    rows = ROWS + MORE
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("own") for c in ("part", "mask", "digest", "first", "bits", "good", "n", "step")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit("own")).withColumn("marked_id", F.lit("own"))
    got = _got(_audit(docs, labels))
    assert got == _brute(rows, LABELS)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert _audit(docs.limit(0), labels).count() == 0
    assert _got(_audit(docs, labels.limit(0))) == _brute(ROWS, [])


def test_a_copied_text_is_joined_by_a_skewed_split(spark):
    """A text that half the rows share is dealt over several tasks of the join."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        masks = interaction.failure_masks(rows.repartition(20))
        assert masks.filter(F.col("mask").bitwiseAND(16) != 0).count() == 19_999
        masks.write.format("noop").mode("overwrite").save()
        frame = masks.select("part", "mask")
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6])
def test_plain_changes(k):
    order, seen = list(range(k)), set()
    seen.add(tuple(order))
    for i in interaction.plain_changes(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert seen == set(permutations(range(k)))
    assert len(list(interaction.plain_changes(k))) == len(seen) - 1


def test_swaps_keep_every_weight_and_share_nodes():
    rng = np.random.default_rng(1)
    for k in (2, 4, 5):
        weights = {m: (int(rng.integers(0, 3)), int(rng.integers(0, 2))) for m in range(1 << k) if rng.random() < 0.6}
        diagram = interaction.Diagram(k, weights)
        for place in interaction.plain_changes(k):
            diagram.swap(place)
            for mask in range(1 << k):
                node = diagram.root
                for f in diagram.order:
                    node = diagram.edges[node][mask >> f & 1]
                assert diagram.weight[node] == weights.get(mask, (0, 0))
            for table in diagram.levels:
                assert len(set(table.values())) == len(table)
            for level, table in enumerate(diagram.levels[:-1]):
                assert all(diagram.edges[node] == pair for pair, node in table.items()) and len(table) <= 1 << level
            assert diagram.weight[diagram.root] == tuple(sum(w[i] for w in weights.values()) for i in range(2))
    equal = interaction.Diagram(5, {m: (1,) for m in range(32)})
    assert equal.size() == 6  # a node a level


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    expected = con.execute(interaction.audit_sql()).df()
    want = {(r.part, r.filter_order, r.step): tuple(getattr(r, c) for c in COLUMNS) for r in expected.itertuples()}
    assert _got(_audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))) == want
