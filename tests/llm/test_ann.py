"""Recall of the search itself, the share of rows that it compares, and crowded buckets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlens.llm import ann


def _exact(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [int(ids[i]) for i in np.lexsort((ids, d)) if i != q][:k]


def _lists(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(found) for q, found in out.items()}


def _recall(lists, x, ids):
    hits = [len({v for _, v, _ in found} & set(_exact(x, ids, int(np.flatnonzero(ids == q)[0])))) for q, found in lists.items()]
    return np.mean(hits) / 10


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_over_the_whole_table(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    lists = _lists(ann.search(table, F.col("vec_id") % 100 == 0))
    rows = [r for r in table.orderBy("vec_id").collect() if r["embedding"] is not None]
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    assert sorted(lists) == [i for i in ids.tolist() if i % 100 == 0] and all(len(found) == 10 for found in lists.values())
    assert _recall(lists, x, ids) >= 0.9


def _share(n, queries=25):
    """Recall at 10 and compared share of `n` vectors spread evenly in 64 dimensions, by the hashing alone."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    used = ann.shape(n, 64, ann.TABLES, ann.PROBES)
    met = np.zeros((queries, n), bool)
    for t in range(ann.TABLES):
        own = ann.buckets(x, t, used, 1)[:, 0]
        met |= (ann.buckets(x[:queries], t, used, ann.PROBES)[:, :, None] == own[None, None, :]).any(axis=1)
    met[np.arange(queries), np.arange(queries)] = False
    hits = [met[q, _exact(x, np.arange(n), q)].mean() for q in range(queries)]
    return np.mean(hits), met.mean()


def test_compared_share_falls_with_the_rows():
    shares = []
    for n in (1_000, 5_000, 25_000):
        recall, share = _share(n)
        assert recall >= 0.85  # evenly spread vectors have no near neighbours: harder than any real table
        shares.append(share)
    assert shares[1] < 0.7 * shares[0] and shares[2] < 0.7 * shares[1]


def test_shape_grows_with_the_rows():
    sizes = [np.prod([2 * n for n in ann.shape(10**e, 64, 14, 112)], dtype=float) for e in range(1, 12)]
    assert sizes == sorted(sizes) and sizes[-1] > 100 * sizes[3]
    assert ann.shape(1, 1, 14, 112) and ann.shape(10, 3, 14, 112)


def test_buckets_are_the_nearest_ones():
    x = np.random.default_rng(1).normal(size=(5, 6))
    used = (8, 4)
    along = ann.signed_axes(x, 3, used)
    costs = ((along[0].max(1, keepdims=True) - along[0]) ** 2)[:, :, None] + ((along[1].max(1, keepdims=True) - along[1]) ** 2)[:, None, :]
    got = ann.buckets(x, 3, used, 20)
    for i in range(5):
        assert costs[i].ravel()[got[i]] == pytest.approx(np.sort(costs[i].ravel())[:20])
        assert got[i, 0] == along[0][i].argmax() * 8 + along[1][i].argmax()


def test_crowded_buckets_and_areas_give_the_same_lists(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    x[:400] = x[0] + 1e-3 * rng.normal(size=(400, 8))  # near half of the rows share their buckets
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = _lists(ann.search(rows, F.col("vec_id") % 3 == 0))
    for block, task in ((40, 10_000), (40, 50), (10_000, 50)):
        monkeypatch.setattr(ann, "BLOCK_ROWS", block)
        monkeypatch.setattr(ann, "TASK_ROWS", task)
        assert _lists(ann.search(rows, F.col("vec_id") % 3 == 0)) == whole
    assert _recall(whole, x, np.arange(900)) >= 0.9
