"""Whitening against dense linear algebra, and the eigenvalue steps by themselves."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, size string, part string, v string"


def _expected(vectors):
    x = np.floor(np.asarray(vectors, np.float32).astype(float) * 1024).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    deviations = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return deviations, centred, values[::-1], vectors[:, ::-1]


def _compare(rows, vectors, ids):
    deviations, centred, values, components = _expected(vectors)
    k = min(8, len(values))
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by_id) == sorted(ids) and all(sorted(c) == list(range(1, k + 1)) for c in by_id.values())
    for c in range(1, k + 1):
        got = np.array([by_id[i][c]["whitened"] for i in ids], float)
        want = centred @ components[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert by_id[ids[0]][c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert [by_id[i][1]["deviation"] for i in ids] == deviations.tolist()
    assert all(r["n"] == len(ids) and r["identity_error"] < 1e-9 and r["deviation_wide"] is None for r in rows)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    vectors[200:] = vectors[0]  # a third of the rows are equal
    rows = [(i, v.tolist(), *["own"] * 4) for i, v in enumerate(vectors)]
    bad = [(None, *["own"] * 4), ([], *["own"] * 4), ([1.0, None] + [0.0] * 10, *["own"] * 4), ([float("nan")] * 12, *["own"] * 4), ([float("inf")] * 12, *["own"] * 4)]
    rows += [(1000 + i, *b) for i, b in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    _compare(got, vectors, list(range(300)))


def test_narrow_repeated_and_empty(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    _compare(whitening.whiten(rows).collect(), vectors, list(range(40)))
    twice = whitening.whiten(rows.unionByName(rows).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))).collect()
    assert len(twice) == 80 * 3 and sum(r["vec_id"] is None for r in twice) == 6
    assert whitening.whiten(rows.limit(0)).count() == 0
    assert [f.dataType.simpleString() for f in whitening.whiten(rows).schema] == ["bigint", "int", "bigint", "bigint", "decimal(38,0)", "double", "double", "double"]


def test_lengths_apart_and_without_variance(spark):
    rng = np.random.default_rng(5)
    long_, short = rng.normal(size=(50, 6)).astype(np.float32), rng.normal(size=(30, 2)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(long_)] + [(100 + i, v.tolist()) for i, v in enumerate(short)] + [(200 + i, [0.5] * 4) for i in range(7)] + [(300, [1.0] * 9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    _compare([r for r in got if r["vec_id"] < 100], long_, list(range(50)))
    _compare([r for r in got if 100 <= r["vec_id"] < 200], short, list(range(100, 130)))
    flat = [r for r in got if r["vec_id"] >= 200]
    assert len(flat) == 7 * 4 + 8
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in flat)


def test_many_parts_and_strips(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "STRIP", 30)
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(200, 10)) * np.linspace(1, 2, 10)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(9)
    _compare(whitening.whiten(rows).collect(), vectors, list(range(200)))


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(x)]) for i, x in enumerate((0, 1e12, -3e12, 1e18, float(2**70)))]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [min(max(int(np.floor(v[0] * 1024)), -(2**61)), 2**61) + 100_000 for _, v in rows]
    for i in range(5):
        want = (5 * x[i] - sum(x)) ** 2
        assert got[i]["deviation"] is None and want > 2**63
        assert got[i]["deviation_wide"] is None or int(got[i]["deviation_wide"]) == want


def test_sum_of_squares_is_exact():
    rng = np.random.default_rng(7)
    for top in (100, 1 << 31, 1 << 40, (1 << 52) - 1, 1 << 57):
        y = rng.integers(-top, top, (20, 7))
        assert whitening.sum_of_squares(y) == [sum(int(c) ** 2 for c in row) for row in y]
    assert whitening.sum_of_squares(np.array([[10**30, 1]], object)) == [10**60 + 1]


def test_sturm_counts():
    rng = np.random.default_rng(8)
    d, e = rng.normal(size=30), rng.normal(size=29)
    e[10] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    points = np.concatenate((values + 1e-9, values - 1e-9, [-100, 100]))
    assert whitening.sturm_counts(d, e, points).tolist() == [int((values < p).sum()) for p in points]


@pytest.mark.parametrize("kind", ["random", "equal", "clustered", "diagonal", "rank one", "one", "two", "zero", "large"])
def test_leading(kind):
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    matrix = {
        "random": (lambda a: a @ a.T)(rng.normal(size=(40, 60))),
        "equal": q @ np.diag([5.0] * 6 + [1.0] * 34) @ q.T,
        "clustered": q @ np.diag(np.concatenate((7 + 1e-9 * np.arange(10), np.linspace(1, 2, 30)))) @ q.T,
        "diagonal": np.diag(np.arange(40.0)),
        "rank one": np.outer(np.arange(40.0), np.arange(40.0)),
        "one": np.array([[3.0]]),
        "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
        "zero": np.zeros((9, 9)),
        "large": 1e200 * (lambda a: a @ a.T)(rng.normal(size=(20, 30))),
    }[kind]
    matrix = (matrix + matrix.T) / 2
    k = min(8, len(matrix))
    values, vectors = whitening.leading(matrix, k)
    norm = np.abs(matrix).max() or 1.0
    assert values / norm == pytest.approx(np.linalg.eigvalsh(matrix / norm)[::-1][:k], abs=1e-13 * len(matrix))
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(vectors @ (matrix / norm) - (values / norm)[:, None] * vectors).max() < 1e-12 * len(matrix)


def test_centring_keeps_small_spreads_on_large_offsets():
    x = np.array([[10**15], [10**15 + 1], [10**15 + 3]])
    parts = [whitening.Moments.of(x[:1]), whitening.Moments.of(x[1:])]
    parts[0].add(parts[1])
    exact = sum((Fraction(int(v)) - Fraction(3 * 10**15 + 4, 3)) ** 2 for v in x[:, 0])
    assert parts[0].products[0, 0] == pytest.approx(float(exact), rel=1e-12)
