"""Embedding whitening: leading principal components of integer vectors, scaled to unit variance.

Each entry c becomes x = floor(1024 c) + 100000.

1. One pass sums the vectors (whole numbers, exact) and their products. Products
   are formed from entries centred on their batch's mean; batches, tasks and
   groups of tasks are joined by the pairwise update of a covariance, so the
   large common offset is never squared. A covariance travels in strips of rows
   of at most STRIP entries, and FAN parts of a strip are joined by a task, level
   by level, whatever the number of tasks.
2. The driver holds one dimensions x dimensions matrix. Householder reflections
   make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues,
   inverse iteration their vectors; vectors of a cluster of eigenvalues are
   orthogonalised against each other in every round.
3. Means and components are broadcast. A second pass measures the covariance of
   the whitened rows, a third gives them.

Vectors that are null or hold null or non-finite entries take no part. Each
remaining row gives rows, repeated rows and null ids too; an empty vector has no
component. Vectors of different lengths are fitted apart, each length by its own
rows. Entries beyond 2**61 are held there. A component without variance (equal
rows, fewer rows than components) has whitened null and explained 0, and bears
not on identity_error. A deviation beyond a long is null; `deviation_wide` then
has it. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import stored

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
STRIP = 1 << 17  # entries of a strip of a covariance: 1 MB
FAN = 32  # parts that a task joins
EPS = float(np.finfo(float).eps)
LONG = (1 << 63) - 1

PARTS = "size int, strip int, part long, n long, sums string, products binary"
COLUMNS = "vec_id long, component int, n long, deviation long, deviation_wide decimal(38,0), whitened double, explained double, identity_error double"


# ------------------------------------------------------------------ rows


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as array<double>."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.coalesce(fine, F.lit(False)))


def integers(values: np.ndarray) -> np.ndarray:
    """x of each entry, exact: the scale is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -(2.0**61), 2.0**61).astype(np.int64) + OFFSET


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, x as rows) for each vector length but 0."""
    v = batch.column(batch.schema.get_field_index("v"))
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    values = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        flat = values if len(at) == len(sizes) else values[(starts[at, None] + np.arange(size)).ravel()]
        yield at, integers(flat.reshape(len(at), size))


# --------------------------------------------------------------- moments


class Moments:
    """Count, sums (Python ints for whole numbers) and the centred products of rows `strip` of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, first: int = 0):
        self.n, self.sums, self.products, self.first = n, sums, products, first

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        n = len(rows)
        if rows.dtype.kind == "i" and n * int(np.abs(rows).max()) > LONG:
            sums = rows.astype(object).sum(axis=0)
        else:
            sums = rows.sum(axis=0).astype(object)
        if rows.dtype.kind == "i":
            base = sums // n
            centred = (rows - base.astype(np.int64)).astype(float) - ((sums - base * n) / n).astype(float)
        else:
            centred = rows - (sums / n).astype(float)
        return cls(n, sums, centred.T @ centred)

    def add(self, other: Moments) -> None:
        step = ((other.sums * self.n - self.sums * other.n) / (self.n * other.n)).astype(float)
        here = step[self.first : self.first + len(self.products)]
        self.products = self.products + other.products + np.outer(here, step) * (self.n * other.n / (self.n + other.n))
        self.sums = self.sums + other.sums
        self.n += other.n


def _strips(size: int) -> list[tuple[int, int]]:
    height = max(1, STRIP // size)
    return [(i, min(i + height, size)) for i in range(0, size, height)]


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The parts of a strip as one, in their order, so a rerun adds alike."""
    size, strip = int(group["size"].iloc[0]), int(group["strip"].iloc[0])
    first, end = _strips(size)[strip]
    total = None
    for row in group.sort_values("part").itertuples():
        one = Moments(int(row.n), np.array(json.loads(row.sums), object), np.frombuffer(row.products).reshape(end - first, size), first)
        if total is None:
            total = one
        else:
            total.add(one)
    return pd.DataFrame({"size": [size], "strip": [strip], "part": [int(group["part"].iloc[0]) // FAN], "n": [total.n], "sums": [json.dumps(total.sums.tolist())], "products": [total.products.tobytes()]})


def moments(rows: DataFrame, values) -> dict[int, Moments]:
    """By vector length; `values` gives (length, matrix) pairs of an Arrow batch of `rows`."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for size, x in values(batch):
                one = Moments.of(x)
                if size in held:
                    held[size].add(one)
                else:
                    held[size] = one
        for size, m in held.items():
            sums = json.dumps(m.sums.tolist())
            width = m.products.shape[1]
            for k, (i, j) in enumerate(_strips(width)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([width], pa.int32()), pa.array([k], pa.int32()), pa.array([task], pa.int64()), pa.array([m.n], pa.int64()), pa.array([sums]), pa.array([m.products[i:j].tobytes()], pa.binary())],
                    names=["size", "strip", "part", "n", "sums", "products"],
                )

    parts = stored(rows.mapInArrow(summed, PARTS), "whitening-parts")
    n_parts = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n_parts > 1:
        parts = parts.groupBy("size", "strip", F.floor(F.col("part") / FAN)).applyInPandas(_joined, PARTS)
        n_parts = -(-n_parts // FAN)
    out: dict[int, Moments] = {}
    for row in parts.orderBy("size", "strip").toLocalIterator():  # one matrix a vector length
        size = row["size"]
        strip = np.frombuffer(row["products"]).reshape(-1, size)
        if size in out:
            out[size].products = np.concatenate((out[size].products, strip))
        else:
            out[size] = Moments(row["n"], np.array(json.loads(row["sums"]), object), strip)
    return out


# ---------------------------------------------------------- eigenvectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections."""
    a, mirrors = matrix.copy(), []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        if not np.any(u[1:]):
            mirrors.append(None)
            continue
        norm = np.copysign(np.linalg.norm(u), u[0])
        u[0] += norm
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1, k] = a[k, k + 1] = -norm
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny
    with np.errstate(over="ignore", divide="ignore"):
        q = diagonal[0] - points
        count = (q < 0).astype(int)
        for d, e in zip(diagonal[1:].tolist(), off.tolist(), strict=True):
            q = d - points - e * e / np.where(q == 0, tiny, q)
            count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection to the last bits."""
    n = len(diagonal)
    reach = np.abs(np.concatenate((off, [0]))) + np.abs(np.concatenate(([0], off)))
    margin = EPS * n * np.max(np.abs(diagonal) + reach) + np.finfo(float).tiny
    low, high = np.full(k, np.min(diagonal - reach) - margin), np.full(k, np.max(diagonal + reach) + margin)
    place = n - np.arange(k)  # among the eigenvalues in rising order, from 1
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            return middle
        above = sturm_counts(diagonal, off, middle) >= place
        high, low = np.where(open_ & above, middle, high), np.where(open_ & ~above, middle, low)


class _Shifted:
    """Factors of a shifted tridiagonal matrix with row interchanges; pivots are never smaller than `floor`."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, shift: float, floor: float):
        n = len(diagonal)
        d, e, u, u2 = (diagonal - shift).tolist(), off.tolist(), [*off.tolist(), 0.0], [0.0] * n
        self.steps = []
        for i in range(n - 1):
            if abs(d[i]) >= abs(e[i]):
                m = e[i] / d[i] if d[i] else 0.0
                d[i + 1] -= m * u[i]
                self.steps.append((False, m))
            else:
                m = d[i] / e[i]
                d[i], above, u[i] = e[i], u[i], d[i + 1]
                u2[i] = u[i + 1]
                d[i + 1] = above - m * u[i]
                u[i + 1] = -m * u2[i]
                self.steps.append((True, m))
        self.d = [x if abs(x) >= floor else float(np.copysign(floor, x)) for x in d]
        self.u, self.u2 = u, u2

    def solve(self, right: np.ndarray) -> np.ndarray:
        b = right.tolist()
        for i, (swapped, m) in enumerate(self.steps):
            if swapped:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= m * b[i]
        after = after2 = 0.0
        for i in range(len(b) - 1, -1, -1):
            b[i] = (b[i] - self.u[i] * after - self.u2[i] * after2) / self.d[i]
            after, after2 = b[i], after
        return np.array(b)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors as rows. Values closer than a thousandth of the norm form a cluster."""
    n = len(diagonal)
    norm = max(np.max(np.abs(diagonal)), np.max(np.abs(off), initial=0.0), 1e-100)
    rng, out, cluster, shift = np.random.default_rng(11), [], 0, np.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        shift = min(value, shift - 10 * EPS * norm)  # equal values get shifts of their own
        factors, z = _Shifted(diagonal, off, shift, EPS * norm), rng.standard_normal(n)
        for _ in range(rounds):
            z = factors.solve(z / np.linalg.norm(z))
            for _ in range(2):
                for before in out[cluster:]:
                    z = z - (before @ z) * before
        out.append(z / np.linalg.norm(z))
    return np.array(out).reshape(len(values), n)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as rows; a vector's largest entry is positive."""
    scale = float(np.max(np.abs(matrix))) or 1.0
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        if mirrors[i] is not None:
            vectors[:, i + 1 :] -= 2 * np.outer(vectors[:, i + 1 :] @ mirrors[i], mirrors[i])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = vectors[np.arange(k), np.argmax(np.abs(vectors), axis=1)]
    return values * scale, vectors * np.where(largest < 0, -1.0, 1.0)[:, None]


# ------------------------------------------------------------- whitening


@dataclass
class Model:
    """The fit of one vector length. `live` components have variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    spread: np.ndarray
    explained: np.ndarray
    live: int
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact (Python ints where a long is too narrow)."""
        sums = np.array(self.sums, object)
        base = sums // self.n
        rest = sums - base * self.n
        near = x - base.astype(np.int64)
        if (int(np.abs(near).max(initial=0)) + 1) * self.n <= LONG >> 1:
            return near * self.n - rest.astype(np.int64)
        return near.astype(object) * self.n - rest

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Row by live component."""
        return (deviations / self.n).astype(float) @ self.vectors[: self.live].T / self.spread[: self.live]


def sum_of_squares(y: np.ndarray) -> list[int]:
    """Of each row, exact."""
    if y.dtype == object:
        return (y * y).sum(axis=1).tolist()
    most, width = int(np.abs(y).max(initial=0)), y.shape[1]
    if most * most * width <= LONG:
        return (y * y).sum(axis=1).tolist()
    if most >= 1 << 52 or width > 1 << 10:
        return (y.astype(object) ** 2).sum(axis=1).tolist()
    y = np.abs(y)
    high, low = y >> 26, y & ((1 << 26) - 1)
    parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist(), strict=True)
    return [(a << 52) + (b << 27) + c for a, b, c in parts]


def fit(fine: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each vector length of `usable` rows."""
    models: dict[int, Model] = {}
    for size, m in moments(fine.select("v"), lambda batch: ((x.shape[1], x) for _, x in _by_size(batch))).items():
        covariance = (m.products + m.products.T) / (2 * m.n)
        k, trace = min(components, size), float(np.trace(covariance))
        values, vectors = leading(covariance, k)
        live = int(np.count_nonzero(values > size * EPS * max(values[0], 0)))
        values = np.where(np.arange(k) < live, values, 0.0)
        models[size] = Model(m.n, m.sums.tolist(), vectors, np.sqrt(values), values / trace if trace > 0 else np.zeros(k), live)
    spread = fine.sparkSession.sparkContext.broadcast(models)

    def whitened(batch: pa.RecordBatch):
        for _, x in _by_size(batch):
            model = spread.value[x.shape[1]]
            if model.live:
                yield x.shape[1], model.whitened(model.deviations(x))

    for size, model in models.items():
        of_size = fine if len(models) == 1 else fine.filter(F.size("v") == size)
        for m in moments(of_size.select("v"), whitened).values():
            model.identity_error = float(np.max(np.abs(m.products / m.n - np.eye(len(m.products)))))
    return models


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """COLUMNS: a row for each remaining row of `rows` and component."""
    fine = usable(rows, id_col, vector_col)
    models = fine.sparkSession.sparkContext.broadcast(fit(fine, components))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for at, x in _by_size(batch):
                model = models.value[x.shape[1]]
                k = len(model.vectors)
                y = model.deviations(x)
                squares = sum_of_squares(y)
                white = np.full((len(x), k), np.nan)
                white[:, : model.live] = model.whitened(y)
                every = np.repeat(np.arange(len(at)), k)
                narrow = pa.array([s if s <= LONG else None for s in squares], pa.int64())
                wide = pa.array([Decimal(s) if s > LONG else None for s in squares], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at[every])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(every), model.n, np.int64)),
                        narrow.take(pa.array(every)),
                        wide.take(pa.array(every)),
                        pa.array(white.ravel(), from_pandas=True),  # NaN: null
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array(np.full(len(every), model.identity_error)),
                    ],
                    names=[c.split()[0] for c in COLUMNS.split(", ")],
                )

    return fine.mapInArrow(given, COLUMNS)
