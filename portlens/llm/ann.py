"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are rotated by three rounds of random signs and a fast Hadamard
transform; a rotation's hash is the signed axis nearest to the result. A table's
bucket joins the hashes of several rotations, so many that the buckets grow with
the rows (`shape`). A query probes the buckets nearest to it in every table, by
the sum of squared distances to the nearest axes. The rows found are ranked by
their exact distance. On unit vectors spread evenly in 64 dimensions, the
hardest case, recall at 10 is 0.9 and more while the share of rows that a query
is compared with falls: 0.32 of 2,000 rows, 0.2 of 10,000, 0.11 of 51,000.

Equal vectors are one class with its smallest ids, so a vector that a third of
the rows share is one entry. The index holds a class once a table, its vector as
8-bit steps with their error: a task keeps for a query whatever the error leaves
among its nearest of all buckets there, and only those are ranked on the
original vectors. Nothing else of a query and a row ever leaves a task.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null id; vectors are compared within their length. A
(id, vector) row repeated counts once. A query is never its own neighbour,
under any row with its id. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portlens.llm.common import stored

TABLES = 14
PROBES = 112
SHARE, FALL = 0.3, 0.35  # of 2,000 rows, and the power by which it falls with their number
BLOCK_ROWS = 4096
TASK_ROWS = 20_000
CHUNK = 64  # vectors hashed at a time
SEED = 7


def _rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of unit rows, padded to a power of two."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        out = out * s
        half = 1
        while half < width:
            pairs = out.reshape(len(x), -1, 2, half)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), width)
            half *= 2
        out /= np.sqrt(width)
    return out


def shape(rows: int, size: int, tables: int, probes: int) -> tuple[int, ...]:
    """Axes used of each rotation that a table's hash joins, for so many rows of one length.

    The buckets of a table grow with the rows, so that the share of rows in a
    query's probed buckets falls as the power FALL of their number (SHARE of
    2,000 rows); whole rotations are added as they grow, the last one cut to its
    first axes.
    """
    share = min(1.0, SHARE * (max(rows, 1) / 2000) ** -FALL)
    buckets = probes / (1 - (1 - share) ** (1 / tables))
    width = max(2, 1 << (size - 1).bit_length())
    bits, each = max(1, round(np.log2(buckets))), (2 * width).bit_length() - 1
    whole = (bits - 1) // each
    return (*[width] * whole, 1 << (bits - whole * each - 1))


def signed_axes(x: np.ndarray, table: int, used: tuple[int, ...]) -> list[np.ndarray]:
    """For each rotation of a table the rows' coordinates along the signed axes."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = (_rotated(unit, table * 64 + i)[:, :n] for i, n in enumerate(used))
    return [np.concatenate((r, -r), axis=1) for r in turned]


def buckets(x: np.ndarray, table: int, used: tuple[int, ...], probes: int) -> np.ndarray:
    """The `probes` nearest buckets of each row, nearest first: the least sum of squared distances to the nearest axes."""
    code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for along in signed_axes(x, table, used):
        far = (along.max(axis=1, keepdims=True) - along) ** 2
        k = min(probes, far.shape[1])
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        sums = (cost[:, :, None] + np.take_along_axis(far, near, axis=1)[:, None, :]).reshape(len(x), -1)
        codes = (code[:, :, None] * far.shape[1] + near[:, None, :]).reshape(len(x), -1)
        k = min(probes, sums.shape[1])
        best = np.argpartition(sums, k - 1, axis=1)[:, :k]
        code, cost = np.take_along_axis(codes, best, axis=1), np.take_along_axis(sums, best, axis=1)
    order = np.argsort(cost, axis=1, kind="stable")
    return np.take_along_axis(code, order, axis=1)


def _codes(vector: Column, shapes: dict[int, tuple[int, ...]], tables: int, probes: int) -> Column:
    """struct(codes, areas, q, scale, error): buckets of all tables by length and table, the areas they lie in
    (without the last rotation), and the vector as 8-bit steps with its distance to them."""

    @F.pandas_udf("codes array<long>, areas array<long>, q binary, scale double, error double")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [None] * len(rows)
            sizes = np.array([len(v) for v in rows])
            for size in np.unique(sizes).tolist():
                used = shapes[size]
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), CHUNK):
                    part = at[i : i + CHUNK]
                    x = np.stack([np.asarray(rows.iloc[j], float) for j in part])
                    every = [buckets(x, t, used, probes) for t in range(tables)]
                    place = [(size << 46) + (t << 38) for t in range(tables)]
                    full = np.concatenate([c + p for c, p in zip(every, place, strict=True)], axis=1)
                    area = np.concatenate([c // (2 * used[-1]) + p for c, p in zip(every, place, strict=True)], axis=1)
                    scale = np.abs(x).max(axis=1) / 127
                    q = np.rint(x / scale[:, None]).astype(np.int8)
                    error = np.linalg.norm(x - q * scale[:, None], axis=1)
                    for j, row in zip(part.tolist(), zip(full, area, map(bytes, q), scale, error, strict=True), strict=True):
                        out[j] = row
            yield pd.DataFrame(out, columns=["codes", "areas", "q", "scale", "error"])

    return codes(vector)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (vec_id, v) that take part, v as array<double>."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


def search(rows: DataFrame, queries: Column, k: int = 10, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found for each row where `queries` (over vec_id) holds."""
    fine = usable(rows, id_col, vector_col)
    by_id = Window.partitionBy("v").orderBy("vec_id")
    some = fine.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    classes = some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 ids
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "v", "ids"), "ann-classes")
    asked = fine.filter(queries)
    named = stored(asked.join(classes.select("class", "v"), "v").select("vec_id", "class", "v"), "ann-queries")
    lengths = classes.groupBy(F.size("v").alias("size")).agg(F.sum(F.size("ids")).alias("rows"), F.count(F.lit(1)).alias("classes"))
    lengths = stored(lengths.withColumn("blocks", F.ceil(F.col("classes") / BLOCK_ROWS).cast("int")), "ann-lengths")
    shapes = {r["size"]: shape(r["classes"], r["size"], tables, probes) for r in lengths.collect()}  # a row for each length
    held = stored(classes.select("class", _codes(F.col("v"), shapes, tables, 1).alias("c")).select("class", "c.*"), "ann-index")
    asking = named.dropDuplicates(["class"]).select("class", "v")
    asking = stored(asking.select("class", "v", _codes(F.col("v"), shapes, tables, probes).alias("c")).select("class", "v", "c.codes", "c.areas"), "ann-probes")
    found = _compared(held, asking, max(1, classes.count() * tables // TASK_ROWS), k)
    found = found.join(asking.select(F.col("class").alias("asker"), F.col("v").alias("asked")), "asker")
    found = found.join(classes.select(F.col("class").alias("found"), "v", "ids"), "found")
    distance = F.sqrt(F.aggregate(F.zip_with("v", "asked", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    found = found.select("asker", "ids", distance.alias("score"))
    of_class = found.select("asker", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("asker").orderBy("score", "vec_id")
    of_class = of_class.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    near = named.select(F.col("vec_id").alias("query_id"), F.col("class").alias("asker")).join(of_class, "asker").filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asker").orderBy("score", "vec_id"))
    near = stored(near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "asker", "rank", "vec_id", "score"), "ann-near")
    got = near.groupBy("query_id", "asker").agg(F.count(F.lit(1)).alias("n"))
    due = named.select(F.col("vec_id").alias("query_id"), F.col("class").alias("asker"), "v", F.size("v").alias("size")).join(F.broadcast(lengths), "size")
    short = due.join(got, ["query_id", "asker"], "left").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1))
    short = stored(short.select("query_id", "asker", "v", "size"), "ann-short")
    if not short.isEmpty():
        near = near.join(short, ["query_id", "asker"], "left_anti").unionByName(_exact(short, classes, lengths, k))
    return near.select("query_id", "rank", "vec_id", "score")


def _compared(held: DataFrame, asking: DataFrame, tasks: int, k: int) -> DataFrame:
    """(asker, found): for each query the classes of its probed buckets that may be among its k + 1 nearest.

    Buckets of an area share a task, so a query goes to few tasks, once to each.
    An area that holds far more than a task's rows is dealt out by bucket, and a
    bucket with more than BLOCK_ROWS classes or queries is cut into blocks of
    the ones and tiles of the others.
    """
    place = F.explode(F.arrays_zip("codes", "areas")).alias("p")
    index = held.select("class", "q", "scale", "error", place).select("class", "q", "scale", "error", "p.codes", "p.areas")
    probing = asking.select("class", "v", place).select("class", "v", "p.codes", "p.areas")
    one, none = F.lit(1).alias, F.lit(0).alias
    sides = index.select("codes", "areas", one("rows"), none("asks")).unionByName(probing.select("codes", "areas", none("rows"), one("asks")))
    loads = sides.groupBy("codes", "areas").agg(F.sum("rows").alias("rows"), F.sum("asks").alias("asks"))
    cut = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    crowded = loads.filter(F.greatest("rows", "asks") > BLOCK_ROWS)
    crowded = stored(crowded.select("codes", F.greatest(cut("rows"), F.lit(1)).alias("blocks"), F.greatest(cut("asks"), F.lit(1)).alias("tiles")), "ann-crowded")
    heavy = loads.groupBy("areas").agg(F.sum("rows").alias("rows"), F.sum("asks").alias("asks")).filter(F.greatest("rows", "asks") > 4 * TASK_ROWS)
    heavy = stored(heavy.select("areas", F.lit(True).alias("heavy")), "ann-heavy")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.join(crowded, "codes", "left").join(heavy, "areas", "left")
        count = lambda c: F.coalesce(F.col(c), F.lit(1))
        side = side.withColumn("own", F.pmod(F.xxhash64("class"), count(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count(other) - 1)))
        part = F.xxhash64("codes", *(["own", "other"] if own == "blocks" else ["other", "own"]))
        key = F.when(F.col("blocks").isNotNull(), part).when(F.col("heavy"), F.xxhash64("codes")).otherwise(F.xxhash64("areas"))
        cell = F.when(F.col("blocks").isNotNull(), part.bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("codes"))  # buckets are above zero
        return side.withColumns({"task": F.pmod(key, F.lit(tasks)), "cell": cell})

    rows = dealt(index, "blocks", "tiles").select("task", "cell", "class", "q", "scale", "error")
    asks = dealt(probing, "tiles", "blocks").groupBy("task", "class").agg(F.first("v").alias("v"), F.collect_list("cell").alias("cells"))

    def nearest(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"asker": [], "found": []}, dtype="int64")]
        for size, mine in asks.groupby(asks["v"].map(len)):
            here = rows[rows["q"].map(len) == size].sort_values("cell", kind="stable")
            if not len(here):
                continue
            cell, name, error = (here[c].to_numpy() for c in ("cell", "class", "error"))
            x = np.frombuffer(b"".join(here["q"]), np.int8).reshape(-1, size) * here["scale"].to_numpy()[:, None]
            for asker, v, cells in zip(mine["class"].tolist(), mine["v"], mine["cells"], strict=True):
                first, end = np.searchsorted(cell, cells), np.searchsorted(cell, cells, side="right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(first.tolist(), end.tolist(), strict=True)] or [np.empty(0, int)])
                names, once = np.unique(name[at], return_index=True)
                if not len(names):
                    continue
                at = at[once]
                d = np.sqrt(((x[at] - np.asarray(v, float)) ** 2).sum(axis=1))
                reach = d + error[at]  # the true distance lies within the error of the steps
                last = min(k, len(at) - 1)
                close = d - error[at] <= np.partition(reach, last)[last] * (1 + 1e-12)
                out.append(pd.DataFrame({"asker": asker, "found": names[close]}))
        return pd.concat(out)

    pairs = asks.groupBy("task").cogroup(rows.groupBy("task")).applyInPandas(nearest, "asker long, found long")
    return pairs.distinct()


def _exact(short: DataFrame, classes: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """query_id, asker, rank, vec_id, score: the k nearest rows with another id, among all classes of the query's length."""
    tiles = short.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("tiles"))
    cut = F.broadcast(lengths.join(tiles, "size").select("size", "blocks", "tiles"))  # a row for each length
    asking = short.join(cut, "size").withColumn("tile", F.pmod(F.xxhash64("query_id", "asker"), F.col("tiles")).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = classes.withColumn("size", F.size("v")).join(cut, "size").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    held = held.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    held = held.select("size", "tile", "block", "class", "v", F.element_at("ids", 1).alias("low"), F.coalesce(F.get("ids", F.lit(1)), F.element_at("ids", 1)).alias("next"), (F.size("ids") == 1).alias("lone"))

    def nearest(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "asker": [], "found": [], "score": []})]
        if len(held):
            x = np.stack([np.asarray(v, float) for v in held["v"]])
            low, after, names, lone = (held[c].to_numpy() for c in ("low", "next", "class", "lone"))
            for q, name, v in zip(asking["query_id"].tolist(), asking["asker"].tolist(), asking["v"], strict=True):
                there = np.flatnonzero((low != q) | ~lone)  # classes with another id than the query's
                if not len(there):
                    continue
                d = np.sqrt(((x[there] - np.asarray(v, float)) ** 2).sum(axis=1))
                other = np.where(low[there] == q, after[there], low[there])
                last = min(k, len(there)) - 1
                best = np.flatnonzero(d <= np.partition(d, last)[last])
                best = best[np.lexsort((other[best], d[best]))][:k]
                out.append(pd.DataFrame({"query_id": q, "asker": name, "found": names[there[best]], "score": d[best]}))
        return pd.concat(out[1:] or out)

    keys = ["size", "tile", "block"]
    found = asking.select(*keys, "query_id", "asker", "v").groupBy(*keys).cogroup(held.groupBy(*keys))
    found = found.applyInPandas(nearest, "query_id long, asker long, found long, score double")
    rows = found.join(classes.select(F.col("class").alias("found"), "ids"), "found").select("query_id", "asker", "score", F.explode("ids").alias("vec_id")).filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asker").orderBy("score", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "asker", "rank", "vec_id", "score")
