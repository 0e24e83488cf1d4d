"""SimHash near-duplicates by a segment-popcount embedding.

1. Each text gets a 64-bit fingerprint: bit b is 1 if it is set in over half of
   the XXH64 (seed 42) of its k-word shingles, repeats included.
2. Equal fingerprints become one class; all that follows works on classes.
3. A fingerprint is embedded as the bit counts of its 32 two-bit segments. The
   Manhattan distance of two embeddings never exceeds the bits in which the
   fingerprints differ. The segments form blocks; if the whole distance is at
   most d, at least `blocks - d` blocks lie at distance 0. So each choice of
   `blocks - d` blocks is a grid whose cell is the counts in those blocks, and
   two embeddings in reach share the cell of at least one grid.
4. Within a cell, pairs are first held to the Manhattan bound, then to the exact
   bit distance. Only a spanning forest of the links found leaves a task, never
   all pairs; links within one component add nothing to the components.
   A crowded cell is cut into tiles of TILE classes and each pair of tiles is a
   task of its own, so its size never bears on one task.
5. Components by star joins (`components.py`).

Null text and text without words: fingerprint zero, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Each input
row gives one row; repeated rows share a class. Null ids take part, but are
never the smallest id unless a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portlens.llm import bloom
from portlens.llm.common import stored
from portlens.llm.components import components

SEED = 42
SEGMENTS = 32
TILE = 2048  # classes of a tile of a crowded cell
CELL = 200  # unrelated classes that a cell may hold on average
ROWS = 100_000  # rows of a task, about


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    digest = xxhash.xxh64_intdigest
    ends = ends[min(shingle, len(words)) - 1 :][:n]
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int) -> Column:
    """bigint with the fingerprint's bits."""

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return made(text)


def _counts(f: np.ndarray) -> np.ndarray:
    """The two-bit segments' bit counts, packed two bits each."""
    low = np.uint64(0x5555555555555555)
    return (f & low) + ((f >> np.uint64(1)) & low)


def _block_masks(blocks: int) -> list[int]:
    edges = [round(i * SEGMENTS / blocks) * 2 for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _grids(max_bits: int, classes: int) -> list[int]:
    """For each grid the mask of the blocks that have to agree.

    More blocks have to agree as the classes grow, so a cell of unrelated
    fingerprints stays small (a two-bit count carries 1.5 bits).
    """
    agree = 2
    while agree + max_bits < SEGMENTS and classes / 2 ** (1.5 * SEGMENTS * agree / (agree + max_bits)) > CELL:
        agree += 1
    masks = _block_masks(agree + max_bits)
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(agree + max_bits), agree)]


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether pairs of fingerprints lie within `max_bits`: the Manhattan bound first, then exactly.

    Counts 0, 1, 2 as two bits: they differ by 1 where the low bits differ, else by 2 where the high bits do.
    """
    low, one = np.uint64(0x5555555555555555), np.uint64(1)
    d = _counts(a) ^ _counts(b)
    odd = d & low
    near = np.bitwise_count(odd) + 2 * np.bitwise_count((d >> one) & low & ~odd) <= max_bits
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= max_bits
    return near


class _Forest:
    """Links that join two trees, by union-find over the places of an array."""

    def __init__(self, n: int):
        self.root, self.kept = list(range(n)), []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        root = self.root
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            p, q = x, y
            while root[p] != p:
                root[p] = p = root[root[p]]
            while root[q] != q:
                root[q] = q = root[root[q]]
            if p != q:
                root[q] = p
                self.kept.append((x, y))


def _in_cells(f: np.ndarray, cell: np.ndarray, place: np.ndarray, forest: _Forest, max_bits: int) -> None:
    """Links among rows with equal `cell` (sorted): each row against the k-th after it, k = 1, 2, ..."""
    rows = np.arange(len(f))
    k = 0
    while len(rows):
        k += 1
        rows = rows[rows + k < len(f)]
        rows = rows[cell[rows] == cell[rows + k]]
        near = rows[_near(f[rows], f[rows + k], max_bits)]
        forest.add(place[near], place[near + k])


def _across(f: np.ndarray, x: np.ndarray, y: np.ndarray, place: np.ndarray, forest: _Forest, max_bits: int) -> None:
    """Links between the rows x and the rows y of a pair of tiles, in blocks."""
    step = max(1, (1 << 18) // max(1, len(y)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        u, v = np.repeat(part, len(y)), np.tile(y, len(part))
        near = _near(f[u], f[v], max_bits)
        forest.add(place[u[near]], place[v[near]])


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """(hi, lo): links that connect all fingerprints within `max_bits`; `classes` has a distinct long column f."""
    n = classes.count()
    grids = _grids(max_bits, n)
    tasks = max(1, len(grids) * n // ROWS)
    low = 0x5555555555555555
    signed = [g - (1 << 64) if g >> 63 else g for g in grids]
    shifted = F.shiftrightunsigned("f", 1)
    counts = F.col("f").bitwiseXOR(shifted).bitwiseAND(F.lit(low)).bitwiseOR(F.shiftleft(F.col("f").bitwiseAND(shifted).bitwiseAND(F.lit(low)), 1))
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("e").bitwiseAND(F.lit(g)).alias("cell")) for i, g in enumerate(signed)])
    placed = classes.select("f", counts.alias("e")).select("f", F.explode(cells).alias("c")).select("f", "c.grid", "c.cell")
    crowded = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    crowded = crowded.select("grid", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    placed = placed.join(crowded, ["grid", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("f"), F.col("tiles")).cast("int"))
    pair = lambda t: F.struct(F.least(t, F.col("tile")).alias("x"), F.greatest(t, F.col("tile")).alias("y"))
    dealt = placed.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair)))
    # the cells of a task share its key; a pair of tiles has its own, below zero
    key = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("grid", "cell"), F.lit(tasks))).otherwise(F.xxhash64("grid", "cell", "p.x", "p.y").bitwiseOR(F.lit(-(1 << 63))))
    dealt = dealt.select(key.alias("key"), "f", "grid", "cell", "tile", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "tiles")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["grid", "cell"], kind="stable")
        f = group["f"].to_numpy().view(np.uint64)
        every, place = np.unique(f, return_inverse=True)
        forest = _Forest(len(every))
        step = (np.diff(group["grid"].to_numpy()) != 0) | (np.diff(group["cell"].to_numpy()) != 0)
        cell = np.concatenate(([0], np.cumsum(step)))
        x, y, tile = (group[c].to_numpy() for c in ("x", "y", "tile"))
        if group["tiles"].iloc[0] == 1:
            _in_cells(f, cell, place, forest, max_bits)
        else:
            for c in range(cell[-1] + 1):  # one, unless keys collide
                for p, q in {(int(i), int(j)) for i, j in zip(x[cell == c], y[cell == c], strict=True)}:
                    at = np.flatnonzero((cell == c) & (x == p) & (y == q))
                    if p == q:
                        _in_cells(f[at], cell[at], place[at], forest, max_bits)
                    else:
                        _across(f, at[tile[at] == p], at[tile[at] == q], place, forest, max_bits)
        ends = every.view(np.int64)[np.array(forest.kept, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"hi": ends.max(axis=1), "lo": ends.min(axis=1)})

    return dealt.groupBy("key").applyInPandas(within, "hi long, lo long")


def _labelled(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, f, label): each row's fingerprint and its component's smallest fingerprint."""
    text = F.col(text_col)
    made = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprints(text, shingle).alias("f"))
    made = stored(made, "fingerprints")
    classes = made.select("f").distinct()
    joined = components(links(stored(classes, "classes"), max_bits))
    joined = stored(joined, "labels")
    return stored(made.join(joined, made["f"] == joined["node"], "left").select("doc_id", "text_hash", "f", F.coalesce("label", "f").alias("label")), "labelled")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = _labelled(docs, shingle, max_bits, id_col, text_col)
    # stored, so that a label with a third of the rows is a skewed partition of a plain join, which splits
    least = stored(rows.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("component_id")), "least")
    out = rows.join(least, rows["label"] == least["of"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component, with the columns of `docs`.

    It is the row with the smallest id (a null id only if there is no other);
    of different texts under that id the one with the smallest hash, of equal
    rows any one.
    """
    rows = _labelled(docs, shingle, max_bits, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("s")
    first = rows.groupBy("label").agg(first).select(F.col("s.id").alias("__id"), F.col("s.hash").alias("__hash")).distinct()
    first = stored(first, "kept")
    # few rows go: only those that may be among them are joined, the others pass where they are read
    of_first = (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("text_hash") == F.col("__hash"))
    gone = stored(rows.join(first, of_first, "left_anti").select(F.xxhash64("doc_id", "text_hash").alias("key")), "gone")
    text_hash = F.xxhash64(docs[text_col])
    may_go = bloom.member_filter(gone, "key")(F.xxhash64(docs[id_col], text_hash))
    staying = docs.filter(may_go).join(first, docs[id_col].eqNullSafe(first["__id"]) & (text_hash == first["__hash"]), "left_semi")
    held = docs.filter(~may_go).unionByName(staying)
    twice = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return held if twice.isEmpty() else held.dropDuplicates([id_col, text_col])
