"""Bloom filters over hashes, built in tasks and joined in levels of bounded groups.

A filter's bits are cut into pages of PAGE bits. Each task gathers places and
sends, for every page and FLUSH places, one row with two packed bitmaps: places
met, and places met again. FAN rows of a page are joined by a task, level by
level, so no group grows with the input. What comes to the driver is a row a
page, and the filter sent to every task is at most `max_bits` / 8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import stored

PAGE = 1 << 20
HASHES = 2
FLUSH = 1 << 21  # places that a task holds before it sends them
FAN = 32
MEMBER_BITS = 16  # bits a key of `member_filter`
MEMBER_MAX_BITS = 1 << 28  # 32 MB

PARTS = "page long, part long, once binary, twice binary"


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The filter places of each unsigned 64-bit hash: a row of HASHES."""
    first, second = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) & np.uint64(bits - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def _squeezed(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(bits.tobytes())


def _loose(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def bitmaps(groups: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """PARTS of one task. Each array holds the different places of one counted thing; one met in two of them is met again."""
    task, sent, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

    def rows() -> pd.DataFrame:
        every, counts = np.unique(np.concatenate(held), return_counts=True)
        out = []
        for page in np.unique(every // PAGE).tolist():
            low, high = np.searchsorted(every, (page * PAGE, (page + 1) * PAGE))
            once, twice = np.zeros(PAGE, bool), np.zeros(PAGE, bool)
            once[every[low:high] - page * PAGE] = True
            twice[every[low:high][counts[low:high] > 1] - page * PAGE] = True
            out.append((page, task + sent, *(_squeezed(np.packbits(b, bitorder="little")) for b in (once, twice))))
        return pd.DataFrame(out, columns=["page", "part", "once", "twice"])

    for group in groups:
        held.append(group)
        n += len(group)
        if n >= FLUSH:
            yield rows()
            sent, held, n = sent + 1, [], 0
    if held:
        yield rows()


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(PAGE // 8, np.uint8), np.zeros(PAGE // 8, np.uint8)
    for o, t in zip(group["once"], group["twice"], strict=True):
        o = _loose(o)
        twice |= _loose(t) | (once & o)
        once |= o
    return pd.DataFrame({"page": [group["page"].iloc[0]], "part": [group["part"].min()], "once": [_squeezed(once)], "twice": [_squeezed(twice)]})


def joined(parts: DataFrame) -> DataFrame:
    """One row of PARTS for each page."""
    parts = stored(parts, "filter-parts")
    rows = parts.groupBy("page").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while rows > 1:
        width = -(-rows // FAN)
        parts = parts.groupBy("page", F.pmod(F.xxhash64("part"), F.lit(width))).applyInPandas(_joined, PARTS)
        rows = width
    return parts


def load(pages: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter as packed bits, a page at a time."""
    out = np.zeros(max(bits, PAGE) // 8, np.uint8)
    for row in pages.select("page", column).toLocalIterator():
        out[row["page"] * PAGE // 8 : (row["page"] + 1) * PAGE // 8] = _loose(row[column])
    return out


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all places of each row are set."""
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def filter_size(keys: int, bits_a_key: int, most: int) -> int:
    return min(most, max(PAGE, 1 << int(keys * bits_a_key - 1).bit_length()))


def member_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test on bigint columns: true for all values of `key`, false for nearly all others.

    For a join that few rows of a wide table take part in: the others need not
    be shuffled. Beyond MEMBER_MAX_BITS more of them are, the result is the same.
    """
    spark = keys.sparkSession
    bits = filter_size(max(1, keys.count()), MEMBER_BITS, MEMBER_MAX_BITS)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from bitmaps(places(b[key].to_numpy(np.int64).view(np.uint64), bits).ravel() for b in batches)

    pages = joined(keys.select(key).mapInPandas(gathered, PARTS))
    shared = spark.sparkContext.broadcast(load(pages, "once", bits))

    @F.pandas_udf("boolean")
    def member(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(holds(shared.value, places(values.to_numpy(np.int64).view(np.uint64), bits)))

    return member
