"""Sequence packing by cutting-stock column generation.

A document's tokens are its ids and one closing id. Whole pieces of `capacity`
are cut off first; what remains has a length below `capacity`, and the number
of remainders by length is the histogram of a cutting-stock problem:

* a linear program over patterns (how many pieces of which lengths fill one
  sequence) covers the histogram with the fewest sequences; it starts from
  patterns of one length, and a knapsack by dynamic programming prices new
  ones from the program's duals until none helps by more than TOLERANCE;
* the solution is rounded down, and patterns that fill a sequence are dealt to
  documents: those of one length are ranked, and ranks are mapped to a
  pattern's sequences and places by arithmetic;
* remainders that no rounded pattern takes are laid end to end, by length and
  rank, and cut at sequence borders; the last sequence is cut at its powers of
  two, which need no padding.

The program has a row a length, so it is as small for any number of documents.
Only the histogram reaches the driver. Ranks come from a count by salt and
length and a rank within, so a length that a third of the documents share is
never in one task. The cut remainders are few (the rounding loses less than
one sequence a pattern); only their texts are encoded again for their cuts.

Null text counts as empty: a document of the closing id alone. Each input row
is packed, repeated rows too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portlens.llm import bloom, bpe
from portlens.llm.common import stored

CAPACITY = 1024
TOLERANCE = 0.002
COLUMNS = 1
SALTS = 64
CACHE_WORDS = 1 << 16  # entries of the automaton's word cache, which is emptied when full


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of pieces within `capacity`, any number of each length, and how many of each."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if fits:
            got = best[c - lengths[:fits]] + value[:fits]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], k
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= lengths[choice[c]]
    return float(best[capacity]), pattern


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(basis, solution): longest pieces first, each pattern repeated until it uses up a length.

    Each column uses up a length that no later one has, so the basis is regular.
    """
    m = len(lengths)
    left, basis, x = demand.copy(), np.zeros((m, m)), np.zeros(m)
    while (live := np.flatnonzero(left > 0)).size:
        room, pattern = capacity, np.zeros(m)
        for k in live[::-1]:
            n = min(room // lengths[k], left[k] if left[k] < 1 else np.floor(left[k]))
            n = int(max(n, 1 if lengths[k] <= room else 0))
            pattern[k], room = n, room - n * lengths[k]
        at = np.flatnonzero(pattern)
        out = at[(left[at] / pattern[at]).argmin()]
        times = left[out] / pattern[out]
        left[at] = np.maximum(left[at] - times * pattern[at], 0)
        left[out] = 0
        basis[:, out], x[out] = pattern, times
        for k in at:  # used up at the same time
            if left[k] <= 1e-9 and k != out and not basis[:, k].any():
                left[k] = 0
                basis[k, k] = capacity // lengths[k]
    return basis, x


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, how often each): a nearly optimal basis of the covering program, by the revised simplex method.

    It stops within `tolerance` of the dual bound, or after COLUMNS times the
    lengths; stopping early leaves more remainders to be cut, nothing else.
    """
    m = len(lengths)
    basis, x = first_basis(lengths, demand, capacity)
    inverse = np.linalg.inv(basis)
    bound = demand @ lengths / capacity  # by volume
    for turn in range(1, COLUMNS * m + 1):
        duals = inverse.T @ (basis.max(axis=0) > 0)  # a surplus column has no cost
        low = int(duals.argmin())
        value, pattern = knapsack(np.maximum(duals, 0), lengths, capacity)
        bound = max(bound, demand @ np.maximum(duals, 0) / max(value, 1e-12))
        total = x[basis.max(axis=0) > 0].sum()
        if total <= bound * (1 + tolerance):
            break
        if -duals[low] > value - 1:  # more of this length than asked for costs nothing
            pattern = np.zeros(m)
            pattern[low] = -1
        change = inverse @ pattern
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * change
        x[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        if turn % 100 == 0:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
    return basis.T.round().astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], dict[int, int]]:
    """Rounded patterns (lengths, pieces of each, sequences) that fill a sequence, and the remainders dealt by length."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c and 0 < n < capacity), np.int64)
    dealt = dict.fromkeys(lengths.tolist(), 0)
    out = []
    if len(lengths):
        demand = np.array([histogram[n] for n in lengths.tolist()], float)
        left = demand.astype(np.int64)
        for pattern, x in zip(*column_generation(lengths, demand, capacity), strict=True):
            at = np.flatnonzero(pattern)
            times = min(int(np.floor(x + 1e-9)), int((left[at] // pattern[at]).min())) if (pattern[at] > 0).all() else 0
            if times > 0 and int(pattern @ lengths) == capacity:
                out.append((lengths[at], pattern[at], times))
                left[at] -= times * pattern[at]
        dealt = {int(n): int(d - r) for n, d, r in zip(lengths, demand, left, strict=True)}
    return out, dealt


def _borders(start: int, length: int, tail_at: int, total: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(place, length, sequence, offset) of the pieces of [start, start + length) on the stream of `total` tokens."""
    out, at, end = [], start, start + length
    while at < end:
        if at < tail_at:
            low, high, sequence = at // capacity * capacity, (at // capacity + 1) * capacity, at // capacity
        else:  # the last, open sequence: its length's powers of two, the largest first
            low, rest, sequence = tail_at, total - tail_at, tail_at // capacity
            while True:
                high = low + (1 << (rest.bit_length() - 1))
                if at < high:
                    break
                rest -= high - low
                low, sequence = high, sequence + 1
        cut = min(end, high)
        out.append((at - start, cut - at, sequence, at - low))
        at = cut
    return out


class _Encoder:
    """Ids of whole texts as uint32, by the merges' ranks; by the automaton where the ids don't follow the merges."""

    def __init__(self, vocabulary: bytes):
        self.coder, self.ranks = bpe.Codec(vocabulary, bpe.as_uint32, CACHE_WORDS), None
        labels = self.coder.automaton.labels
        made = self.coder.automaton.made
        merged = [made[i] for i in sorted(labels.values()) if made[i]]
        if merged == sorted(merged):  # ids in the order of the merges, as ranks have to be
            self.ranks = tiktoken.Encoding("packing", pat_str=bpe.SPLIT, mergeable_ranks=labels, special_tokens={})
            self.coder.automaton = self.coder.label_of = None  # not needed any more: a worker's memory

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.ranks is None:
            return np.frombuffer(b"".join(self.coder.encode_chunks(text)), "<u4")
        special = self.coder.special
        if not any(s in text for s in special):
            return np.array(self.ranks.encode_ordinary(text), "<u4")
        ids: list[int] = []
        for i, part in enumerate(self.coder.at_special.split(text)):
            ids += [special[part]] if i % 2 else self.ranks.encode_ordinary(part)
        return np.array(ids, "<u4")


_encoders: dict[bytes, _Encoder] = {}


def _encoder(vocabulary: bytes) -> _Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = _Encoder(vocabulary)
    return _encoders[vocabulary]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe.read_vocabulary(vocabulary_path))  # the file's fixed size
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("salt long, doc_tokens long, full_crcs array<long>, rest_crc long")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared.value)
        salt = TaskContext.get().partitionId()
        for texts in batches:
            rows = []
            for t in texts:
                ids = np.append(encode(t), np.uint32(closing))
                cut = len(ids) // capacity * capacity
                rows.append((salt, len(ids), [_crc(ids[i : i + capacity]) for i in range(0, cut, capacity)], _crc(ids[cut:])))
                salt += 1
            yield pd.DataFrame(rows, columns=["salt", "doc_tokens", "full_crcs", "rest_crc"])

    known = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), measured("text").alias("m")).select("doc_id", "text_hash", "m.*"), "pack-documents")
    salts = max(1, min(spark.sparkContext.defaultParallelism * SALTS, known.count() // 5000 + 1))
    known = known.withColumns({"salt": F.pmod("salt", F.lit(salts)), "rest": F.col("doc_tokens") % capacity, "fulls": F.floor(F.col("doc_tokens") / capacity)})

    # ranks: of remainders within their length, and of whole pieces among all
    cells = known.groupBy("salt", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("fulls").alias("f")).persist()
    histogram = {r["rest"]: r["n"] for r in cells.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    below = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("rest_base", F.coalesce(F.sum("n").over(below), F.lit(0)))
    by_rest = cells.groupBy("rest").agg(F.sum("f").alias("f"))
    rest_order = Window.orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)
    by_rest = by_rest.select(F.col("rest").alias("of"), F.coalesce(F.sum("f").over(rest_order), F.lit(0)).alias("f_before"))  # at most `capacity` rows
    before = before.withColumn("f_base", F.coalesce(F.sum("f").over(below), F.lit(0))).join(F.broadcast(by_rest), F.col("rest") == F.col("of"))
    before = before.select(F.col("salt").alias("s"), F.col("rest").alias("r"), "rest_base", (F.col("f_base") + F.col("f_before")).alias("full_base"))
    within = Window.partitionBy("salt", "rest").orderBy("doc_id", "text_hash")
    ranked = known.withColumns({"k": F.row_number().over(within) - 1, "fk": F.coalesce(F.sum("fulls").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranked = ranked.join(before, (F.col("salt") == F.col("s")) & (F.col("rest") == F.col("r")))
    ranked = ranked.select("doc_id", "text_hash", "doc_tokens", "full_crcs", "rest_crc", "rest", (F.col("k") + F.col("rest_base")).alias("rank"), (F.col("fk") + F.col("full_base")).alias("full_rank"))

    patterns, dealt = plan({n: c for n, c in histogram.items() if n}, capacity)
    runs = _runs(patterns)
    base, stream = {}, 0
    for n in sorted(dealt):
        base[n] = stream
        stream += (histogram[n] - dealt[n]) * n
    first_stream = sum(times for _, _, times in patterns)
    tail = stream // capacity * capacity
    first_full = first_stream + tail // capacity + bin(stream - tail).count("1")
    rules = spark.sparkContext.broadcast((runs, dealt, base))  # by length and pattern: bounded by the histogram

    piece = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, text_hash long, to_cut boolean"
    names = [c.split()[0] for c in piece.split(", ")]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, dealt, base = rules.value
        for b in batches:
            out = []
            for doc_id, text_hash, tokens, crcs, rest_crc, rest, rank, full_rank in b.itertuples(index=False, name=None):
                for i, crc in enumerate(crcs):
                    out.append((doc_id, i * capacity, capacity, crc, tokens, first_full + full_rank + i, 0, capacity, text_hash, False))
                if not rest:
                    continue
                at = tokens - rest
                if rank < dealt[rest]:
                    starts, each, ids, offsets = runs[rest]
                    p = int(np.searchsorted(starts, rank, side="right")) - 1
                    turn, slot = divmod(int(rank) - int(starts[p]), int(each[p]))
                    out.append((doc_id, at, rest, rest_crc, tokens, int(ids[p]) + turn, int(offsets[p]) + slot * rest, capacity, text_hash, False))
                else:
                    place = base[rest] + (rank - dealt[rest]) * rest
                    cuts = _borders(place, rest, tail, stream, capacity)
                    for start, length, sequence, offset in cuts:
                        size = capacity if place + start < tail else _power_at(place + start - tail, stream - tail)
                        out.append((doc_id, at + start, length, rest_crc if len(cuts) == 1 else None, tokens, first_stream + sequence, offset, size, text_hash, len(cuts) > 1))
            frame = pd.DataFrame(out, columns=names)
            for c in ("doc_id", "ids_crc32"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    pieces = stored(ranked.mapInPandas(placed, piece), "pack-pieces")
    cells.unpersist()
    whole = pieces.filter(~F.col("to_cut"))
    cut = pieces.filter("to_cut")
    of_cut = cut.select("doc_id", "text_hash").distinct().select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    may_be_cut = bloom.member_filter(of_cut.select(F.xxhash64("i", "h").alias("key")), "key")(F.xxhash64("doc_id", F.xxhash64("text")))
    docs = docs.filter(may_be_cut)  # few texts are read again, and only those move
    texts = docs.join(of_cut, docs["doc_id"].eqNullSafe(of_cut["i"]) & (F.xxhash64(docs["text"]) == of_cut["h"]), "left_semi").distinct()
    texts = texts.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), "text")

    @F.pandas_udf("long")
    def crc_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = _encoder(shared.value)
        for texts, starts, lengths in batches:
            yield pd.Series([_crc(np.append(encode(t), np.uint32(closing))[s : s + n]) for t, s, n in zip(texts, starts, lengths, strict=True)], dtype="int64")

    # repeated rows share a text: each of their pieces finds it
    cut = cut.join(texts, cut["doc_id"].eqNullSafe(texts["i"]) & (cut["text_hash"] == texts["h"]))
    cut = cut.withColumn("ids_crc32", crc_of("text", "start", "length"))
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    return whole.select(*result).unionByName(cut.select(*result))


def _power_at(at: int, total: int) -> int:
    """The power of two of `total` (the largest first) that holds place `at`."""
    low = 0
    while True:
        size = 1 << ((total - low).bit_length() - 1)
        if at < low + size:
            return size
        low += size


def _runs(patterns: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[int, tuple]:
    """By length: first ranks of the patterns that take it, pieces a sequence, first sequence, offset in it."""
    out: dict[int, list] = {}
    given: dict[int, int] = {}
    sequence = 0
    for lengths, pieces, times in patterns:
        offset = 0
        for n, k in zip(lengths.tolist(), pieces.tolist(), strict=True):
            out.setdefault(n, []).append((given.get(n, 0), k, sequence, offset))
            given[n] = given.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: tuple(np.array(column, np.int64) for column in zip(*rows, strict=True)) for n, rows in out.items()}
