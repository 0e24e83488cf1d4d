"""Language-model scores by deleted interpolation of word n-grams (bigrams).

P(w | v) = a_k c(v, w) / c(v) + b_k c(w) / N + d_k / (V + 1), where k is the
bucket of the context's frequency c(v), by powers of two. The weights a, b, d
of each bucket are learned by expectation-maximisation on held-out counts: the
training documents of a fixed eighth, each with its own counts deleted.

Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. A
text's first word has the start of the text as its context.

How it runs: documents are cut into blocks of about BLOCK tokens. A block counts
its own n-grams first and sends each different one once, as a 64-bit hash, to
the bucket of that hash, together with its training count. A bucket sums what
the blocks sent and answers each block in the order in which it asked. The
blocks then score their documents from the answers. So what is shuffled grows
with the different n-grams of a block, and a word that is everywhere is one
entry a block.

With more than FAN blocks the buckets are asked in levels: FAN blocks form a
unit, whose buckets are summed first and ask FAN finer buckets each, and so on;
the answers take the same way back. So a block, or unit, sends FAN rows of some
thousand n-grams whatever the number of blocks, rows grow in proportion to the
blocks, and no task holds more than a block or FAN rows of a bucket. Words are
told apart by 64 bits, bigrams by the first buckets' bits and 48 more.

Null text counts as empty (one token, the end). Each input row gives one row,
repeated rows too. With nothing to learn from every token has probability 1 by
the base and the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import doc_remainder, stored

BLOCK = 1_000_000  # tokens of a block, about
FAN = 256  # blocks of a unit, and buckets that each asks
SLICE = 8  # one in so many training documents gives the held-out counts; all do if none is in the slice
LEVELS = 64  # buckets of context frequency
END, START = b"\n", b"\n\n"  # no words
FINE = 8  # cells a factor of e in the held-out table
ROUNDS = 60

ASKED = "block long, n int, bucket long, keys binary, counts binary"
ANSWERED = "block long, n int, bucket long, totals binary, types long, tokens long"
BLOCK_COLUMNS = "block long, held_out_part boolean, doc_ids binary, known_id binary, held binary, lengths binary, words binary, tokens binary"


def _squeezed(x: np.ndarray) -> bytes:
    """An array as compressed bytes, the bytes of one significance together: sorted keys and small counts shrink."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _loose(raw: bytes, kind: str, width: int | None = None) -> np.ndarray:
    """The array of `_squeezed`; with a smaller `width` its elements get zero bytes on top."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width or size, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Blocks:
    """Gathers documents until a block is full."""

    def __init__(self, part: bool):
        self.part = part
        self.clear()

    def clear(self) -> None:
        self.ids, self.known, self.held, self.lengths, self.tokens, self.words, self.n = [], [], [], [], [], _Ids(), 0
        self.end = self.words[END]

    def add(self, doc_id, held: bool, text: str | None) -> None:
        words = text.encode().lower().split() if text else []
        tokens = list(map(self.words.__getitem__, words))
        tokens.append(self.end)
        self.tokens.append(np.array(tokens, np.int32))
        self.known.append(not pd.isna(doc_id))
        self.ids.append(0 if pd.isna(doc_id) else int(doc_id))
        self.held.append(held)
        self.lengths.append(len(tokens))
        self.n += len(tokens)

    def row(self, block: int) -> tuple:
        words = np.array([xxhash.xxh64_intdigest(w) for w in self.words], "<u8")
        raw = lambda x, kind: np.array(x, kind).tobytes()
        return block, self.part, raw(self.ids, "<i8"), raw(self.known, bool), raw(self.held, bool), raw(self.lengths, "<i8"), words.tobytes(), _squeezed(np.concatenate(self.tokens).astype("<i4"))


def _blocks(docs: DataFrame, divisor: int, held_remainder: int, block_tokens: int) -> DataFrame:
    """Rows of BLOCK_COLUMNS; the held-out eighth of the training documents has blocks of its own."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n = TaskContext.get().partitionId() << 32, 0
        open_ = {part: _Blocks(part) for part in (False, True)}
        for batch in batches:
            for doc_id, held, part, text in zip(batch["doc_id"].tolist(), batch["held"].tolist(), batch["part"].tolist(), batch["text"], strict=True):
                b = open_[part]
                b.add(doc_id, held, text)
                if b.n >= block_tokens:
                    yield pd.DataFrame([b.row(first + n)], columns=names)
                    n += 1
                    b.clear()
        for b in open_.values():
            if b.n:
                yield pd.DataFrame([b.row(first + n)], columns=names)
                n += 1

    names = [c.split()[0] for c in BLOCK_COLUMNS.split(", ")]
    held = doc_remainder(F.col("doc_id"), divisor) == held_remainder
    part = ~held & (F.pmod(F.xxhash64(F.col("doc_id")), F.lit(SLICE)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), part.alias("part"), "text")
    return rows.mapInPandas(gather, BLOCK_COLUMNS)


class _Block:
    """A block's tokens with its different n-grams in the order of their hashes."""

    def __init__(self, row):
        take = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known, self.held, self.lengths = take("doc_ids", "<i8"), take("known_id", bool), take("held", bool), take("lengths", "<i8")
        words, self.tokens = take("words", "<u8"), _loose(row["tokens"], "<i4")
        self.start = len(words)
        before = np.concatenate(([self.start], self.tokens[:-1]))
        before[np.cumsum(self.lengths)[:-1]] = self.start
        self.before = before.astype(np.int64)
        self.learn = np.repeat(~self.held, self.lengths)
        every = np.append(words, np.uint64(xxhash.xxh64_intdigest(START)))
        code, self.pair_at = np.unique(self.before * (self.start + 1) + self.tokens, return_inverse=True)
        left, right = every[code // (self.start + 1)], every[code % (self.start + 1)]
        mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x7F4A7C159E3779B9) + (left >> np.uint64(7)))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.hashes = {1: every, 2: mixed ^ (mixed >> np.uint64(31))}
        self.order = {n: np.argsort(h, kind="stable") for n, h in self.hashes.items()}

    def counts(self) -> dict[int, np.ndarray]:
        """Training counts by n-gram; the start of the text counts as a context, not as a token."""
        one = np.bincount(self.tokens[self.learn], minlength=self.start + 1)
        one[self.start] = np.count_nonzero(~self.held)
        return {1: one, 2: np.bincount(self.pair_at[self.learn], minlength=len(self.hashes[2]))}


def _ask(blocks: DataFrame, bits: int) -> DataFrame:
    """(block, n, bucket, keys, counts): a block's n-grams by bucket."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                b = _Block(row)
                for n, count in b.counts().items():
                    order = b.order[n]
                    out = _rows_of(row["block"], n, b.hashes[n][order], count[order].astype("<u4"), bits)
                    yield pd.DataFrame(out, columns=["block", "n", "bucket", "keys", "counts"])

    return blocks.mapInPandas(asked, ASKED)


def _pack(keys: np.ndarray, n: int, bits: int) -> bytes:
    """Words whole; of bigrams the 48 bits below the bucket's."""
    if n == 1:
        return _squeezed(keys)
    low = (keys << np.uint64(bits)) >> np.uint64(16)
    return _squeezed(np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]))


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return _loose(raw, "<u8", 8 if n == 1 else 6)


def _whole(raw: bytes, n: int, bucket: int, bits: int) -> np.ndarray:
    """The keys of `_pack` with the bucket's bits, in order."""
    keys = _unpack(raw, n)
    if n == 1 or not bits:
        return keys if n == 1 else keys << np.uint64(16)
    return np.uint64(bucket << (64 - bits)) | ((keys << np.uint64(16)) >> np.uint64(bits))


def _rows_of(unit: int, n: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """Sorted keys and their counts by bucket."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    parts = zip(np.split(keys, cut), np.split(counts, cut), bucket[np.concatenate(([0], cut))].tolist(), strict=True)
    return [(unit, n, b, _pack(k, n, bits), _squeezed(c)) for k, c, b in parts if len(k)]


def _answers(asked: DataFrame, units: int, bits: int, kind: str, fan: int) -> DataFrame:
    """(block, n, bucket, totals, types, tokens) for `asked` of so many blocks or units, whose counts are of `kind`."""
    if units <= fan:
        return _answer(asked, kind)
    asked = stored(asked, "lm-asked")
    width, finer = -(-units // fan), bits + fan.bit_length() - 1
    parent = F.pmod(F.xxhash64("block"), F.lit(width)).alias("unit")

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        unit, n, bucket = map(int, key)
        every, at = np.unique(np.concatenate([_whole(k, n, bucket, bits) for k in group["keys"]]), return_inverse=True)
        counts = np.concatenate([_loose(c, kind) for c in group["counts"]])
        total = np.bincount(at, weights=counts, minlength=len(every)).astype("<u8")
        return pd.DataFrame(_rows_of(unit, n, every, total, finer), columns=["block", "n", "bucket", "keys", "counts"])

    of_units = asked.groupBy(parent, "n", "bucket").applyInPandas(merged, ASKED)
    answered = _answers(of_units, width, finer, "<u8", fan)

    def returned(key: tuple, group: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        _, n, bucket = map(int, key)
        keys = [_whole(k, n, bucket, bits) for k in group["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.concatenate([_loose(t, "<i8") for t in got.sort_values("bucket")["totals"]])
        if len(total) != len(every):
            raise ValueError("a unit got answers that it didn't ask for")
        parts = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        none = [0] * (len(keys) - 1)
        return pd.DataFrame({"block": group["block"], "n": n, "bucket": bucket, "totals": [_squeezed(p) for p in parts], "types": [int(got["types"].sum())] + none, "tokens": [int(got["tokens"].sum())] + none})

    up = F.shiftrightunsigned("bucket", fan.bit_length() - 1).alias("bucket")
    answered = answered.select(F.col("block").alias("unit"), "n", up, F.col("bucket").alias("finer"), "totals", "types", "tokens")
    both = asked.withColumn("unit", parent).groupBy("unit", "n", "bucket").cogroup(answered.groupBy("unit", "n", "bucket"))
    return both.applyInPandas(lambda key, group, got: returned(key, group, got.drop(columns="bucket").rename(columns={"finer": "bucket"})), ANSWERED)


def _answer(asked: DataFrame, kind: str = "<u4") -> DataFrame:
    """(block, n, bucket, totals, types, tokens): the sums of a bucket, in the order of each block's keys.

    types and tokens (of words, on one row a bucket) are those of the training tokens.
    """

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].iloc[0])
        keys = [_unpack(k, n) for k in group["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_loose(c, kind) for c in group["counts"]]), minlength=len(every)).astype("<i8")
        if n == 1:
            token = every != np.uint64(xxhash.xxh64_intdigest(START))
            types, tokens = int(np.count_nonzero(total[token])), int(total[token].sum())
        else:
            types = tokens = 0
        parts = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"block": group["block"], "n": n, "bucket": group["bucket"], "totals": [_squeezed(p) for p in parts], "types": [types] + [0] * (len(keys) - 1), "tokens": [tokens] + [0] * (len(keys) - 1)})

    return asked.groupBy("n", "bucket").applyInPandas(summed, ANSWERED)


def _totals(b: _Block, answers: pd.DataFrame) -> dict[int, np.ndarray]:
    """Corpus counts by the block's own n-grams."""
    out = {}
    for n, order in b.order.items():
        part = answers[answers["n"] == n].sort_values("bucket")
        got = np.concatenate([_loose(t, "<i8") for t in part["totals"]]) if len(part) else np.empty(0, np.int64)
        if len(got) != len(order):
            raise ValueError("a block got answers that it didn't ask for")
        out[n] = np.empty(len(order), np.int64)
        out[n][order] = got
    return out


def _level(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two of its count."""
    return np.where(context > 0, np.minimum(LEVELS - 1, np.log2(np.maximum(context, 1)).astype(np.int64) + 1), 0)


def _held_out_cells(blocks: DataFrame, answers: DataFrame, tokens: int, types: int) -> DataFrame:
    """(level, two, one, n): held-out tokens by context level and the logs of both estimates, in steps of 1 / FINE."""

    def cells(_, block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=["level", "two", "one", "n"], dtype="int64")
        if not len(block):
            return out
        b = _Block(block.iloc[0])
        total = _totals(b, got)
        doc = np.repeat(np.arange(len(b.lengths)), b.lengths)

        def own(place: np.ndarray, size: int) -> np.ndarray:
            """How often each token's n-gram is in its own document."""
            _, at, n = np.unique(doc * size + place, return_inverse=True, return_counts=True)
            return n[at]

        two = total[2][b.pair_at] - own(b.pair_at, len(total[2]))
        context = total[1][b.before] - np.where(b.before == b.start, 1, own(b.before, b.start + 1))
        one = total[1][b.tokens] - own(b.tokens, b.start + 1)
        # the document's own tokens leave N as well; N is far larger than a document
        p2 = np.where((two > 0) & (context > 0), two / np.maximum(context, 1), 0)
        p1 = np.maximum(one, 0) / max(tokens, 1)
        code = lambda p: np.where(p > 0, np.round(np.log(np.maximum(p, 1e-300)) * FINE), 1).astype(np.int64)
        table = pd.DataFrame({"level": _level(context), "two": code(p2), "one": code(p1)})[b.learn]
        return table.groupby(["level", "two", "one"]).size().reset_index(name="n")

    cells_of = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    found = cells_of.applyInPandas(cells, "level long, two long, one long, n long")
    return found.groupBy("level", "two", "one").agg(F.sum("n").alias("n"))


def learn_weights(cells: pd.DataFrame, types: int) -> np.ndarray:
    """LEVELS x 3 weights (bigram, word, uniform) by expectation-maximisation, each level's sum 1.

    A level starts from, and leans by PRIOR tokens on, the weights of all levels together.
    """
    value = lambda c: np.where(c > 0, 0.0, np.exp(np.minimum(c, 0) / FINE))
    p = np.column_stack([value(cells["two"].to_numpy()), value(cells["one"].to_numpy()), np.full(len(cells), 1 / (types + 1))])
    n, level = cells["n"].to_numpy().astype(float), cells["level"].to_numpy()
    prior = np.array([0.3, 0.6, 0.1])

    def fitted(p: np.ndarray, n: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
        w = prior
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) + strength * prior
            w = new / new.sum()
        return w

    every = fitted(p, n, prior, 3.0)
    out = np.tile(every, (LEVELS, 1))
    for k in range(LEVELS):
        at = level == k
        if at.any():
            out[k] = fitted(p[at], n[at], every, 3.0)
    out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def score(docs: DataFrame, divisor: int = 7, held_remainder: int = 2, block_tokens: int = BLOCK, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The training rows are those whose crc32 of the id as text isn't
    `held_remainder` modulo `divisor`. base_score is the add-one word model.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(_blocks(docs, divisor, held_remainder, block_tokens), "lm-blocks")
    number = blocks.count()
    bits = max(0, min(number, fan).bit_length() - 1)
    answers = stored(_answers(_ask(blocks, bits), number, bits, "<u4", fan), "lm-counts")
    size = answers.filter("n = 1").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(size[0] or 0), int(size[1] or 0)
    part = blocks.filter("held_out_part")
    of_part = answers.join(part.select("block"), "block", "left_semi")
    cells = _held_out_cells(part, of_part, tokens, types).toPandas()  # bounded by the steps of the logs
    if not len(cells):
        cells = _held_out_cells(blocks, answers, tokens, types).toPandas()
    weights = learn_weights(cells, types) if len(cells) else np.tile([0.3, 0.6, 0.1], (LEVELS, 1))

    def scored(_, block: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(block):
            return pd.DataFrame(columns=names)
        b = _Block(block.iloc[0])
        total = _totals(b, got)
        one = total[1][b.tokens]
        context, two = total[1][b.before], total[2][b.pair_at]
        w = weights[_level(context)]
        p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(tokens, 1) + w[:, 2] / (types + 1)
        if not tokens:
            p = np.ones(len(b.tokens))
        base = np.log10((one + 1) / (tokens + types + 1))
        starts = np.cumsum(b.lengths) - b.lengths
        by_doc = lambda x: np.add.reduceat(x, starts)
        ids = pd.array(b.ids, dtype="Int64")
        ids[~b.known] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": b.held, "n_tokens": b.lengths, "n_known": by_doc((one > 0).astype(np.int64)), "base_score": by_doc(base), "score": by_doc(np.log10(p))})

    rows = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    out = rows.applyInPandas(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
