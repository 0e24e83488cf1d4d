"""Deleted interpolation against a plain reading of its definition, and the levels of the exchange."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from portlens.llm import lm

from .helpers import ROWS, SCHEMA, lowered, words

START = object()


def _tokens(text):
    return [*words(lowered(text or "")), "\n"]


def _held(i, divisor=7, remainder=2):
    return zlib.crc32(b"" if i is None else str(i).encode()) % divisor == remainder


def _scores(rows, in_slice):
    """Score of each row; the weights come from `learn_weights` over cells that are counted here."""
    docs = [_tokens(t) for _, t, _ in rows]
    train = [d for (i, _, _), d in zip(rows, docs, strict=True) if not _held(i)]
    one, two = Counter(), Counter()
    for d in train:
        one.update([START, *d])
        two.update(zip([START, *d], d, strict=False))
    total, types = sum(n for w, n in one.items() if w is not START), len(one) - 1
    level = lambda n: int(math.log2(n)) + 1 if n > 0 else 0
    code = lambda p: round(math.log(p) * lm.FINE) if p > 0 else 1
    chosen = [(i, d) for (i, _, _), d in zip(rows, docs, strict=True) if not _held(i) and in_slice(i)]
    if not chosen:
        chosen = [(i, d) for (i, _, _), d in zip(rows, docs, strict=True) if not _held(i)]
    cells = Counter()
    for _, d in chosen:
        own, pairs = Counter([START, *d]), Counter(zip([START, *d], d, strict=False))
        for v, w in zip([START, *d], d, strict=False):
            context = one[v] - own[v]
            p2 = (two[v, w] - pairs[v, w]) / context if context > 0 else 0
            cells[level(context), code(p2), code((one[w] - own[w]) / total)] += 1
    table = pd.DataFrame([(*c, n) for c, n in cells.items()], columns=["level", "two", "one", "n"])
    weights = lm.learn_weights(table, types)
    out = []
    for (i, _, _), d in zip(rows, docs, strict=True):
        p = 0.0
        for v, w in zip([START, *d], d, strict=False):
            a, b, c = weights[level(one[v])]
            p += math.log10((a * two[v, w] / one[v] if one[v] else 0) + b * one[w] / total + c / (types + 1))
        out.append((i, len(d), p))
    return sorted(out, key=repr)


def _slice(spark, rows):
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "i long").select("i", (F.pmod(F.xxhash64("i"), F.lit(lm.SLICE)) == 0).alias("in"))
    return {r["i"]: r["in"] for r in ids.collect()}


def _got(rows):
    return sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("extra", [True, False])
def test_scores(spark, extra):
    rng = np.random.default_rng(1)
    rows = list(ROWS)
    if not extra:
        rows = [r for r in ROWS if not _slice(spark, ROWS)[r[0]] and len(r[1] or "") < 200][:8]
    if extra:
        rows += [(100 + k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60) % 50), "en") for k in range(60)]
    chosen = _slice(spark, rows)
    assert any(chosen[i] and not _held(i) for i, _, _ in rows) is extra and not all(_held(i) for i, _, _ in rows)
    expected = _scores(rows, chosen.get)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for block, fan in ((1_000_000, lm.FAN), (300, lm.FAN), (40, 4), (40, 2)):
        got = _got(lm.score(docs, block_tokens=block, fan=fan))
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], rel=1e-9)


def test_rows_sent_grow_in_proportion_to_the_blocks(spark):
    """Ten times the blocks send ten times the rows, once there are more than a unit's."""
    per_block = []
    for blocks in (20, 200):
        docs = spark.range(blocks).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: F.concat(F.lit("w"), (x * F.col("id") % 97).cast("string"))), " ").alias("text"))
        made = lm._blocks(docs.repartition(4), 7, 2, 10)
        n = made.count()
        per_block.append(lm._ask(made, 2).count() / n)
    assert per_block[1] <= 1.2 * per_block[0] and per_block[1] <= 2 * 4


def test_keys_survive_packing_at_every_level():
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 5000, np.uint64))
    for n in (1, 2):
        for bits in (0, 1, 8, 16, 24):
            rows = lm._rows_of(7, n, keys, np.ones(len(keys), "<u4"), bits)
            back = np.concatenate([lm._whole(k, n, b, bits) for _, _, b, k, _ in rows])
            kept = min(64, bits + 48) if n == 2 else 64
            assert (back >> np.uint64(64 - kept) == keys >> np.uint64(64 - kept)).all()
            assert [b for _, _, b, _, _ in rows] == sorted({int(k) >> (64 - bits) if bits else 0 for k in keys.tolist()})


def test_word_hash_is_the_one_that_starts_exclude():
    assert xxhash.xxh64_intdigest(lm.START) != xxhash.xxh64_intdigest(lm.END)
