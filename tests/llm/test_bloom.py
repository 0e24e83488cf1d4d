"""The filters: bits by brute force, levels of bounded groups, membership."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from portlens.llm import bloom


def test_once_and_twice_bits(spark, monkeypatch):
    monkeypatch.setattr(bloom, "FAN", 2)
    bits, rng = 2 * bloom.PAGE, np.random.default_rng(1)
    groups = [sorted(set(rng.integers(0, 5000, 40).tolist()) | set(rng.integers(bloom.PAGE, bits, 3).tolist())) for _ in range(60)]

    def gathered(batches):
        for b in batches:
            for part in (b.iloc[:2], b.iloc[2:]):  # several rows a task
                yield from (f.assign(part=f["part"] + (1 << 20) * len(part)) for f in bloom.bitmaps(np.array(g, np.int64) for g in part["g"]))

    rows = spark.createDataFrame([(g,) for g in groups], "g array<long>").repartition(7)
    pages = bloom.joined(rows.mapInPandas(gathered, bloom.PARTS)).persist()
    assert pages.count() == 2
    times = np.bincount(np.concatenate(groups), minlength=bits)
    for column, least in (("once", 1), ("twice", 2)):
        got = np.unpackbits(bloom.load(pages, column, bits), bitorder="little")
        assert (got.astype(bool) == (times >= least)).all()
    pages.unpersist()


def test_flushes_give_the_same_bits(spark, monkeypatch):
    groups = [np.array([i, i + 1, 7]) for i in range(50)]

    class Context:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(bloom.TaskContext, "get", staticmethod(lambda: Context))
    monkeypatch.setattr(bloom, "FLUSH", 10)
    parts = pd.concat(bloom.bitmaps(iter(groups)))
    assert parts["part"].is_unique and len(parts) > 10
    one = bloom._joined(parts)
    times = np.bincount(np.concatenate(groups), minlength=bloom.PAGE)
    got = np.unpackbits(bloom._loose(one["twice"][0]), bitorder="little")
    assert (got.astype(bool) == (times >= 2)).all()


def test_member_filter(spark):
    keys = spark.range(0, 5000).select((F.xxhash64("id")).alias("key"))
    member = bloom.member_filter(keys, "key")
    got = spark.range(0, 50_000).select("id", member(F.xxhash64("id")).alias("in")).groupBy((F.col("id") < 5000).alias("true"), "in").count().collect()
    counts = {(r["true"], r["in"]): r["count"] for r in got}
    assert counts[True, True] == 5000 and (True, False) not in counts and counts.get((False, True), 0) < 500
    none = bloom.member_filter(keys.limit(0), "key")
    assert spark.range(10).filter(none(F.xxhash64("id"))).count() == 0
