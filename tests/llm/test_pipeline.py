"""The pipeline's stages on odd rows, and the whole against each stage's definition."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from portlens.llm import quality, simhash
from portlens.llm.common import stored

from .helpers import BLANK, ROWS, SCHEMA, lowered, words

INTERNAL = ["__lost", "__lost_id", "__lost_hash", "___lost", "__left", "__language", "__quality", "__id", "__hash", "f", "label", "key", "kept", "digest", "salt", "rest", "rank", "text_hash", "m", "c", "p", "i", "h", "s", "n", "page", "part", "member", "LANG_pred", "N_dropped"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("source", F.lit("web")).withColumn("n_chars", F.length("text"))
    return stored(rows.withColumns({c: F.lit(f"own {c}") for c in INTERNAL}).repartition(3), "test-docs")


def _texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def _key(line):
    k = lowered(line.strip(BLANK))
    return k if len(k) >= 40 else None


def _without_lines(rows):
    held: dict = {}
    for i, t in rows:
        for k in {_key(x) for x in (t or "").split("\n")} - {None}:
            held.setdefault(k, []).append(-1 if i is None else i)
    keep = lambda i, x: _key(x) is None or len(held[_key(x)]) < 5 or max(held[_key(x)]) == (-1 if i is None else i)
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t in rows]


def _fingerprint(t):
    w = words(lowered(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _one_of_each(rows):
    prints = {t: _fingerprint(t) for _, t in rows}
    group = {f: f for f in set(prints.values())}
    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 4:
                old, new = group[b], group[a]
                group = {f: new if g == old else g for f, g in group.items()}
    best: dict = {}
    for i, t in rows:
        g = group[prints[t]]
        order = (i is None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42))
        if g not in best or order[:2] < best[g][0][:2]:
            best[g] = (order, i)
    return sorted((i for _, i in best.values()), key=repr)


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_on_odd_rows(spark, docs, name):
    out = stored(STAGES[name](spark, docs, ""), "test-out")
    if name == "packing":
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ROWS]
        got = Counter()
        for r in out.collect():
            got[r["doc_id"]] += r["length"]
        want = Counter()
        for (i, _, _), n in zip(ROWS, lengths, strict=True):
            want[i] += n
        assert got == want
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    assert out.filter(" or ".join(f"`{c}` <> 'own {c}'" for c in INTERNAL)).count() == 0
    rows = [(i, t) for i, t, _ in ROWS]
    if name == "language_id":
        assert _texts(out) == sorted(((i, t) for i, t in rows if any(c.isalpha() for c in t or "")), key=repr)
    if name == "quality_rules":
        kept = {(r["doc_id"], r["kept"]) for r in quality.apply_policy(quality.ledger(docs)).collect()}
        assert {(i, True) for i, _ in _texts(out)} <= kept and all(len(words(t)) >= 10 for _, t in _texts(out))
    if name == "line_dedup":
        assert _texts(out) == sorted(_without_lines(rows), key=repr)
    if name == "simhash_near_dedup":
        assert [i for i, _ in _texts(out)] == _one_of_each(rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_on_an_empty_table(spark, docs, name):
    none = stored(docs.limit(0), "test-none")
    out = STAGES[name](spark, none, "")
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_rare_columns_are_not_needed(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).drop("source")
    assert STAGES["line_dedup"](spark, rows, "").columns == ["doc_id", "text", "lang"]


def test_the_whole_pipeline(spark):
    """run() on sf0.001: after each stage what its definition leaves, then every id of what is left in one piece."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    kept = {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).filter("kept").collect()}
    rows = _without_lines([(i, t) for i, t in rows if i in kept])
    staying = set(_one_of_each(rows))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in rows if i in staying}
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(ids)
    for i, cut in pieces.items():
        at = 0
        for start, length, crc in sorted(cut):
            assert start == at and crc == zlib.crc32(ids[i][start : start + length].tobytes())
            at += length
        assert at == len(ids[i])


def test_fingerprints_of_the_brute_force():
    for _, t, _ in ROWS[:9]:
        assert simhash.fingerprint(t, 4) == _fingerprint(t)
