"""Language ID and toxicity by brute force, on held-out rows, and with repeated ids; copyright clauses of any length."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlens.llm import langid, licenses, toxicity

SF = "/root/testdata/sf0.1"


# ------------------------------------------------------------- language ID


def _character(c):
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 8) % 37


def _gram_set(text):
    c = [_character(x) for x in text]
    return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)} if any(c) else set()


def _kernel(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_grams_are_the_presence_of_one_to_three():
    for text in ("Hello, wörld", "a", "ab", "  x ", "123", "", "été ÉTÉ", "\U0001d400bc"):
        if text:
            got = langid.grams(text)
            assert len(got) == len(_gram_set(text)) or text.startswith("\U0001d400")
    assert not len(langid.grams("123 !!"))


def test_model_is_nystrom_ridge_on_the_kernel():
    rng = np.random.default_rng(3)
    words = {lang: ["".join(rng.choice(list(letters), 4)) for _ in range(20)] for lang, letters in (("x", "abcdefg"), ("y", "defghij"), ("z", "hijklmn"))}
    rows = [(lang, " ".join(rng.choice(words[lang], 6))) for lang in "xyz" for _ in range(9 if lang != "z" else 5)]
    rng.shuffle(rows)
    model = langid.learn([(lang, langid.grams(t)) for lang, t in rows], landmarks=4)
    names, n = "xyz", len(rows)
    marks = [_gram_set([t for lang, t in rows if lang == name][k]) for k in range(4) for name in names]
    sets = [_gram_set(t) for _, t in rows]
    own = np.array([[_kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = np.array([[_kernel(s, m) for m in marks] for s in sets]) @ white
    count = {name: sum(lang == name for lang, _ in rows) for name in names}
    share = np.diag([n / 3 / count[lang] for lang, _ in rows])
    wanted = np.array([[1.0 if lang == name else -1.0 for name in names] for lang, _ in rows])
    solved = np.linalg.solve(features.T @ share @ features + langid.RIDGE * n / 3 * np.eye(len(marks)), features.T @ share @ wanted)
    raw = langid.SHARPNESS * (features @ solved)
    expected = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
    assert model.languages == ("x", "y", "z")
    assert model.shares([langid.grams(t) for _, t in rows]) == pytest.approx(expected, abs=2e-3)


def test_repeated_ids_and_null_texts_take_no_places(spark):
    english = ["the cat sat on the mat and the dog ran", "this is a text that has some words in it", "they were there with other people then"]
    german = ["der hund lief über die straße und bellte", "das ist ein text mit einigen wörtern darin", "sie waren dort mit anderen leuten dann"]
    rows = [(i, t, "en") for i, t in enumerate(english * 4)] + [(100 + i, t, "de") for i, t in enumerate(german * 4)]
    noise = [(k, t, "en") for k in (0, 1) for t in ["zzz qqq xxx"] * 50] + [(1000 + k, None, "de") for k in range(500)]
    plain = spark.createDataFrame(rows + noise, "doc_id long, text string, lang string")
    one, two = (langid.fit(plain.repartition(n), F.lit(True), per_language=6) for n in (1, 7))
    assert (one.weights == two.weights).all() and (one.shared == two.shared).all()
    got = langid.identify(spark.createDataFrame(rows, plain.schema), one).collect()
    want = {i: lang for i, _, lang in rows}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.9


def test_rows_and_landmarks_are_bounded_in_all(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(100 * k + i, " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(6)), f"l{k:02}") for k in range(30) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "ALL_LANDMARKS", 20)
    monkeypatch.setattr(langid, "MATRIX", 20_000)
    seen = []
    learn = langid.learn
    monkeypatch.setattr(langid, "learn", lambda found, **more: seen.append(len(found)) or learn(found, **more))
    model = langid.fit(table, F.lit(True), all_rows=60)
    assert seen == [60] and len(model.languages) == 30
    assert model.shared.shape[1] <= 20 and model.shared.size <= 20_000
    langid.fit(table, F.lit(True), all_rows=10)
    assert seen == [60, 10]


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs, langid.train_rows())).filter("held_out and lang_pred <> 'und'")
    right = got.join(docs.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).filter("lang is not null")
    assert right.filter("lang = lang_pred").count() >= 0.98 * right.count() > 0


# ----------------------------------------------------------------- toxicity


def _clause(read):
    """By the definition: the nearest target on either side, then negation and report before the word."""
    total = 0.0
    for i, (symbol, weight) in enumerate(read):
        if not weight:
            continue
        near = lambda trigger, reach, before: any(s == trigger for s, _ in (read[max(0, i - reach) : i] if before else read[i + 1 : i + 1 + reach]))  # noqa: E731, B023
        reach = 4 if symbol == toxicity.INSULT else 6
        there = near(toxicity.TARGET, reach, True) or near(toxicity.TARGET, reach, False)
        factor = (1.5 if there else 1.0) if symbol == toxicity.INSULT else (1.0 if there else 0.25)
        factor *= 0.4 if near(toxicity.NEGATION, 3, True) else 1.0
        factor *= 0.6 if near(toxicity.REPORT, 12, True) else 1.0
        total += weight * factor
    return total


def test_clauses_by_brute_force():
    rng, grammar = np.random.default_rng(5), toxicity.Grammar({})
    weights = {toxicity.INSULT: 2.5, toxicity.THREAT: toxicity.THREAT_WEIGHT}
    for _ in range(500):
        read = [(int(s), weights.get(int(s), 0.0)) for s in rng.integers(0, toxicity.SYMBOLS, int(rng.integers(0, 25)))]
        assert grammar.clause(read) == pytest.approx(_clause(read))


def test_features_by_brute_force():
    grammar = toxicity.Grammar({"grob": 3.0, "zil*": 2.0})
    total, most, words, share = grammar.features("You are a grob, not me. Fine day! She said zilfop; nothing here\nno zilch")
    clauses = [3.0 * 1.5, 2.0 * 0.6 * 1.5, 2.0 * 0.4]
    assert (total, most) == pytest.approx((np.log1p(sum(clauses)), clauses[0]))
    assert words == pytest.approx(np.log1p(3)) and share == pytest.approx(np.log1p(100 * 3 / 5))


def test_threats_and_later_negations():
    grammar = toxicity.Grammar({"grob": 3.0})
    for text in ("I will poison you and your family", "Je vais vous étrangler", "Ich werde dich ermorden", "voy a matar a ellos"):
        assert grammar.features(text)[1] >= toxicity.THREAT_WEIGHT
    assert grammar.features("a grob you are and not me")[1] == grammar.features("a grob you are")[1] == 4.5
    assert grammar.features("the fire will destroy the forest")[1] == 0.25 * toxicity.THREAT_WEIGHT


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "clean"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels, F.lit(True)).count() == 2


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out")
    known = got.join(labels.select(F.col("doc_id").alias("i"), "toxic"), F.col("doc_id") == F.col("i")).groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in known}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * (n[0, 0] + n.get((0, 1), 0))


# ----------------------------------------------------------------- licences


def test_copyright_clauses_of_any_length(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and t.startswith("Permission"))
    holders = ", ".join(f"Holder Number {i}" for i in range(400))
    texts = [f"MIT License Copyright (c) 2020 {holders} {mit}", f"Copyright (c) 2020 {holders}. All rights reserved. {mit}", "(c) 2020. " * 40_000, "copyright (c) 2020 x " * 20_000 + mit, "a relicensed\x01thing (c) 2020"]
    began = time.time()
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == ["MIT", "MIT", None, "MIT", None]
    assert time.time() - began < 120
