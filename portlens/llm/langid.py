"""Language identification by a string kernel.

A text is the set of its character 1- to 3-grams (a blended spectrum of
presence, whole texts). The kernel of two texts is the number of shared grams
over the geometric mean of their numbers. A bounded sample of labelled rows
gives landmarks; kernel values to the landmarks, whitened by the landmarks' own
kernel (Nyström), are the features of one-versus-rest ridge regression. Scoring
folds both into one matrix: presence rows x landmark grams x weights, a batch
of texts at a time.

Characters are lower-cased and dealt to 64 classes: a to z, other letters by
code point, and one class for all else.

Null text, and text without a letter, is `und` with score 0. If no row can be
learned from, every text is. Each input row gives one row. A score is the
softmax share of the chosen language. Equal scores go to the language that
sorts first.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portlens.llm.common import doc_remainder, fresh_name, stored

PER_LANGUAGE = 400  # labelled rows to learn from, a language
ALL_ROWS = 25_600  # labelled rows of all languages: with more than 64 of them each has fewer; those beyond as many languages as rows, the rarest, are not learned
SHARE = 8  # times as many ids of a language are ranked to find them
LANDMARKS = 24  # of those, a language
ALL_LANDMARKS = 1024  # of all languages: where these are many, each has fewer landmarks, the rarest none of their own
MATRIX = 1 << 25  # landmark grams x landmarks at most: 128 MB
CHUNK = 2048  # rows whose features are held at once
RIDGE = 1e-2
SHARPNESS = 4.0
CLASSES = 64
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
BATCH = 256


def _class_table() -> np.ndarray:
    """Class of each code point below 65,536."""
    out = np.zeros(1 << 16, np.int32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 8) % (CLASSES - 27)
    return out


_tables: dict[str, np.ndarray] = {}


def grams(text: str) -> np.ndarray:
    """The sorted places of the grams of one text; none if it has no letter."""
    if "classes" not in _tables:
        _tables["classes"], _tables["flags"] = _class_table(), np.zeros(GRAMS, bool)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _tables["classes"][np.minimum(points, 0xFFFF)]
    if not c.any() and not any(x.isalpha() for x in text if x > "\uffff"):
        return np.empty(0, np.int64)
    flags = _tables["flags"]
    two = c[:-1] * CLASSES + c[1:]
    flags[c] = True
    flags[CLASSES + two] = True
    flags[CLASSES + CLASSES**2 + two[:-1] * CLASSES + c[2:]] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    columns: np.ndarray  # row of each gram in `shared`, -1 if no landmark has it
    shared: np.ndarray  # landmark grams x landmarks, over the root of each landmark's size
    weights: np.ndarray  # landmarks x languages

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of gram sets to the landmarks."""
        out = np.empty((len(sets), self.shared.shape[1]), np.float32)
        for i in range(0, len(sets), BATCH):
            part = sets[i : i + BATCH]
            there = np.zeros((len(part), len(self.shared)), np.float32)
            for k, s in enumerate(part):
                at = self.columns[s]
                there[k, at[at >= 0]] = 1
            size = np.sqrt([max(1, len(s)) for s in part])
            out[i : i + BATCH] = there @ self.shared / size[:, None]
        return out

    def shares(self, sets: list[np.ndarray]) -> np.ndarray:
        raw = SHARPNESS * (self.values(sets) @ self.weights)
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def learn(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, unpack: Callable[[bytes], np.ndarray] | None = None) -> Model | None:
    """A model from (language, gram set) rows, the first `landmarks` rows of each language as landmarks.

    Sets may come packed, with `unpack` to open them: those of a chunk are open at a time.
    """
    unpack = unpack or (lambda s: s)
    sizes = Counter(lang for lang, _ in rows)
    names = tuple(sorted(sizes))
    if not names:
        return None
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(names)))
    first: dict[str, list] = {name: [] for name in sorted(names, key=lambda n: (-sizes[n], n))[:ALL_LANDMARKS]}
    for lang, s in rows:
        if lang in first and len(first[lang]) < landmarks:
            first[lang].append(s)
    # the first landmark of each language, then the second: what the matrix has no room for is left out
    marks = [unpack(first[name][k]) for k in range(landmarks) for name in first if k < len(first[name])]
    marks = marks[: max(1, MATRIX // len(np.unique(np.concatenate(marks))))]
    known = np.unique(np.concatenate(marks))
    columns = np.full(GRAMS, -1, np.int32)
    columns[known] = np.arange(len(known))
    shared = np.zeros((len(known), len(marks)), np.float32)
    for j, s in enumerate(marks):
        shared[columns[s], j] = 1 / np.sqrt(len(s))
    bare = Model(names, columns, shared, np.zeros((len(marks), len(names)), np.float32))
    own, vectors = np.linalg.eigh(bare.values(marks).astype(np.float64))
    white = vectors * (1 / np.sqrt(np.maximum(own, 1e-6))) @ vectors.T
    place = {name: j for j, name in enumerate(names)}
    normal = RIDGE * len(rows) * np.eye(len(marks)) / len(names)
    wanted = np.zeros((len(marks), len(names)))
    for at in range(0, len(rows), CHUNK):
        part = rows[at : at + CHUNK]
        features = bare.values([unpack(s) for _, s in part]) @ white
        # a language counts as much as any other, however many rows it has
        share = np.array([1 / sizes[lang] for lang, _ in part])[:, None] * len(rows) / len(names)
        weighted = features * share
        normal += features.T @ weighted
        # targets are 1 for the row's language and -1 for the others
        of = np.array([place[lang] for lang, _ in part])
        wanted -= weighted.sum(axis=0)[:, None]
        for j in np.unique(of):
            wanted[:, j] += 2 * weighted[of == j].sum(axis=0)
    solved = np.linalg.solve(normal, wanted)
    return Model(names, columns, shared, (white @ solved).astype(np.float32))


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, all_rows: int = ALL_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from at most `per_language` rows of each language and `all_rows` in all.

    Rows with a text are chosen by a hash of their id. A repeated id counts once
    in a language, with the text of the smallest hash, so a rerun learns alike.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = d.filter(train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    every = stored(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")), "languages")
    languages = every.count()
    if languages > all_rows:
        every, languages = stored(every.orderBy(F.desc("ids"), "lang").limit(all_rows), "languages"), all_rows
    each = max(1, min(per_language, all_rows // max(1, languages)))
    # the first rows by hash lie in the first share of its range: only that share moves, however long the table
    place = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    some = usable.select("doc_id", "lang").join(F.broadcast(every), "lang")  # at most `all_rows` languages
    some = some.filter(place * F.col("ids") <= SHARE * each).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)
    ids = ids.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"))  # at most `all_rows`

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, lang, zlib.compress(np.packbits(np.bincount(g, minlength=GRAMS).astype(bool)).tobytes(), 1)) for i, lang, t in zip(b["doc_id"], b["lang"], b["text"], strict=True) if len(g := grams(t))]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "grams"])

    chosen = usable.join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")))
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("s")).select("doc_id", "lang", "s.text")
    found = chosen.mapInPandas(sets, "doc_id long, lang string, grams binary").collect()  # at most `all_rows`
    unpack = lambda raw: np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), count=GRAMS))
    found = sorted(found, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["grams"]))
    return learn([(r["lang"], r["grams"]) for r in found], unpack=unpack)


def predictions(docs: DataFrame, text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x landmarks x grams: bounded by the parameters

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            parts = [guessed(m, texts.iloc[i : i + BATCH].tolist()) for i in range(0, len(texts), BATCH)]
            yield pd.DataFrame([row for part in parts for row in part], columns=["lang_pred", "score"])

    def guessed(m: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
        """Gram sets of one batch at a time: those of a whole Arrow batch would be many times its text."""
        sets = [grams(t) if t else np.empty(0, np.int64) for t in texts]
        out = [("und", 0.0)] * len(sets)
        at = [i for i, s in enumerate(sets) if len(s)]
        if m is not None and at:
            share = m.shares([sets[i] for i in at])
            for i, row, best in zip(at, share, share.argmax(axis=1).tolist(), strict=True):
                out[i] = m.languages[best], float(min(1.0, row[best]))
        return out

    return predicted(text)


def train_rows(id_col: str = "doc_id") -> Column:
    """Whether a row may be learned from: crc32 of its id as text isn't 2 modulo 4."""
    return doc_remainder(F.col(id_col), 4) != 2


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = docs.select(F.col(id_col).alias("doc_id"), (~train_rows(id_col)).alias("held_out"), predictions(docs, F.col(text_col), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model | None, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text has a language, with the columns of `docs`."""
    name = fresh_name(docs, "language")
    rows = docs.withColumn(name, predictions(docs, F.col(text_col), model))
    return rows.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= min_score)).drop(name)
