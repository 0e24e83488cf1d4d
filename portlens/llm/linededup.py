"""Line dedup with two Bloom filters.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` with A-Z lower-cased. A key
of at least `min_chars` code points that is found in at least `min_docs`
documents loses all its lines except those in the document with the largest id.

1. Each task hashes the keys of its documents. A key's bits go to the filter
   "once"; where a bit is met again by another document or another task it
   goes to "twice". Bits travel as packed pages, joined in levels (`bloom.py`),
   so a key that a third of the documents share is one place a task.
2. A key whose bits are all in "twice" is a suspect. Only suspects leave their
   task, as 256-bit digests, for the exact count and the choice of the
   document that keeps the line.
3. Documents that lose lines are shuffled to the digests they lose; the others,
   told apart by a filter of (id, text hash), pass as they are read.

"twice" is the one thing sent to every task. Its size follows the number of
lines up to MAX_BITS (128 MB); beyond that more lines are suspects, and the
exact count, a shuffle, takes them: the result is the same at every size.

Each row is a document, repeated rows and ids too: a row counts once for its
key, and rows that share the largest id all keep the line. Null ids count, and
are below every other. Null or empty text is one empty line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portlens.llm import bloom
from portlens.llm.common import BLANK, fresh_name, stored

BITS_A_LINE = 16
MAX_BITS = 1 << 30


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is too short to count."""
    key = line.strip(BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()


def text_keys(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of one whole text."""
    if not text or len(text) < min_chars:
        return []
    return [k for k in dict.fromkeys(line_key(x, min_chars) for x in text.encode().split(b"\n")) if k is not None]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_128_intdigest(k) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)


def filter_bits(docs: DataFrame, text_col: str) -> int:
    """A power of two by the number of lines."""
    t = F.col(text_col)
    lines = docs.agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return bloom.filter_size(lines, BITS_A_LINE, MAX_BITS)


def twice_filter(docs: DataFrame, bits: int, min_chars: int, text_col: str) -> DataFrame:
    """The pages of the filter (`bloom.PARTS`); a document's key counts once."""

    def once_and_twice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (text_keys(t, min_chars) for batch in batches for t in batch["t"])
        yield from bloom.bitmaps(np.unique(bloom.places(_hashes(k), bits)) for k in keys if k)

    return bloom.joined(docs.select(F.col(text_col).alias("t")).mapInPandas(once_and_twice, bloom.PARTS))


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def suspects(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, digest): one row for each document and suspected key."""
    spark = docs.sparkSession
    bits = filter_bits(docs, text_col)
    pages = twice_filter(docs, bits, min_chars, text_col)
    shared = spark.sparkContext.broadcast(bloom.load(pages, "twice", bits))  # at most MAX_BITS

    @F.pandas_udf("array<binary>")
    def suspected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        twice = shared.value
        for texts in batches:
            out = []
            for t in texts:
                keys = text_keys(t, min_chars)
                if keys:
                    seen = bloom.holds(twice, bloom.places(_hashes(keys), bits))
                    out.append([_digest(k) for k, s in zip(keys, seen.tolist(), strict=True) if s])
                else:
                    out.append([])
            yield pd.Series(out, dtype=object)

    t = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("text_hash"), suspected(t).alias("digests"))
    return rows.select("doc_id", "text_hash", F.explode("digests").alias("digest"))


def drops(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, digests): the keys whose lines a document loses, one row for such a document."""
    found = stored(suspects(docs, min_chars, id_col, text_col), "suspects")
    counted = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    # stored, so that the join reads a plain table: small ones are broadcast by their
    # measured size, else a digest that many documents share is a skewed partition that splits
    counted = stored(counted.filter(F.col("n") >= min_docs).select("digest", "keeper"), "repeated")
    lost = found.join(counted, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("digest").alias("digests"))


def without(text: Column, digests: Column, min_chars: int) -> Column:
    """struct(n_dropped, kept) of a text and the digests it loses."""

    @F.pandas_udf("n_dropped long, kept string")
    def left(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lost in batches:
            rows = []
            for t, gone in zip(texts, lost, strict=True):
                if gone is None or not len(gone):
                    rows.append((0, t or ""))
                    continue
                gone = set(map(bytes, gone))
                lines = (t or "").encode().split(b"\n")
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in gone]
                rows.append((len(lines) - len(kept), b"\n".join(kept).decode()))
            yield pd.DataFrame(rows, columns=["n_dropped", "kept"])

    return left(text, digests)


def _with_left(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """`docs` with a struct column (n_dropped, kept), and that column's name.

    Only documents that a filter on (id, text hash) takes for ones that lose
    lines are shuffled; the others pass where they are read.
    """
    name, lost_id, lost_hash, gone = (fresh_name(docs, stem) for stem in ("left", "lost_id", "lost_hash", "lost"))
    lost = stored(drops(docs, min_chars, min_docs, id_col, text_col), "lost")
    text_hash = F.xxhash64(docs[text_col])
    loses = bloom.member_filter(lost.select(F.xxhash64("doc_id", "text_hash").alias("key")), "key")(F.xxhash64(docs[id_col], text_hash))
    columns = [docs[c] for c in docs.columns]
    whole = F.struct(F.lit(0).cast("long").alias("n_dropped"), F.coalesce(docs[text_col], F.lit("")).alias("kept"))
    passing = docs.filter(~loses).select(*columns, whole.alias(name))
    lost = lost.select(F.col("doc_id").alias(lost_id), F.col("text_hash").alias(lost_hash), F.col("digests").alias(gone))
    joined = docs.filter(loses).join(lost, docs[id_col].eqNullSafe(lost[lost_id]) & (text_hash == lost[lost_hash]), "left")
    losing = joined.select(*columns, without(docs[text_col], F.col(gone), min_chars).alias(name))
    return passing.unionByName(losing), name


def dedup_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text that stays), one row for each input row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, name = _with_left(docs, min_chars, min_docs, "doc_id", "text")
    t = F.coalesce("text", F.lit(""))
    n_lines = (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), f"{name}.n_dropped", f"{name}.kept")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated lines taken out of its texts (null stays null)."""
    out, name = _with_left(docs, min_chars, min_docs, id_col, text_col)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(f"{name}.kept"))).drop(name)
