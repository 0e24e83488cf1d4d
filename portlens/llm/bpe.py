"""Byte-level BPE by a tokenization automaton.

The automaton accepts exactly the token sequences that the merge list gives.
It is compiled by successive merge gadgets: it starts as one state with a loop
for every byte, and the k-th merge (a, b) -> c

* copies the state that a leads to, without its arc b, and leads a there (after
  a, b can no longer follow: the merge would have joined them), and
* gives every state that still allows a an arc c into the state that b leads to.

Where a token leads never depends on where it was read, so a state is named by
the token that leads to it and the merge after which it stood so. A gadget is
recorded as the arc its copy lost and the parts of the token it made. Whether a
state has an arc is read back along that record and kept in a table of
transitions.

A word has one accepted path. `encode` follows it longest arc first and goes
back where an arc is missing; the prefix before a position has one encoding
too, so a position found dead stays dead and the walk is linear in the word's
length. `decode` emits the labels of the arcs.

The vocabulary file (a `tokenizers` JSON of a byte-level BPE) is read on the
driver; tasks get it as a broadcast of that file's fixed size.

Null text counts as empty. Empty text has no tokens. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_WORDS = 400_000  # entries of a task's word cache, which is emptied when full
CACHE_ARCS = 500_000  # entries of the table of transitions, likewise


def _byte_chars() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton of a merge list; `encode` and `decode` for bytes and ids."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = labels
        self.label_of = {i: label for label, i in labels.items()}
        if any(bytes([b]) not in labels for b in range(256)):
            raise ValueError("the vocabulary must hold every byte")
        size = max(labels.values()) + 1
        self.made = [0] * size  # the merge that made a token, 0 for bytes
        self.parts = [(-1, -1)] * size
        self.lost: dict[int, int] = {}  # by state and arc: the merge whose copy lost the arc
        for k, (x, y) in enumerate(merges, 1):
            self._gadget(k, labels[x], labels[y], labels[x + y])
        self.arcs: dict[int, bool] = {}
        self._shorter()

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        if self.made[c]:
            raise ValueError("two merges make one token")
        if self._allows(a, k - 1, b):  # else an earlier merge keeps the two apart: no path reads them
            self.lost[a << 20 | b] = k
            self.made[c], self.parts[c] = k, (a, b)

    def _allows(self, state: int, k: int, arc: int) -> bool:
        """Whether the state that the token `state` led to after merge k has `arc`."""
        made, lost, parts = self.made, self.lost, self.parts
        while True:
            if lost.get(state << 20 | arc, k + 1) <= k:
                return False
            s, t = made[state], made[arc]
            if s < t:  # the gadget of `arc` gave it to the states that had its left part
                k, arc = t, parts[arc][0]
            elif s > t:  # older than `state`, which led where its right part led
                k, state = s - 1, parts[state][1]
            elif s:  # one token after itself
                k, state, arc = s - 1, parts[state][1], parts[arc][0]
            else:
                return True

    def has_arc(self, state: int, token: int) -> bool:
        """Whether `token` can follow once `state` is read, from the table of transitions."""
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._allows(state, len(self.made), token)
        return known

    def _shorter(self) -> None:
        """For each token the longest one that is a proper prefix of it, or -1."""
        self.shorter = [-1] * len(self.made)
        self.starts = set()
        for label, i in self.labels.items():
            for n in range(len(label) - 1, 0, -1):
                self.starts.add(label[:n])
                j = self.labels.get(label[:n])
                if j is not None and self.shorter[i] < 0:
                    self.shorter[i] = j

    def _first(self, word: bytes, at: int) -> int:
        """The longest token that starts at `at`."""
        labels, starts, found, end = self.labels, self.starts, -1, len(word)
        n = at + 1
        while n <= end:
            part = word[at:n]
            i = labels.get(part)
            if i is not None:
                found = i
            if part not in starts:
                break
            n += 1
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids on the accepted path of one pre-split word."""
        whole = self.labels.get(word)
        if whole is not None and (self.made[whole] or len(word) == 1):
            return [whole]  # a merged token's own bytes are read as that token
        end, at, state, out, label_of = len(word), 0, -1, [], self.label_of
        dead: set[int] = set()
        token = self._first(word, 0)
        arcs, shorter = self.arcs, self.shorter
        while at < end:
            while token >= 0:
                nxt = at + len(label_of[token])
                if nxt not in dead:
                    ok = True if state < 0 else arcs.get(state << 20 | token)
                    if ok if ok is not None else self.has_arc(state, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, state = nxt, token
                token = self._first(word, at) if at < end else -1
            else:
                dead.add(at)
                token = out.pop()
                at -= len(label_of[token])
                state = out[-1] if out else -1
                token = shorter[token]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.label_of.__getitem__, ids))


class Codec:
    """Whole texts to ids and back, with the vocabulary's special tokens.

    `keep(ids)` makes what the cache holds for a chunk of text: `encode_chunks`
    gives those values in order.
    """

    def __init__(self, vocabulary: bytes, keep: Callable[[list[int]], object], cache_words: int = CACHE_WORDS):
        spec = json.loads(vocabulary)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is asked for")
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.automaton = Automaton(labels, merges)
        self.label_of = self.automaton.label_of | {i: s.encode() for s, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(SPLIT)
        self.odd = re.compile(r" (?:\s|$)")
        self.keep = keep

        class Chunks(dict):
            def __init__(cache, before):  # noqa: N805
                cache.before = before

            def __missing__(cache, chunk):  # noqa: N805
                if len(cache) >= cache_words:
                    cache.clear()
                cache[chunk] = value = self.keep(self.encode_words(cache.before + chunk))
                return value

        self.first, self.later = Chunks(""), Chunks(" ")

    def encode_words(self, chunk: str) -> list[int]:
        ids = []
        for word in self.words.findall(chunk):
            ids += self.automaton.encode(word.encode())
        return ids

    def _encode(self, text: str) -> list:
        """`text` cut before each single space that a non-blank follows: word borders under SPLIT."""
        first, *rest = text.split(" ")
        if self.odd.search(text):
            parts, rest = [first, *rest], []
            for x in parts[1:]:
                if x and not x[0].isspace():
                    rest.append(x)
                elif rest:
                    rest[-1] += f" {x}"
                else:
                    first += f" {x}"
        out = [self.first[first]] if first else []
        out += map(self.later.__getitem__, rest)
        return out

    def encode_chunks(self, text: str) -> list:
        if self.at_special and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.at_special.split(text)):
                if i % 2:
                    out.append(self.keep([self.special[part]]))
                elif part:
                    out += self._encode(part)
            return out
        return self._encode(text) if text else []


_codecs: dict[tuple[str, str], Codec] = {}


def as_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def as_uint32(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def codec(vocabulary: bytes, keep: Callable[[list[int]], object]) -> Codec:
    """A worker process compiles a vocabulary once and keeps its caches over its tasks."""
    key = hashlib.sha256(vocabulary).hexdigest(), keep.__name__
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, keep)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def token_ids(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int> of the token ids of each whole text."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(shared.value, as_uint32)
        for texts in batches:
            yield pd.Series([np.frombuffer(b"".join(coder.encode_chunks(t or "")), "<u4").astype("i4") for t in texts], dtype=object)

    return encode(text)


def decoded_text(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of an array of ids, special tokens included; null for null."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = codec(shared.value, as_uint32)
        for rows in batches:
            yield pd.Series([None if r is None else b"".join(map(coder.label_of.__getitem__, r)).decode("utf-8", "replace") for r in rows], dtype=object)

    return decode(ids)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text encoded and decoded: id, n_tokens, ids_sha256, decoded_sha256.

    The digests are those of the decimal ids joined by commas, and of the text
    that the ids decode to. One row per input row, repeated ones included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = codec(shared.value, as_text)
        labels = {str(i): label for i, label in coder.label_of.items()}.__getitem__
        for texts in batches:
            rows = []
            for text in texts:
                ids = ",".join(coder.encode_chunks(text or ""))
                each = ids.split(",") if ids else []
                rows.append((len(each), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(map(labels, each))).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col)).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
