"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once a document and stores what it measured and
one bit a failed rule. Policies are versioned sets of rules; `apply_policy` and
`ablation` work on the stored bits alone, so a new policy never reads a text.

Definitions: words are `[^\\x20\\x09-\\x0D]+`; null text has none. Each input row
gets a row of its own, repeated rows too. Empty texts fail the length rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import BLANK, fresh_name

SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")

#: few_distinct_words: under a tenth of the words; from 5,000 words on under the root of 50 times as many, which is 500 there too and falls as a share after that.
#: name -> whether it failed, over the measures; a rule's bit is its place here. Append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols_by_words": "100 * n_symbols > 10 * n_words",
    "symbols_by_chars": "100 * n_symbols > 10 * (word_chars + 1)",
    "duplicate_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines",
    "mean_word_long": "word_chars > 20 * n_words",
    "mean_word_short": "word_chars < 2 * n_words",
    "few_distinct_words": "n_words >= 50 and (n_words < 5000 and 100 * n_distinct_words < 10 * n_words or n_words >= 5000 and n_distinct_words * n_distinct_words < 50 * n_words)",
}
BIT = {name: i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

#: version -> the rules that reject a document
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols_by_words", "mean_word_long", "mean_word_short"),
    "v2": (*BASE, "symbols_by_words", "duplicate_lines", "mean_word_long", "mean_word_short", "few_distinct_words"),
}
PRODUCTION = "v2"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words found twice or more, each word once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice)).tolist()
    found = [tuple(words[i : i + window]) for i in at]  # the windows themselves decide
    count = Counter(found)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, found, strict=True):
        if count[w] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    blanks = sum(raw.count(BLANK[i : i + 1]) for i in range(len(BLANK)))
    return (
        len(words),
        len(text) - blanks,
        sum(raw.count(c) for c in SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
    )


def _measures(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")

    return measured(text)


def failure_bits(prefix: str = "") -> Column:
    """bigint with the bit of every failed rule, over columns (or fields of `prefix`) named as MEASURES."""
    names = re.compile(rf"\b({'|'.join(MEASURES)})\b")
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        failed = F.expr(names.sub(rf"{prefix}.\1", rule) if prefix else rule)
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << BIT[r] for r in rules)


def passes(policy: str, bits: Column | str = "failed") -> Column:
    """Whether no rule of the policy failed."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the MEASURES and `failed`, one row for each input row."""
    out = docs.select(F.col(id_col).alias("doc_id"), _measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    return out.withColumn("failed", failure_bits())


def apply_policy(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with `base_failed` and `kept`."""
    return rows.withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def ablation(rows: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule: documents that fail it, that only it rejects, and what the policy rejects.

    The ledger is counted by its failure bits first (at most 2 ** rules rows),
    so policies and rules never multiply the documents.
    """
    policies = POLICIES if policies is None else policies
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cells = [(p, r, mask(rules), 1 << BIT[r]) for p, rules in policies.items() for r in rules]
    spec = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in cells]))
    hit = lambda bits: F.sum(F.when(bits, F.col("n")).otherwise(0))
    seen = F.col("failed").bitwiseAND(F.col("c.mask"))
    return (
        counts.select("failed", "n", spec.alias("c"))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            hit(seen.bitwiseAND(F.col("c.bit")) != 0).alias("fails"),
            hit(seen == F.col("c.bit")).alias("only_this_rule"),
            hit(seen != 0).alias("rejected"),
            F.sum("n").alias("documents"),
        )
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text passes, with the columns of `docs`."""
    name = fresh_name(docs, "quality")
    rows = docs.withColumn(name, _measures(F.col(text_col)))
    bits = failure_bits(name)
    return rows.filter(passes("base", bits) & passes(policy, bits)).drop(name)


def ablation_sql(docs: str = "documents") -> str:
    """DuckDB SQL for `ablation` over the whole of `docs`, from the texts."""
    word, blank = r"'[\x20\x09-\x0D]+'", r"'[\x20\x09-\x0D]'"
    rules = ", ".join(f"({rule})::INT AS {name}" for name, rule in RULES.items())
    cells = ", ".join(f"('{policy}', '{name}')" for policy, names in POLICIES.items() for name in names)
    failed = " ".join(f"WHEN '{name}' THEN {name}" for name in RULES)
    together = " ".join(f"WHEN '{policy}' THEN {' + '.join(names)}" for policy, names in POLICIES.items())
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t FROM {docs}),
split AS (
  SELECT r, t, list_filter(string_split_regex(t, {word}), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, {blank}, '', 'g') <> '') AS lines
  FROM texts),
windows AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split)),
again AS (SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN again USING (r, w), range(0, {WINDOW}) AS o(k) GROUP BY r),
measured AS (
  SELECT r, len(words) AS n_words, length(regexp_replace(t, {blank}, '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct_words
  FROM split LEFT JOIN covered USING (r)),
failures AS (SELECT {rules} FROM measured),
cells(policy, rule) AS (VALUES {cells}),
seen AS (SELECT policy, rule, CASE rule {failed} END AS fails, CASE policy {together} END AS of_policy FROM failures, cells)
SELECT policy, rule, sum(fails)::BIGINT AS fails, count(*) FILTER (fails = 1 AND of_policy = 1) AS only_this_rule,
  count(*) FILTER (of_policy > 0) AS rejected, count(*) AS documents
FROM seen GROUP BY policy, rule
"""
