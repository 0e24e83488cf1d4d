"""Filter interaction audit by count-weighted decision diagrams.

Each document gets a mask of the filters it fails. Documents are counted by
part and mask first, so a part is at most 2 ** filters rows, however many
documents it has. Each part's counts become a decision diagram: a level a
filter, an edge for passing and one for failing, equal nodes shared, each node
with the number of documents, good ones and toxic ones below it. All orders of
the filters follow from each other by adjacent swaps (plain changes), and a swap
rebuilds only the two levels that change places. In each order the path on which
every filter passes gives the steps: what fails there is what a step removes.

Filters, over whole texts (null: empty; words `[^\\x20\\x09-\\x0D]+`):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] > 10 * code
points; D any of `#$%&*|`; E the text is that of a smaller doc_id, in any part.
A null id is neither smaller nor larger than another, so it neither fails E nor
makes others fail; rows that repeat an id with its text don't fail E by each
other. A null lang counts as the empty string. An id with several label rows is
good (toxic) if one of them says so. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import stored

FILTERS = "ABCDE"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = "#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")

STEPS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long, nodes int"


def own_failures(text: str) -> int:
    """The bits of A to D of one whole text."""
    raw = text.encode()
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), any(c in text for c in SYMBOLS))
    return sum(1 << i for i, f in enumerate(failed) if f)


def _read(text: Column) -> Column:
    @F.pandas_udf("bits int, digest binary")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = [t or "" for t in texts]
            yield pd.DataFrame({"bits": [own_failures(t) for t in texts], "digest": [hashlib.sha256(t.encode()).digest() for t in texts]})

    return read(text)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask: one row for each row of `docs`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), _read(F.col(text_col)).alias("r"))
    rows = stored(rows.select("doc_id", "part", "r.bits", "r.digest"), "audit-rows")
    # stored, so that a text with a third of the rows is a skewed partition of a plain join, which splits
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = stored(first.select("digest", "first"), "audit-first")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", F.col("bits").bitwiseOR(F.when(again, DUPLICATE).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail."""
    marked = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.groupBy(F.col(label_id_col).alias("marked_id")).agg(marked(good_col).alias("good"), marked(toxic_col).alias("toxic"))
    marks = stored(marks.filter("marked_id is not null and good + toxic > 0"), "audit-marks")
    rows = masks.join(marks, masks["doc_id"] == marks["marked_id"], "left")
    of = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), of("good"), of("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """n! - 1 places i: swapping the elements i and i + 1 in turn runs through all orders."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + 1 if down else place
        down = not down


class Diagram:
    """Weights by masks of `k` filters. A node's pair of edges leads to (passes, fails)."""

    def __init__(self, k: int, weights: dict[int, tuple[int, ...]]):
        self.order = list(range(k))
        self.edges: dict[int, tuple[int, int]] = {}
        self.weight: dict[int, tuple[int, ...]] = {}
        self.levels: list[dict] = [{} for _ in range(k + 1)]  # edges (at the bottom: weights) -> node
        self._made = 0
        zero = tuple([0] * len(next(iter(weights.values()), (0,))))
        row = [self._leaf(weights.get(sum(1 << f for f in range(k) if path >> (k - 1 - f) & 1), zero)) for path in range(1 << k)]
        for level in range(k - 1, -1, -1):
            row = [self._node(self.levels[level], row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _new(self, weight: tuple[int, ...]) -> int:
        self._made += 1
        self.weight[self._made] = weight
        return self._made

    def _leaf(self, weight: tuple[int, ...]) -> int:
        if weight not in self.levels[-1]:
            self.levels[-1][weight] = self._new(weight)
        return self.levels[-1][weight]

    def _node(self, table: dict, low: int, high: int) -> int:
        if (low, high) not in table:
            table[low, high] = node = self._new(tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True)))
            self.edges[node] = (low, high)
        return table[low, high]

    def swap(self, level: int) -> None:
        """Exchange a level with the one below. Nodes above keep their edges; those of the level keep their meaning."""
        here, below = {}, {}
        for (low, high), node in self.levels[level].items():
            (pp, pf), (fp, ff) = self.edges[low], self.edges[high]
            self.edges[node] = pair = (self._node(below, pp, fp), self._node(below, pf, ff))
            here[pair] = node
        for node in self.levels[level + 1].values():
            del self.edges[node], self.weight[node]
        self.levels[level], self.levels[level + 1] = here, below
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight that fails here, weight that goes on) down the path on which all pass."""
        node = self.root
        for f in self.order:
            low, high = self.edges[node]
            yield f, self.weight[high], self.weight[low]
            node = low

    def only(self, f: int) -> tuple[int, ...]:
        """The weight of what fails the filter f and no other."""
        node = self.root
        for g in self.order:
            node = self.edges[node][g == f]
        return self.weight[node]

    def size(self) -> int:
        return len(self.weight)


def steps_of(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """Rows of STEPS without the part, for all orders of the filters."""
    k = len(filters)
    diagram = Diagram(k, counts)
    fails = [sum(w[0] for mask, w in counts.items() if mask >> f & 1) for f in range(k)]
    unique = [diagram.only(f)[0] for f in range(k)]
    shapley, rows = [0] * k, []
    for place in [None, *plain_changes(k)]:
        if place is not None:
            diagram.swap(place)
        name = "".join(filters[f] for f in diagram.order)
        for step, (f, out, kept) in enumerate(diagram.all_pass(), 1):
            shapley[f] += out[0]
            rows.append((name, step, f, kept[0], out[0], out[1], out[2], diagram.size()))
    return [(name, step, filters[f], kept, out, fails[f] - out, unique[f], good, toxic, shapley[f], size) for name, step, f, kept, out, good, toxic, size in rows]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """STEPS for each part of `mask_counts`: a row for each order and step."""
    columns = [c.split()[0] for c in STEPS.split(", ")]

    def of_part(group: pd.DataFrame) -> pd.DataFrame:  # at most 2 ** filters rows
        by_mask = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in group.itertuples()}
        return pd.DataFrame([(group["part"].iloc[0], *row) for row in steps_of(by_mask, filters)], columns=columns)

    return counts.groupBy("part").applyInPandas(of_part, STEPS)


def audit_sql(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for the same rows: every order is applied to the counted masks by itself."""
    orders = " || ".join(f"f{i}.l" for i in range(5))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM {docs}),
worded AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM texts),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
masks AS (
  SELECT doc_id, part,
    (len(words) < 100)::INT
    + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM worded JOIN firsts USING (t)),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM {labels} GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT {orders} AS filter_order
  FROM letters f0, letters f1, letters f2, letters f3, letters f4
  WHERE f0.bit | f1.bit | f2.bit | f3.bit | f4.bit = 31),
steps AS (
  SELECT filter_order, step::INT AS step, l AS filter, bit,
    (SELECT coalesce(sum(e.bit), 0) FROM letters e WHERE strpos(filter_order, e.l) < step) AS earlier
  FROM orders, range(1, 6) r(step) JOIN letters ON l = substr(filter_order, step, 1)),
removals AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, filter)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM removals
"""
