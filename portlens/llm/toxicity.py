"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, other. Four
small transducers read the symbols of a clause in step, each with a weight for
the insult or threat it lets pass:

* target: raises what stands near the one it is aimed at,
* negation: lowers what follows a negation closely,
* reported speech: lowers what follows a verb of speech or a quotation mark,
* threat: lets a threat pass only near a target.

`compose` joins transducers into one deterministic table of states: those of
targets, read in both directions, and those of negation and report, read in
order. A clause's weight is the sum of its insults' and threats' weights times
the weights on the arcs they take. Clauses end at `. ! ? ; :` and line ends. A text is scored by its
matched clauses (their sum, the strongest, how many different words matched and
the share of clauses that matched) with a logistic curve.

Insults and their weights are learned: the log-odds of the documents with a word,
or with a longer word of a stem (`stem*`), among toxic and clean labelled rows,
from a bounded sample chosen by a hash of the id. Only those whose log-odds stay
above MIN_BOUND by SURE standard errors are kept, so a rare word that chance put
into toxic rows alone is none. The other word lists are fixed here. The curve is
fitted on the same sample.

Null and empty texts match nothing and get the curve's base value. Each input
row gives one row. With no labels nothing is learned and all texts get 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portlens.llm.common import doc_remainder

SAMPLE_TOXIC = 6000  # labelled rows to learn from
SAMPLE_CLEAN = 12000
MIN_DOCS, MIN_SHARE = 3, 0.005  # toxic rows that must hold an insult
SURE, MIN_BOUND = 1.5, 2.0
STEMS = range(3, 9)  # letters of a stem
SEEN_WORDS = 200_000  # words whose reading a task remembers at a time
THREAT_WEIGHT = 3.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6
#: Fixed words; a threat counts near a target only.
THREATS = """
kill killed hurt harm destroy murder stab shoot burn beat strangle choke poison drown hang lynch maim torture slaughter butcher cripple smash crush punch slap whip behead bury bomb attack assault execute suffocate
tuer tuerai tuerons frapper brûler étrangler empoisonner massacrer égorger poignarder abattre détruire torturer noyer écraser
töten umbringen ermorden verbrennen erwürgen vergiften erstechen erschießen vernichten foltern verprügeln schlagen abschlachten zerstören
matar mataré quemar golpear estrangular envenenar apuñalar disparar destruir torturar degollar ahogar aplastar
""".split()
TARGETS = "you your yours yourself u he she him her they them their people everyone tu toi vous ton ta ils elle du dich dir euch sie er ihr tú vosotros usted ellos ella".split()
NEGATIONS = "not no never nor neither without isn't aren't wasn't don't doesn't pas jamais ni sans nicht kein keine nie niemals weder nunca jamás sin tampoco".split()
REPORTS = 'said says say wrote writes called calls quoted quote reported claims " “ ” « » „ dit écrit appelé sagte schrieb nannte dijo escribió llamó'.split()

CLAUSE_END = re.compile(r"[.!?;:\n\r]+")
TOKEN = re.compile(r"""[^\W_]+(?:'[^\W_]+)*|["“”«»„]""")


@dataclass(frozen=True)
class Transducer:
    """Reads one symbol at a time: step(state, symbol) -> (next state, weight of that symbol)."""

    start: int
    step: object


def _near(trigger: int, reach: int, there: float, away: float, on: tuple[int, ...]) -> Transducer:
    """Symbols `on` weigh `there` within `reach` symbols after `trigger`, else `away`; all others 1."""

    def step(left: int, symbol: int) -> tuple[int, float]:
        weight = (there if left else away) if symbol in on else 1.0
        return (reach if symbol == trigger else max(0, left - 1)), weight

    return Transducer(0, step)


GRAMMAR = (
    _near(TARGET, 4, 1.5, 1.0, (INSULT,)),
    _near(TARGET, 6, 1.0, 0.25, (THREAT,)),
    _near(NEGATION, 3, 0.4, 1.0, (INSULT, THREAT)),
    _near(REPORT, 12, 0.6, 1.0, (INSULT, THREAT)),
)


def compose(parts: tuple[Transducer, ...]) -> tuple[list[list[int]], list[list[float]]]:
    """One deterministic table of the transducers run in step: next state and weight by state and symbol."""
    states = {tuple(p.start for p in parts): 0}
    nexts: list[list[int]] = []
    weights: list[list[float]] = []
    queue = list(states)
    for state in queue:  # grows while new states are reached
        row, cost = [], []
        for symbol in range(SYMBOLS):
            taken = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            to = tuple(s for s, _ in taken)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            row.append(states[to])
            cost.append(float(np.prod([w for _, w in taken])))
        nexts.append(row)
        weights.append(cost)
    return nexts, weights


FIXED = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS} | {w: THREAT for w in THREATS}


class Grammar:
    """The composed table with a lexicon of insults."""

    def __init__(self, insults: dict[str, float]):
        self.aimed, self.lowered = compose(GRAMMAR[:2]), compose(GRAMMAR[2:])
        self.insults = insults
        self.seen: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight; of the stems that it continues and the whole word the heaviest counts."""
        known = self.seen.get(word)
        if known is None:
            symbol = FIXED.get(word)
            if symbol is None:
                weight = max([self.insults.get(word, 0.0), *(self.insults.get(word[:n] + "*", 0.0) for n in STEMS if n < len(word))])
                known = (INSULT, weight) if weight else (OTHER, 0.0)
            else:
                known = symbol, THREAT_WEIGHT if symbol == THREAT else 0.0
            if len(self.seen) >= SEEN_WORDS:
                self.seen.clear()
            self.seen[word] = known
        return known

    def weights_at(self, table: tuple, read: list[tuple[int, float]]) -> list[float]:
        """The table's weight on each symbol, read in order."""
        nexts, weights = table
        state, out = 0, []
        for symbol, _ in read:
            out.append(weights[state][symbol])
            state = nexts[state][symbol]
        return out

    def clause(self, read: list[tuple[int, float]]) -> float:
        """A clause's weight. Targets act on both sides, the nearer one counts; negation and report act to the right."""
        right, left = self.weights_at(self.aimed, read), self.weights_at(self.aimed, read[::-1])[::-1]
        held = self.weights_at(self.lowered, read)
        return sum(w * max(x, y) * z for (_, w), x, y, z in zip(read, right, left, held, strict=True) if w)

    def features(self, text: str | None) -> tuple[float, ...]:
        """Of one whole text: log of 1 + the matched clauses' sum, the strongest clause, log of 1 + different words, log of 1 + percent of clauses."""
        total, most, words, matched, clauses = 0.0, 0.0, set(), 0, 0
        for part in CLAUSE_END.split((text or "").lower()):
            tokens = TOKEN.findall(part)
            clauses += bool(tokens)
            read = [self.read(t) for t in tokens]
            if any(weight for _, weight in read):
                weight = self.clause(read)
                total, most, matched = total + weight, max(most, weight), matched + 1
                words.update(t for t, (_, w) in zip(tokens, read, strict=True) if w)
        return float(np.log1p(total)), most, float(np.log1p(len(words))), float(np.log1p(100 * matched / max(1, clauses)))


FEATURES = ("total", "most", "words", "share")


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    curve: tuple[float, ...]  # intercept and a weight for each feature


def _sample(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(text, label): at most SAMPLE_TOXIC and SAMPLE_CLEAN rows with different texts; of a repeated id the text of the smallest hash."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda toxic, n: known.filter((F.col("toxic") == 1) if toxic else (F.col("toxic") != 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(True, SAMPLE_TOXIC).unionByName(pick(False, SAMPLE_CLEAN)).select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).cast("int").alias("label"))
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # ids: bounded by the two parameters
    rows = rows.filter(F.col("text").isNotNull()).groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("s"), F.max("label").alias("label"))
    return rows.groupBy(F.col("s.text").alias("text")).agg(F.max("label").alias("label"))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def train_rows(id_col: str = "doc_id") -> Column:
    return doc_remainder(F.col(id_col), 4) != 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model | None:
    """Learn the insults and the curve; None if no labelled row can be learned from."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(toxic_col).alias("toxic"))
    rows = _sample(docs, labels, train_rows()).persist()
    try:
        size = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
        toxic, clean = int(size[0] or 0), int(size[1] or 0) - int(size[0] or 0)
        if not toxic or not clean:
            return None
        words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1)))
        stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: n < F.length(w)), lambda n: F.concat(F.substring(w, F.lit(1), n), F.lit("*"))))))
        seen = rows.select("label", F.explode(F.concat(words, stems)).alias("word")).groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
        weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
        bound = F.col("w") - SURE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
        heavy = seen.withColumn("w", weight).filter((F.col("t") >= max(MIN_DOCS, MIN_SHARE * toxic)) & (bound >= MIN_BOUND))
        kept = [r for r in heavy.orderBy(F.desc("w"), "word").collect() if r["word"] not in FIXED]  # words of the sample, each in several toxic rows
        # a stem of one word only says nothing about other words
        alone = {(r["word"][:n] + "*", r["t"], r["c"]) for r in kept if not r["word"].endswith("*") for n in STEMS}
        insults = {r["word"]: float(r["w"]) for r in kept if (r["word"], r["t"], r["c"]) not in alone}
        found = rows.select(_features(rows, F.col("text"), insults).alias("f"), "label").select("f.*", "label").collect()  # four numbers for each sampled row
    finally:
        rows.unpersist()
    x = np.array([[r[f] for f in FEATURES] for r in found])
    return Model(insults, _fit_curve(x, np.array([r["label"] for r in found], float)))


def _features(docs: DataFrame, text: Column, insults: dict[str, float]) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(insults)  # words of the bounded sample

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(shared.value)
        for texts in batches:
            yield pd.DataFrame([grammar.features(t) for t in texts], columns=list(FEATURES), dtype=float)

    return matched(text)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the features."""
    model = model or Model({}, (-30.0, *[0.0] * len(FEATURES)))
    rows = docs.select(F.col(id_col).alias("doc_id"), (~train_rows(id_col)).alias("held_out"), _features(docs, F.col(text_col), model.insults).alias("f"))
    b = model.curve
    z = sum((F.lit(w) * F.col(f"f.{f}") for w, f in zip(b[1:], FEATURES, strict=True)), F.lit(b[0]))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("f.total").alias("clause_total"), F.col("f.most").alias("strongest_clause"))
