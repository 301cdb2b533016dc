"""Toxicity by a weighted finite-state grammar over clauses: insults and threats, targets, negation and reported speech."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, stored

#: Labelled rows from which lexicon and calibration are learnt, at most (about); the only bound on what is read.
MAX_TRAINING = 20_000
#: About so many words and stems may enter the lexicon by chance; the least G2 with the label follows from the number tried.
BY_CHANCE = 20
#: Letters of the stems that stand for all words that begin with them.
STEMS = (4, 5, 6)
#: Of the toxic texts with a learnt word, the share in which it must follow a modal to be a threat, or stand beside a known insult or
#: threat to be a target, and the texts needed to tell.
LIKE_THREAT, LIKE_TARGET, TELLING = 0.5, 0.8, 10
THRESHOLD = 0.3
#: The grammar's own words.
INSULTS = "idiot idiots moron morons imbecile stupid scum idiota imbécil estúpido estúpida escoria dummkopf arschloch trottel abschaum imbécile connard crétin".split()
THREATS = "kill hurt destroy murder shoot stab beat strangle töten umbringen erschießen matar matarte tuer tuerai".split()
MODALS = "will gonna going shall must should 'll werde werden voy vais va".split()
TARGETS = "you your yours yourself u ur they them their these those du dich dir euch ihr tú ti te usted ustedes tu toi vous".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't won't cannot can't without nicht kein keine nie niemals nunca jamás ningún pas jamais aucun".split()
REPORTS = "said says wrote writes called calls quoted quotes reported claims claimed according sagte sagt schrieb dijo dice escribió dit écrit".split()

OTHER, INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, QUOTE, END = range(9)
TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n\"“”«»]")


class Machine:
    """A transducer: moves[state][class] is the next state, gains[state][class] the factor of an event, last[state] that of the clause."""

    def __init__(self, moves: list[list[int]], gains: list[list[float]], last: list[float]) -> None:
        self.moves, self.gains, self.last = moves, gains, last

    def __mul__(self, other: Machine) -> Machine:
        """Both at once: states are pairs, factors are products."""
        pairs = list(product(range(len(self.moves)), range(len(other.moves))))
        at = {p: k for k, p in enumerate(pairs)}
        return Machine(
            [[at[self.moves[a][c], other.moves[b][c]] for c in range(END)] for a, b in pairs],
            [[self.gains[a][c] * other.gains[b][c] for c in range(END)] for a, b in pairs],
            [self.last[a] * other.last[b] for a, b in pairs],
        )


def within(trigger: int, reach: int, near: dict[int, float], far: dict[int, float]) -> Machine:
    """Events get the factors of `near` up to `reach` tokens after a trigger, else those of `far`."""
    moves = [[reach if c == trigger else max(0, s - 1) for c in range(END)] for s in range(reach + 1)]
    return Machine(moves, [[(near if s else far).get(c, 1.0) for c in range(END)] for s in range(reach + 1)], [1.0] * (reach + 1))


def once(triggers: tuple[int, ...], factor: float) -> Machine:
    """The clause gets the factor if a trigger occurs anywhere in it."""
    return Machine([[int(c in triggers) for c in range(END)], [1] * END], [[1.0] * END] * 2, [1.0, factor])


GRAMMAR = (
    within(NEGATION, 3, {INSULT: 0.15, THREAT: 0.1}, {}) * within(MODAL, 3, {THREAT: 2.0}, {THREAT: 0.3}) * once((TARGET,), 1.3) * once((REPORT, QUOTE), 0.6)
)


class Lexicon(dict):
    """Token to (class, weight); words get the largest weight of the entries for the word and its stems, and the class of that entry."""

    def __init__(self, learnt: dict[str, tuple[int, float]]) -> None:
        super().__init__()
        self.learnt = learnt
        self.fixed: dict[str, tuple[int, float]] = {m: (END, 0.0) for m in ".!?;\n"} | {m: (QUOTE, 0.0) for m in '"“”«»'}
        for kind, entries in ((INSULT, INSULTS), (THREAT, THREATS), (MODAL, MODALS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.fixed |= {w: (kind, 2.0 if kind in (INSULT, THREAT) else 0.0) for w in entries}

    def __missing__(self, token: str) -> tuple[int, float]:
        low = token.lower()
        fixed = self.fixed.get(low)
        names = [low, *(low[:k] + "*" for k in STEMS if len(low) >= k)]
        kind, weight = max((self.learnt[n] for n in names if n in self.learnt), key=lambda x: x[1], default=(OTHER, 0.0))
        if fixed and (fixed[0] not in (INSULT, THREAT) or weight < fixed[1]):
            found = fixed
        else:
            found = (fixed[0] if fixed else kind, weight if kind != TARGET else 0.0)
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found


def clause_scores(text: str, lexicon: Lexicon) -> tuple[list[float], int, int]:
    """The scores of the clauses that have an event, the number of events, and of tokens."""
    tokens = TOKENS.findall(text)
    tags = [lexicon[t] for t in tokens]
    kinds = np.fromiter((k for k, _ in tags), dtype=np.int8, count=len(tags))
    events = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    if not len(events):
        return [], 0, len(tokens)
    ends, scores, done = np.r_[-1, np.flatnonzero(kinds == END), len(kinds)], [], -1
    for stop in np.unique(np.searchsorted(ends, events)):
        state, total = 0, 0.0
        for k in range(int(ends[stop - 1]) + 1, int(ends[stop])):
            kind, weight = tags[k]
            if weight:
                total += weight * GRAMMAR.gains[state][kind]
            state = GRAMMAR.moves[state][kind]
        scores.append(total * GRAMMAR.last[state])
    return scores, len(events), len(tokens)


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    scores, events, n = clause_scores(text, lexicon)
    total = sum(scores)
    return math.log1p(total), max(scores, default=0.0), math.log1p(100 * total / max(20, n)), math.log1p(events)


class Model:
    def __init__(self, learnt: dict[str, tuple[int, float]], weights: np.ndarray) -> None:
        self.learnt, self.weights = learnt, weights

    def score(self, f: tuple[float, ...]) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[0] + np.dot(self.weights[1:], f)))))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_TRAINING) -> DataFrame:
    """(text, y) of the labelled rows that may be learnt from: not held out, label and text known, about `most` rows by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    share = 1.0 if n <= most else most / n
    chosen = stored(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))), "training-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    return stored(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), "training")  # chosen has about `most` rows


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words and stems: the toxic and other texts that have them, and the toxic ones in which they follow a modal, or stand beside an
    insult or threat of the fixed lists."""
    plain, names = Lexicon({}), ("feature", "bad", "good", "modal", "beside")
    counts = [Counter() for _ in names[1:]]
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tokens = [t.lower() for t in TOKENS.findall(text)]
            features = lambda found: found | {t[:k] + "*" for t in found for k in STEMS if len(t) >= k}
            counts[1 - y].update(features({t for t in tokens if t[0].isalpha()}))
            if y:
                kinds = [plain[t][0] for t in tokens]
                after, beside = set(), set()
                for k, kind in enumerate(kinds):
                    if kind == MODAL:
                        after.update(tokens[k + 1 : k + 4])
                    elif kind in (INSULT, THREAT):
                        beside.update(tokens[max(0, k - 3) : k] + tokens[k + 1 : k + 4])
                counts[2].update(features({t for t in after if t[0].isalpha()}))
                counts[3].update(features({t for t in beside if t[0].isalpha()}))
        if len(counts[1]) > 300_000:
            yield _counted(counts, names)
    yield _counted(counts, names)


def _counted(counts: list[Counter], names: tuple[str, ...]) -> pa.RecordBatch:
    found = list(counts[0].keys() | counts[1].keys())
    arrays = [pa.array(found, pa.string()), *(pa.array([c[w] for w in found], pa.int64()) for c in counts)]
    for c in counts:
        c.clear()
    return pa.RecordBatch.from_arrays(arrays, list(names))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAINING) -> Model:
    """Lexicon and calibration from the labelled rows that are not held out; without any, the grammar's own words decide."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = training_rows(docs, labels, label, most)
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    bad_n, good_n = n.get(1, 0), n.get(0, 0)
    if not bad_n or not good_n:
        return Model({}, np.array([-3.0, 1.0, 0.3, 0.3, 0.0]))
    sums = [F.sum(c).alias(c) for c in ("bad", "good", "modal", "beside")]
    counted = rows.select("text", "y").mapInArrow(_counts, "feature string, bad long, good long, modal long, beside long").groupBy("feature").agg(*sums).where("bad >= 3")
    total, seen = float(bad_n + good_n), F.col("bad") + F.col("good")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    rest_bad, rest_good = F.lit(bad_n) - F.col("bad"), F.lit(good_n) - F.col("good")
    rest = F.lit(total) - seen
    g2 = 2 * (part(F.col("bad"), seen * bad_n / total) + part(F.col("good"), seen * good_n / total) + part(rest_bad, rest * bad_n / total) + part(rest_good, rest * good_n / total))
    odds = F.log((F.col("bad") + 0.2) / (bad_n + 0.4)) - F.log((F.col("good") + 0.2) / (good_n + 0.4))
    counted = stored(counted.withColumn("g2", g2).withColumn("odds", odds), "counted")
    least = max(8.0, 2 * math.log(max(1.0, counted.count() / BY_CHANCE)))
    learnt = counted.where((F.col("g2") >= least) & (F.col("odds") >= 1.5))
    telling = F.col("bad") >= TELLING
    kind = F.when(telling & (F.col("modal") >= F.col("bad") * LIKE_THREAT), THREAT).when(telling & (F.col("beside") >= F.col("bad") * LIKE_TARGET), TARGET).otherwise(INSULT)
    # As many words as about `most` labelled rows can tell to be toxic ones, far fewer than those rows have.
    lexicon = {r.feature: (r.kind, float(r.odds)) for r in learnt.select("feature", "odds", kind.alias("kind")).collect()}
    held = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(held.value)
        for b in batches:
            found = np.array([features(t, own) for t in b.column(0).to_pylist()], dtype=np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, k]) for k in range(4)), b.column(1)], ["a", "b", "c", "d", "y"])

    table = rows.select("text", "y").mapInArrow(measure, "a double, b double, c double, d double, y int").toPandas()  # about MAX_TRAINING rows of numbers
    x, y = np.c_[np.ones(len(table)), table[["a", "b", "c", "d"]].to_numpy()], table["y"].to_numpy().astype(float)
    weights = np.zeros(5)
    for _ in range(60):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(5), x.T @ (p - y) + 0.05 * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, weights)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column to its toxicity; null counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(held.value.learnt)
        for batch in batches:
            yield pd.Series([held.value.score(features(t or "", lexicon)) for t in batch], dtype="float64")

    return toxicity


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, most: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; only text is read for the score.

    Null and empty texts have no clause and get the score of a text without events. Repeated rows are scored alike; a document
    whose labels disagree counts as toxic in training; a null doc_id is never held out. Empty labels: the grammar's own words
    with fixed weights. Empty docs: no rows. Other columns are ignored.
    """
    model = fit(docs, labels, label, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    return docs.where(scorer(docs, fit(docs, labels, label))(F.col("text").cast("string")) < threshold)
