"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, stored, text_slices
from .toxicity import training_rows

#: Labelled rows that the network and its temperature are fitted on, at most (about). Word vectors come from all documents.
MAX_TRAINING = 20_000
#: Length of a vector, non-zero entries of an index vector, reach of a context.
SIZE, NONZERO, REACH = 48, 6, 2
#: A word is common if it makes at least one in so many words of the corpus, so there are no more common words than this.
COMMON = 65_536
#: Words that are worked on at a time.
PIECE = 200_000
HIDDEN = 24
THRESHOLD = 0.7
PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]?\Z")
ODD = np.uint64(1 << 63)


class Words(dict):
    """Token to the hash of its word: plain ones lower-cased without end marks, all others by their shape, with the top bit set."""

    def __missing__(self, token: str) -> int:
        if PLAIN.match(token) and not (len(token) > 2 and token.isupper()):
            found = xxhash.xxh3_64_intdigest(token.lower().rstrip(".,;:!?")) >> 1
        else:
            shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", token)
            shape = re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "0", shape))
            found = xxhash.xxh3_64_intdigest(shape) >> 1 | 1 << 63
        if len(self) > 300_000:
            self.clear()
        self[token] = found
        return found


def hashes(texts: pa.Array, words: Words) -> list[np.ndarray]:
    """The hashes of each text's words, in order; only different tokens of a batch are looked at one by one."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    table = np.fromiter(map(words.__getitem__, distinct), dtype=np.uint64, count=len(distinct))
    found = table[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, dtype=np.uint64)
    cuts = lists.offsets.to_numpy()
    own = np.split(found, (cuts - cuts[0])[1:-1]) if len(texts) else []
    empty = next((k for k, token in enumerate(distinct) if not token), None)  # a text without words is one empty token
    return own if empty is None else [h[:0] if len(h) == 1 and h[0] == table[empty] else h for h in own]


def index_vectors(found: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors of words, from their hashes alone."""
    out, row = np.zeros((len(found), SIZE), dtype=np.int8), np.arange(len(found))
    for k in range(NONZERO):
        place = ((found >> np.uint64(8 * k)) & np.uint64(0xFF)) % np.uint64(SIZE)
        out[row, place.astype(np.int64)] += (((found >> np.uint64(50 + k)) & np.uint64(1)).astype(np.int8) << 1) - 1
    return out


def pieces(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts as hashes, runs of about PIECE words: (a text's place, hash, whether it is only there as context of its neighbours)."""
    owners, found, edge, size = [], [], [], 0
    for at, own in enumerate(texts):
        for start in range(0, len(own), PIECE):
            low, high = max(0, start - REACH), min(len(own), start + PIECE + REACH)
            outside = np.ones(high - low + REACH, dtype=bool)  # the last REACH places are empty
            outside[start - low : min(len(own), start + PIECE) - low] = False
            owners.append(np.full(len(outside), at))
            found.append(np.r_[own[low:high], np.zeros(REACH, dtype=np.uint64)])
            edge.append(outside)
            size += len(outside)
            if size >= PIECE:
                yield np.concatenate(owners), np.concatenate(found), np.concatenate(edge)
                owners, found, edge, size = [], [], [], 0
    if size:
        yield np.concatenate(owners), np.concatenate(found), np.concatenate(edge)


def contexts(found: np.ndarray) -> np.ndarray:
    """For each place the sum of the index vectors of the words within reach; empty places have hash 0."""
    distinct, at = np.unique(found, return_inverse=True)
    table = index_vectors(distinct)
    table[distinct == 0] = 0
    near = table[at]
    out = np.zeros_like(near)
    for k in range(1, REACH + 1):
        out[k:] += near[:-k]
        out[:-k] += near[k:]
    return out


def common_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, shares of all words) of the words that make at least one in COMMON, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting = Words(), []
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                waiting += hashes(texts, words)
            if sum(map(len, waiting)) > 1_000_000:
                yield counted(waiting)
                waiting = []
        if waiting:
            yield counted(waiting)

    def counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])

    sums = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = stored(sums, "word-counts")
    total = sums.agg(F.sum("n")).first()[0] or 0
    table = sums.where(F.col("n") * COMMON >= total).toPandas()  # at most COMMON rows
    found, n = table["word"].to_numpy(dtype=np.int64).view(np.uint64), table["n"].to_numpy(dtype=float)
    order = np.argsort(found)
    return found[order], n[order] / max(1, total)


def places(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of hashes in the sorted table, -1 for others."""
    if not len(known):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, at, -1)


class Vectors:
    """Vectors of the common words, and what all words weigh: the rarer, the more."""

    def __init__(self, known: np.ndarray, shares: np.ndarray, sums: np.ndarray) -> None:
        self.known = known
        self.table = (sums / np.maximum(1e-6, np.linalg.norm(sums, axis=1, keepdims=True))).astype(np.float32)
        self.weights = (1e-3 / (1e-3 + shares)).astype(np.float32)

    def pooled(self, texts: pa.Array, words: Words) -> np.ndarray:
        """Of each text: the weighted mean of its words' vectors and their spread, how often words follow themselves, repeat, are not
        common and have an uncommon shape, and the length. The vector of a word that isn't common comes from its neighbours here."""
        n = len(texts)
        mean, square, weight = np.zeros((n, SIZE)), np.zeros((n, SIZE)), np.zeros(n)
        more = np.zeros((n, 5))
        own = [h for _, part in text_slices(texts) for h in hashes(part, words)]
        more[:, 4] = [len(np.unique(h)) for h in own]
        for owner, found, edge in pieces(own):
            at = places(found, self.known)
            vectors = self.table[at] if len(self.table) else np.zeros((len(found), SIZE), dtype=np.float32)
            rare = np.flatnonzero((at < 0) & ~edge)
            if len(rare):
                local = contexts(found)[rare].astype(np.float32)
                vectors[rare] = local / np.maximum(1e-6, np.linalg.norm(local, axis=1, keepdims=True))
            w = np.where(at < 0, np.float32(1), self.weights[at] if len(self.weights) else np.float32(1)) * ~edge
            new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            who = owner[new]
            vectors *= w[:, None]
            mean[who] += np.add.reduceat(vectors, new, axis=0)
            vectors *= vectors
            square[who] += np.add.reduceat(vectors, new, axis=0)
            weight[who] += np.add.reduceat(w, new)
            again = np.r_[False, (found[1:] == found[:-1])] & ~edge
            for k, flag in enumerate((~edge, again, (at < 0) & ~edge, (found >= ODD) & ~edge)):
                more[who, k] += np.add.reduceat(flag.astype(np.float64), new)
        size = np.maximum(1.0, more[:, :1])
        mean /= np.maximum(1e-6, weight)[:, None]
        spread = np.sqrt(np.maximum(0.0, square / size))
        return np.c_[mean, spread, more[:, 1:] / size, np.log1p(more[:, 0]) / 10]


def word_vectors(docs: DataFrame) -> Vectors:
    """Sums of the index vectors of all words within reach, for each common word over all documents: COMMON x SIZE numbers at most.

    A task adds up its share and sends a row a word; Spark adds the rows of a word, so that no task gathers those of all tasks.
    """
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, shares = common_words(docs)
    held = docs.sparkSession.sparkContext.broadcast(known)
    names = [f"c{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros((len(held.value), SIZE), dtype=np.int32)
        for b in batches:
            for _, found, edge in (x for _, texts in text_slices(b.column(0)) for x in pieces(hashes(texts, words))):
                at = places(found, held.value)
                own = np.flatnonzero((at >= 0) & ~edge)
                if len(own):
                    own = own[np.argsort(at[own], kind="stable")]
                    word = at[own]
                    new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                    sums[word[new]] += np.add.reduceat(contexts(found)[own], new, axis=0, dtype=np.int32)
        some = np.flatnonzero(sums.any(axis=1)).astype(np.int32)
        for k in range(0, len(some), 8192):
            part = some[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(sums[part, j]) for j in range(SIZE))], ["word", *names])

    schema = "word int, " + ", ".join(f"{c} int" for c in names)
    summed = docs.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).cast("double").alias(c) for c in names]).toPandas()
    sums = np.zeros((len(known), SIZE))
    sums[summed["word"].to_numpy(dtype=np.int64)] = summed[names].to_numpy(dtype=float)
    return Vectors(known, shares, sums)


class Network:
    """tanh(xA + a)B + b, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 500) -> None:
        rng = np.random.default_rng(7)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-3, 1.0
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.p = p
        moment, second = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if 0 < y.mean() < 1 else np.ones(len(y))
        weight = np.sqrt(weight)
        z = (x - self.mean) / self.scale
        for t in range(1, steps + 1):
            rows = slice(None) if len(z) <= 4096 else rng.integers(0, len(z), 4096)
            zb, yb, wb = z[rows], y[rows], weight[rows]
            h = np.tanh(zb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) * wb / len(zb)
            back = (d[:, None] * p[2][None, :]) * (1 - h * h)
            for k, g in enumerate((zb.T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True))):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= 0.01 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)
        losses = [(np.mean(np.logaddexp(0, -np.where(y == 1, z, -z) / t)), t) for t in np.geomspace(0.25, 8, 41)]
        self.temperature = min(losses)[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, vectors: Vectors, label: str = "quality", most: int = MAX_TRAINING) -> Network | None:
    """The network from four fifths of the training rows, its temperature from the rest. None without labels of both kinds."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            x = [row.tobytes() for row in held.value.pooled(b.column(1), words).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["doc_id", "x", "y"])

    rows = training_rows(docs, labels, label, most).select("doc_id", "text", "y")
    table = rows.mapInArrow(run, "doc_id long, x binary, y int").toPandas().sort_values("doc_id")  # about MAX_TRAINING rows of 100 numbers
    y = table["y"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.frombuffer(b"".join(table["x"]), dtype=np.float32).reshape(len(y), -1).astype(float)
    aside = np.array([xxhash.xxh32_intdigest(str(d), 5) % 5 == 0 for d in table["doc_id"]])
    if aside.sum() < 20 or not 0 < y[~aside].sum() < (~aside).sum():
        aside[:] = False
    net = Network(x[~aside], y[~aside])
    net.calibrate(x[aside] if aside.any() else x, y[aside] if aside.any() else y)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, most: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; only text is read for the score.

    Null and empty texts have the zero vector and get the score that the network gives it. Repeated rows are scored alike; a
    null doc_id is never held out. Without labels of both kinds all scores are 0.5. Empty docs: no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vectors = word_vectors(docs)
    held = spark.sparkContext.broadcast((vectors, fit(docs, labels, vectors, label, most)))

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (table, net), words = held.value, Words()
        for batch in batches:
            if net is None or not len(batch):
                yield pd.Series(np.full(len(batch), 0.5))
            else:
                yield pd.Series(net.probability(table.pooled(pa.array(batch, pa.string(), from_pandas=True), words)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
