"""Resampling of subjects with replacement, exactly: every replicate draws as many subjects as there are.

A replicate's draws go down a binary tree over the subjects in hash order: at each node a binomial number of them goes left. So
a task that holds a range of subjects learns its draws from the path above it, and no table of draws is made. Curves of all
replicates are taken from one table in score order whose rows hold a vector of weights, one for each replicate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.columns import hash_uniform
from caselight.operators import metrics as M
from caselight.operators.order import SENT
from caselight.operators.store import written
from caselight.operators.tables import hash_ranks

#: Subjects whose draws one task works out at a time, about, and the levels of the tree that one task expands.
BLOCK, LEVELS = 256, 10
#: Up to so many draws a quantile is searched from zero.
SMALL = 900
#: Cells of a block that one task takes, and that a task sums up at a time; bytes of weights it holds for that; products it makes at a time.
LOT, HELD, PRODUCTS = 1_000_000, 32_000_000, 2_000_000
#: Distinct scores in one row of a table of curves.
CHUNK = 8
#: Columns of that table.
CURVES = "range int, chunk int, last boolean, scores array<double>, pos binary, neg binary, start_pos binary, start_neg binary, won binary"


def uniforms(seed: str, nodes: list[str], replicates: int) -> np.ndarray:
    """Numbers in [0, 1), nodes x replicates: four replicates share one digest."""
    lots = -(-replicates // 4)
    raw = b"".join(hashlib.md5(f"{seed}:{node}:{k}".encode()).digest() for node in nodes for k in range(lots))
    return np.frombuffer(raw, dtype=">u4").reshape(len(nodes), lots * 4)[:, :replicates] / 4294967296.0


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least k whose binomial distribution function exceeds u."""
    p = np.broadcast_to(p, n.shape)
    q = 1 - p
    far = n * np.log1p(-np.minimum(p, 1 - 1e-16)) < -600
    k = np.where((n > SMALL) | far, np.maximum(0, np.floor(n * p - 14 * np.sqrt(n * p * q))), 0).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = n * np.log1p(-p)
        odd = np.flatnonzero((k > 0) & (p < 1))
        if len(odd):
            nf, kf, pf = n.ravel()[odd], k.ravel()[odd], p.ravel()[odd]
            choose = [math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(nf.tolist(), kf.tolist(), strict=True)]
            log.ravel()[odd] = np.array(choose) + kf * np.log(pf) + (nf - kf) * np.log1p(-pf)
        mass = np.where(p < 1, np.exp(log), 0.0)
        total, ratio = mass.copy(), np.where(p < 1, p / np.where(q > 0, q, 1), 0.0)
        while True:
            more = (total <= u) & (k < n) & (p < 1)
            if not more.any():
                break
            k += more
            mass = np.where(more, mass * (n - k + 1) / k * ratio, mass)
            total += np.where(more, mass, 0.0)
    return np.where(p >= 1, n, np.where(p <= 0, 0, k))


def _bound(level: int, node: int, total: int) -> int:
    return (node * total) >> level


def halved(draws: np.ndarray, level: int, first: int, total: int, seed: str) -> np.ndarray:
    """Draws of the nodes one level down: of node k of a level, which holds the subjects from k total / 2^level on, the children 2k and 2k + 1."""
    nodes = range(first, first + len(draws))
    size = np.array([_bound(level, k + 1, total) - _bound(level, k, total) for k in nodes])
    left = np.array([_bound(level + 1, 2 * k + 1, total) - _bound(level, k, total) for k in nodes])
    p = np.where(size > 0, left / np.maximum(size, 1), 0.0)[:, None]
    u = uniforms(seed, [f"{level}:{k}" for k in nodes], draws.shape[1])
    low = binomial(draws, p, u)
    return np.stack([low, draws - low], 1).reshape(-1, draws.shape[1])


def _depth(total: int, block: int) -> int:
    return max(0, (max(1, total) - 1).bit_length() - (block.bit_length() - 1))


def _leaves(draws: np.ndarray, level: int, node: int, total: int, seed: str) -> np.ndarray:
    """Weights of the subjects below a node, subjects x replicates."""
    vector, first, deepest = draws[None, :].astype(np.int64), node, (total - 1).bit_length()
    for at in range(level, deepest):
        vector = halved(vector, at, first, total, seed)
        first *= 2
    nodes = np.arange(first, first + len(vector))
    return vector[[_bound(deepest, int(k) + 1, total) > _bound(deepest, int(k), total) for k in nodes]]


def _tasks(spark: SparkSession) -> int:
    """Tasks for rows of few bytes and much work each, which Spark would put into few tasks by their bytes."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _ranges(df: DataFrame, total: int, replicates: int, seed: str, block: int) -> DataFrame:
    """(node, draws) at the depth of blocks; a task expands LEVELS levels at most."""
    spark, depth, level = df.sparkSession, _depth(total, block), 0
    nodes = spark.createDataFrame([(0, bytearray(np.full(replicates, total, dtype=np.int64).tobytes()))], "node long, draws binary")
    while level < depth:
        start, stop = level, min(depth, level + LEVELS)

        def expand(batches: Iterator[pa.RecordBatch], start: int = start, stop: int = stop) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    draws, first = np.frombuffer(raw, dtype=np.int64)[None, :], node
                    for at in range(start, stop):
                        draws, first = halved(draws, at, first, total, seed), first * 2
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(draws)), pa.int64()), pa.array([d.tobytes() for d in draws], pa.binary())], ["node", "draws"])

        nodes, level = (nodes.repartition(_tasks(spark), "node") if level else nodes).mapInArrow(expand, "node long, draws binary"), stop
    return nodes


def _placed(subjects: DataFrame, key: str, seed: str, block: int) -> tuple[DataFrame, int]:
    """(subjects with _at, their place from 0 in hash order, and _node, their block; how many there are). Subjects are stored, one row each."""
    stored = written(subjects, "subjects")
    total = stored.count()
    u = hash_uniform(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))
    ranked = hash_ranks(stored.withColumn("_u", u).withColumn("_all", F.lit(1)), "_all", "_u", key)
    node = F.expr(f"(rank * {1 << _depth(total, block)}L - 1) div {max(1, total)}L")
    return ranked.select(*subjects.columns, node.alias("_node"), (F.col("rank") - 1).alias("_at")), total


def _weighted(subjects: DataFrame, key: str, values: list[str], schema: str, work: Callable, replicates: int, seed: str, block: int) -> DataFrame:
    """work(iterator of (rows of a block without the draws, weights subjects x replicates)) over subjects, one row each."""
    placed, total = _placed(subjects, key, seed, block)
    if not total:
        return subjects.sparkSession.createDataFrame([], schema)
    depth = _depth(total, block)
    rows = placed.select("_node", "_at", F.lit(None).cast("binary").alias("_draws"), F.col(key).cast("string").alias("_key"), *values)
    heads = _ranges(subjects, total, replicates, seed, block).select(F.col("node").alias("_node"), F.lit(-1).cast("long").alias("_at"), F.col("draws").alias("_draws"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition(_tasks(subjects.sparkSession), "_node").sortWithinPartitions("_node", "_at")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            heads = np.flatnonzero(rest["_at"].to_numpy() == -1)
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                yield one(rest.slice(a, b - a))
            rest = rest.slice(heads[-1]).combine_chunks() if len(heads) else rest
        if rest is not None and len(rest):
            yield one(rest)

    def one(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        draws = np.frombuffer(table["_draws"][0].as_py(), dtype=np.int64)
        return table.slice(1), _leaves(draws, depth, table["_node"][0].as_py(), total, seed)

    return both.mapInArrow(lambda batches: work(blocks(batches)), schema)


def resample_weights(subjects: DataFrame, key: str, replicates: int = 1000, seed: str = "resample", block: int = BLOCK) -> DataFrame:
    """(key as text, weights): how often each replicate draws each of the distinct subjects. The weights of a replicate add up to the number of subjects."""

    def work(blocks: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for table, weights in blocks:
            if len(table):
                yield pa.RecordBatch.from_arrays([table["_key"].combine_chunks(), pa.array([w.astype("<i4").tobytes() for w in weights], pa.binary())], [key, "weights"])

    return _weighted(subjects.select(key).distinct(), key, [], f"`{key}` string, weights binary", work, replicates, seed, block)


def resampled_sums(totals: DataFrame, key: str, values: list[str], replicates: int = 1000, seed: str = "resample", block: int = BLOCK) -> DataFrame:
    """(r, values...): sums of per-subject totals (one row a subject) in each replicate. A task adds up its subjects, so a row for each task and replicate is shuffled."""

    def work(blocks: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((replicates, len(values)))
        for table, weights in blocks:
            if len(table):
                out += weights.T @ np.stack([table[v].to_numpy().astype(float) for v in values], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(replicates), pa.int32()), *[pa.array(c) for c in out.T]], ["r", *values])

    schema = ", ".join(["r int", *(f"`{v}` double" for v in values)])
    parts = _weighted(totals, key, values, schema, work, replicates, seed, block)
    return parts.groupBy("r").agg(*[F.sum(v).alias(v) for v in values])


def interval(point: DataFrame, drawn: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, point, low, high, n_boot) from (metric, point) and the replicates' (metric, v); replicates without a value don't count."""
    cuts = drawn.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("metric").agg(F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.count("v").alias("n_boot"))
    found = point.join(cuts, "metric", "left")
    return found.select("metric", "point", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), F.coalesce("n_boot", F.lit(0)).alias("n_boot"))


Metrics = Callable[[Callable[[str], Column]], dict[str, Column]]


def resample(df: DataFrame, cluster: str, sums: dict[str, Column], metrics: Metrics, replicates: int = 1000, alpha: float = 0.05, seed: str = "resample") -> DataFrame:
    """(metric, point, low, high, n_boot) of metrics that are functions of sums over rows, resampling clusters with replacement.

    metrics gets a function from a sum's name to its column and returns named columns.
    """
    totals = df.groupBy(cluster).agg(*[F.sum(c).cast("double").alias(name) for name, c in sums.items()]).fillna(0.0, list(sums))
    long = lambda rows, v: rows.select(F.explode(F.create_map(*[x for k, c in metrics(F.col).items() for x in (F.lit(k), c.cast("double"))])).alias("metric", v))
    whole = totals.agg(*[F.sum(name).alias(name) for name in sums])
    return interval(long(whole, "point"), long(resampled_sums(totals, cluster, list(sums), replicates, seed), "v"), alpha)


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4")


def _packed(sums: np.ndarray) -> pa.Array:
    """Vectors as bytes, in the narrowest whole numbers that hold them all."""
    most = int(sums.max(initial=0))
    data = np.ascontiguousarray(sums.astype(next(k for k in ("<u1", "<u2", "<u4", "<i8") if most <= np.iinfo(k).max)))
    ends = np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpacked(raw: bytes, replicates: int) -> np.ndarray:
    return np.frombuffer(raw, dtype={1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(raw) // replicates]).astype(np.int64)


def _by_score(total: int, depth: int, replicates: int, seed: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From cells by block, after a row with the block's draws: the cells' drawn counts summed by score, over as many blocks as HELD and LOT allow. Weights are worked
    out where the cells lie, so only sums are shuffled. A row has the positive or the negative ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: list[np.ndarray] = []
        cells: list[tuple[np.ndarray, ...]] = []
        start = held = 0
        node, draws = -1, None

        def flush() -> Iterator[pa.RecordBatch]:
            table = np.concatenate(weights)
            row, score, p, n = (np.concatenate(c) for c in zip(*cells, strict=True))
            order, step = np.argsort(score, kind="stable"), max(1, PRODUCTS // replicates)
            for k, count in enumerate((p, n)):
                own = order[count[order] > 0]
                for low in range(0, len(own), step):
                    some = own[low : low + step]
                    s = score[some]
                    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                    sums = _packed(np.add.reduceat(table[row[some]] * count[some, None], first, 0))
                    none = pa.nulls(len(first), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(s[first]), *((none, sums) if k else (sums, none))], ["score", "pos", "neg"])

        for batch in batches:
            at = batch.column(1).to_numpy()
            cuts = np.unique([0, *np.flatnonzero(at == -1), len(at)]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at[a] == -1:
                    node, draws, a = batch.column(0)[a].as_py(), np.frombuffer(batch.column(2)[a].as_py(), dtype=np.int64), a + 1
                if a == b:
                    continue
                if held >= LOT or sum(w.nbytes for w in weights) >= HELD:
                    yield from flush()
                    weights, cells, start, held = weights[-1:] if draws is None else [], [], 0, 0
                if draws is not None:
                    start = sum(len(w) for w in weights)
                    weights.append(_leaves(draws, depth, node, total, seed).astype(np.int32))
                    draws = None
                score, p, n = (batch.column(c).slice(a, b - a).to_numpy() for c in (3, 4, 5))
                cells.append((at[a:b] - _bound(depth, node, total) + start, score, p, n))
                held += b - a
        if cells:
            yield from flush()

    return work


def _chunks(replicates: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows by falling score: rows of CHUNK distinct scores with the replicates' sums at each, above the chunk within the range, and pairs won so far."""
    names = [f.split()[0] for f in CURVES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId(), 0
        zero = np.zeros(replicates, dtype=np.int64)
        above, below, won = zero.copy(), zero.copy(), np.zeros(replicates)
        scores, pos, neg = [], [], []

        def row(last: bool) -> pa.RecordBatch:
            nonlocal above, below, won, chunk
            start = above.tobytes(), below.tobytes()
            for p, n in zip(pos, neg, strict=True):
                won = won + n * (above + p / 2.0)
                above, below = above + p, below + n
            values = [number, chunk, last, list(scores), b"".join(x.tobytes() for x in pos), b"".join(x.tobytes() for x in neg), *start, won.tobytes()]
            chunk += 1
            scores.clear(), pos.clear(), neg.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names).cast(target)

        target = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("last", pa.bool_()), ("scores", pa.list_(pa.float64())), *[(c, pa.binary()) for c in names[4:]]])
        for batch in batches:
            for score, p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                p, n = (_unpacked(x, replicates) if x else zero for x in (p, n))
                if scores and scores[-1] == score:
                    pos[-1], neg[-1] = pos[-1] + p, neg[-1] + n
                    continue
                if len(scores) == CHUNK:
                    yield row(False)
                scores.append(score), pos.append(p), neg.append(n)
        if scores:
            yield row(True)

    return work


def curves(df: DataFrame, y: str, score: str, cluster: str, replicates: int = 1000, seed: str = "resample", block: int = BLOCK) -> DataFrame:
    """The stored curves of all replicates (CURVES), in ranges of falling score. Rows without a score are left out; a cluster without one is still drawn."""
    spark, pos = df.sparkSession, (F.col(y) == 1).cast("long")
    placed, total = _placed(df.select(F.col(cluster).alias("_key")).distinct(), "_key", seed, block)
    if not total:
        return written(spark.createDataFrame([], CURVES), "curves")
    depth, tasks = _depth(total, block), _tasks(spark)
    zero = F.lit(0).cast("long")
    cells = df.where(F.col(score).isNotNull()).groupBy(F.col(cluster).alias("_own"), F.col(score).cast("double").alias("score")).agg(F.coalesce(F.sum(pos), zero).alias("p"), F.coalesce(F.sum(1 - pos), zero).alias("n"))
    cells = written(cells.join(placed, F.col("_own").eqNullSafe(F.col("_key"))).select("_node", "_at", "score", "p", "n"), "cells")
    heads = _ranges(df, total, replicates, seed, block).select(F.col("node").alias("_node"), F.lit(-1).cast("long").alias("_at"), F.col("draws").alias("_draws"))
    # Blocks of very many cells are dealt to several tasks; each has the block's draws.
    large = written(cells.groupBy("_node").agg(F.ceil(F.count("*") / LOT).alias("_lots")).where("_lots > 1"), "large")
    sent = F.broadcast(large) if large.limit(SENT + 1).count() <= SENT else large
    lots = F.coalesce("_lots", F.lit(1))
    rows = cells.join(sent, "_node", "left").select("_node", "_at", F.lit(None).cast("binary").alias("_draws"), "score", "p", "n", F.pmod(F.xxhash64("score"), lots).alias("_lot"))
    each = heads.join(sent, "_node", "left").select("_node", "_at", "_draws", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)).alias("_lot"))
    both = rows.unionByName(each, allowMissingColumns=True).repartition(tasks, "_node", "_lot").sortWithinPartitions("_node", "_lot", "_at").drop("_lot")
    summed = written(both.mapInArrow(_by_score(total, depth, replicates, seed), "score double, pos binary, neg binary"), "sums")
    order = F.col("score").desc()
    return written(summed.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(_chunks(replicates), CURVES), "curves")


def _range_totals(table: DataFrame) -> DataFrame:
    """(range, r, chunks, pos, neg, won, before_pos, before_neg): a row for each range and replicate, with what stands in the ranges above."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk, pos, neg, sp, sn, won in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                sp, sn = np.frombuffer(sp, dtype=np.int64), np.frombuffer(sn, dtype=np.int64)
                p, n = (s + np.frombuffer(x, dtype=np.int64).reshape(-1, len(s)).sum(0) for s, x in ((sp, pos), (sn, neg)))
                head = [np.full(len(p), v, dtype=np.int32) for v in (number, chunk + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head[0], np.arange(len(p), dtype=np.int32), head[1], p, n, np.frombuffer(won, dtype=np.float64))], ["range", "r", "chunks", "pos", "neg", "won"])

    rows = table.where("last").select("range", "chunk", "pos", "neg", "start_pos", "start_neg", "won").mapInArrow(work, "range int, r int, chunks int, pos long, neg long, won double")
    above = W.partitionBy("r").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    return rows.select("*", zero("pos").alias("before_pos"), zero("neg").alias("before_neg"), F.sum("pos").over(W.partitionBy("r")).alias("all_pos"), F.sum("neg").over(W.partitionBy("r")).alias("all_neg"))


def area_draws(table: DataFrame) -> DataFrame:
    """(r, v): the area under each replicate's ROC curve; null with one class."""
    t = _range_totals(table)
    won = F.sum(F.col("won") + F.col("neg") * F.col("before_pos").cast("double"))
    return t.groupBy("r").agg(F.try_divide(won, F.max("all_pos").cast("double") * F.max("all_neg")).alias("v"))


def specificity_draws(table: DataFrame, target: float = 0.9) -> DataFrame:
    """(r, v): each replicate's specificity at its own threshold for the target sensitivity, as metrics.threshold_at_sensitivity finds it.

    First the range and then the chunk in which a replicate reaches the target is found; only those chunks are read again. A point on a straight line
    between its neighbours is no point of the curve: a replicate whose point is not settled within its chunk goes on to the next.
    """
    spark, t = table.sparkSession, written(_range_totals(table), "curve-totals")
    reached = F.col("before_pos") + F.col("pos")
    enough = lambda c: c / F.col("all_pos") >= target - 1e-12
    both = t.where("all_pos > 0 and all_neg > 0")
    hit = both.where(enough(reached) & ~enough(F.col("before_pos"))).select("r", "range", "before_pos", "before_neg", "all_pos", "all_neg").collect()  # a row for each replicate
    sizes = {r["range"]: r["chunks"] for r in t.groupBy("range").agg(F.max("chunks").alias("chunks")).collect()}  # a row for each range
    found: dict[int, float] = {}
    start: dict[int, list] = {}
    for h in hit:
        start.setdefault(h["range"], []).append((h["r"], h["before_pos"], h["before_neg"], h["all_pos"]))
    negatives = {h["r"]: h["all_neg"] for h in hit}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk, pos, neg, sp, sn in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                rs, bp, bn, ap = (np.array(x) for x in zip(*start[number], strict=True))
                sp, sn = np.frombuffer(sp, dtype=np.int64), np.frombuffer(sn, dtype=np.int64)
                pos, neg = (np.frombuffer(x, dtype=np.int64).reshape(-1, len(sp)) for x in (pos, neg))
                low, high = sp[rs] + bp, sp[rs] + bp + pos.sum(0)[rs]
                own = np.flatnonzero((low / ap < target - 1e-12) & (high / ap >= target - 1e-12))
                out = []
                for k in own:
                    r, p, n = rs[k], pos[:, rs[k]], neg[:, rs[k]]
                    cp, cn = low[k] + np.cumsum(p), sn[r] + bn[k] + np.cumsum(n)
                    at = int(np.argmax(cp / ap[k] >= target - 1e-12))
                    settled = cp[at] == p[at] and cn[at] == n[at]  # the first point of a curve is one
                    out.append(_settle(int(r), number, chunk, int(p[at]), int(n[at]), int(cn[at]), p[at + 1 :], n[at + 1 :], settled))
                yield from _states(out)

    def further(waiting: dict[tuple[int, int], list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, chunk, pos, neg, sp, _ in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                    wide = len(sp) // 8
                    pos, neg = (np.frombuffer(x, dtype=np.int64).reshape(-1, wide) for x in (pos, neg))
                    yield from _states([_settle(r, number, chunk, dp, dn, cn, pos[:, r], neg[:, r], False) for r, dp, dn, cn in waiting[number, chunk]])

        return work

    rows = table.select("range", "chunk", "pos", "neg", "start_pos", "start_neg")
    states = rows.where(F.col("range").isin(list(start))).mapInArrow(first, STATE).collect() if start else []
    order = sorted(sizes)
    while states:
        waiting: dict[tuple[int, int], list] = {}
        for s in states:
            at = s["chunk"] + 1, s["range"]
            if not s["done"] and at[0] == sizes[s["range"]]:
                later = [x for x in order if x > s["range"]]
                at = (0, later[0]) if later else None
            if s["done"] or at is None:
                found[s["r"]] = 1 - s["cn"] / negatives[s["r"]]
            else:
                waiting.setdefault((at[1], at[0]), []).append((s["r"], s["dp"], s["dn"], s["cn"]))
        places = [(F.col("range") == a) & (F.col("chunk") == b) for a, b in waiting]
        some = None
        for place in places:
            some = place if some is None else some | place
        states = rows.where(some).mapInArrow(further(waiting), STATE).collect() if waiting else []
    return spark.createDataFrame(sorted(found.items()), "r int, v double")


STATE = "r int, range int, chunk int, dp long, dn long, cn long, done boolean"


def _settle(r: int, number: int, chunk: int, dp: int, dn: int, cn: int, pos: np.ndarray, neg: np.ndarray, done: bool) -> tuple:
    """Goes on from a point to the first that is no inner point of a straight line."""
    if not done:
        for p, n in zip(pos.tolist(), neg.tolist(), strict=True):
            if not p and not n:
                continue
            if (p, n) != (dp, dn):
                done = True
                break
            cn += n
    return r, number, chunk, dp, dn, cn, done


def _states(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in STATE.split(", ")])


def resample_areas(df: DataFrame, y: str, score: str, cluster: str, replicates: int = 1000, alpha: float = 0.05, target: float | None = 0.9, seed: str = "resample") -> DataFrame:
    """(metric, point, low, high, n_boot) of the area under the ROC curve (auroc) and, with a target, of the specificity at the threshold that each replicate
    finds anew for that sensitivity (spec_at_sens). Exact on ties; points are those of the rows themselves, null with one class."""
    table = curves(df, y, score, cluster, replicates, seed)
    point = M.auroc(df, y, score).select(F.lit("auroc").alias("metric"), F.col("auroc").alias("point"))
    drawn = area_draws(table).select(F.lit("auroc").alias("metric"), "v")
    if target is not None:
        name = F.lit("spec_at_sens").alias("metric")
        point = point.unionByName(spec_at_sens(df, y, score, target).select(name, F.col("specificity").alias("point")))
        drawn = drawn.unionByName(specificity_draws(table, target).select(name, "v"))
    return interval(point, drawn, alpha)


def spec_at_sens(df: DataFrame, y: str, score: str, target: float = 0.9) -> DataFrame:
    """(threshold, specificity): the specificity at the threshold for a sensitivity; null with one class."""
    cut = M.threshold_at_sensitivity(df, y, score, target)
    rates = M.confusion(df.crossJoin(F.broadcast(cut)), y, score, F.col("threshold"), ["threshold"])
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return rates.select("threshold", F.when(both, F.col("specificity")).alias("specificity"))


def resample_callable(df: DataFrame, cluster: str, cells: list[str], metric: Callable[[pd.DataFrame, np.ndarray], float], name: str, replicates: int = 1000, alpha: float = 0.05, seed: str = "resample", lots: int = 64) -> DataFrame:
    """(metric, point, low, high, n_boot) of any function of weighted cells, resampling clusters.

    Rows are counted by cluster and `cells`, columns of few distinct combinations (classes, grades, binned scores); metric gets the combinations and their
    weights in one replicate and returns a number, or NaN for none. Replicates are dealt out in `lots`, each a group of one Arrow function that
    holds a row for each combination, whatever the number of rows or clusters.
    """
    counts = df.groupBy(F.col(cluster).cast("string").alias("_c"), *cells).agg(F.count("*").alias("_n"))
    weights = resample_weights(df, cluster, replicates, seed).withColumnRenamed(cluster, "_k")
    joined = counts.join(weights, counts["_c"].eqNullSafe(weights["_k"])).select(*cells, "_n", "weights")
    size = -(-replicates // lots)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cells).schema.fields)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task for each combination, cut into lots of replicates."""
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *cell, n, raw in zip(*columns, strict=True):
                key = tuple(cell)
                now = n * _vector(raw).astype(np.int64)
                sums[key] = sums[key] + now if key in sums else now
        for key, total in sums.items():
            parts = [total[k : k + size].tobytes() for k in range(0, replicates, size)]
            columns = [pa.array([v] * len(parts), batch.schema.field(k).type) for k, v in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], [*cells, "lot", "sums"])

    parts = joined.mapInArrow(summed, f"{kinds}, lot int, sums binary")

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.stack([np.frombuffer(x, dtype=np.int64) for x in pdf["sums"]])
        keys, which = np.unique([repr(t) for t in pdf[cells].itertuples(index=False)], return_inverse=True)
        first = np.array([int(np.flatnonzero(which == k)[0]) for k in range(len(keys))])
        added = np.zeros((len(keys), total.shape[1]), dtype=np.int64)
        np.add.at(added, which, total)
        frame = pdf[cells].iloc[first].reset_index(drop=True)
        return pd.DataFrame({"metric": name, "v": [float(metric(frame[added[:, r] > 0], added[added[:, r] > 0, r])) for r in range(added.shape[1])]})

    drawn = parts.groupBy("lot").applyInPandas(measured, "metric string, v double")
    whole = df.groupBy(*cells).agg(F.count("*").alias("_n")).groupBy(F.lit(0).alias("_one"))
    point = whole.applyInPandas(lambda pdf: pd.DataFrame({"metric": [name], "point": [float(metric(pdf[cells], pdf["_n"].to_numpy()))]}), "metric string, point double")
    return interval(point.withColumn("point", F.when(~F.isnan("point"), F.col("point"))), drawn, alpha)
