"""Fits of many groups at once: isotonic by mergeable blocks, temperatures by vectors of losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.operators.store import written

#: The range of a temperature, the steps of the first grid and of the one around its best.
COLDEST, HOTTEST, GRID, FINE = 0.05, 10.0, 400, 50
#: Rows whose losses are taken at a time.
PIECE = 4096


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields) if names else ""


def _pool(batches: Iterator[pa.RecordBatch], keys: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pools adjacent violators among blocks sorted by key and score. Blocks that were pooled in a part of a group stay pooled in the whole,
    so parts may be pooled first, in any order. Sums and counts are whole numbers, so means are compared exactly."""
    now, stack, out = None, [], []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for *key, lo, hi, s, n in zip(*columns, strict=True):
            if now != key:
                out += [(*now, *b) for b in stack] if now is not None else []
                now, stack = key, []
            while stack and stack[-1][2] * n >= s * stack[-1][3]:
                b = stack.pop()
                lo, s, n = b[0], b[2] + s, b[3] + n
            stack.append((lo, hi, s, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), batch.schema, strict=True)], names)
            out = []
    if now is not None:
        rows = [(*now, *b) for b in stack]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), batch.schema, strict=True)], names)


def isotonic_blocks(df: DataFrame, score: str, y: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, lo, hi, s, n): each group's isotonic fit of y (0 or 1) on score as blocks of scores with a common mean s / n.

    Equal scores are one block from the start. Ranges of scores are pooled by themselves, and what is left of them group by group: of labels 0
    and 1 that is far fewer blocks than scores, as means must rise from block to block.
    """
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("long")).alias("s"), F.count("*").alias("n"))
    cells = cells.select(*by, "lo", F.col("lo").alias("hi"), "s", "n")
    names, order = cells.columns, [*by, "lo"]
    schema = f"{_kinds(cells, by)}lo double, hi double, s long, n long"
    pool = lambda rows: rows.sortWithinPartitions(*order).mapInArrow(lambda batches: _pool(batches, len(by), names), schema)
    parts = pool(cells.repartitionByRange(*order))
    return pool(parts.repartition(*by) if by else parts.repartition(1))


def isotonic_fits(df: DataFrame, score: str, y: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, xs, ys): the knots of each group's fit, the two ends of every block. A row holds a stored profile, as large as its fit has blocks; without groups
    an empty table has one of no knots."""
    b = isotonic_blocks(df, score, y, by).withColumn("m", F.col("s") / F.col("n"))
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    knots = b.select(*by, F.explode(ends).alias("x"), "m").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "m"))).alias("k"))
    return knots.select(*by, F.col("k.x").alias("xs"), F.col("k.m").alias("ys"))


def interpolated(df: DataFrame, score: str, fits: DataFrame, by: list[str] = [], name: str = "calibrated") -> DataFrame:  # noqa: B006
    """Adds the fitted value of the row's group: a straight line between knots, the ends beyond them; null where a group has no fit. Profiles go to all tasks, one a group."""
    table = {tuple(r[c] for c in by): (np.array(r["xs"], dtype=float), np.array(r["ys"], dtype=float)) for r in fits.collect() if r["xs"]}

    @F.pandas_udf("double")
    def between(z: pd.Series, groups: pd.DataFrame) -> pd.Series:
        out, value = np.full(len(z), np.nan), z.to_numpy(dtype=float)
        for key, at in groups.groupby(list(groups.columns), sort=False, dropna=False).indices.items() if by else [((), np.arange(len(z)))]:
            found = table.get(tuple(x.item() if hasattr(x, "item") else x for x in (key if isinstance(key, tuple) else (key,))))
            if found is not None:
                out[at] = np.clip(np.interp(value[at], *found), 0.0, 1.0)
        return pd.Series(out).where(z.notna().to_numpy() & ~np.isnan(out))

    groups = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))
    fitted = between(F.col(score).cast("double"), groups)
    return df.withColumn(name, F.when(~F.isnan(fitted), fitted))


def _losses(grouped: DataFrame, by: list[str], grids: dict[tuple, np.ndarray]) -> DataFrame:
    """(by, k, loss): of each group the log loss at each temperature of its grid. A task adds up vectors and gives a row for each temperature."""
    schema = f"{_kinds(grouped, by)}k int, loss double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [f.type for f in batch.schema][: len(by)]
            z, y, n = (batch.column(len(by) + k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(by))], strict=True)) if by else [()] * len(z)
            for key, at in pd.Series(range(len(z))).groupby(pd.Series(keys, dtype=object), sort=False).indices.items():
                grid = grids[key]
                for low in range(0, len(at), PIECE):
                    some = at[low : low + PIECE]
                    p = np.clip(1 / (1 + np.exp(-np.clip(z[some, None] / grid, -30, 30))), 1e-7, 1 - 1e-7)
                    loss = -(n[some, None] * np.log(np.where(y[some, None] == 1, p, 1 - p))).sum(0)
                    sums[key] = sums[key] + loss if key in sums else loss
        for key, loss in sums.items():
            own = [pa.array([v] * len(loss), t) for v, t in zip(key, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(range(len(loss)), pa.int32()), pa.array(loss)], [*by, "k", "loss"])

    return grouped.mapInArrow(work, schema)


def fit_temperatures(df: DataFrame, z: str, y: str, by: list[str] = [], lo: float = COLDEST, hi: float = HOTTEST, n: int = GRID, fine: int = FINE) -> DataFrame:  # noqa: B006
    """(by, temperature): of each group the temperature of least mean log loss on a grid, then on a finer one around it; of equal losses the lower.

    Equal scores are counted first. Groups are few (folds, sites): their grids go to all tasks. One row at least comes back without groups: 1.0 without rows.
    """
    cells = df.where(F.col(z).isNotNull()).groupBy(*by, F.col(z).cast("double").alias("_z"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    grouped = written(cells, "temperature")
    keys = [tuple(r) for r in grouped.select(*by).distinct().collect()] if by else [()]

    def best(grids: dict[tuple, np.ndarray]) -> dict[tuple, float]:
        total = _losses(grouped, by, grids).groupBy(*by, "k").agg(F.round(F.sum("loss"), 6).alias("loss"))
        found = total.groupBy(*by).agg(F.min_by("k", F.struct("loss", "k")).alias("k")).collect()  # a row for each group
        return {tuple(r[c] for c in by): float(grids[tuple(r[c] for c in by)][r["k"]]) for r in found if r["k"] is not None}

    line = lambda a, b, steps: a + np.arange(steps) * ((b - a) / (steps - 1))
    first, step = best({k: line(lo, hi, n) for k in keys}), (hi - lo) / n
    last = best({k: line(max(lo, t - step), min(hi, t + step), fine) for k, t in first.items()}) if first else {}
    rows = [(*k, t) for k, t in last.items()] or ([] if by else [(1.0,)])
    return df.sparkSession.createDataFrame(rows, f"{_kinds(df, by)}temperature double")
