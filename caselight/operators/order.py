"""Exact order statistics by repeated counts of ranges: no task gathers the values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.operators.store import written

#: Parts into which a range of values is cut, and values of a range that are few enough to be ranked as they are.
PARTS, FEW = 4096, 4096
#: Rows of wanted ranks that may be sent to all tasks; beyond, rows and ranks are joined by group.
SENT = 20_000


def _near(rows: DataFrame, ranks: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows beside the wanted ranks of their group whose range they lie in. few: there are so few ranks that all tasks may get them."""
    named = ranks.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_rank", "_lo", "_hi", "_below")
    sent = F.broadcast(named) if few else named
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(sent, same & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*[f"_g{k}" for k in range(len(by))])


def _selected(rows: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, _rank, _x): the values at the wanted ranks (from 0). ranks: by, _rank, _lo, _hi, _below, _inside.

    A range is cut into PARTS equal parts, its values are counted by part, and the part that holds the rank is the next range, from its least to its
    largest value, until a range holds one value only or FEW rows. A range's ends fall into different parts, so each pass makes it smaller.
    """
    state, (number, most) = ranks, ranks.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_inside"))), F.lit(0))).first()
    sent = number <= SENT
    while most > FEW:
        wide = state.where(F.col("_lo") < F.col("_hi")).where(F.col("_inside") > FEW)
        near = _near(rows, wide, by, sent)
        part = F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * PARTS)
        part = F.when(F.col("_v") == F.col("_hi"), PARTS - 1).otherwise(F.least(F.lit(PARTS - 1), part))
        parts = near.groupBy(*by, "_rank", "_below", part.alias("_part")).agg(F.count("*").alias("_inside"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_inside").over(W.partitionBy(*by, "_rank").orderBy("_part")) - F.col("_inside") + F.col("_below")  # over PARTS rows
        found = parts.withColumn("_below", before).where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_inside")))
        rest = state.where((F.col("_lo") >= F.col("_hi")) | (F.col("_inside") <= FEW))
        state = written(rest.unionByName(found.select(*state.columns)), "ranks")
        most = state.agg(F.coalesce(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_inside"))), F.lit(0))).first()[0]
    one = state.where(F.col("_lo") >= F.col("_hi")).select(*by, "_rank", F.col("_lo").alias("_x"))
    few = _near(rows, state.where(F.col("_lo") < F.col("_hi")), by, sent)
    at = F.row_number().over(W.partitionBy(*by, "_rank").orderBy("_v")) - 1 + F.col("_below")  # over FEW rows
    return one.unionByName(few.withColumn("_at", at).where(F.col("_at") == F.col("_rank")).select(*by, "_rank", F.col("_v").alias("_x")))


def quantiles(df: DataFrame, value: str | Column, fractions: list[float], by: list[str] = [], name: str = "value") -> DataFrame:  # noqa: B006
    """(by, fraction, value): quantiles with straight lines between ranks, exactly as a sort of each group would give them.

    Null and NaN values don't count; a group without any has no row. A null group is a group. Ties and repeated rows count each time.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    asked = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    wanted = written(groups.withColumn("fraction", asked).withColumn("_place", (F.col("_n") - 1) * F.col("fraction")), "wanted")
    low, high = F.floor("_place").cast("long"), F.ceil("_place").cast("long")
    ranks = wanted.select(*by, F.explode(F.array(low, high)).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside")).distinct()
    found = _selected(rows, ranks, by)
    own = wanted.withColumns({"_rank": F.explode(F.array_distinct(F.array(low, high)))})
    weight = F.when(low == high, F.lit(1.0)).when(F.col("_rank") == low, high - F.col("_place")).otherwise(F.col("_place") - low)
    other = found.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], F.col("_rank").alias("_r"), "_x")
    same = F.col("_rank") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return own.join(other, same).groupBy(*by, "fraction").agg(F.sum(weight * F.col("_x")).alias(name))


def median(df: DataFrame, value: str | Column, by: list[str] = [], name: str = "median") -> DataFrame:  # noqa: B006
    return quantiles(df, value, [0.5], by, name).drop("fraction")
