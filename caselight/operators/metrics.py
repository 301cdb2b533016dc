"""Screening metrics over labelled scores: exact curves by two-level prefix sums, thresholds, calibration, abstention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.columns import logit_c, sigmoid_c
from caselight.operators.fits import fit_temperatures
from caselight.operators.order import quantiles
from caselight.operators.store import written

#: Ranges of scores that are sorted on their own; None: as many as the session shuffles to.
RANGES: int | None = None


def confusion(df: DataFrame, y: str, score: str, threshold: float | Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts at score >= threshold and the rates; a rate without cases is null."""
    call, pos = F.col(score) >= threshold, F.col(y) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(call & pos).alias("tp"), F.count_if(call & ~pos).alias("fp"), F.count_if(~call & ~pos).alias("tn"), F.count_if(~call & pos).alias("fn")
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *by, "tp", "fp", "tn", "fn", F.try_divide(tp + fn, tp + fp + tn + fn).alias("prevalence"), F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"), F.try_divide(tp, tp + fp).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"),
    )


def prefix_sums(df: DataFrame, order: str, values: list[str], by: list[str] = [], ranged: bool = False) -> DataFrame:  # noqa: B006
    """Per distinct value of `order`, descending: the sums of values there and, as cum_*, at it and above.

    Distinct values are dealt out by ranges of (by, order), as many as the session shuffles to, and stored; ranges get offsets from their
    sums and are sorted on their own, so that no single task sorts the whole table or a large group.
    """
    distinct = df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(*[F.sum(v).alias(v) for v in values])
    ranged_rows = distinct.repartitionByRange(*([RANGES] if RANGES else []), *by, order)
    rows = written(ranged_rows.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy(*by, "_range").agg(*[F.sum(v).alias("_" + v) for v in values])
    above = W.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*by, "_range", *[F.coalesce(F.sum("_" + v).over(above), F.lit(0)).alias("_" + v) for v in values])
    inside = W.partitionBy(*by, "_range").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    found = rows.join(offsets, [*by, "_range"]).select(*by, "_range", order, *values, *[(F.sum(v).over(inside) + F.col("_" + v)).alias("cum_" + v) for v in values])
    return found if ranged else found.drop("_range")


def _marks(df: DataFrame, y: str) -> DataFrame:
    return df.withColumn("pos", (F.col(y) == 1).cast("long")).withColumn("neg", (F.col(y) != 1).cast("long"))


def auroc(df: DataFrame, y: str, score: str, by: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """(by, auroc, auprc): by ranks with ties shared, and average precision; null with one class. Rows may have weights."""
    marked = _marks(df, y)
    if weight:
        marked = marked.withColumns({c: F.col(c) * F.col(weight) for c in ("pos", "neg")})
    sums = prefix_sums(marked, score, ["pos", "neg"], by)
    won = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    total = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    precision = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return sums.groupBy(*by).agg(F.try_divide(won, total[0] * total[1]).alias("auroc"), F.when(total[1] > 0, F.try_divide(precision, total[0])).alias("auprc"))


def screening_metrics(df: DataFrame, y: str, score: str, threshold: float | Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, tp, fp, tn, fn, prevalence, sensitivity, specificity, ppv, npv, auroc, auprc) at score >= threshold; what has no cases, or one class only, is null."""
    counts, areas = confusion(df, y, score, threshold, by), auroc(df, y, score, by)
    return counts.join(areas, by) if by else counts.crossJoin(F.broadcast(areas))  # a row each


def roc_points(df: DataFrame, y: str, score: str, drop: bool = True, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, threshold, fpr, tpr, fps, tps): without points on a straight line between neighbours, after a first point (0, 0, inf)."""
    sums = prefix_sums(_marks(df, y), score, ["pos", "neg"], by, ranged=True)
    sums = sums.select(*by, "_range", F.col(score).cast("double").alias("threshold"), F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))
    if drop:
        # Neighbours come from the own range; at its ends from the last and first rows of the ranges beside it, one row a range.
        point = F.struct("fps", "tps")
        ends = sums.groupBy(*by, "_range").agg(F.max_by(point, "threshold").alias("top"), F.min_by(point, "threshold").alias("bottom"))
        order = W.partitionBy(*by).orderBy(F.desc("_range"))  # over a row for each range
        ends = ends.select(*by, "_range", F.lag("bottom").over(order).alias("above"), F.lead("top").over(order).alias("below"))
        own = W.partitionBy(*by, "_range").orderBy(F.desc("threshold"))
        near = sums.join(ends if by else F.broadcast(ends), [*by, "_range"])
        near = near.withColumn("above", F.coalesce(F.lag(point).over(own), "above")).withColumn("below", F.coalesce(F.lead(point).over(own), "below"))
        bend = lambda c: F.col("below")[c] - F.col(c) != F.col(c) - F.col("above")[c]
        sums = near.where(F.coalesce(bend("fps") | bend("tps"), F.lit(True)))
    sums = sums.select(*by, "threshold", "tps", "fps")
    top = sums.groupBy(*by).agg(F.max("tps").alias("p"), F.max("fps").alias("n"))
    start = [F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps")]
    points = top.where("p is not null").select(*by, *start).unionByName(sums)
    joined = points.join(top, by) if by else points.crossJoin(F.broadcast(top))
    return joined.select(*by, "threshold", F.try_divide("fps", "n").alias("fpr"), F.try_divide("tps", "p").alias("tpr"), "fps", "tps")


def threshold_at_sensitivity(df: DataFrame, y: str, score: str, target: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, threshold): of points with tpr >= target the least fpr, then the highest threshold; 0.5 without positives."""
    best = F.min_by("threshold", F.struct("fpr", -F.col("threshold")))
    reached = F.col("tpr") >= target - 1e-12
    if not by:
        return roc_points(df, y, score).where(reached).agg(F.coalesce(best, F.lit(0.5)).alias("threshold"))
    known = roc_points(df, y, score, by=by).where(reached).groupBy(*by).agg(best.alias("threshold"))
    return df.select(*by).distinct().join(known, by, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def youden(df: DataFrame, y: str, score: str) -> DataFrame:
    points = roc_points(df, y, score).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return points.agg(F.least(F.coalesce(F.max_by("threshold", F.struct("j", "threshold")), F.lit(0.5)), F.lit(1.0)).alias("threshold"))


def bin_index(p: Column, bins: int) -> Column:
    """The bin (lo, hi] of p by edges i * (1 / bins); 0 falls in none."""
    edges = F.array(*[F.lit(k * (1.0 / bins)) for k in range(bins)] + [F.lit(1.0)])
    found = F.size(F.filter(edges, lambda e: e < p)) - 1
    return F.when((found >= 0) & (found < bins), found)


def ece(df: DataFrame, y: str, prob: str, bins: int = 15, by: list[str] = []) -> DataFrame:  # noqa: B006
    table = df.groupBy(*by, bin_index(F.col(prob), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(prob).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"))
    return table.groupBy(*by).agg((F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sy")))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, y: str, prob: str, bins: int = 10) -> DataFrame:
    """A row for each bin, empty ones too."""
    found = df.groupBy(bin_index(F.col(prob), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    label = F.format_string("(%.1f, %.1f]", F.col("bin") / float(bins), (F.col("bin") + 1) / float(bins))
    return all_bins.join(found, "bin", "left").select("bin", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "observed")


def qwk(df: DataFrame, y: str, yhat: str, k: int = 5) -> DataFrame:
    """Quadratic weighted kappa from the k x k table of counts."""
    counts = df.groupBy(F.col(y).alias("a"), F.col(yhat).alias("b")).agg(F.count("*").alias("n"))  # k * k rows
    rows = counts.groupBy("a").agg(F.sum("n").alias("na"))
    cols = counts.groupBy("b").agg(F.sum("n").alias("nb"))
    w = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / float((k - 1) ** 2)
    seen = counts.agg(F.sum(w * F.col("n")).alias("seen"), F.sum("n").alias("total"))
    chance = rows.crossJoin(cols).agg(F.sum(w * F.col("na") * F.col("nb")).alias("chance"))
    return seen.crossJoin(chance).select((1 - F.try_divide(F.col("seen") * F.col("total"), F.col("chance"))).alias("qwk"))


def subgroups(df: DataFrame, y: str, score: str, threshold: float, columns: list[str], least_n: int = 30, least_pos: int = 10) -> DataFrame:
    """Metrics of each value of each present column at the shared threshold; null groups are left out."""
    present = [c for c in columns if c in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("group")) for c in present]))
    long = df.select(y, score, pairs.alias("g")).select(y, score, "g.attribute", "g.group").where(F.col("group").isNotNull())
    by = ["attribute", "group"]
    found = confusion(long, y, score, threshold, by).join(auroc(long, y, score, by), by)
    n, pos = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.col("tp") + F.col("fn")
    return found.select(*by, n.alias("n"), pos.alias("positives"), "sensitivity", "specificity", "auroc", ((n < least_n) | (pos < least_pos)).alias("underpowered"))


def fit_temperature(df: DataFrame, z: str, y: str) -> DataFrame:
    """(temperature): least mean log loss on a grid, then on a finer one around it."""
    return fit_temperatures(df, z, y)


def abstention_bands(df: DataFrame, prob: str, threshold: float, coverages: list[float]) -> DataFrame:
    """(coverage, low, high): the band around the threshold outside which that share of cases lies."""
    clipped = max(1e-7, min(1 - 1e-7, threshold))
    at = F.lit(math.log(clipped / (1 - clipped)))
    shares = {1 - c: c for c in coverages}
    away = written(df.select(F.abs(logit_c(F.col(prob)) - at).alias("away")), "away")  # each count of ranges reads it
    cuts = quantiles(away, "away", list(shares), name="cut")
    coverage = F.create_map(*[F.lit(float(x)) for pair in shares.items() for x in pair])[F.col("fraction")]
    rows = cuts.select("cut", coverage.alias("coverage"))
    edge = lambda sign: F.when(F.col("coverage") >= 1, F.lit(threshold)).otherwise(sigmoid_c(at + sign * F.col("cut")))
    return rows.select("coverage", edge(-1).alias("low"), edge(1).alias("high"))


def abstention_curve(df: DataFrame, y: str, prob: str, threshold: float, source: DataFrame, coverages: list[float]) -> DataFrame:
    """Bands from source, measured on df: a case is kept if it lies outside the band or on its edge."""
    bands = abstention_bands(source, prob, threshold, coverages)
    kept = (F.col(prob) <= F.col("low")) | (F.col(prob) >= F.col("high"))
    call, pos = F.col(prob) >= threshold, F.col(y) == 1
    found = df.select(y, prob).crossJoin(F.broadcast(bands)).groupBy("coverage", "low", "high").agg(
        F.count("*").alias("n"), F.count_if(kept).alias("retained"), F.count_if(kept & pos).alias("p"), F.count_if(kept & ~pos).alias("q"),
        F.count_if(kept & pos & call).alias("tp"), F.count_if(kept & ~pos & ~call).alias("tn"),
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return found.select(
        "coverage", "low", "high", (F.col("retained") / F.col("n")).alias("actual"), "retained", (F.col("n") - F.col("retained")).alias("referred"),
        F.when(both, F.col("tp") / F.col("p")).alias("sensitivity"), F.when(both, F.col("tn") / F.col("q")).alias("specificity"), F.when(both, F.col("p") - F.col("tp")).alias("missed"),
    )


def rates(preds: DataFrame, latest: DataFrame, by: list[str]) -> DataFrame:
    """By group: shares of decisions, mean probability, and agreement of the latest verdicts."""
    joined = preds.join(latest.select("case_id", F.col("verdict").alias("latest")), "case_id", "left")
    both = F.col("latest").isin("REFER", "ROUTINE") & F.col("decision").isin("REFER", "ROUTINE")
    share = lambda c: F.avg(c.cast("double"))
    return joined.groupBy(*by).agg(
        F.count("*").alias("n"), share(F.col("decision") == "REFER").alias("refer_rate"), share(F.col("decision") == "MANUAL_REVIEW").alias("manual_rate"),
        share(F.col("gradable") == 0).alias("ungradable_rate"), F.avg("probability").alias("mean_probability"), F.count("latest").alias("reviewed"),
        F.avg(F.when(both, (F.col("latest") == F.col("decision")).cast("double"))).alias("agreement"),
    )


def max_false_reject_threshold(df: DataFrame, reject: str, score: str, share: float) -> DataFrame:
    """(threshold, strict): the lowest cut that rejects at most that share of accepted items; strict: only scores above it are rejected."""
    accepted = df.where(F.col(reject) == 0).withColumn("one", F.lit(1).cast("long"))
    n = accepted.agg(F.count("*").alias("n"))
    sums = prefix_sums(accepted, score, ["one"]).crossJoin(F.broadcast(n))
    allowed = F.floor(F.lit(share) * F.col("n"))
    over = F.max(F.when(F.col("cum_one") > allowed, F.col(score)))
    return sums.agg(F.coalesce(over, F.min(score), F.lit(0.5)).alias("threshold"), over.isNotNull().alias("strict"))
