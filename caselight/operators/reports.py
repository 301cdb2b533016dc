"""Reports over decided cases, gates, grades, periods and folds, and checks that stop a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.operators import calibration as K
from caselight.operators import metrics as M
from caselight.operators import resampling as S
from caselight.operators.order import median, quantiles
from caselight.operators.store import written

#: Fixed values of the monitoring window, in days: the recent part, the whole, and what the whole is clamped to.
RECENT, WINDOW, CLAMP = 28, 90, (7, 730)


def ops_summary(outcomes: DataFrame) -> DataFrame:
    """One row of totals over outcomes with their latest verdict, decision, gradable and latency_ms; the median latency is 0 without cases."""
    call = ("REFER", "ROUTINE")
    both = F.col("latest").isin(*call) & F.col("decision").isin(*call)
    of = lambda x: F.count_if(F.col("decision") == x)
    totals = outcomes.agg(
        F.count("*").alias("total"), of("REFER").alias("refer"), of("ROUTINE").alias("routine"), of("MANUAL_REVIEW").alias("manual"),
        F.count_if(F.col("gradable") == 0).alias("ungradable"), F.count("latest").alias("reviewed"),
        F.avg(F.when(both, (F.col("latest") == F.col("decision")).cast("double"))).alias("agreement"),
    )
    middle = median(outcomes, "latency_ms").agg(F.coalesce(F.max("median"), F.lit(0.0)).alias("median_latency"))
    return totals.crossJoin(F.broadcast(middle))  # a row each


def served_summary(df: DataFrame, y: str = "y", decision: str = "decision", probability: str = "probability") -> DataFrame:
    """One row: how many cases each decision has, the share decided without a person, and of those the sensitivity and specificity."""
    d, auto, pos = F.col(decision), F.col(decision) != "MANUAL_REVIEW", F.col(y) == 1
    manual = d == "MANUAL_REVIEW"
    s = df.agg(
        F.count("*").alias("n"), F.count_if(d == "REFER").alias("refer"), F.count_if(d == "ROUTINE").alias("routine"), F.count_if(manual).alias("manual"),
        F.count_if(manual & F.col(probability).isNull()).alias("by_gate"), F.count_if(manual & F.col(probability).isNotNull()).alias("by_band"),
        F.count_if(auto & pos).alias("auto_pos"), F.count_if(auto & ~pos).alias("auto_neg"),
        F.count_if((d == "ROUTINE") & pos).alias("missed"), F.count_if((d == "REFER") & ~pos).alias("false_referrals"),
    )
    share = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(a).cast("double"))
    return s.select(
        "n", "refer", "routine", "manual", "by_gate", "by_band", F.try_divide(F.col("n") - F.col("manual"), F.col("n").cast("double")).alias("coverage"),
        share("auto_pos", "missed").alias("sensitivity"), share("auto_neg", "false_referrals").alias("specificity"), "missed", "false_referrals",
    )


def metric_percentiles(df: DataFrame, metrics: list[str], by: list[str], at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(metric, by, n, p5, ...) with straight lines between ranks; values that are null, NaN or no numbers don't count."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").try_cast("double").alias("value")) for m in metrics])
    long = df.select(*by, F.explode(pairs).alias("m")).select(*by, "m.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    n = long.groupBy("metric", *by).agg(F.count("*").alias("n"))
    q = quantiles(long, "value", list(at), ["metric", *by]).groupBy("metric", *by).agg(*[F.max(F.when(F.col("fraction") == x, F.col("value"))).alias(f"p{round(100 * x)}") for x in at])
    keys = ["metric", *by]
    same = [n[c].eqNullSafe(q[c]) for c in keys]
    return n.join(q, same).select(*[n[c] for c in keys], "n", *[f"p{round(100 * x)}" for x in at])


def gate_metrics(df: DataFrame, reject: str, score: str, threshold: float) -> DataFrame:
    """One row: what a gate that rejects at score >= threshold catches, misses and rejects wrongly, and its AUROC."""
    c = M.confusion(df, reject, score, threshold).crossJoin(M.auroc(df, reject, score))
    wrong = F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_reject_rate")
    return c.select(F.col("tp").alias("caught"), F.col("fn").alias("missed"), F.col("fp").alias("false_rejects"), F.col("sensitivity").alias("catch_rate"), wrong, "auroc")


def gate_compare(df: DataFrame, reject: str, score: str, threshold: float, sharpness: str, least: float) -> DataFrame:
    """(gate, caught, false_rejects, catch_rate, false_reject_rate, auroc) of the learnt gate and of low sharpness, on the same items."""
    both = df.where(F.col(score).isNotNull() & F.col(sharpness).isNotNull()).withColumn("_low", -F.col(sharpness))
    keep = ["caught", "false_rejects", "catch_rate", "false_reject_rate", "auroc"]
    learnt = gate_metrics(both, reject, score, threshold).select(F.lit("learned").alias("gate"), *keep)
    # Sharpness below the least: -sharpness above -least, so equal values must not be rejected.
    strict = both.withColumn("_call", (F.col(sharpness) < least).cast("double"))
    c = M.confusion(strict, reject, "_call", 1.0).crossJoin(M.auroc(both, reject, "_low"))
    wrong = F.try_divide("fp", F.col("fp") + F.col("tn")).alias("false_reject_rate")
    plain = c.select(F.lit("classical").alias("gate"), F.col("tp").alias("caught"), F.col("fp").alias("false_rejects"), F.col("sensitivity").alias("catch_rate"), wrong, "auroc")
    return learnt.unionByName(plain)


def grade_distribution(df: DataFrame, grade: str = "grade", subject: str = "subject", grades: int = 5, referable: int = 2) -> DataFrame:
    """A row for each grade, also empty ones: n, percent, and over all rows the percent of referable grades and the rows of a subject."""
    found = df.groupBy(F.col(grade).cast("int").alias("grade")).agg(F.count("*").alias("n"))
    each = df.sparkSession.range(grades).select(F.col("id").cast("int").alias("grade")).join(found, "grade", "left")
    whole = df.where(F.col(grade).between(0, grades - 1)).agg(F.count("*").alias("total"), F.count_if(F.col(grade) >= referable).alias("bad"), F.countDistinct(subject).alias("subjects"))
    part = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return each.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).crossJoin(F.broadcast(whole)).select(
        "grade", "n", part("n", "total").alias("percent"), part("bad", "total").alias("referable_percent"), F.try_divide(F.col("total").cast("double"), F.col("subjects")).alias("rows_per_subject")
    )


def device_rates(preds: DataFrame, latest: DataFrame) -> DataFrame:
    """rates() by device; a null device is unknown."""
    return M.rates(preds.withColumn("device", F.coalesce("device", F.lit("unknown"))), latest, ["device"])


def recent_vs_baseline(preds: DataFrame, latest: DataFrame, now: str, days: int = WINDOW, recent: int = RECENT) -> DataFrame:
    """rates() of the last `recent` days and of the rest of the last `days`, which are clamped to CLAMP; days count back from `now`."""
    end, span = F.lit(now).cast("timestamp"), min(max(days, CLAMP[0]), CLAMP[1])
    rows = preds.where((F.col("created") >= end - F.expr(f"interval {span} days")) & (F.col("created") <= end))
    period = F.when(F.col("created") >= end - F.expr(f"interval {recent} days"), "recent").otherwise("baseline")
    return M.rates(rows.withColumn("period", period), latest, ["period"])


def sample_per_grade(df: DataFrame, n: int, name: str = "case_id", grade: str = "grade", gradable: str = "gradable", ungradable: int = 2) -> DataFrame:
    """(grade, name): the first n gradable rows of each grade by name, and the first few ungradable ones with a null grade.

    Names are gathered by bounded aggregates, so no grade is sorted as a whole."""
    first = lambda k: F.slice(F.array_sort(F.collect_set(name)), 1, k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(256)))
    by = F.when(F.col(gradable) == 1, F.col(grade).cast("int")).alias("grade")
    part = salted.groupBy("_salt", by, (F.col(gradable) == 1).alias("_ok")).agg(F.slice(F.array_sort(F.collect_set(name)), 1, max(n, ungradable)).alias("names"))
    each = part.select("grade", "_ok", F.explode("names").alias(name))
    both = each.groupBy("grade", "_ok").agg(first(n).alias("a"), first(ungradable).alias("b"))
    return both.select("grade", F.explode(F.when(F.col("_ok"), F.col("a")).otherwise(F.col("b"))).alias(name))


def assert_unique(df: DataFrame, *key: str, shown: int = 6) -> DataFrame:
    """df itself; an error that names some of the keys if any occurs twice."""
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    found = twice.orderBy(*key).limit(shown).collect()
    if found:
        raise ValueError(f"{twice.count()} keys occur more than once, such as " + ", ".join("/".join(str(r[k]) for k in key) for r in found))
    return df


def assert_no_leakage(assigned: DataFrame, subject: str, split: str, shown: int = 5) -> DataFrame:
    """assigned itself; an error with their number and some examples if subjects are in more than one split."""
    both = assigned.groupBy(subject).agg(F.count_distinct(split).alias("n")).where("n > 1")
    found = both.orderBy(subject).limit(shown).collect()
    if found:
        raise ValueError(f"{both.count()} subjects are in more than one split, such as " + ", ".join(str(r[subject]) for r in found))
    return assigned


def _wide(intervals: DataFrame, names: list[str], points: list[str]) -> DataFrame:
    """One row: the points of some metrics, then the ends of the intervals of all."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return intervals.agg(*[pick(m, "point").alias(m) for m in points], *[pick(m, c).alias(f"{m}_{c}") for m in names for c in ("low", "high")], F.max("n_boot").alias("n_boot"))


def external_report(df: DataFrame, y: str, prob: str, call: str, cluster: str, gradable: str = "gradable", replicates: int = 1000) -> DataFrame:
    """One row: rates of the stored call and the AUROC, with its interval over resampled subjects, of gradable rows with a label; no row unless both classes occur."""
    known = (F.col(gradable) == 1) & F.col(y).isNotNull() & F.col(call).isNotNull()
    rows = written(df.where(known).select(*dict.fromkeys([y, prob, cluster]), F.col(call).cast("double").alias("_call")), "external")
    area = _wide(S.resample_areas(rows, y, prob, cluster, replicates, target=None), ["auroc"], ["auroc"])
    return M.confusion(rows, y, "_call", 1.0).crossJoin(area).where("tp + fn > 0 and fp + tn > 0")


def oof_report(df: DataFrame, y: str, logit: str, prob: str, threshold: str, cluster: str, replicates: int = 1000) -> DataFrame:
    """One row over out-of-fold scores: rates at each row's own threshold, the AUROC and the uncalibrated calibration error, with the intervals of the
    first three over resampled subjects."""
    rows = written(df.select(*dict.fromkeys([y, logit, prob, threshold, cluster])), "oof")
    found = K.resample_rates(rows, y, prob, F.col(threshold), cluster, replicates).unionByName(S.resample_areas(rows, y, logit, cluster, replicates, target=None))
    wide = _wide(found, ["sensitivity", "specificity", "auroc"], ["auroc"])
    counts, error = M.confusion(rows, y, prob, F.col(threshold)), M.ece(rows, y, prob)
    return counts.crossJoin(wide).crossJoin(error).select(*counts.columns, "auroc", *error.columns, *[c for c in wide.columns if c != "auroc"])


def visit_worklist(visits: DataFrame, limit: int = 100) -> DataFrame:
    """Of the newest `limit` visits: those with pending cases first, then by the urgency of their decision, the newest first."""
    rank = F.when(F.col("decision") == "MANUAL_REVIEW", 0).when(F.col("decision") == "REFER", 1).when(F.col("decision") == "INCOMPLETE", 2).when(F.col("decision") == "ROUTINE", 3).otherwise(4)
    newest = visits.orderBy(F.desc("last_utc"), "visit").limit(limit)
    return newest.orderBy((F.col("pending") > 0).desc(), rank, F.desc("last_utc"), "visit")


def visit_list(outcomes: DataFrame, decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """(visit, subject, first_utc, last_utc, cases, pending, decision), of the newest `limit` visits if one is given."""
    heads = outcomes.where(F.col("visit").isNotNull()).groupBy("visit").agg(
        F.max("subject").alias("subject"), F.min("created").alias("first_utc"), F.max("created").alias("last_utc"), F.count("*").alias("cases"), F.count_if(F.col("latest").isNull()).alias("pending")
    )
    rows = heads.join(decisions.select("visit", "decision"), "visit")
    return rows if limit is None else rows.orderBy(F.desc("last_utc"), "visit").limit(limit)


def keep_first(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds rk to the rows of groups of more than one: their place by order within the group."""
    w = W.partitionBy(group)
    return df.withColumn("rk", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")
