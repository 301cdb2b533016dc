"""Evaluation of gates and reasons, resampling with metrics given as functions, and logged rows beside their records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.columns import hash_uniform, norm_path
from caselight.operators import metrics as M
from caselight.operators.calibration import poisson_weight
from caselight.operators.gates import problem_probability

#: Equal steps of a score between its least and its largest value; a resampled area is taken over them.
STEPS = 200


def gate_validation(items: DataFrame, label: str, reject_values: list[str], seen: DataFrame, readable: Column) -> DataFrame:
    """One row: how a gate agrees with human rejections. items: filename, gradable, p_ungradable. seen: filenames that the model was trained on.

    Labels are compared as text. Excluded and unreadable items count on their own; rates without cases are null.
    """
    rows = items.withColumn("_path", norm_path(F.col("filename"))).withColumn("_readable", F.coalesce(readable, F.lit(False)))
    known = seen.select(norm_path(F.col("filename")).alias("_path")).distinct().withColumn("_seen", F.lit(True))
    rows = rows.join(known, "_path", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    human = F.coalesce(F.col(label).cast("string").isin(reject_values), F.lit(False)).cast("int")
    rows = rows.withColumn("_human", human).withColumn("_gate", (~F.coalesce("gradable", F.lit(False))).cast("int"))
    used, rej, gate = ~F.col("_seen") & F.col("_readable"), F.col("_human") == 1, F.col("_gate") == 1
    n = rows.agg(
        F.count_if("_seen").alias("excluded"), F.count_if(~F.col("_seen") & ~F.col("_readable")).alias("unreadable"), F.count_if(used).alias("n_items"), F.count_if(used & rej).alias("n_human_reject"),
        F.count_if(used & ~rej).alias("n_human_accept"), F.count_if(used & rej & gate).alias("_tp"), F.count_if(used & ~rej & gate).alias("false_rejects"),
    )
    area = M.auroc(rows.where(used), "_human", "p_ungradable").select("auroc")
    return n.crossJoin(area).select(
        "excluded", "unreadable", "n_items", "n_human_reject", "n_human_accept", F.try_divide("_tp", "n_human_reject").alias("catch_rate"), (F.col("n_human_reject") - F.col("_tp")).alias("missed_rejects"),
        F.try_divide("false_rejects", "n_human_accept").alias("false_reject_rate"), "false_rejects", "auroc",
    )


def predicted_level(logits: Column) -> Column:
    """How many of the logits say "better than this level"."""
    return F.size(F.filter(logits, lambda z: z > 0))


def subscore_metrics(df: DataFrame, specs: dict[str, tuple[str, str, int, int]], threshold: float) -> DataFrame:
    """A row for each sub-score (name: level column, logits column, number of levels, how many of the worst are a problem), over rows whose level is known (0 or more)."""
    one = lambda name, level, logits, k, bad: F.struct(
        F.lit(name).alias("subscore"), F.col(level).cast("int").alias("level"), predicted_level(F.col(logits)).alias("guess"), (F.col(level) < bad).cast("int").alias("problem"),
        problem_probability(F.col(logits), bad).alias("p"), F.lit(k).alias("k"),
    )
    long = df.select(F.inline(F.array(*[one(name, *spec) for name, spec in specs.items()]))).where("level >= 0")
    by, gap = ["subscore"], lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    cells = long.groupBy("subscore", "k", "level", "guess").agg(F.count("*").alias("n"))  # k * k rows each
    seen = cells.groupBy("subscore").agg(F.sum(gap("level", "guess") * F.col("n")).alias("seen"), F.sum("n").alias("n"), F.sum(F.when(F.col("level") == F.col("guess"), F.col("n")).otherwise(0)).alias("same"))
    margin = lambda c, name: cells.groupBy("subscore", c).agg(F.sum("n").alias(name))
    chance = margin("level", "na").join(margin("guess", "nb"), "subscore").groupBy("subscore").agg(F.sum(gap("level", "guess") * F.col("na") * F.col("nb")).alias("chance"))
    rates = M.confusion(long, "problem", "p", threshold, by).join(M.auroc(long, "problem", "p", by), by)
    j = rates.join(seen, by).join(chance, by)
    kappa = 1 - F.try_divide(F.col("seen").cast("double") * F.col("n"), F.col("chance"))
    return j.select("subscore", "n", (F.col("tp") + F.col("fn")).alias("n_problem"), "auroc", "sensitivity", "specificity", kappa.alias("weighted_kappa"), F.try_divide("same", "n").alias("exact_agreement"))


Metrics = Callable[[Callable[[str], Column]], dict[str, Column]]


def bootstrap(df: DataFrame, cluster: str, sums: dict[str, Column], metrics: Metrics, replicates: int = 1000, alpha: float = 0.05, seed: str = "boot") -> DataFrame:
    """(metric, point, low, high, n_boot) of metrics that are functions of sums over rows, resampling clusters.

    metrics gets a function from a sum's name to its column and returns named columns. Rows are summed by cluster first;
    replicates without a value are left out, and n_boot counts the others.
    """
    totals = df.groupBy(cluster).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    spread = totals.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, cluster)
    each = spread.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(hash_uniform(seed, F.col(cluster), F.col("r")))).where("w > 0")
    drawn = each.groupBy("r").agg(*[F.sum(F.col(name) * F.col("w")).alias(name) for name in sums])
    long = lambda rows, v: rows.select(F.explode(F.create_map(*[x for k, c in metrics(F.col).items() for x in (F.lit(k), c.cast("double"))])).alias("metric", v))
    return _interval(long(totals.agg(*[F.sum(name).alias(name) for name in sums]), "point"), long(drawn, "v"), alpha)


def _interval(point: DataFrame, drawn: DataFrame, alpha: float) -> DataFrame:
    cuts = drawn.groupBy("metric").agg(F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.count("v").alias("n_boot"))
    return point.join(cuts, "metric").select("metric", "point", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), "n_boot")


def bootstrap_auroc(df: DataFrame, y: str, score: str, cluster: str, replicates: int = 200, alpha: float = 0.05, seed: str = "boot") -> DataFrame:
    """(metric, point, low, high, n_boot) of the area under the ROC curve, resampling clusters. The point is exact.

    Replicates take scores in STEPS equal steps, so that a cluster is at most that many counts whatever its rows, and a
    replicate that many sums; equal steps count as ties.
    """
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    step = F.least(F.lit(STEPS - 1), F.floor(F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * STEPS)).cast("int")
    rows = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(ends)).select(F.col(cluster).alias("c"), F.coalesce(step, F.lit(0)).alias("step"), (F.col(y) == 1).cast("long").alias("pos"))
    counts = rows.groupBy("c", "step").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    clusters = counts.groupBy("c").agg(F.collect_list(F.struct("step", "pos", "neg")).alias("cells"))
    spread = clusters.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "c")
    each = spread.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(hash_uniform(seed, F.col("c"), F.col("r")))).where("w > 0")
    sums = each.select("r", "w", F.inline("cells")).groupBy("r", "step").agg(F.sum(F.col("pos") * F.col("w")).alias("pos"), F.sum(F.col("neg") * F.col("w")).alias("neg"))
    cells = sums.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("step", "pos", "neg"))).alias("cells"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(0.0).alias("won"))
    won = F.aggregate("cells", start, lambda a, x: F.struct((a["below"] + x["neg"]).alias("below"), (a["won"] + x["pos"] * (a["below"] + x["neg"] / 2.0)).alias("won")))["won"]
    drawn = cells.select(F.lit("auroc").alias("metric"), F.try_divide(won, F.col("p").cast("double") * F.col("n")).alias("v"))
    return _interval(M.auroc(df, y, score).select(F.lit("auroc").alias("metric"), F.col("auroc").alias("point")), drawn, alpha)


def gated(df: DataFrame, *gates: Callable[[DataFrame], Column]) -> DataFrame:
    """Adds reasons and gradable. A gate is any function from the rows to an array of reasons, empty or null if it has none; each may reject, none overrules another."""
    reasons = F.flatten(F.array(*[F.coalesce(gate(df), F.array().cast("array<string>")) for gate in gates])) if gates else F.array().cast("array<string>")
    return df.withColumn("reasons", reasons).withColumn("gradable", F.size("reasons") == 0)


def record_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a row's columns as JSON, nulls included, in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def check_records(log: DataFrame, tables: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """(seq, action, problem): entries whose stored row is missing or has another hash. log: seq, action, record_sha256.

    tables names for each action the stored rows (their hash in record_sha256), their key and how an entry refers to it.
    """
    out = None
    for action, (rows, key, entry_key) in tables.items():
        stored = rows.select(F.col(key).cast("string").alias("_key"), F.col("record_sha256").alias("_now"), F.lit(True).alias("_found"))
        j = log.where(F.col("action") == action).withColumn("_key", entry_key.cast("string")).join(stored, "_key", "left")
        bad = j.where(F.col("_found").isNull() | ~F.col("record_sha256").eqNullSafe(F.col("_now")))
        found = bad.select("seq", "action", F.when(F.col("_found").isNull(), "row missing").otherwise("row altered").alias("problem"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no tables")
    return out
