"""Calibration of scores: isotonic fits, the choice of a method, storable profiles, sites, cross-fits, and resampling of subjects."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.columns import apply_temperature, hash_uniform, sigmoid
from caselight.operators import metrics as M
from caselight.operators import resampling as R
from caselight.operators.fits import fit_temperatures, interpolated, isotonic_fits
from caselight.operators.store import written
from caselight.operators.tables import hash_ranks

#: The least rows of a held-out part, its share, and how calibrators are tried, in the order that decides ties.
LEAST_HELD, HELD_SHARE, METHODS = 20, 0.3, ("identity", "temperature", "isotonic")
#: The distribution function of a Poisson variable of mean one.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def fit_isotonic(df: DataFrame, score: str, y: str) -> IsotonicRegressionModel:
    """The isotonic fit of y on score. Equal scores are pooled first, so only distinct scores with their means and counts are fitted."""
    pooled = df.groupBy(F.col(score).cast("double").alias("features")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(pooled)


def apply_isotonic(df: DataFrame, score: str, model: IsotonicRegressionModel, name: str = "calibrated") -> DataFrame:
    """Adds the fitted value: a straight line between knots, the ends beyond them, within [0, 1]."""
    own = df.withColumn("_score", F.col(score).cast("double"))
    fitted = model.copy({model.featuresCol: "_score", model.predictionCol: name}).transform(own).drop("_score")
    return fitted.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name))))


def knots(model: IsotonicRegressionModel) -> tuple[list[float], list[float]]:
    """The scores and fitted values that a stored profile holds."""
    return model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()


def holdout(df: DataFrame, key: str, share: float = HELD_SHARE, seed: str = "holdout") -> tuple[DataFrame, DataFrame]:
    """(fit, held) parts by a hash of the key."""
    u = hash_uniform(seed, F.col(key))
    return df.where(u >= share), df.where(u < share)


def _degenerate(fit: DataFrame, held: DataFrame, y: str) -> bool:
    count = lambda d: d.agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("p")).first()
    a, b = count(fit), count(held)
    return b.n < LEAST_HELD or not b.p or not a.p


def select_calibrator(fit: DataFrame, held: DataFrame, z: str, y: str) -> DataFrame:
    """(method, ece, chosen): fitted on one part, measured on the other; of equals identity before temperature before isotonic.

    With fewer than LEAST_HELD rows held out, or a part without positives, temperature is chosen, and nothing is measured.
    """
    if _degenerate(fit, held, y):
        return fit.sparkSession.createDataFrame([(m, None, m == "temperature") for m in METHODS], "method string, ece double, chosen boolean")
    return _tried(held, z, y, M.fit_temperature(fit, z, y), isotonic_fits(fit, z, y))


def _tried(held: DataFrame, z: str, y: str, warm: DataFrame, fits: DataFrame) -> DataFrame:
    """(method, ece, chosen) of calibrators that are fitted already."""
    p = held.withColumn("_identity", sigmoid(F.col(z))).crossJoin(F.broadcast(warm)).withColumn("_temperature", apply_temperature(F.col(z), F.col("temperature")))
    p = interpolated(p, z, fits, name="_isotonic")
    arms = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(m).alias("method"), F.col(f"_{m}").alias("p")) for k, m in enumerate(METHODS)])
    found = M.ece(p.select(F.col(y).alias("y"), F.explode(arms).alias("m")).select("y", "m.*"), "y", "p", by=["rank", "method"])
    best = found.agg(F.min_by("method", F.struct(F.round("ece", 9), F.col("rank"))).alias("best"))
    return found.crossJoin(F.broadcast(best)).select("method", "ece", (F.col("method") == F.col("best")).alias("chosen"))


PROFILE = "method string, temperature double, isotonic_x array<double>, isotonic_y array<double>, held_out_ece double, threshold double, band_low double, band_high double, n long, positives long, fingerprint string"


def fit_profile(df: DataFrame, key: str, z: str, y: str, target: float = 0.9, coverage: float = 0.85, seed: str = "holdout") -> DataFrame:
    """One storable row (PROFILE) fitted on df: the calibrator with the least held-out error, its parameters, the operating point at
    the target sensitivity and the abstention band of calibrated probabilities, the sizes, and a fingerprint of the rows used."""
    spark = df.sparkSession
    rows = written(df.select(*dict.fromkeys([key, z, y]), (hash_uniform(seed, F.col(key)) < HELD_SHARE).alias("_held")), "profile-rows")  # what follows reads it many times
    fit, held = rows.where("not _held"), rows.where("_held")
    whole = _degenerate(fit, held, y)
    warm = M.fit_temperature(rows if whole else fit, z, y)
    temperature = warm.first()[0]
    method, error, xs, ys = "temperature", None, [], []
    if not whole:
        xs, ys = isotonic_fits(fit, z, y).first()
        fits = spark.createDataFrame([(xs, ys)], "xs array<double>, ys array<double>")
        method, error = _tried(held, z, y, warm, fits).where("chosen").select("method", "ece").first()
    stored = spark.createDataFrame([(method, temperature, xs, ys)], "method string, temperature double, isotonic_x array<double>, isotonic_y array<double>")
    p = written(calibrated(rows, z, stored, "_p").select(y, "_p"), "profile-scores")
    cut = M.threshold_at_sensitivity(p, y, "_p", target).first()[0]
    band = M.abstention_bands(p, "_p", min(max(cut, 1e-6), 1 - 1e-6), [coverage]).first()
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("p"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(F.xxhash64(F.col(key).cast("string"), F.col(y)))), 256).alias("f")).first()
    return spark.createDataFrame([(method, temperature, xs, ys, error, cut, band.low, band.high, size.n, size.p, size.f)], PROFILE)


def calibrated(df: DataFrame, z: str, stored: DataFrame, name: str = "calibrated") -> DataFrame:
    """Adds the probability that a stored profile (one row) gives: by isotonic knots, by its temperature, or as the model has it. Knots go to the tasks once, not with
    every row."""
    own = stored.select("method", "temperature").first()
    if own.method == "isotonic":
        return interpolated(df, z, stored.select(F.col("isotonic_x").alias("xs"), F.col("isotonic_y").alias("ys")), name=name)
    return df.withColumn(name, apply_temperature(F.col(z), F.lit(own.temperature).cast("double")) if own.method == "temperature" else sigmoid(F.col(z)))


def profile(df: DataFrame, z: str, y: str, target: float = 0.9) -> DataFrame:
    """(temperature, threshold): one row, fitted on df."""
    return M.fit_temperature(df, z, y).crossJoin(M.threshold_at_sensitivity(df, y, z, target))


def profile_score(df: DataFrame, z: str, y: str, fitted: DataFrame) -> DataFrame:
    """One row: rates of df at the profile's threshold and its calibration error at the profile's temperature."""
    j = df.crossJoin(F.broadcast(fitted)).withColumn("_p", apply_temperature(F.col(z), F.col("temperature")))
    c = M.confusion(j, y, z, F.col("threshold"), ["temperature", "threshold"])
    return c.crossJoin(M.ece(j, y, "_p")).select("temperature", "threshold", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), "sensitivity", "specificity", "ece")


def site_calibration(calibration: DataFrame, evaluation: DataFrame, source: DataFrame, z: str, y: str, target: float = 0.9) -> DataFrame:
    """(profile, ...): the evaluation part under the site's own profile and under the source's."""
    rows = [profile_score(evaluation, z, y, profile(part, z, y, target)).select(F.lit(name).alias("profile"), "*") for name, part in (("site", calibration), ("source", source))]
    return rows[0].unionByName(rows[1])


def assert_enough(train: DataFrame, locked: DataFrame, y: str, least: int = 30) -> None:
    """An error if the train part has too few cases of a class or the locked part no positives."""
    n = train.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q")).first()
    if n.p < least or n.q < least:
        raise ValueError(f"train part has {n.p} positives and {n.q} negatives; {least} of each are needed")
    if not locked.where(F.col(y) == 1).limit(1).count():
        raise ValueError("locked part has no positives")


def recalibrated(train: DataFrame, locked: DataFrame, z: str, y: str, target: float = 0.9, least: int = 30) -> DataFrame:
    """The locked part under a profile of the train part; an error if either has too few cases of a class."""
    assert_enough(train, locked, y, least)
    return profile_score(locked, z, y, profile(train, z, y, target))


def profile_report(df: DataFrame, z: str, y: str, stored: DataFrame) -> DataFrame:
    """One row: a stored profile measured on df, with tp, fp, tn, fn, rates, AUROC, the calibration error, and the share outside its band."""
    rows = written(calibrated(df, z, stored, "_p").select(*dict.fromkeys([z, y]), "_p"), "profile-measured")
    p = rows.crossJoin(F.broadcast(stored.select("threshold", "band_low", "band_high")))
    c = M.confusion(p, y, "_p", F.col("threshold"), ["threshold"])
    outside = p.agg(F.avg(((F.col("_p") <= F.col("band_low")) | (F.col("_p") >= F.col("band_high"))).cast("double")).alias("coverage"))
    return c.crossJoin(M.auroc(rows, y, z).select("auroc")).crossJoin(M.ece(p, y, "_p")).crossJoin(outside)


def crossfit_scores(df: DataFrame, key: str, z: str, y: str, target: float = 0.9, repeats: int = 5, folds: int = 2) -> DataFrame:
    """(repeat, fold, key, y, method, temperature, threshold, p): every row under the calibrator and the threshold that the other folds of a repeat give.

    Folds have equal shares of both classes. All calibrators are fitted at once, in groups of (repeat, fold), each chosen by its error on a held-out part as in
    select_calibrator(); a fold whose held-out part is too small takes a temperature fitted on all its rows.
    """
    by = ["repeat", "fold"]
    runs = df.select(key, z, y, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    runs = runs.withColumn("_u", hash_uniform("crossfit", F.col("repeat"), F.col(key))).withColumn("_class", F.concat_ws(":", "repeat", F.col(y).cast("string")))
    runs = hash_ranks(runs, "_class", "_u", key).withColumn("own", ((F.col("rank") - 1) % folds).cast("int")).drop("_u", "_class", "rank", "size")
    runs = written(runs, "crossfit")
    fit = runs.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(folds)]))).where("fold <> own")
    fit = fit.withColumn("_held", hash_uniform("holdout", F.col("repeat"), F.col("fold"), F.col(key)) < HELD_SHARE)
    pos = F.col(y) == 1
    weak = (F.count_if("_held") < LEAST_HELD) | (F.count_if(F.col("_held") & pos) == 0) | (F.count_if(~F.col("_held") & pos) == 0)
    fit = written(fit.join(F.broadcast(fit.groupBy(*by).agg(weak.alias("_weak"))), by), "crossfit-fit")  # a row for each fold
    used = fit.where(F.col("_weak") | ~F.col("_held"))
    warm = fit_temperatures(used, z, y, by)
    knots = written(isotonic_fits(used.where("not _weak"), z, y, by), "crossfit-knots")

    def arms(rows: DataFrame) -> DataFrame:
        p = rows.join(F.broadcast(warm), by).withColumn("_identity", sigmoid(F.col(z))).withColumn("_temperature", apply_temperature(F.col(z), F.col("temperature")))
        return interpolated(p, z, knots, by, "_isotonic")

    tried = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(m).alias("method"), F.col(f"_{m}").alias("p")) for k, m in enumerate(METHODS)])
    long = arms(fit.where("_held and not _weak")).select(*by, F.col(y).alias("y"), F.explode(tried).alias("m")).select(*by, "y", "m.*")
    best = M.ece(long, "y", "p", by=[*by, "rank", "method"]).groupBy(*by).agg(F.min_by("method", F.struct(F.round("ece", 9), F.col("rank"))).alias("method"))
    chosen = written(warm.join(best, by, "left").withColumn("method", F.coalesce("method", F.lit("temperature"))).select(*by, "method"), "crossfit-methods")

    def scored(rows: DataFrame) -> DataFrame:
        p = F.coalesce(*[F.when(F.col("method") == m, F.col(f"_{m}")) for m in METHODS])
        return arms(rows).join(F.broadcast(chosen), by).withColumn("p", p)

    cut = M.threshold_at_sensitivity(scored(fit).select(*by, y, "p"), y, "p", target, by)
    return scored(runs.withColumnRenamed("own", "fold")).join(F.broadcast(cut), by).select(*by, key, y, "method", "temperature", "threshold", "p")


def crossfit(df: DataFrame, key: str, z: str, y: str, target: float = 0.9, repeats: int = 5, folds: int = 2) -> DataFrame:
    """(repeat, fold, n, method, temperature, threshold, sensitivity, specificity, ece): what the other folds' calibrator and threshold do on each fold."""
    scored, by = written(crossfit_scores(df, key, z, y, target, repeats, folds), "crossfit-scores"), ["repeat", "fold"]
    c = M.confusion(scored, y, "p", F.col("threshold"), [*by, "method", "temperature", "threshold"]).join(M.ece(scored, y, "p", by=by), by)
    n = (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n")
    return c.select(*by, n, "method", "temperature", "threshold", "sensitivity", "specificity", "ece")


def crossfit_summary(scored: DataFrame, y: str) -> DataFrame:
    """(metric, mean, sd) over repeats, from crossfit_scores(): rates and error are those of all rows of a repeat, each under its own fold's calibrator."""
    hit = (F.col("p") >= F.col("threshold")).cast("double")
    each = M.confusion(scored.withColumn("_hit", hit), y, "_hit", 1.0, ["repeat"]).join(M.ece(scored, y, "p", by=["repeat"]), "repeat")
    long = each.select(F.explode(F.create_map(*[x for m in ("sensitivity", "specificity", "ece") for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def poisson_weight(u: Column) -> Column:
    # Inside a lambda, so that u, often a hash, is worked out once and not for each step.
    return F.transform(F.array(u), lambda x: sum(((x >= c).cast("int") for c in POISSON[1:]), (x >= POISSON[0]).cast("int")))[0]


def _poisson_sums(counts: DataFrame, cluster: str, columns: list[str], replicates: int, seed: str) -> DataFrame:
    """(r, columns): weighted sums of a row for each subject, a row for each task and replicate that draws anyone. Weights are those of poisson_weight(hash_uniform())."""
    tails = [f"{r}".encode() for r in range(replicates)]

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, drawn = np.zeros((len(columns), replicates), dtype=np.int64), np.zeros(replicates, dtype=bool)
        for part in parts:
            for name, row in zip(part["_head"].tolist(), part[columns].to_numpy(np.int64), strict=True):
                head = name.encode()
                u = np.frombuffer(b"".join(hashlib.md5(head + t).digest()[:4] for t in tails), dtype=">u4") / 4294967296.0
                w = np.searchsorted(POISSON, u, side="right")
                sums += row[:, None] * w
                drawn |= w > 0
        at = np.flatnonzero(drawn)
        yield pd.DataFrame({"r": at, **{c: sums[k][at] for k, c in enumerate(columns)}})

    head = F.concat(F.concat_ws(":", F.lit(seed), F.col(cluster).cast("string")), F.lit(":")).alias("_head")
    return counts.select(head, *columns).mapInPandas(add, "r long, " + ", ".join(f"{c} long" for c in columns))


def bootstrap_rates(df: DataFrame, y: str, score: str, threshold: float, cluster: str, replicates: int = 1000, alpha: float = 0.05, seed: str = "boot") -> DataFrame:
    """(metric, point, low, high, n_boot): subjects are resampled by Poisson weights, so that no draw needs the number of subjects.

    Counts are summed by subject first and by replicate in each task, so that only a row for each replicate is shuffled.
    """
    counts = M.confusion(df, y, score, threshold, [cluster]).select(cluster, "tp", "fp", "tn", "fn")
    spread = counts.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, cluster)  # few bytes, much work each
    each = _poisson_sums(spread, cluster, ["tp", "fp", "tn", "fn"], replicates, seed)
    tp, fp, tn, fn = (F.sum(c) for c in ("tp", "fp", "tn", "fn"))
    rates = [F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity")]
    boot = each.groupBy("r").agg(*rates).select(F.explode(F.create_map(F.lit("sensitivity"), "sensitivity", F.lit("specificity"), "specificity")).alias("metric", "v"))
    cuts = boot.groupBy("metric").agg(F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.count("v").alias("n_boot"))
    point = counts.agg(*rates).select(F.explode(F.create_map(F.lit("sensitivity"), "sensitivity", F.lit("specificity"), "specificity")).alias("metric", "point"))
    return point.join(cuts, "metric").select("metric", "point", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), "n_boot")


def full_report(
    df: DataFrame, y: str, z: str, prob: str, cluster: str, threshold: float = 0.5, target: float = 0.9, grades: tuple[str, str] | None = None, replicates: int = 1000
) -> DataFrame:
    """One row: counts, rates, areas, calibration error, weighted kappa of (true, predicted) grades if given, and, resampling subjects, the intervals of sensitivity,
    specificity, the area under the ROC curve and the specificity at the target sensitivity, whose threshold every replicate finds anew."""
    ci = resample_rates(df, y, prob, F.lit(threshold), cluster, replicates).unionByName(R.resample_areas(df, y, z, cluster, replicates, target=target))
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(m if c == "point" else f"{m}_{c}")
    wide = ci.agg(*[pick(m, c) for m in ("sensitivity", "specificity", "auroc", "spec_at_sens") for c in ("low", "high")], pick("spec_at_sens", "point"), pick("auroc", "n_boot"))
    out = M.confusion(df, y, prob, threshold).crossJoin(M.auroc(df, y, z)).crossJoin(M.ece(df, y, prob)).crossJoin(wide)
    return out.crossJoin(M.qwk(df.where(F.col(grades[0]).isNotNull() & F.col(grades[1]).isNotNull()), *grades)) if grades else out


def resample_rates(df: DataFrame, y: str, score: str, threshold: Column, cluster: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(metric, point, low, high, n_boot) of sensitivity and specificity at score >= threshold, resampling as many subjects as there are."""
    call, pos = F.col(score) >= threshold, F.col(y) == 1
    sums = {"tp": call & pos, "p": pos, "tn": ~call & ~pos, "q": ~pos}
    rates = lambda s: {"sensitivity": F.try_divide(s("tp"), s("p")), "specificity": F.try_divide(s("tn"), s("q"))}
    return R.resample(df, cluster, {k: c.cast("long") for k, c in sums.items()}, rates, replicates, alpha)
