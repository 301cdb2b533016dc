"""Joins, orders, visits, splits and checks over case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.columns import hash32, hash_uniform, locked_split, pseudonym
from caselight.operators.order import SENT, median


def latest_verdict(verdicts: DataFrame) -> DataFrame:
    """One row a case: its last verdict by time and row, as one aggregate."""
    last = F.max_by(F.struct("verdict_id", "verdict", "grade", "grader", "dme"), F.struct("case_created", "row_id"))
    return verdicts.groupBy("case_id").agg(last.alias("v"), F.count("*").alias("revisions")).select("case_id", "v.*", "revisions")


def effective_outcomes(preds: DataFrame, verdicts: DataFrame) -> DataFrame:
    v = latest_verdict(verdicts).select("case_id", F.col("verdict").alias("latest"))
    outcome = F.when(F.col("latest") == "UNGRADABLE", "MANUAL_REVIEW").otherwise(F.coalesce("latest", "decision"))
    return preds.join(v, "case_id", "left").withColumn("outcome", outcome).withColumn("origin", F.when(F.col("latest").isNull(), "model").otherwise("grader"))


def side_outcomes(outcomes: DataFrame) -> DataFrame:
    """By visit and side the most severe outcome, the first case on ties; null sides are left out here."""
    severity = F.when(F.col("outcome") == "REFER", 2).when(F.col("outcome") == "MANUAL_REVIEW", 1).otherwise(0)
    return (
        outcomes.where(F.col("side").isNotNull()).withColumn("severity", severity).groupBy("visit", "side")
        .agg(F.max_by(F.struct("outcome", "case_id"), F.struct("severity", -F.col("case_id"))).alias("top"), F.bool_and(F.col("origin") == "grader").alias("all_human"))
        .select("visit", "side", "top.outcome", "top.case_id", "all_human")
    )


def visit_decisions(outcomes: DataFrame) -> DataFrame:
    """Any REFER, else any MANUAL_REVIEW, else INCOMPLETE if a side lacks, else ROUTINE; final if graders decided all sides."""
    sides = side_outcomes(outcomes).groupBy("visit").agg(F.collect_set("side").alias("sides"), F.collect_set("outcome").alias("found"), F.bool_and("all_human").alias("human"))
    unlabelled = outcomes.groupBy("visit").agg(F.count_if(F.col("side").isNull()).alias("unlabelled"))
    missing = F.array_except(F.array(F.lit("left"), F.lit("right")), F.coalesce("sides", F.array().cast("array<string>")))
    has = lambda x: F.coalesce(F.array_contains("found", x), F.lit(False))
    decision = F.when(has("REFER"), "REFER").when(has("MANUAL_REVIEW"), "MANUAL_REVIEW").when(F.size(missing) > 0, "INCOMPLETE").otherwise("ROUTINE")
    rows = unlabelled.join(sides, "visit", "left").select("visit", decision.alias("decision"), F.array_join(missing, ",").alias("missing"), F.coalesce("human", F.lit(False)).alias("human"), "unlabelled")
    return rows.select("visit", "decision", "missing", (F.col("human") & (F.col("missing") == "")).alias("final"), "unlabelled")


def visit_heads(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("visit").isNotNull()).groupBy("visit").agg(F.max("subject").alias("subject"), F.min("created").alias("first_utc"), F.max("created").alias("last_utc"), F.count("*").alias("cases"))


def worklist(preds: DataFrame, limit: int = 200) -> DataFrame:
    rank = F.when(F.col("decision") == "MANUAL_REVIEW", 0).when(F.col("decision") == "REFER", 1).otherwise(2)
    return preds.withColumn("rank", rank).orderBy("rank", F.desc_nulls_last("probability"), F.desc("created"), F.desc("case_id")).limit(max(1, min(1000, limit)))


def median_cases(df: DataFrame, group: str, value: str, key: str, ties: Column | None = None) -> DataFrame:
    """By group the case nearest the median; of equally near ones the first by `ties` (a number at the end of a name, say), then by key."""
    known = df.where(F.col(value).isNotNull())
    mid = median(known, value, [group]).withColumnRenamed(group, "_group")
    near = F.struct(F.round(F.abs(F.col(value) - F.col("median")), 9), *([] if ties is None else [ties]), F.col(key))
    sizes = mid.limit(SENT + 1).count()  # groups
    both = known.join(F.broadcast(mid) if sizes <= SENT else mid, known[group].eqNullSafe(F.col("_group")))
    return both.groupBy(group, "median").agg(F.min_by(key, near).alias(key))


#: Ranges of a uniform hash that are ranked on their own.
HASH_RANGES = 1024


def hash_ranks(df: DataFrame, stratum: str, u: str, key: str) -> DataFrame:
    """Adds rank (from 1, by u and key) and size of each row's stratum. The ranges of a uniform number are counted first, and each is
    ranked on its own, so a stratum that holds most rows is dealt to many tasks. A null stratum is one."""
    rows = df.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-"))).withColumn("_r", F.floor(F.col(u) * HASH_RANGES))
    counts = rows.groupBy("_s", "_r").agg(F.count("*").alias("_n"))
    own = W.partitionBy("_s")
    counts = counts.select("_s", "_r", (F.sum("_n").over(own.orderBy("_r")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("size"))
    inside = F.row_number().over(W.partitionBy("_s", "_r").orderBy(u, key))
    return rows.withColumn("_at", inside).join(counts, ["_s", "_r"]).withColumn("rank", F.col("_before") + F.col("_at")).drop("_s", "_r", "_at", "_before")


def split_by_subject(df: DataFrame, subject: str, grade: str, ratios: tuple[float, float] = (0.70, 0.85), seed: str = "split") -> DataFrame:
    """(subject, stratum, split): subjects by hash rank within the stratum of their worst grade; the order of rows is no matter."""
    worst = df.groupBy(subject).agg(F.max(grade).alias("stratum")).withColumn("u", hash_uniform(seed, F.col(subject)))
    ranked = hash_ranks(worst, "stratum", "u", subject).withColumn("share", (F.col("rank") - 0.5) / F.col("size"))
    return ranked.select(subject, "stratum", F.when(F.col("share") < ratios[0], "train").when(F.col("share") < ratios[1], "val").otherwise("test").alias("split"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: str = "fold") -> DataFrame:
    ranked = hash_ranks(df.select(key, label).withColumn("u", hash_uniform(seed, F.col(key))), label, "u", key)
    return ranked.select(key, label, ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def leaks(assigned: DataFrame, subject: str, split: str) -> DataFrame:
    """Subjects in more than one split, in one pass."""
    return assigned.groupBy(subject).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("n")).where("n > 1")


def label_conflicts(df: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """Groups of equal content: size, labels, the row to keep (null if the labels disagree)."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels"), F.min(order).alias("first")).where("n > 1")
    return g.withColumn("keep", F.when(F.col("labels") == 1, F.col("first"))).drop("first")


def pseudonymise(preds: DataFrame, key_hex: str) -> DataFrame:
    code = lambda kind, c: pseudonym(key_hex, kind, F.col(c))
    rows = preds.select(code("subject", "subject").alias("subject_code"), code("case", "case_id").alias("case_code"), code("visit", "visit").alias("visit_code"), F.date_format("created", "yyyy-MM").alias("month"), "gradable", (F.col("grade") >= 2).cast("int").alias("referable"))
    return rows.withColumn("split", locked_split(F.col("subject_code")))


def hamming_pairs(df: DataFrame, key: str, bits: str | list[str], distance: int) -> DataFrame:
    """(a, b, distance) of pairs of rows at most `distance` bits apart, by one long of bits or several.

    Of distance + 1 bands such pairs agree in one; the bands are dealt over the words, so that each lies within a word. A pair is
    given out by the first band in which it agrees. Selective if words x 64 / (distance + 1) bits are many, such as 19 of 256 at 12.
    """
    words = [bits] if isinstance(bits, str) else list(bits)
    share = [(distance + 1) * k // len(words) for k in range(len(words) + 1)]
    cuts = [(w, 64 * j // n, 64 * (j + 1) // n) for w, n in enumerate(b - a for a, b in zip(share[:-1], share[1:], strict=True)) for j in range(n)]
    cut = lambda x, w, a, b: x[w] if b - a == 64 else F.shiftrightunsigned(x[w], a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    rows = df.select(F.col(key).alias("k"), F.array(*[F.col(w) for w in words]).alias("x"))
    part = F.array(*[F.struct(F.lit(n).alias("band"), cut(F.col("x"), *c).alias("part")) for n, c in enumerate(cuts)])
    banded = rows.select("k", "x", F.explode(part).alias("p"))
    other = banded.select(F.col("k").alias("k2"), F.col("x").alias("x2"), "p")
    near = sum((F.bit_count(F.col("x")[w].bitwiseXOR(F.col("x2")[w])) for w in range(1, len(words))), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("x2")[0])))
    first = F.coalesce(*[F.when(cut(F.col("x"), *c) == cut(F.col("x2"), *c), F.lit(n)) for n, c in enumerate(cuts)])
    found = banded.join(other.hint("merge"), "p").where((F.col("k") < F.col("k2")) & (near <= distance) & (first == F.col("p.band")))
    return found.select(F.col("k").alias("a"), F.col("k2").alias("b"), near.cast("int").alias("distance"))


def early_stop(history: DataFrame, run: str, epoch: str, metric: str, patience: int = 7) -> DataFrame:
    """By run: the epoch of the first strict maximum, and the first epoch at which it is `patience` old. A metric that is null, NaN or
    infinite counts as minus infinity."""
    upto = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    value = F.col(metric).cast("double")
    finite = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(float("-inf"))).otherwise(value)
    best = F.max(F.struct(finite, -F.col(epoch))).over(upto)
    rows = history.withColumn("best", -best["col2"])
    stop = rows.where(F.col(epoch) - F.col("best") >= patience).groupBy(run).agg(F.min(epoch).alias("stop_epoch"))
    kept = rows.join(stop, run, "left").where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return kept.groupBy(run).agg(F.max("best").alias("best_epoch"), F.max("stop_epoch").alias("stop_epoch"))


def bit_key(embedding: str):
    """64 sign bits of a vector as a long."""
    bits = F.array_join(F.transform(F.slice(F.col(embedding), 1, 64), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    half = lambda a: F.conv(F.substring(bits, a, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def view_rows(cases: DataFrame, views: int = 8) -> DataFrame:
    rows = cases.select("case_id", "logit", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view"))
    return rows.select("case_id", "view", (F.col("logit") + (hash32(F.col("case_id") * 8 + F.col("view")) % 200 - 100) / F.lit(1000.0)).alias("logit"))


def halves_by_subject(df: DataFrame, subject: str, grade: str, fraction: float = 0.5, seed: str = "site") -> DataFrame:
    """(subject, part): calibration or evaluation, by hash rank within the stratum of the worst grade."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    ranked = split_by_subject(df, subject, grade, (fraction, 1.0), seed)
    return ranked.select(subject, F.when(F.col("split") == "train", "calibration").otherwise("evaluation").alias("part"))


def canonical_hash(df: DataFrame, columns: list[str], name: str = "record_sha256") -> DataFrame:
    """Adds the SHA-256 of the sorted name=value strings of all columns that aren't null."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in sorted(columns)]
    return df.withColumn(name, F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256))


def visit_cases(preds: DataFrame) -> DataFrame:
    """All cases of each visit in one row, in the order of time."""
    rows = preds.where(F.col("visit").isNotNull()).groupBy("visit").agg(F.array_sort(F.collect_list(F.struct("created", "case_id"))).alias("c"))
    return rows.select("visit", F.array_join(F.transform("c", lambda x: x["case_id"].cast("string")), ",").alias("cases"), F.size("c").cast("long").alias("n"))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    """How often each reason occurs; what follows a colon or a bracket doesn't count."""
    key = F.trim(F.element_at(F.split(F.element_at(F.split("reason", ":"), 1), r"\("), 1))
    return df.select(F.explode(reasons).alias("reason")).groupBy(key.alias("reason")).agg(F.count("*").alias("n"))


def worst_grade(df: DataFrame, key: str, grade: str) -> DataFrame:
    """(key, grade): the highest grade of each key, such as a subject or a visit; rows without a grade don't count, a key without any has null."""
    return df.groupBy(key).agg(F.max(grade).alias(grade))


def pos_weights(df: DataFrame, grade: str, levels: int) -> DataFrame:
    """(k, weight) for each of the levels - 1 questions "is the grade over k?": the rows at or below it for each one above; at least one counts as above."""
    asked = F.explode(F.sequence(F.lit(0), F.lit(levels - 2))).alias("k")
    counts = df.where(F.col(grade).isNotNull()).groupBy(grade).agg(F.count("*").alias("_n"))  # a row for each grade
    rows = counts.select(grade, "_n", asked).groupBy("k").agg(
        F.sum(F.when(F.col(grade) <= F.col("k"), F.col("_n")).otherwise(0)).alias("_neg"), F.sum(F.when(F.col(grade) > F.col("k"), F.col("_n")).otherwise(0)).alias("_pos")
    )
    return rows.select("k", (F.col("_neg") / F.greatest("_pos", F.lit(1))).alias("weight"))


def view_average(views: DataFrame, key: str, value: str, member: str | None = None) -> DataFrame:
    """(key, value): the mean over a case's views; with members of an ensemble the mean of each member's mean, so that members count alike whatever their views."""
    if member is not None:
        views = views.groupBy(key, member).agg(F.avg(value).alias(value))
    return views.groupBy(key).agg(F.avg(value).alias(value))


def repeat_mean_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, sd) over repeats, the standard deviation of the repeats as a whole; null without values."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def selected_split(df: DataFrame, assigned: DataFrame, subject: str, split: str | None = None) -> DataFrame:
    """Rows with the split of their subject, or those of one split. assigned has a row for each subject; rows of other subjects are left out."""
    parts = assigned.select(subject, "split") if split is None else assigned.where(F.col("split") == split).select(subject)
    return df.join(parts, subject, "inner" if split is None else "left_semi")


def exact_duplicates(df: DataFrame, digest: str) -> DataFrame:
    """(digest, n) of contents that more than one row has; rows without a digest are no copies of each other."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")


def case_timeline(verdicts: DataFrame) -> DataFrame:
    """(case_id, history, n): a case's verdicts in the order of their cases' times and rows."""
    v = verdicts.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("case_created", "row_id", "verdict"))).alias("v"))  # as long as a case has revisions
    return v.select("case_id", F.array_join(F.col("v.verdict"), ">").alias("history"), F.size("v").cast("long").alias("n"))


def last_event(log: DataFrame, by: list[str], seq: str, detail: str) -> DataFrame:
    """(by, seq, detail) of the last entry of each group."""
    return log.groupBy(*by).agg(F.max(seq).alias("seq"), F.max_by(detail, seq).alias("detail"))
