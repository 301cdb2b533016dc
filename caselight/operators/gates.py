"""Rules that let a row pass or name every reason why not. A value that was not measured (null or NaN) never passes a floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.columns import norm_path, normalise_side

#: Fixed values of the acceptance rule.
FLOORS = {"auroc": 0.85, "sensitivity": 0.85, "specificity": 0.50}
MOST_ECE, LEAST_POSITIVES, TEMPERATURES, POINTS = 0.10, 30, (0.05, 10.0), (0.001, 0.999)
#: Fixed values of the alert rule.
LEAST_AGREEMENT, LEAST_REVIEWED, LEAST_N, RISE, SHIFT, DEVICE_CEILING, DEVICE_N = 0.85, 20, 30, 0.10, 0.10, 0.25, 20


def named(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in the order given; a null condition counts as false."""
    return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))


def unmeasured(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


def below(c: Column, least: float | Column) -> Column:
    return unmeasured(c) | (c < least)


def above(c: Column, most: float | Column) -> Column:
    return unmeasured(c) | (c > most)


def subject_of(df: DataFrame, mode: str, column: str | None = None) -> Column:
    """A subject from a column, from a file name up to its first _ or ., or one for each row; a missing column is an error."""
    if mode == "row":
        return F.concat(F.lit("row_"), F.col("row_id").cast("string"))
    if column not in df.columns:
        raise ValueError(f"no column {column}; subjects are never guessed")
    if mode == "column":
        return F.col(column).cast("string")
    if mode == "prefix":
        return F.regexp_extract(F.element_at(F.split(norm_path(F.col(column)), "/"), -1), r"^([^_.]*)", 1)
    raise ValueError(f"unknown mode {mode}")


def anatomy_rule(df: DataFrame) -> DataFrame:
    """Adds score and passed from red, corner, centre and disc; a picture that isn't red can't pass whatever its form."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    red, field = clip((F.col("red") - 0.02) / 0.10), clip((F.col("centre") - F.col("corner") - 0.3) / 0.5)
    score = 0.35 * red + 0.35 * field + 0.30 * F.col("disc")
    return df.withColumn("score", F.when(red < 0.30, F.least(score, F.lit(0.49))).otherwise(score)).withColumn("passed", (red >= 0.30) & (F.col("score") >= 0.5))


def combined_gate(df: DataFrame, threshold: float) -> DataFrame:
    """Joins the classical reasons (array), the learnt p_ungradable (may be null) and anatomy's passed: each may reject, none may overrule another."""
    learnt = F.coalesce(F.col("p_ungradable") >= threshold, F.lit(False))
    reasons = F.concat("reasons", named((learnt, "learnt gate"), (~F.col("passed"), "wrong subject")))
    source = F.when(F.col("p_ungradable").isNull(), "classical").otherwise("learned")
    return df.withColumn("reasons", reasons).withColumn("gradable", F.size("reasons") == 0).withColumn("source", source)


def checked_verdicts(verdicts: DataFrame, preds: DataFrame, note: str | None = None, findings: str | None = None, codes: tuple[str, ...] = ()) -> DataFrame:
    """Adds problem (null if valid) and agreed, which is null unless verdict and decision are both REFER or ROUTINE. Notes are cut to 2000
    characters. findings is an array column, all of whose values must be among codes."""
    known = preds.select("case_id", "decision")
    j = verdicts.join(known, "case_id", "left")
    verdict, call = F.col("verdict"), ("REFER", "ROUTINE")
    problem = (
        F.when(F.col("decision").isNull(), "unknown case").when(verdict.isNull() | ~verdict.isin(*call, "UNGRADABLE"), "unknown verdict")
        .when(~F.col("grade").between(0, 4), "grade out of range").when((verdict == "UNGRADABLE") & (F.col("grade").isNotNull() | F.col("dme").isNotNull()), "ungradable with a finding")
    )
    if findings:
        unknown = F.size(F.array_except(F.coalesce(findings, F.array().cast("array<string>")), F.array(*[F.lit(c) for c in codes]).cast("array<string>"))) > 0
        problem = F.coalesce(problem, F.when(unknown, "unknown finding"))
    agreed = F.when(problem.isNull() & verdict.isin(*call) & F.col("decision").isin(*call), verdict == F.col("decision"))
    j = j.withColumn("problem", problem).withColumn("agreed", agreed)
    return j.withColumn(note, F.substring(note, 1, 2000)) if note else j


def reconcile(df: DataFrame) -> DataFrame:
    """Form fields against file tags. Adds subject_id, side_id, visit_id, device_id and problem (null if accepted)."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    form, tag = text(F.col("form_subject")), F.col("tag_subject")
    side, tag_side = normalise_side(F.col("form_side")), F.col("tag_side")
    problem = (
        F.when(form != tag, "subject mismatch").when(text(F.col("form_side")).isNotNull() & side.isNull(), "unknown side").when(side != tag_side, "side mismatch")
        .when(F.coalesce(form, tag).isNull(), "no subject").when(F.coalesce(side, tag_side).isNull(), "no side")
        .when((F.length(F.coalesce(form, tag)) > 64) | (F.length("form_visit") > 128) | (F.length("form_device") > 128), "too long")
    )
    subject = F.coalesce(form, tag)
    return df.withColumns({
        "problem": problem, "subject_id": subject, "side_id": F.coalesce(side, tag_side),
        "visit_id": F.coalesce(text(F.col("form_visit")), F.concat(subject, F.lit(":"), F.col("created").cast("date").cast("string"))),
        "device_id": F.coalesce(text(F.col("form_device")), F.lit("unknown")),
    })


def check_tables(df: DataFrame, split: str, grade: str, subject: str, required: list[str]) -> DataFrame:
    """(check, status, n): missing columns, grades out of range, null subjects, and by split its rows and positives."""
    spark = df.sparkSession
    lack = [c for c in required if c not in df.columns]
    status = lambda bad, word="FAIL": F.when(bad, word).otherwise("OK")
    columns = spark.createDataFrame([("required columns", "FAIL" if lack else "OK", len(lack))], "check string, status string, n long")
    whole = df.agg(F.count_if(~F.coalesce(F.col(grade).between(0, 4), F.lit(False))).alias("g"), F.count_if(F.col(subject).isNull()).alias("s"))
    whole = whole.select(F.explode(F.array(F.struct(F.lit("grade range").alias("check"), status(F.col("g") > 0).alias("status"), F.col("g").alias("n")), F.struct(F.lit("subject").alias("check"), status(F.col("s") > 0, "WARN").alias("status"), F.col("s").alias("n")))).alias("r")).select("r.*")
    splits = spark.createDataFrame([("train",), ("val",), ("test",)], f"{split} string")
    counts = splits.join(df.groupBy(split).agg(F.count("*").alias("rows"), F.count_if(F.col(grade) >= 2).alias("pos")), split, "left").fillna(0, ["rows", "pos"])
    label = lambda what: F.concat(F.col(split), F.lit(what)).alias("check")
    by_split = counts.select(F.explode(F.array(F.struct(label(" rows"), status(F.col("rows") == 0).alias("status"), F.col("rows").alias("n")), F.struct(label(" positives"), status(F.col("pos") == 0).alias("status"), F.col("pos").alias("n")))).alias("r")).select("r.*")
    return columns.unionByName(whole).unionByName(by_split)


def report_failures(report: Column, name: str) -> Column:
    """Reasons against one report, a struct with tp, fn, auroc, sensitivity, specificity and ece."""
    positives = F.coalesce(report["tp"] + report["fn"], F.lit(0))
    return named((positives < LEAST_POSITIVES, f"{name}: too few positives"), *[(below(report[k], v), f"{name}: {k} too low") for k, v in FLOORS.items()], (above(report["ece"], MOST_ECE), f"{name}: ece too high"))


def acceptance_failures(df: DataFrame, checkpoint: str, fingerprint: str, external_required: bool = False) -> Column:
    """Every reason why an evaluation row must not be served; an empty array accepts it.

    Columns: checkpoint_sha256, preprocess_fingerprint, operating_point, method, temperature, internal, external (structs), band_low, band_high.
    """
    point, t = F.col("operating_point"), F.col("temperature")
    first = named(
        (F.col("checkpoint_sha256").isNull() | (F.col("checkpoint_sha256") != checkpoint), "other checkpoint"),
        (F.col("preprocess_fingerprint").isNull() | (F.col("preprocess_fingerprint") != fingerprint), "other preprocessing"),
        (unmeasured(point) | (point <= POINTS[0]) | (point >= POINTS[1]), "operating point out of range"), (F.coalesce(F.col("method"), F.lit("")) == "", "no calibration"),
        ((F.col("method") == "temperature") & (unmeasured(t) | (t <= TEMPERATURES[0] * 1.0001) | (t >= TEMPERATURES[1] * 0.9999)), "temperature at its bound"),
    )
    outside = F.when(F.col("external").isNotNull(), report_failures(F.col("external"), "external")).otherwise(named((F.lit(external_required), "no external test")))
    return F.concat(first, report_failures(F.col("internal"), "internal"), outside, named((F.col("band_low").isNull() | F.col("band_high").isNull(), "no abstention band")))


def compare_candidate(df: DataFrame, target: float, tolerance: float = 0.02, least: int = 20) -> Column:
    """Reasons why a candidate is worse. Columns: struct current (may be null) and candidate of auroc, catch_rate, false_reject_rate, and candidate.rejects.

    Where df has base_current and base_candidate, the AUROCs on the test set of the data that the current model came from, a candidate that has
    forgotten them is worse too.
    """
    cur, new = F.col("current"), F.col("candidate")
    has = cur.isNotNull()
    forgot = [(has & below(F.col("base_candidate"), F.col("base_current") - tolerance), "base auroc")] if {"base_current", "base_candidate"} <= set(df.columns) else []
    return named(
        (new["rejects"] < least, "too few rejects"), (has & below(new["auroc"], cur["auroc"] - tolerance), "auroc"), (has & below(new["catch_rate"], cur["catch_rate"] - tolerance), "catch rate"),
        (has & above(new["false_reject_rate"], F.greatest(cur["false_reject_rate"], F.lit(target)) + tolerance), "false rejects"), *forgot,
    )


def seen_by_either(*seen: DataFrame, name: str = "filename") -> DataFrame:
    """(filename): what any of the models was trained or tuned on, once each, by normalised path; validations leave all of it out."""
    paths = [s.where(F.col(name).isNotNull()).select(norm_path(F.col(name)).alias("filename")) for s in seen]
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out.distinct()


def external_status(report: Column) -> Column:
    """validated if an external report meets all floors, else experimental."""
    why = named((F.coalesce(report["tp"] + report["fn"], F.lit(0)) < LEAST_POSITIVES, "positives"), *[(below(report[k], v), k) for k, v in FLOORS.items()])
    return F.struct(F.when(report.isNotNull() & (F.size(why) == 0), "validated").otherwise("experimental").alias("status"), F.when(report.isNull(), F.array(F.lit("no external test"))).otherwise(why).alias("why"))


def problem_probability(logits: Column, levels: int) -> Column:
    """1 - sigmoid of the logit at the level from which no problem is left."""
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.element_at(logits, levels)))
    return 1 - 1 / (1 + F.exp(-z))


def likely_causes(causes: Column, nothing: str = "no single cause") -> Column:
    """Of an array of structs (p, threshold, text) the texts of flagged ones, likeliest first, the earlier on ties; else one fixed text."""
    ranked = F.array_sort(F.transform(F.filter(F.transform(causes, lambda c, i: F.struct((-c["p"]).alias("m"), i.alias("i"), c["threshold"].alias("threshold"), c["text"].alias("text"))), lambda c: -c["m"] >= c["threshold"]), lambda c: F.struct(c["m"], c["i"], c["text"])))
    return F.when(F.size(ranked) > 0, F.transform(ranked, lambda c: c["text"])).otherwise(F.array(F.lit(nothing)))


def explained_gate(df: DataFrame, p: str, threshold: float, causes: Column) -> DataFrame:
    """Adds rejected, which p alone decides, and causes, which only rejected rows have."""
    rejected = F.coalesce(F.col(p) >= threshold, F.lit(False))
    return df.withColumn("rejected", rejected).withColumn("causes", F.when(rejected, likely_causes(causes)).otherwise(F.array().cast("array<string>")))


def drift_alerts(periods: DataFrame, devices: DataFrame, unvalidated: DataFrame) -> DataFrame:
    """(alert, key, value) from rates of periods recent and baseline, rates of devices, and (n) of unvalidated predictions. All are small."""
    one = lambda which: F.max_by(F.struct("n", "reviewed", "agreement", "ungradable_rate", "refer_rate"), F.when(F.col("period") == which, 1))
    both = periods.agg(one("recent").alias("r"), one("baseline").alias("b"))
    r, b = F.col("r"), F.col("b")
    rise, shift = r["ungradable_rate"] - b["ungradable_rate"], r["refer_rate"] - b["refer_rate"]
    enough = (r["n"] >= LEAST_N) & (b["n"] >= LEAST_N)
    alert = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("alert"), F.lit(None).cast("string").alias("key"), value.cast("double").alias("value")))
    found = F.array_compact(F.array(alert((r["reviewed"] >= LEAST_REVIEWED) & (r["agreement"] < LEAST_AGREEMENT), "agreement", r["agreement"]), alert(enough & (rise > RISE), "ungradable", rise), alert(enough & (F.abs(shift) > SHIFT), "referral", shift)))
    rows = both.select(F.explode(found).alias("a")).select("a.*")
    by_device = devices.where((F.col("n") >= DEVICE_N) & (F.col("ungradable_rate") > DEVICE_CEILING)).select(F.lit("device").alias("alert"), F.col("device").alias("key"), F.col("ungradable_rate").alias("value"))
    return rows.unionByName(by_device).unionByName(unvalidated.where("n > 0").select(F.lit("unvalidated").alias("alert"), F.lit(None).cast("string").alias("key"), F.col("n").cast("double").alias("value")))


def secondary_findings(sides: DataFrame, cases: DataFrame) -> DataFrame:
    """By visit and side: a validated suspicion turns a model's ROUTINE into REFER; an experimental one is advice; a grader's verdict stands.

    sides: visit, side, outcome, origin. cases: visit, side, case_id, suspected, finding_probability, finding_status (null: no finding).
    """
    seen = cases.where(F.col("side").isNotNull() & F.col("suspected").isNotNull())
    info = seen.groupBy("visit", "side").agg(F.bool_or("suspected").alias("suspected"), F.max(F.coalesce("finding_probability", F.lit(0.0))).alias("probability"), F.min_by(F.coalesce("finding_status", F.lit("experimental")), "case_id").alias("status"))
    j = sides.join(info, ["visit", "side"], "left")
    sure = F.coalesce(F.col("suspected") & (F.col("status") == "validated"), F.lit(False))
    turned = sure & (F.col("origin") == "model") & (F.col("outcome") == "ROUTINE")
    note = F.when(turned, "referred").when(sure, "also suspected").when(F.coalesce("suspected", F.lit(False)), "advice")
    return j.select("visit", "side", F.when(turned, "REFER").otherwise(F.col("outcome")).alias("outcome"), "suspected", "probability", "status", note.alias("note"))
