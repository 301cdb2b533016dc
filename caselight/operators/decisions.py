"""Decisions with their reasons: of cases by thresholds, of pictures by measures, of visits by their sides; lookups and stored bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.operators.gates import named, secondary_findings
from caselight.operators.tables import side_outcomes

#: Fixed values of the classical quality gate: least field of view and sharpness, least and largest brightness.
QUALITY = {"fov": 0.25, "blur": 12.0, "dark": 20.0, "bright": 235.0}
#: Rows up to which a lookup table is broadcast.
LOOKUP_ROWS = 400_000


def _number(x: float | str | Column) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else F.col(x) if isinstance(x, str) else x


def two_digits(x: Column) -> Column:
    return x.cast("decimal(12,6)").cast("decimal(12,2)").cast("string")


def shown(p: Column) -> Column:
    """A probability in two digits that never reads as certainty."""
    return F.when(p >= 0.995, ">0.99").when(p <= 0.005, "<0.01").otherwise(two_digits(p))


def decide(
    df: DataFrame, point: float | str | Column, low: float | str | Column | None = None, high: float | str | Column | None = None,
    prob: str = "prob", gradable: str = "gradable", why: str | None = None,
) -> DataFrame:
    """Adds decision, probability and reasons (an array). Thresholds are numbers, columns or names of columns, such as of a stored profile.

    What isn't gradable goes to a person, without a probability, with the gate's own reasons (an array column `why`). Else a
    probability strictly within the band goes to a person, and others by the operating point. Without a band none does. A null
    probability of a gradable case goes to a person too.
    """
    p, cut = F.col(prob), _number(point)
    a, b = (_number(x) if x is not None else F.lit(None).cast("double") for x in (low, high))
    bad = F.coalesce(F.col(gradable).cast("int"), F.lit(0)) == 0
    within = F.coalesce((a < p) & (p < b), F.lit(False))
    decision = F.when(bad | p.isNull() | within, "MANUAL_REVIEW").when(p >= cut, "REFER").otherwise("ROUTINE")
    gate = F.array_join(F.col(why), "; ") if why else F.lit("quality gate")
    text = lambda *parts: F.array(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]))
    reasons = (
        F.when(bad, F.array(F.concat(F.lit("not gradable: "), gate), F.lit("take the picture again; this is no negative result")))
        .when(p.isNull(), text("no probability"))
        .when(within, text("probability ", shown(p), " within the abstention band ", two_digits(a), " to ", two_digits(b)))
        .when(p >= cut, text("probability ", shown(p), " at or above the operating point ", two_digits(cut)))
        .otherwise(F.concat(text("probability ", shown(p), " below the operating point ", two_digits(cut)), text("other diseases are not assessed")))
    )
    return df.withColumn("decision", decision).withColumn("probability", F.when(~bad, p)).withColumn("reasons", reasons)


def assess_quality(df: DataFrame, thresholds: dict[str, float] = QUALITY, fov: str = "fov", blur: str = "blur", mean: str = "mean") -> DataFrame:
    """Adds quality_reasons (an array) and gradable, which is true without reasons. A measure that is null or NaN is a reason of its own."""
    lacks = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    reasons = named(
        (lacks(fov) | lacks(blur) | lacks(mean), "not measured"), (F.col(fov) < thresholds["fov"], "field of view too small"), (F.col(blur) < thresholds["blur"], "not sharp"),
        (F.col(mean) < thresholds["dark"], "too dark"), (F.col(mean) > thresholds["bright"], "too bright"),
    )
    return df.withColumn("quality_reasons", reasons).withColumn("gradable", F.size("quality_reasons") == 0)


def decide_visits(outcomes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(visit, decision, missing, final, unlabelled, reasons): outcomes as of effective_outcomes(), findings as secondary_findings() takes them.

    A validated finding turns a model's ROUTINE side into REFER before the visit is decided: any REFER, else any MANUAL_REVIEW, else
    INCOMPLETE if a side lacks, else ROUTINE. Final if graders decided every case of both sides. Cases without a side are counted.
    """
    tops = side_outcomes(outcomes)
    # The origin is that of the case which gave the side its outcome; final asks for graders on all cases.
    origin = outcomes.select("case_id", "origin")
    sides = tops.join(origin, "case_id").select("visit", "side", "outcome", "origin", "all_human")
    if findings is None:
        turned = sides.select("visit", "side", "outcome", F.lit(None).cast("string").alias("note"))
    else:
        turned = secondary_findings(sides.drop("all_human"), findings).select("visit", "side", "outcome", "note")
    each = turned.join(sides.select("visit", "side", "all_human"), ["visit", "side"])
    label = F.when(F.col("note") == "referred", "FINDING").otherwise(F.col("outcome"))
    by = each.groupBy("visit").agg(
        F.array_sort(F.collect_set("side")).alias("sides"), F.collect_set("outcome").alias("found"), F.bool_and("all_human").alias("human"),
        F.map_from_entries(F.collect_list(F.struct("side", label.alias("label")))).alias("labels"), F.map_from_entries(F.collect_list(F.struct("side", F.coalesce("note", F.lit("-"))))).alias("notes"),
    )
    rows = outcomes.groupBy("visit").agg(F.count_if(F.col("side").isNull()).alias("unlabelled")).join(by, "visit", "left")
    both = F.array(F.lit("left"), F.lit("right"))
    missing = F.array_except(both, F.coalesce("sides", F.array().cast("array<string>")))
    has = lambda x: F.coalesce(F.array_contains("found", x), F.lit(False))
    decision = F.when(has("REFER"), "REFER").when(has("MANUAL_REVIEW"), "MANUAL_REVIEW").when(F.size(missing) > 0, "INCOMPLETE").otherwise("ROUTINE")
    rows = rows.withColumn("lacks", missing).withColumn("decision", decision)
    with_ = lambda column, x: F.filter(both, lambda s: F.coalesce(F.element_at(column, s) == x, F.lit(False)))
    line = lambda sides, text: (F.size(sides) > 0, F.concat(F.lit(text), F.array_join(sides, " and ")))
    refer, manual = F.col("decision") == "REFER", F.col("decision") == "MANUAL_REVIEW"
    only = lambda cond, pair: (cond & pair[0], pair[1])
    reasons = named(
        only(refer, line(with_("labels", "REFER"), "refer: ")), only(refer, line(with_("labels", "FINDING"), "refer for the finding: ")),
        only(manual, line(with_("labels", "MANUAL_REVIEW"), "a grader must decide: ")), only(F.col("decision") == "INCOMPLETE", line(F.col("lacks"), "no result: ")),
        (F.col("decision") == "ROUTINE", "nothing to refer on either side"), line(with_("notes", "also suspected"), "finding also suspected: "),
        line(with_("notes", "advice"), "finding suspected, advice only: "), (F.col("unlabelled") > 0, F.concat(F.col("unlabelled").cast("string"), F.lit(" without a side, not used"))),
    )
    final = F.coalesce("human", F.lit(False)) & (F.size("lacks") == 0)
    return rows.select("visit", "decision", F.array_join("lacks", ",").alias("missing"), final.alias("final"), "unlabelled", reasons.alias("reasons"))


def lookup_default(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Adds value from a table of distinct keys; the default where the key is null or unknown. The table is broadcast only if it is small."""
    small = table.select(key, value).limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    side = table.select(key, value)
    return df.join(F.broadcast(side) if small else side, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def band_for(curve: DataFrame, coverage: float, tolerance: float = 1e-6) -> DataFrame:
    """(coverage, low, high) of an abstention curve or bands at one coverage; no row if there is none."""
    return curve.where(F.abs(F.col("coverage") - coverage) <= tolerance).select("coverage", "low", "high")
