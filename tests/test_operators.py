import math
import random

import pytest
from pyspark.sql import functions as F

from caselight.operators import metrics as M
from caselight.operators import tables as O


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = [(f"P{i // 2}", int(rng.random() < 0.2), k) for i, k in ((i, i) for i in range(600))]
    rows = [(s, y, round(rng.gauss(1.2 * y, 1), 2), k) for s, y, k in rows]
    return spark.createDataFrame(rows, "subject string, y int, score double, k int").cache(), rows


def test_auroc_equals_pairs(scored):
    df, rows = scored
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(M.auroc(df, "y", "score").first().auroc - want) < 1e-9


def test_constant_score_is_half_and_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, score double")
    assert M.auroc(df, "y", "score").first().auroc == 0.5
    assert M.auroc(df.where("y = 0"), "y", "score").first().auroc is None


def test_sensitivity_is_honoured(scored):
    df, rows = scored
    t = M.threshold_at_sensitivity(df, "y", "score", 0.9).first().threshold
    hit = [r[2] >= t for r in rows if r[1]]
    assert sum(hit) / len(hit) >= 0.9


def test_prefix_sums_do_not_sort_in_one_task(scored):
    df, _ = scored
    rows = df.withColumn("pos", F.col("y")).repartition(4)
    plan = M.prefix_sums(rows, "score", ["pos"])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x and "score" in x.split("windowspecdefinition")[-1]]
    assert windows and all("_range" in x for x in windows)


def test_kappa_falls_with_distance(spark):
    pair = lambda f: spark.createDataFrame([(g, f(g)) for g in range(5) for _ in range(20)], "a int, b int")
    same, near, far = (M.qwk(pair(f), "a", "b").first().qwk for f in (lambda g: g, lambda g: min(4, g + 1), lambda g: 0 if g == 4 else g))
    assert same == 1 and same > near > far


def test_small_groups_are_marked_and_null_groups_left_out(spark):
    df = spark.createDataFrame([(k % 2, 0.5, "big") for k in range(100)] + [(1, 0.5, "tiny")] * 5 + [(1, 0.5, None)], "y int, p double, device string")
    got = {r.group: r.underpowered for r in M.subgroups(df, "y", "p", 0.5, ["device", "absent"]).collect()}
    assert got == {"big": False, "tiny": True}


def test_all_cases_are_kept_at_full_coverage(spark):
    df = spark.createDataFrame([(k % 2, k / 100) for k in range(1, 100)], "y int, p double")
    rows = {r.coverage: r for r in M.abstention_curve(df, "y", "p", 0.5, df, [1.0, 0.8]).collect()}
    assert rows[1.0].actual == 1 and abs(rows[0.8].actual - 0.8) < 0.02


@pytest.mark.parametrize(
    "sides, decision, missing",
    [
        ([("left", "ROUTINE"), ("right", "ROUTINE")], "ROUTINE", ""), ([("left", "ROUTINE"), ("right", "REFER")], "REFER", ""),
        ([("left", "MANUAL_REVIEW"), ("right", "ROUTINE")], "MANUAL_REVIEW", ""), ([("left", "ROUTINE")], "INCOMPLETE", "right"), ([(None, "REFER")], "INCOMPLETE", "left,right"),
    ],
)
def test_visit_decisions(spark, sides, decision, missing):
    df = spark.createDataFrame([("v", s, o, k, "model") for k, (s, o) in enumerate(sides)], "visit string, side string, outcome string, case_id int, origin string")
    got = O.visit_decisions(df).first()
    assert (got.decision, got.missing, got.final) == (decision, missing, False)


def test_latest_verdict_wins(spark):
    v = spark.createDataFrame([(1, 1, "ROUTINE", 0), (2, 1, "ROUTINE", 1), (3, 1, "REFER", 2)], "verdict_id long, case_id long, verdict string, row_id long")
    v = v.withColumn("case_created", F.current_timestamp()).withColumn("grade", F.lit(0)).withColumn("grader", F.lit("g")).withColumn("dme", F.lit(0))
    assert O.latest_verdict(v).first().verdict == "REFER"


def test_splits_have_no_leak_and_the_detector_fires(spark, scored):
    df, _ = scored
    s = O.split_by_subject(df, "subject", "y")
    joined = df.join(s, "subject")
    assert O.leaks(joined, "subject", "split").count() == 0
    assert O.leaks(df.withColumn("split", (F.col("k") % 2).cast("string")), "subject", "split").count() == 300
    again = O.split_by_subject(df.orderBy(F.desc("k")), "subject", "y")
    assert s.exceptAll(again).count() == 0


def test_conflicting_labels_keep_nothing(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3), ("b", 0, 4), ("c", 1, 5)], "h string, g int, k int")
    assert {r.h: r.keep for r in O.label_conflicts(df, "h", "g", "k").collect()} == {"a": 1, "b": None}


def test_rows_on_the_edge_of_a_band_count_as_by_the_c_library(spark):
    """Scores with many ties, each of which is a band's edge once: the last bit of a logarithm decides."""
    values = [x for p in (0.434135, 0.256355, *(round(1 / (1 + math.exp(z / 37)), 6) for z in range(1, 80))) for x in (p, round(1 - p, 6))]
    coverages = [k / 80 for k in range(1, 80)]
    df = spark.createDataFrame([(int(k % 2), p) for p in values for k in range(3)], "y int, p double")
    cut = sorted(abs(math.log(p / (1 - p))) for p in values for _ in range(3))
    want = {}
    for c in coverages:
        place = (len(cut) - 1) * (1 - c)
        low, high = math.floor(place), math.ceil(place)
        at = cut[low] if low == high else (high - place) * cut[low] + (place - low) * cut[high]
        want[c] = sum(p <= 1 / (1 + math.exp(at)) or p >= 1 / (1 + math.exp(-at)) for p in values) * 3
    assert {r.coverage: r.retained for r in M.abstention_curve(df, "y", "p", 0.5, df, coverages).collect()} == want
