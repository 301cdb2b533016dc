import math

import pytest
from pyspark.sql import functions as F

from caselight.operators import audit as A
from caselight.operators import decisions as D
from caselight.operators import metrics as M
from caselight.operators import reports as R
from caselight.operators import tables as O
from caselight.operators.store import written
from caselight.sources import files as S


def test_decisions_name_their_reasons(spark):
    rows = [(1, 1, 0.9), (2, 1, 0.5), (3, 1, 0.35), (4, 1, 0.1), (5, 0, 0.9), (6, None, 0.9), (7, 1, None), (8, 1, 0.999)]
    got = {r.k: r for r in D.decide(spark.createDataFrame(rows, "k int, gradable int, prob double"), 0.5, 0.35, 0.65).collect()}
    assert [got[k].decision for k in range(1, 9)] == ["REFER", "MANUAL_REVIEW", "ROUTINE", "ROUTINE", "MANUAL_REVIEW", "MANUAL_REVIEW", "MANUAL_REVIEW", "REFER"]
    assert got[5].probability is None and "no negative result" in got[5].reasons[1] and ">0.99" in got[8].reasons[0] and got[2].reasons == ["probability 0.50 within the abstention band 0.35 to 0.65"]
    assert D.decide(spark.createDataFrame(rows, "k int, gradable int, prob double"), 0.5).where("k = 2").first().decision == "REFER"


def test_quality_reasons(spark):
    rows = [(1, 0.5, 50.0, 100.0), (2, 0.1, 5.0, 10.0), (3, 0.5, math.nan, 240.0), (4, None, 50.0, 100.0)]
    got = {r.k: r for r in D.assess_quality(spark.createDataFrame(rows, "k int, fov double, blur double, mean double")).collect()}
    assert got[1].gradable and got[2].quality_reasons == ["field of view too small", "not sharp", "too dark"] and got[3].quality_reasons == ["not measured", "too bright"] and not got[4].gradable


def test_visits_take_findings_and_count_cases_without_side(spark):
    o = [("a", 1, "left", "ROUTINE", "model"), ("a", 2, "right", "ROUTINE", "grader"), ("a", 3, None, "REFER", "model"), ("b", 4, "left", "ROUTINE", "grader"), ("b", 5, "right", "ROUTINE", "grader"), ("c", 6, "left", "ROUTINE", "model"), ("d", 7, None, "REFER", "model")]
    found = [("a", "left", 1, True, 0.9, "validated"), ("a", "right", 2, True, 0.8, "validated"), ("b", "left", 4, True, 0.9, "experimental")]
    outcomes = spark.createDataFrame(o, "visit string, case_id int, side string, outcome string, origin string")
    findings = spark.createDataFrame(found, "visit string, side string, case_id int, suspected boolean, finding_probability double, finding_status string")
    got = {r.visit: r for r in D.decide_visits(outcomes, findings).collect()}
    assert (got["a"].decision, got["a"].reasons) == ("REFER", ["refer for the finding: left", "finding also suspected: right", "1 without a side, not used"]) and not got["a"].final
    assert (got["b"].decision, got["b"].final, got["b"].reasons) == ("ROUTINE", True, ["nothing to refer on either side", "finding suspected, advice only: left"])
    assert (got["c"].decision, got["c"].missing, got["d"].missing, got["d"].reasons[-1]) == ("INCOMPLETE", "right", "left,right", "1 without a side, not used")
    assert {r.visit: r.decision for r in D.decide_visits(outcomes).collect()}["a"] == "ROUTINE"


def test_lookups_and_bands(spark):
    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, key string")
    got = D.lookup_default(df, spark.createDataFrame([("a", "A")], "key string, value string"), "key", "value", "none")
    assert {r.k: r.value for r in got.collect()} == {1: "A", 2: "none", 3: "none"}
    curve = spark.createDataFrame([(0.85, 0.4, 0.6), (0.8, 0.3, 0.7)], "coverage double, low double, high double")
    assert D.band_for(curve, 0.85).first().low == 0.4 and D.band_for(curve, 0.86).count() == 0


def test_guards_name_examples(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "s string, split string")
    with pytest.raises(ValueError, match="1 subjects .* a"):
        R.assert_no_leakage(df, "s", "split")
    with pytest.raises(ValueError, match="1 keys .* a"):
        R.assert_unique(df, "s")
    assert R.assert_unique(df, "s", "split").count() == 3


def test_early_stop_takes_nan_for_the_worst(spark):
    rows = [("r", e, m) for e, m in enumerate([0.5, 0.9, math.nan, math.inf, None, 0.8, 0.7, 0.6, 0.5, 0.4], 1)]
    got = O.early_stop(spark.createDataFrame(rows, "run string, epoch int, m double"), "run", "epoch", "m").first()
    assert (got.best_epoch, got.stop_epoch) == (2, 9)


def test_grades_keep_empty_ones_and_percentiles_drop_what_is_no_number(spark):
    got = {r.grade: r for r in R.grade_distribution(spark.createDataFrame([(0, "a"), (0, "b"), (3, "b"), (None, "b")], "grade int, subject string")).collect()}
    assert [got[g].n for g in range(5)] == [2, 0, 0, 1, 0] and round(got[1].referable_percent, 3) == 33.333 and got[0].rows_per_subject == 1.5
    p = R.metric_percentiles(spark.createDataFrame([("1",), ("3",), ("x",), ("NaN",), (None,)], "m string"), ["m"], []).first()
    assert (p.n, p.p50, p.p25) == (2, 2.0, 1.5)


def test_curve_does_not_depend_on_ranges(spark, monkeypatch):
    rows = [(k, (k * 7919) % 997 / 997, int((k * 31) % 10 < 4)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, s double, y int")
    curve = lambda: sorted(tuple(r) for r in M.roc_points(df, "y", "s").collect())
    many = curve()
    monkeypatch.setattr(M, "RANGES", 2)
    assert many == curve()
    weighted = M.auroc(df.withColumn("w", F.lit(2.0)), "y", "s", weight="w").first().auroc
    assert abs(weighted - M.auroc(df, "y", "s").first().auroc) < 1e-12


def test_near_pairs_of_long_hashes(spark):
    import random

    rng = random.Random(2)
    words = [[rng.getrandbits(63) for _ in range(4)] for _ in range(40)]
    for _ in range(80):
        w = list(rng.choice(words[:40]))
        for _ in range(rng.randrange(16)):
            w[rng.randrange(4)] ^= 1 << rng.randrange(63)
        words.append(w)
    df = spark.createDataFrame([(k, *w) for k, w in enumerate(words)], "k int, a long, b long, c long, d long")
    got = {(r.a, r.b, r.distance) for r in O.hamming_pairs(df, "k", ["a", "b", "c", "d"], 12).collect()}
    apart = lambda u, v: sum((x ^ y).bit_count() for x, y in zip(u, v, strict=True))
    want = {(i, j, apart(words[i], words[j])) for j in range(len(words)) for i in range(j) if apart(words[i], words[j]) <= 12}
    assert got == want and len(want) > 20


def test_a_rewritten_block_is_given_away_by_the_level_above(spark):
    log = spark.createDataFrame([(k, f"entry {k}") for k in range(30)], "seq long, body string")
    chained = written(A.chain(log, "seq", "body", 8), "c")
    good = A.heads(chained, "seq")
    assert A.verify_heads(good).count() == 0 and A.verified(chained, "seq", "body", good, 8).first().ok
    forged = good.withColumn("head", F.when((F.col("level") == 0) & (F.col("block") == 2), F.lit("0" * 64)).otherwise(F.col("head")))
    assert [(r.level, r.block) for r in A.verify_heads(forged).collect()] == [(1, 0)]
    row = A.verified(chained, "seq", "body", forged, 8).first()
    assert not row.ok and row.problems == 2 and row.entries == 30


def test_legacy_rows_are_anchored_once(spark):
    log = spark.createDataFrame([(1, 5, "prediction"), (2, 6, "verdict")], "seq long, case_id long, action string")
    rows = spark.createDataFrame([(k,) for k in (5, 7, 6)], "case_id long")
    once = A.anchored(rows, log, "case_id", "prediction")
    assert sorted((r.seq, r.case_id, r.legacy) for r in once.collect()) == [(1, 5, False), (2, 6, False), (3, 6, True), (4, 7, True)]
    assert A.anchored(rows, once, "case_id", "prediction").count() == 4


def test_demonstration_labels_are_the_same_for_a_seed(spark):
    a = S.synthetic_labels(spark, 300)
    assert a.count() == 600 and a.collect() == S.synthetic_labels(spark, 300).collect() and a.where("grade not between 0 and 4").count() == 0
    shares = {r.gradable: r["count"] / 600 for r in a.groupBy("gradable").count().collect()}
    assert 0.02 < shares[0] < 0.11 and a.select("filename").distinct().count() == 600
