import pytest
from pyspark.sql import functions as F

from caselight.operators import audit as A
from caselight.operators import gates as G


def test_unmeasured_values_fail_floors(spark):
    schema = "tp long, fn long, auroc double, sensitivity double, specificity double, ece double"
    df = spark.createDataFrame([(40, 2, 0.9, 0.9, 0.9, 0.05), (40, 2, float("nan"), 0.9, 0.9, None), (10, 2, 0.9, 0.9, 0.9, 0.05)], schema)
    got = [r[0] for r in df.select(G.report_failures(F.struct(*df.columns), "internal")).collect()]
    assert got == [[], ["internal: auroc too low", "internal: ece too high"], ["internal: too few positives"]]


def test_red_is_needed(spark):
    df = spark.createDataFrame([(0.02, 1.0, 0.0, 1.0), (0.2, 1.0, 0.0, 1.0)], "red double, centre double, corner double, disc double")
    assert [(round(r.score, 6), r.passed) for r in G.anatomy_rule(df).collect()] == [(0.49, False), (1.0, True)]


def test_learnt_gate_cannot_overrule(spark):
    df = spark.createDataFrame([(["dark"], 0.0, True), ([], 0.9, True), ([], None, True), ([], 0.1, False)], "reasons array<string>, p_ungradable double, passed boolean")
    assert [(r.gradable, r.source) for r in G.combined_gate(df, 0.6).collect()] == [(False, "learned"), (False, "learned"), (True, "classical"), (False, "learned")]


def test_subject_is_never_guessed(spark):
    df = spark.createDataFrame([("a\\10_left.jpeg", 1)], "f string, row_id int")
    assert df.select(G.subject_of(df, "prefix", "f")).first()[0] == "10"
    with pytest.raises(ValueError):
        G.subject_of(df, "column", "patient")


def test_long_identifiers_and_missing_sides_are_refused(spark):
    rows = [("x" * 65, None, "L", None), (None, None, "L", None), ("a", None, None, None), ("a", "b", "L", None), ("a", "a", "os", "left")]
    df = spark.createDataFrame(rows, "form_subject string, tag_subject string, form_side string, tag_side string").withColumns({"form_visit": F.lit(None).cast("string"), "form_device": F.lit(None).cast("string"), "created": F.current_timestamp()})
    assert [r.problem for r in G.reconcile(df).collect()] == ["too long", "no subject", "no side", "subject mismatch", None]


def _log(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("b"), "id").alias("body"))


def test_an_untouched_chain_has_no_problem(spark):
    chained = A.chain(_log(spark, 700), "seq", "body").cache()
    assert A.verify(chained, "seq", "body", A.heads(chained, "seq")).count() == 0
    assert [tuple(r) for r in A.heads(chained, "seq").groupBy("level").count().orderBy("level").collect()] == [(0, 3), (1, 1)]


def test_a_swapped_pair_and_a_lost_end_are_found(spark):
    chained = A.chain(_log(spark, 300), "seq", "body").cache()
    heads = A.heads(chained, "seq")
    swapped = chained.withColumn("body", F.when(F.col("seq") == 5, "b6").when(F.col("seq") == 6, "b5").otherwise(F.col("body")))
    assert {tuple(r) for r in A.verify(swapped, "seq", "body", heads).collect()} == {(5, "altered"), (6, "altered")}
    assert {tuple(r) for r in A.verify(chained.where("seq < 299"), "seq", "body", heads).collect()} == {(256, "end missing")}


def test_registry_replays_rollbacks(spark):
    events = [("q", "v1", "registered", 1), ("q", "v1", "promoted", 2), ("q", "v2", "registered", 3), ("q", "v2", "promoted", 4), ("q", "v3", "registered", 5), ("q", "v1", "rolled back", 6)]
    got = {r.version: (r.status, r.replaced) for r in A.registry_status(spark.createDataFrame(events, "kind string, version string, action string, seq int")).collect()}
    assert got == {"v1": ("active", "v2"), "v2": ("retired", None), "v3": ("candidate", None)}


def test_append_only(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, a string, b int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "k int, a string, b int")
    assert {tuple(r) for r in A.append_only(old, new, "k").collect()} == {(2, "updated"), (3, "deleted")}
