"""Small operators over case tables by value: nulls, ties, empty tables."""

import datetime as dt

from caselight.operators import gates as G
from caselight.operators import metrics as M
from caselight.operators import tables as O


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_grades_weights_and_averages(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3), ("b", None), ("c", 1), (None, 2)], "s string, g int")
    assert rows(O.worst_grade(df, "s", "g")) == sorted([("a", 3), ("b", None), ("c", 1), (None, 2)], key=repr)
    assert rows(O.pos_weights(df, "g", 5)) == [(0, 1 / 3), (1, 1.0), (2, 3.0), (3, 4.0)]
    assert O.pos_weights(df.limit(0), "g", 5).collect() == []
    views = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 8.0), (2, 0, None)], "k int, m int, v double")
    assert rows(O.view_average(views, "k", "v")) == [(1, 4.0), (2, None)] and rows(O.view_average(views, "k", "v", "m")) == [(1, 5.0), (2, None)]
    assert rows(O.repeat_mean_sd(views, ["k"], "v"))[0][:2] == (1, 4.0)


def test_splits_copies_timelines_and_last_entries(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3), (None, 4)], "s string, c int")
    parts = spark.createDataFrame([("a", "train"), ("b", "test")], "s string, split string")
    assert rows(O.selected_split(cases, parts, "s", "test")) == [("b", 2)] and len(rows(O.selected_split(cases, parts, "s"))) == 2
    copies = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "h string")
    assert rows(O.exact_duplicates(copies, "h")) == [("x", 2)]
    t = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(1, t, 2, "REFER"), (1, t, 1, "ROUTINE"), (2, t, 3, None)], "case_id int, case_created timestamp, row_id int, verdict string")
    assert rows(O.case_timeline(v)) == [(1, "ROUTINE>REFER", 2), (2, "", 1)]
    log = spark.createDataFrame([("x", 1, "a"), ("x", 3, None), ("y", 2, "b")], "e string, n int, d string")
    assert rows(O.last_event(log, ["e"], "n", "d")) == [("x", 3, None), ("y", 2, "b")]


def test_screening_metrics_by_group(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.1, 0), ("a", 0.8, 0), ("b", 0.7, 1)], "g string, s double, y int")
    got = {r.g: r for r in M.screening_metrics(df, "y", "s", 0.5, ["g"]).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].sensitivity, got["a"].specificity, got["a"].auroc) == (1, 1, 1.0, 0.5, 1.0)
    assert got["b"].specificity is None and got["b"].auroc is None
    assert M.screening_metrics(df, "y", "s", 0.5).first().tp == 2


def test_guard_of_the_base_set_and_seen_files(spark):
    gate = "struct<auroc:double,catch_rate:double,false_reject_rate:double,rejects:long>"
    good = (0.9, 0.5, 0.01, 50)
    data = [(1, good, good, 0.9, 0.89), (2, good, good, 0.9, 0.8), (3, None, good, None, None), (4, good, good, 0.9, None)]
    df = spark.createDataFrame(data, f"k int, current {gate}, candidate {gate}, base_current double, base_candidate double")
    assert rows(df.select("k", G.compare_candidate(df, 0.05).alias("w"))) == [(1, []), (2, ["base auroc"]), (3, []), (4, ["base auroc"])]
    one, two = (spark.createDataFrame([(x,) for x in v], "filename string") for v in (["a\\b.jpg", "c.jpg", None], ["a/b.jpg", "d.jpg"]))
    assert rows(G.seen_by_either(one, two)) == [("a/b.jpg",), ("c.jpg",), ("d.jpg",)]
