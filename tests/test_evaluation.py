import math

import pytest
from pyspark.sql import functions as F
from test_files_streams import _png

from caselight.functions import columns as C
from caselight.operators import evaluation as E
from caselight.sources import files as S


def _tail(n, p, ks):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in ks)


def test_exact_interval_has_its_tails(spark):
    cases = [(0, 10), (10, 10), (3, 10), (17, 40), (1, 200), (0, 0), (None, 5)]
    rows = spark.createDataFrame(cases, "k int, n int").select("k", "n", C.clopper_pearson(F.col("k"), F.col("n")).alias("ci")).collect()
    for r in rows:
        if not r.n or r.k is None:
            assert r.ci is None or r.ci.low is None or math.isnan(r.ci.low)
            continue
        assert r.ci.low == 0 if r.k == 0 else abs(_tail(r.n, r.ci.low, range(r.k, r.n + 1)) - 0.025) < 1e-9
        assert r.ci.high == 1 if r.k == r.n else abs(_tail(r.n, r.ci.high, range(r.k + 1)) - 0.025) < 1e-9


def test_ids_levels_and_findings(spark):
    df = spark.createDataFrame([("d\\7_l2.jpg", "6", ["b", "a", "b", None]), ("x", "3", []), (None, None, None)], "p string, v string, f array<string>")
    side, level = C.side_from_id(F.regexp_replace("p", r"\.jpg$", "")), C.level_index(F.col("v"), [1, 4, 6, 8, 10])
    got = df.select(C.stem_prefix(F.col("p")).alias("stem"), side.alias("side"), level.alias("level"), C.encode_findings(F.col("f")).alias("json"), C.encode_findings(F.col("f"), ";").alias("text"), C.decode_findings(C.encode_findings(F.col("f"))).alias("back")).collect()
    assert [tuple(r) for r in got] == [("7", "left", 2, '["a","b"]', "a;b", ["a", "b"]), ("x", None, -1, "[]", "", []), (None, None, -1, None, None, [])]


def test_gate_validation(spark):
    rows = [("a", "0", True, 0.1), ("b", "1", False, 0.9), ("c\\d", "1", False, 0.8), ("e", "2", False, 0.7), ("f", "1", True, 0.2), ("gone", "1", None, None)]
    items = spark.createDataFrame(rows, "filename string, quality string, gradable boolean, p_ungradable double")
    seen = spark.createDataFrame([("c/d",)], "filename string")
    got = E.gate_validation(items, "quality", ["1"], seen, F.col("p_ungradable").isNotNull()).first().asDict()
    assert got == {"excluded": 1, "unreadable": 1, "n_items": 4, "n_human_reject": 2, "n_human_accept": 2, "catch_rate": 0.5, "missed_rejects": 1, "false_reject_rate": 0.5, "false_rejects": 1, "auroc": 0.75}
    empty = E.gate_validation(items.limit(0), "quality", ["1"], seen, F.lit(True)).first()
    assert empty.n_items == 0 and empty.catch_rate is None and empty.auroc is None


def test_bootstrap_contains_its_point(spark):
    df = spark.range(400).select((F.col("id") % 80).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("double").alias("s") * 0.5 + F.rand(3))
    df = df.toDF("c", "y", "s")
    for r in E.bootstrap_auroc(df, "y", "s", "c", 100).collect() + E.bootstrap(df, "c", {"y": F.col("y"), "n": F.lit(1)}, lambda s: {"share": s("y") / s("n")}, 100).collect():
        assert r.low < r.point < r.high and r.n_boot == 100
    assert E.bootstrap_auroc(df.where("y = 1"), "y", "s", "c", 20).collect()[0].n_boot == 0


def test_record_checks_find_altered_and_missing_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    hashed = lambda df: df.withColumn("record_sha256", E.record_hash(df, ["id", "v"]))
    log = hashed(rows).select((F.col("id") * 10).alias("seq"), F.lit("made").alias("action"), F.col("id").cast("string").alias("entity"), "record_sha256")
    now = spark.createDataFrame([(1, "a"), (2, "")], "id int, v string")
    got = E.check_records(log, {"made": (hashed(now), "id", F.col("entity"))}).collect()
    assert sorted((r.seq, r.problem) for r in got) == [(20, "row altered"), (30, "row missing")]


def test_image_fingerprints(spark, tmp_path):
    ramp = [[(x * 3, x * 3, x * 3) for x in range(68)] for _ in range(32)]
    _png(tmp_path / "a.png", ramp)
    _png(tmp_path / "b.png", ramp)
    _png(tmp_path / "c.png", [row[::-1] for row in ramp])
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {r.path[-5]: r for r in S.image_fingerprints(spark, str(tmp_path)).collect()}
    assert set(got) == set("abc") and got["a"].pixel_md5 == got["b"].pixel_md5 != got["c"].pixel_md5
    assert got["a"].dhash == "f" * 64 and got["c"].dhash == "0" * 64 and (got["a"].h0, got["c"].h3) == (-1, 0)


def test_sources_of_several_shapes(spark):
    train = spark.createDataFrame([("1_l1", 1, 2, 3), ("1_r1", 1, 2, 3)], "image_id string, patient_id int, left_grade int, right_grade int")
    held = spark.createDataFrame([("27_r2", 4, 6)], "image_id string, raw_grade int, clarity int")
    sites = spark.createDataFrame([("1_l1", "north")], "image_id string, site string")
    got = S.assemble_multisource({"train": train, "held": held}, sites).select("image_id", "subject", "side", "raw_grade", "site", "clarity").collect()
    assert sorted(tuple(r) for r in got) == [("1_l1", "S0001", "left", 2, "north", None), ("1_r1", "S0001", "right", 3, "unknown", None), ("27_r2", "S0027", "right", 4, "unknown", 6)]
    with pytest.raises(ValueError):
        S.assemble_multisource({"held": held}, sites, train)
    with pytest.raises(ValueError):
        S.assemble_multisource({"held": held.withColumn("image_id", F.lit("27"))}, sites)


def test_patients_numbers_may_be_long(spark):
    part = spark.createDataFrame([("3000000000_l1", 1), ("12345_r1", 2)], "image_id string, raw_grade int")
    got = S.assemble_multisource({"train": part}, spark.createDataFrame([], "image_id string, site string"))
    assert {r.subject for r in got.collect()} == {"S3000000000", "S12345"}
