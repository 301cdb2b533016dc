import ipaddress
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from caselight.functions.columns import hash_uniform
from caselight.operators import calibration as K
from caselight.operators import curation as U
from caselight.operators import sites as S


def test_isotonic_equals_pooling(spark):
    rng = random.Random(3)
    rows = [(p := rng.randrange(0, 21) / 20, int(rng.random() < p * p)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    got = {r.p: r.fitted for r in K.apply_isotonic(df.select("p").distinct(), "p", K.fit_isotonic(df, "p", "y"), "fitted").collect()}
    blocks = []
    for level in sorted({p for p, _ in rows}):
        ys = [y for p, y in rows if p == level]
        blocks.append([sum(ys), len(ys), [level]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, ls = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ls]
    want = {x: s / n for s, n, ls in blocks for x in ls}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_isotonic_is_straight_between_and_flat_beyond(spark):
    model = K.fit_isotonic(spark.createDataFrame([(-2.0, 0), (-2.0, 0), (0.0, 0), (0.0, 1), (2.0, 1)], "z double, y int"), "z", "y")
    at = spark.createDataFrame([(z,) for z in (-9.0, -2.0, -1.0, 0.0, 1.0, 9.0)], "z double")
    assert [round(r.p, 6) for r in K.apply_isotonic(at, "z", model, "p").orderBy("z").collect()] == [0.0, 0.0, 0.25, 0.5, 0.75, 1.0]
    xs, ys = K.knots(model)
    stored = spark.createDataFrame([("isotonic", None, xs, ys)], "method string, temperature double, isotonic_x array<double>, isotonic_y array<double>")
    assert [round(r.p, 6) for r in K.calibrated(at, "z", stored, "p").orderBy("z").collect()] == [0.0, 0.0, 0.25, 0.5, 0.75, 1.0]


def test_few_held_out_rows_fall_back_to_temperature(spark):
    rng = random.Random(4)
    rows = [(k, z := rng.gauss(0, 2), int(rng.random() < 1 / (1 + math.exp(-z / 2)))) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, z double, y int")
    profile = K.fit_profile(df, "k", "z", "y").first()
    assert (profile.method, profile.n, profile.held_out_ece, list(profile.isotonic_x)) == ("temperature", 40, None, []) and profile.band_low <= profile.threshold <= profile.band_high
    none = [(r.method, r.chosen) for r in K.select_calibrator(df.where("y = 0"), df, "z", "y").collect()]
    assert ("temperature", True) in none and sum(c for _, c in none) == 1
    many = spark.createDataFrame([(k, z := rng.gauss(0, 2), int(rng.random() < 1 / (1 + math.exp(-2 * z - 1)))) for k in range(600)], "k int, z double, y int")
    fitted = K.fit_profile(many, "k", "z", "y")
    assert fitted.first().held_out_ece is not None and K.profile_report(many, "z", "y", fitted).first().sensitivity >= 0.9 - 1e-9


def test_a_profile_reads_its_rows_once_and_sends_no_knots_with_them(spark):
    rng = random.Random(6)
    read = spark.sparkContext.accumulator(0)

    def seen(y):
        read.add(1)
        return y

    many = spark.createDataFrame([(k, z := rng.gauss(0, 2), int(rng.random() < 1 / (1 + math.exp(-2 * z - 1)))) for k in range(600)], "k int, z double, y int")
    watched = many.withColumn("y", F.udf(seen, "int").asNondeterministic()("y"))
    profile = K.fit_profile(watched, "k", "z", "y")
    assert read.value == 600 and profile.first() == K.fit_profile(many, "k", "z", "y").first()
    read.value = 0
    assert K.profile_report(watched, "z", "y", profile).first().sensitivity >= 0.9 - 1e-9 and read.value == 600
    knots = spark.createDataFrame([("isotonic", None, [0.0, 1.0], [0.2, 0.6])], "method string, temperature double, isotonic_x array<double>, isotonic_y array<double>")
    assert "Join" not in K.calibrated(many, "z", knots, "p")._jdf.queryExecution().executedPlan().toString()


def test_recalibration_fits_the_candidate_once(spark, monkeypatch):
    rng, fits = random.Random(7), []
    rows = spark.createDataFrame([(k, z := rng.gauss(0, 2), int(rng.random() < 1 / (1 + math.exp(-2 * z)))) for k in range(600)], "k int, z double, y int")
    current = K.fit_profile(rows, "k", "z", "y")
    monkeypatch.setattr(K.M, "fit_temperature", lambda *a, fit=K.M.fit_temperature: fits.append(a) or fit(*a))
    got = S.recalibrated_evidence(rows.where("k < 300"), rows.where("k >= 300"), current, rows, "k", "z", "y", "a", "f").collect()
    assert sorted(r.profile for r in got) == ["candidate", "current"] and len(fits) == 1
    with pytest.raises(ValueError, match="30 of each"):
        S.recalibrated_evidence(rows.where("k < 20"), rows, current, rows, "k", "z", "y", "a", "f")


def test_bootstrap_holds_the_point_and_is_wider_for_subjects(spark):
    rng = random.Random(5)
    rows = []
    for s in range(120):
        hit = rng.random() < 0.7
        rows += [(f"s{s}", 1, 0.9 if hit else 0.1) for _ in range(4)] + [(f"s{s}", 0, rng.random() * 0.6)]
    df = spark.createDataFrame(rows, "s string, y int, p double").withColumn("row", F.monotonically_increasing_id().cast("string")).cache()
    by = lambda c: K.bootstrap_rates(df, "y", "p", 0.5, c, 300).where("metric = 'sensitivity'").first()
    subject, row = by("s"), by("row")
    assert subject.low <= subject.point <= subject.high and subject.n_boot == 300
    assert subject.high - subject.low > 1.5 * (row.high - row.low)


def test_recalibration_needs_cases(spark):
    few = spark.createDataFrame([(1.0, 1)] * 5 + [(-1.0, 0)] * 50, "z double, y int")
    with pytest.raises(ValueError):
        K.recalibrated(few, few, "z", "y")


def test_leaders_equal_the_walk_in_order(spark):
    rng = random.Random(7)
    bits = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(60):
        x = rng.choice(bits)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        bits.append(x)
    leaders, want = [], {}
    for k, x in enumerate(bits):
        want[k] = next((j for j in leaders if bin(bits[j] ^ x).count("1") <= 3), k)
        if want[k] == k:
            leaders.append(k)
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(bits)], "k long, x long")
    assert {r.k: r.leader for r in U.near_groups(df, "k", "x", 3).collect()} == want


def test_guard_stops_large_removals(spark):
    near = spark.createDataFrame([(k, 0) for k in range(4)], "k long, leader long")
    content = spark.createDataFrame([(k, str(k)) for k in range(4)], "k long, d string")
    with pytest.raises(ValueError):
        U.deduplicated(near, content, "k", "d")
    assert sorted(r.k for r in U.deduplicated(near, content, "k", "d", guard=0.8).collect()) == [0]
    assert U.deduplicated(near, content, "k", "d", most=2).count() == 4  # a suspicious group is flagged only


def test_rare_strata(spark):
    counts = spark.createDataFrame([(0, 100), (1, 40), (2, 20), (3, 4), (4, 2)], "grade int, n int")
    assert U.collapsed_strata(counts, "grade", 7) == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}
    assert U.collapsed_strata(counts, "grade", 6) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_addresses(spark):
    rows = ["10.0.0.1", "10.1.0.1", "::ffff:10.0.2.3", "127.0.0.1", "::1", "10.0.0.256", "10.0.0", "x", None]
    df = spark.createDataFrame([(r,) for r in rows], "ip string")
    assert [r.allowed for r in U.allowed_clients(df, "ip", ["10.0.0.0/16"]).collect()] == [True, False, True, True, True, False, False, False, False]
    with pytest.raises(ValueError):
        U.allowed_clients(df, "ip", ["10.0.0.0/99"])
    wide = spark.createDataFrame([("2001:db8::5",), ("2001:DB9::1",), ("::1",), ("2001:zz::",), ("10.0.0.1",), ("::ffff:10.9.0.1",)], "ip string")
    assert [r.allowed for r in U.allowed_clients(wide, "ip", ["2001:db8::/32", "10.9.0.0/16"]).collect()] == [True, False, True, False, False, True]
    assert ipaddress.ip_address("::ffff:10.9.0.1").ipv4_mapped is not None


def test_encryption_round_trip_and_ids(spark):
    key = "11" * 32
    df = spark.createDataFrame([("a1", "raw", bytearray(b"xyz"))], "c string, k string, b binary")
    assert bytes(U.decrypted(U.encrypted(df, key, "c", "k", "b"), key).first().content) == b"xyz"
    with pytest.raises(Exception, match="not allowed"):
        U.encrypted(df.withColumn("c", F.lit("../a")), key, "c", "k", "b").collect()


def test_mixed_visits_are_rejected(spark):
    cases = spark.createDataFrame([("v", 1, "A", "left", "REFER", "model", 0.8), ("v", 2, "B", "right", "ROUTINE", "model", 0.1)], "visit string, case_id int, subject string, side string, outcome string, origin string, probability double")
    decisions = spark.createDataFrame([("v", "REFER", False)], "visit string, decision string, final boolean")
    reports, rejects = U.visit_reports(cases, decisions)
    assert reports.count() == 0 and rejects.first().visit == "v"


def test_set_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",)], "f string")
    print_a = U.set_fingerprint(a, "f").first().fingerprint
    U.same_set(a.orderBy(F.desc("f")), "f", print_a)
    with pytest.raises(ValueError):
        U.same_set(a.limit(1), "f", print_a)


def test_reports_tell_performer_reasons_and_findings(spark):
    cases = spark.createDataFrame(
        [("v", 1, "A", "left", "REFER", "grader", 0.8, "g1", "m2", True, "validated"), ("v", 2, "A", "right", "ROUTINE", "model", 0.12345, None, "m2", False, "experimental"), ("w", 3, None, None, "ROUTINE", "model", None, None, None, None, None)],
        "visit string, case_id int, subject string, side string, outcome string, origin string, probability double, grader string, model_version string, suspected boolean, finding_status string",
    )
    decisions = spark.createDataFrame([("v", "REFER", True, ["refer: left"]), ("w", "INCOMPLETE", False, [])], "visit string, decision string, final boolean, reasons array<string>")
    reports, rejects = U.visit_reports(cases, decisions)
    got = {r.visit: json.loads(r.report) for r in reports.collect()}
    assert rejects.count() == 0 and got["v"]["conclusion"] == "REFER; refer: left" and got["v"]["conclusionCode"] == [{"text": "REFER"}]
    first, second = got["v"]["contained"]
    assert first["performer"] == [{"display": "g1"}] and "performer" not in second and second["method"] == {"text": "model m2"} and second["component"][0]["value"] == 0.1235
    assert first["component"][1]["finding"] == "suspected" and [x["reference"] for x in got["v"]["result"]] == ["#obs-1", "#obs-2"]
    assert "subject" not in got["w"] and got["w"]["contained"][0]["component"] == []


def test_migration_is_checked_and_purge_purges(spark, tmp_path):
    key = "22" * 32
    df = spark.createDataFrame([("a1", "raw", bytearray(b"xyz"))], "c string, k string, b binary")
    assert bytes(U.decrypted(U.migrated(df, key, "c", "k", "b"), key).first().content) == b"xyz"
    rows = spark.sql("select * from values (1, timestamp'2024-01-01', 'raw'), (2, timestamp'2024-03-01', 'raw'), (3, cast(null as timestamp), 'preview') as t(id, at, kind)")
    now = F.lit("2024-03-10").cast("timestamp")
    assert U.purge_files(rows, f"{tmp_path}/kept", "at", 30, now, "kind") == 1
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [2, 3]


def test_snapshot_leaves_out_what_it_must(spark):
    preds = spark.sql("select * from values (1, 'S1', 'v1', 'left', timestamp'2024-02-03', 'd', 'REFER', 0.9D, 1), (2, cast(null as string), 'v2', 'left', timestamp'2024-02-03', 'd', 'REFER', 0.9D, 1), (3, 'S1', null, null, timestamp'2024-03-03', 'd', 'ROUTINE', 0.1D, 1) as t(case_id, subject, visit, side, created, device, decision, probability, gradable)")
    verdicts = spark.sql("select * from values (10, 10, 1, timestamp'2024-02-04', 'g', 'UNGRADABLE', cast(null as int), cast(null as int)), (11, 11, 2, timestamp'2024-02-04', 'g', 'REFER', 3, 1), (12, 12, 3, timestamp'2024-02-04', 'g', 'ROUTINE', 0, 0) as t(verdict_id, row_id, case_id, case_created, grader, verdict, grade, dme)")
    got = U.snapshot(preds, verdicts, "00" * 32, spark.createDataFrame([(1,), (2,)], "case_id int")).collect()
    assert len(got) == 1 and got[0].human_referable is None and got[0].month == "2024-02" and "S1" not in str(got[0]) and "grader" not in " ".join(got[0].__fields__)


def test_poisson_sums_take_one_hash_a_draw(spark):
    """Weighted sums in the tasks are those of the weights by expression, for null subjects too."""
    counts = spark.createDataFrame([(None, 1, 5), ("S1", 2, 0), ("S22", 3, 7), ("é", 0, 9)], "subject string, tp long, fp long").repartition(3)
    u = hash_uniform("boot", F.col("subject"), F.col("r"))
    each = counts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("w", K.poisson_weight(u)).where("w > 0")
    want = {tuple(r) for r in each.groupBy("r").agg(F.sum(F.col("tp") * F.col("w")), F.sum(F.col("fp") * F.col("w"))).collect()}
    got = K._poisson_sums(counts, "subject", ["tp", "fp"], 200, "boot").groupBy("r").agg(F.sum("tp"), F.sum("fp")).collect()
    assert {tuple(r) for r in got} == want and len(want) > 150
