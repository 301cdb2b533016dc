import struct
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caselight.operators import trainers as T
from caselight.sources import files as S
from caselight.streaming import streams as R


def _png(path, pixels):
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    disc = lambda x, y: (200, 80, 40) if (x - 20) ** 2 + (y - 20) ** 2 < 225 else (0, 0, 0)
    _png(tmp_path / "red.png", [[disc(x, y) for x in range(40)] for y in range(40)])
    _png(tmp_path / "flat.png", [[(128, 128, 128)] * 40 for _ in range(40)])
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: r for r in S.image_stats(spark, str(tmp_path)).collect()}
    assert not got["bad.png"].readable and got["bad.png"].content_md5 is None
    assert 0.3 < got["red.png"].fov_fraction < 0.6 and got["red.png"].red > 0.3 and got["red.png"].corner == 0
    assert got["flat.png"].fov_fraction == 1 and got["flat.png"].blur_var == 0 and abs(got["flat.png"].red) < 1e-6
    done = S.image_stats(spark, str(tmp_path)).where("readable").select("path")
    assert S.image_stats(spark, str(tmp_path), done).count() == 1


def test_manifest_finds_changes(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}.txt").write_text(str(k))
    before = spark.createDataFrame(S.manifest(spark, str(tmp_path)).collect())
    (tmp_path / "f1.txt").write_text("other")
    (tmp_path / "f2.txt").unlink()
    got = {r.path.rsplit("/", 1)[-1]: r.problem for r in S.verify_manifest(before, S.manifest(spark, str(tmp_path))).collect()}
    assert got == {"f1.txt": "changed", "f2.txt": "missing"}


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id_code,diagnosis,age\na.png,2,30\nb.png,,31\nc.png,0,32\n")
    rows = S.load_labels(spark, str(tmp_path / "l.csv"), "id_code", "diagnosis", spark.createDataFrame([("c.png",)], "filename string"))
    assert [(r.filename, r.grade, r.referable) for r in rows.collect()] == [("a.png", 2, 1)]
    (tmp_path / "m.csv").write_text("id_code,diagnosis\na.png,7\n")
    with pytest.raises(ValueError):
        S.load_labels(spark, str(tmp_path / "m.csv"), "id_code", "diagnosis")


def test_partitions_names_and_merges(spark):
    a = spark.createDataFrame([("1", 2, 0)], "` id ` string, grade int, `Unnamed: 3` int")
    b = spark.createDataFrame([("1", 3), (None, 1)], "id string, grade int")
    assert sorted(tuple(r) for r in S.assemble({"a": a, "b": b}, "id").collect()) == [("a1", 2), ("b1", 3)]
    with pytest.raises(ValueError):
        S.assemble({"a": b.unionByName(b)}, "id")
    merged = S.merge_keep_last(spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int"), spark.createDataFrame([("y", 0)], "k string, v int"), "k")
    assert sorted(tuple(r) for r in merged.collect()) == [("x", 1), ("y", 0)]
    files = spark.createDataFrame([("d/a.png",), ("d/b.jpeg",)], "path string")
    found = S.resolve_filenames(spark.createDataFrame([("a.png",), ("b.png",), ("c.png",)], "f string"), files, "f")
    assert {r.f: (r.found, r.how) for r in found.collect()} == {"a.png": ("d/a.png", "exact"), "b.png": ("d/b.jpeg", "repaired"), "c.png": (None, "missing")}


def test_runs_and_label_sinks(spark, tmp_path):
    for auc in (0.8, 0.9):
        S.append_run(spark.createDataFrame([("m", auc)], "model string, auc double"), str(tmp_path / "runs"))
    assert S.experiments(spark.read.json(str(tmp_path / "runs")), "model", ["auc"]).first().auc == "0.850 ± 0.050"
    S.write_labels(spark.createDataFrame([(1, None), (1, 5), (1, 2), (0, 1)], "human_quality int, raw_grade int"), str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels/graded")).count() == 2
    assert spark.read.parquet(str(tmp_path / "labels/quality")).agg(F.sum("quality")).first()[0] == 2


def _stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return R.stream_table(spark, path)


def test_lockout_counts_and_refuses(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda m: t + timedelta(minutes=m)
    rows = [(k, "u", at(k), True) for k in range(5)] + [(5, "u", at(6), True), (6, "u", at(25), False), (7, "u", at(26), True)]
    got = R.drained(R.lockouts(_stream(spark, tmp_path, rows, "row int, user string, ts timestamp, bad boolean"), "user", "row", "ts", "bad"), "lock")
    assert [r.outcome for r in got.orderBy("row").collect()] == ["failed"] * 4 + ["locked", "refused", "ok", "failed"]


def test_sessions_end_at_the_cap(spark, tmp_path):
    rows = [("u", datetime(2024, 1, 1) + timedelta(minutes=10 * k)) for k in range(60)]
    got = R.drained(R.capped_sessions(_stream(spark, tmp_path, rows, "user string, ts timestamp"), "user", "ts", 900, 8 * 3600), "capped")
    assert [r["count"] for r in got.groupBy("session").count().orderBy("session").collect()] == [48, 12]


def test_ordinal_model_learns(spark):
    rows = [(k, [float(k % 5), float((k * 7) % 3)], k % 5) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, f array<double>, g int")
    scored = T.score_ordinal(df, "f", T.fit_ordinal(df, "f", "g"))
    hit = scored.select(F.avg((F.size(F.filter("cumulative", lambda p: p > 0.5)) == F.col("g")).cast("double"))).first()[0]
    assert hit > 0.75
    assert T.oof_scores(df.withColumn("y", (F.col("g") > 1).cast("int")), "k", "f", "y").count() == 200
