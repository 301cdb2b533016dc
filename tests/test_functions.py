import hashlib
import hmac
import math

from pyspark.sql import functions as F

from caselight.functions import columns as C


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_codes_equal_hmac(spark):
    key = "0b" * 32
    got = one(spark, c=C.pseudonym(key, "subject", F.lit("Zoë")))
    assert got.c == hmac.new(bytes.fromhex(key), "subject:Zoë".encode(), hashlib.sha256).hexdigest()[:16]


def test_names_and_sides(spark):
    got = one(spark, a=C.flat_name(F.lit("a\\b/10_left.jpeg")), b=C.normalise_side(F.lit(" OS ")), c=C.normalise_side(F.lit("x")), d=C.trailing_number(F.lit("eye_012.png")), e=C.trailing_number(F.lit("eye.png")))
    assert (got.a, got.b, got.c, got.d, got.e) == ("a__b__10_left.png", "left", None, 12, 0)


def test_ordinal_round_trip(spark):
    df = spark.range(5).select(F.col("id").cast("int").alias("g"))
    assert [tuple(r) for r in df.select("g", C.grade_decode(C.ordinal_encode(F.col("g"), 5).cast("array<double>"))).collect()] == [(g, g) for g in range(5)]
    assert one(spark, m=C.enforce_monotonic(F.array(F.lit(0.9), F.lit(0.2), F.lit(0.6)))).m == [0.9, 0.2, 0.2]


def test_intervals_and_display(spark):
    got = one(spark, w=C.wilson(F.lit(142), F.lit(161.0)), z=C.wilson(F.lit(0), F.lit(0.0)), hi=C.prob_display(F.lit(0.996)), lo=C.prob_display(F.lit(0.001)), mid=C.prob_display(F.lit(0.5)))
    assert abs(got.w.low - 0.823) < 1e-3 and abs(got.w.high - 0.923) < 1e-3 and got.z is None
    assert (got.hi, got.lo, got.mid) == (">0.99", "<0.01", "0.50")


def test_week_belongs_to_its_iso_year(spark):
    assert one(spark, w=C.iso_week(F.lit("2024-12-30").cast("date"))).w == "2025-W01"


def test_temperature_of_zero_is_one(spark):
    got = one(spark, a=C.apply_temperature(F.lit(1.0), F.lit(0.0)), b=C.apply_temperature(F.lit(1.0), F.lit(2.0)))
    assert math.isclose(got.a, 1 / (1 + math.exp(-1))) and math.isclose(got.b, 1 / (1 + math.exp(-0.5)))
