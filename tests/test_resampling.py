"""The exact resample of subjects against its definition: weights, curves of every replicate, and free metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import reports
from caselight.operators import resampling as R

SCHEMA = "subject string, score double, y int, grade int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(11)
    out = []
    for s in range(37):
        for _ in range(int(r.integers(1, 9))):
            y = int(r.random() < 0.3 + 0.01 * s)
            out.append((f"s{s}", float(np.round(r.normal() + y, 1)), y, int(r.integers(0, 3))))
    return [*out, (None, 0.5, 1, 2), (None, -0.5, 0, 0), ("s1", None, 1, 1)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def weights_of(df, replicates, block=R.BLOCK):
    return {r.subject: np.frombuffer(r.weights, dtype="<i4") for r in R.resample_weights(df, "subject", replicates, block=block).collect()}


def test_quantiles_of_the_binomial():
    u = np.array([2**-32, 1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 2**-32])
    for n in (0, 1, 2, 7, 40, 899, 2000):
        for p in (0.0, 1 / 3, 0.5, 2 / 3, 0.999, 1.0):
            got = R.binomial(np.full(u.shape, n), np.full(u.shape, p), u)
            total, want = 0.0, np.zeros(len(u), dtype=int)
            mass = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(p) if k else 0) + ((n - k) * math.log1p(-p) if n - k else 0)) if 0 < p < 1 else float(k == (n if p else 0)) for k in range(n + 1)]
            for k in range(n):
                total += mass[k]
                want += total <= u
            assert np.abs(got - want).max() <= (0 if n < 100 else 1) and got.max(initial=0) <= n


def test_weights_add_up_and_do_not_depend_on_blocks(df):
    whole = weights_of(df, 200)
    total = sum(w.astype(int) for w in whole.values())
    assert len(whole) == 38 and None in whole and (total == 38).all()
    for block in (2, 8):
        other = weights_of(df, 200, block)
        assert all((other[s] == w).all() for s, w in whole.items())
    drawn = np.stack(list(whole.values()))
    assert abs(drawn.var() - (1 - 1 / 38)) < 0.05 and (drawn[:, 0] != drawn[:, 1]).any()
    assert abs((drawn == 0).mean() - (1 - 1 / 38) ** 38) < 0.02


def drawn_rows(rows, weights, r):
    return [(s, y) for key, s, y, _ in rows if s is not None for _ in range(weights[key][r])]


def plain_area(cells):
    pos, neg = [s for s, y in cells if y], [s for s, y in cells if not y]
    return None if not pos or not neg else sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)


def plain_specificity(cells, target):
    p, n = sum(y for _, y in cells), sum(1 - y for _, y in cells)
    if not p or not n:
        return None
    points = []
    for t in sorted({s for s, _ in cells}, reverse=True):
        points.append((sum(1 - y for s, y in cells if s >= t), sum(y for s, y in cells if s >= t)))
    kept = [k for k in range(len(points)) if k in (0, len(points) - 1) or any(points[k + 1][c] - points[k][c] != points[k][c] - points[k - 1][c] for c in (0, 1))]
    return 1 - min(points[k][0] for k in kept if points[k][1] / p >= target - 1e-12) / n


def test_curves_of_every_replicate(df, rows):
    weights, table = weights_of(df, 60), R.curves(df, "y", "score", "subject", 60)
    areas = {r.r: r.v for r in R.area_draws(table).collect()}
    assert len(areas) == 60
    for target in (0.5, 0.9, 1.0):
        specs = {r.r: r.v for r in R.specificity_draws(table, target).collect()}
        for r in range(60):
            cells = drawn_rows(rows, weights, r)
            assert areas[r] == pytest.approx(plain_area(cells), abs=1e-12)
            assert specs[r] == pytest.approx(plain_specificity(cells, target), abs=1e-12)


def test_curves_move_sums_by_score(df, spark, monkeypatch):
    """Many cells of few scores: what is shuffled is a row for each score, class and task, not a vector for each cell; small blocks, lots and slices change nothing."""
    stored = {}
    monkeypatch.setattr(R, "written", lambda frame, name, keep=R.written: stored.setdefault(name, keep(frame, name)))
    many = spark.range(6000).select((F.col("id") % 600).cast("string").alias("subject"), (F.xxhash64("id") % 7).cast("double").alias("score"), (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("y"))
    R.curves(many, "y", "score", "subject", 20)
    assert 0 < stored["sums"].count() <= 2 * 13 * R._tasks(spark)
    monkeypatch.undo()
    whole = {r.r: r.v for r in R.area_draws(R.curves(df, "y", "score", "subject", 60)).collect()}
    for name, small in (("LOT", 5), ("HELD", 1), ("PRODUCTS", 120)):
        monkeypatch.setattr(R, name, small)
    assert {r.r: r.v for r in R.area_draws(R.curves(df, "y", "score", "subject", 60, block=4)).collect()} == pytest.approx(whole, abs=1e-12)


def test_sums_in_narrow_bytes():
    for most, wide in ((255, 1), (256, 2), (70_000, 4), (2**40, 8)):
        v = np.array([[0, most, 3], [1, 2, 0]])
        raw = R._packed(v).to_pylist()
        assert [len(x) for x in raw] == [3 * wide] * 2 and np.array_equal([R._unpacked(x, 3) for x in raw], v)


@pytest.fixture
def watched(spark, df):
    """Scored rows, and how often one was read."""
    read = spark.sparkContext.accumulator(0)

    def seen(y):
        read.add(1)
        return y

    scored = df.where("score is not null").withColumn("y", F.udf(seen, "int").asNondeterministic()("y"))
    return scored.withColumns({"prob": 1 / (1 + F.exp(-F.col("score"))), "cut": F.lit(0.5), "call": F.col("score") >= 0, "gradable": F.lit(1)}), read


def test_external_report_reads_its_rows_once(watched, df):
    scored, read = watched
    got = reports.external_report(scored, "y", "prob", "call", "subject", replicates=20).first()
    assert got.tp + got.fn > 0 and got.auroc_low < got.auroc < got.auroc_high and got.n_boot == 20
    assert read.value == df.where("score is not null").count()


def test_oof_report_reads_its_rows_once(watched, df):
    scored, read = watched
    found = reports.oof_report(scored, "y", "score", "prob", "cut", "subject", 20)
    assert found.columns[9:12] == ["auroc", "ece", "sensitivity_low"]
    got = found.first()
    assert got.auroc_low < got.auroc < got.auroc_high and got.sensitivity_low <= got.sensitivity <= got.sensitivity_high
    assert read.value == df.where("score is not null").count()


def test_intervals_and_single_classes(df, spark, rows):
    got = {r.metric: r for r in R.resample_areas(df, "y", "score", "subject", 60).collect()}
    weights = weights_of(df, 60)
    want = np.percentile([plain_area(drawn_rows(rows, weights, r)) for r in range(60)], [2.5, 97.5])
    assert (got["auroc"].low, got["auroc"].high) == pytest.approx(tuple(want)) and got["auroc"].n_boot == 60 and got["spec_at_sens"].n_boot == 60
    one = spark.createDataFrame([("a", 0.1, 1, 1), ("b", 0.2, 1, 0)], SCHEMA)
    assert [(r.point, r.low, r.n_boot) for r in R.resample_areas(one, "y", "score", "subject", 10).collect()] == [(None, None, 0)] * 2
    assert {r.n_boot for r in R.resample_areas(df.limit(0), "y", "score", "subject", 10).collect()} <= {0}


def test_sums_and_free_metrics_agree(df):
    """Agreement of grade and class as a function of sums and as a free function of weighted cells."""
    same = F.when(F.col("grade") == F.col("y"), 1).otherwise(0)
    sums = R.resample(df, "subject", {"same": same, "n": F.lit(1)}, lambda s: {"agreement": s("same") / s("n")}, 50).collect()
    free = R.resample_callable(df, "subject", ["grade", "y"], lambda f, w: (w * (f["grade"] == f["y"])).sum() / w.sum(), "agreement", 50, lots=7).collect()
    assert tuple(sums[0]) == pytest.approx(tuple(free[0])) if isinstance(sums[0][0], float) else sums[0].metric == free[0].metric
    assert [sums[0][k] for k in range(1, 5)] == pytest.approx([free[0][k] for k in range(1, 5)])
