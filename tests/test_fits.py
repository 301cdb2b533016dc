"""Grouped fits against one plain fit a group."""

import math

import numpy as np
import pytest

from caselight.operators import calibration as K
from caselight.operators import fits as T
from caselight.operators import metrics as M

SCHEMA = "g string, z double, y int, key long"


def plain_isotonic(z, y):
    """Least squares by the largest, over starts, of the least mean from there on."""
    xs = sorted(set(z))
    cells = [(sum(b for a, b in zip(z, y, strict=True) if a == x), sum(a == x for a in z)) for x in xs]
    mean = lambda a, b: sum(c[0] for c in cells[a : b + 1]) / sum(c[1] for c in cells[a : b + 1])
    return {x: max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k, x in enumerate(xs)}


def plain_temperature(z, y):
    def best(grid):
        loss = [round(-sum(math.log(p if b == 1 else 1 - p) for p, b in ((min(max(1 / (1 + math.exp(-max(-30, min(30, a / t)))), 1e-7), 1 - 1e-7), b) for a, b in zip(z, y, strict=True))), 6) for t in grid]
        return grid[int(np.argmin(loss))]

    t, step = best([0.05 + k * 9.95 / 399 for k in range(400)]), 9.95 / 400
    lo, hi = max(0.05, t - step), min(10, t + step)
    return best([lo + k * (hi - lo) / 49 for k in range(50)])


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 60), ("b", 25), ("up", 12), ("one", 1), ("same", 9)):
        for k in range(n):
            z = float(np.round(r.normal() * 2, 1)) if g in "ab" else float(k) if g == "up" else 0.5
            y = int(r.random() < 1 / (1 + math.exp(-z))) if g in "ab" else int(k >= 6) if g == "up" else k % 2
            rows.append((g, z, y, len(rows)))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame([*data, ("a", None, 1, -1), ("none", None, 0, -2)], SCHEMA).repartition(6).cache()


def test_isotonic_of_every_group_at_once(df, data):
    groups = {g: ([z for h, z, *_ in data if h == g], [y for h, _, y, _ in data if h == g]) for g in {r[0] for r in data}}
    fits = T.isotonic_fits(df, "z", "y", ["g"])
    assert {r.g for r in fits.collect()} == groups.keys()
    for r in T.interpolated(df, "z", fits, ["g"]).collect():
        if r.z is None or r.g == "none":
            assert r.calibrated is None
        else:
            assert r.calibrated == pytest.approx(plain_isotonic(*groups[r.g])[r.z], abs=1e-12)
    blocks = T.isotonic_blocks(df, "z", "y", ["g"]).collect()
    for g in groups:
        own = sorted((b for b in blocks if b.g == g), key=lambda b: b.lo)
        assert sum(b.n for b in own) == len(groups[g][0]) and all(a.s / a.n < b.s / b.n and a.hi < b.lo for a, b in zip(own, own[1:], strict=False))


def test_isotonic_without_groups_and_between_knots(df, data, spark):
    z, y = [r[1] for r in data], [r[2] for r in data]
    want = plain_isotonic(z, y)
    fits = T.isotonic_fits(df, "z", "y")
    assert all(r.calibrated == pytest.approx(want[r.z]) for r in T.interpolated(df, "z", fits).where("z is not null").collect())
    (row,) = fits.collect()
    far = spark.createDataFrame([(-99.0,), (99.0,)], "z double")
    assert [r.calibrated for r in T.interpolated(far, "z", fits).orderBy("z").collect()] == pytest.approx([row.ys[0], row.ys[-1]])
    none = T.isotonic_fits(df.limit(0), "z", "y")
    assert [tuple(r) for r in none.collect()] == [([], [])] and T.interpolated(far, "z", none).where("calibrated is not null").count() == 0
    assert T.isotonic_fits(df.limit(0), "z", "y", ["g"]).collect() == []


def test_temperatures_of_every_group_at_once(df, data):
    got = {r.g: r.temperature for r in T.fit_temperatures(df, "z", "y", ["g"]).collect()}
    for g in ("a", "b", "up", "same"):
        own = [r for r in data if r[0] == g]
        assert got[g] == pytest.approx(plain_temperature([r[1] for r in own], [r[2] for r in own]), abs=1e-9)
    assert "none" not in got
    whole = M.fit_temperature(df, "z", "y").first()[0]
    assert whole == pytest.approx(plain_temperature([r[1] for r in data], [r[2] for r in data]), abs=1e-9)
    assert T.fit_temperatures(df.limit(0), "z", "y").first()[0] == 1.0 and T.fit_temperatures(df.limit(0), "z", "y", ["g"]).collect() == []
    assert "400" not in T.fit_temperatures(df, "z", "y")._jdf.queryExecution().toString()  # no plan multiplies rows by the grid


def test_thresholds_of_every_group(df, data, spark):
    got = {r.g: r.threshold for r in M.threshold_at_sensitivity(df, "y", "z", 0.9, ["g"]).collect()}
    for g in ("a", "b", "up", "one", "same"):
        own = spark.createDataFrame([r for r in data if r[0] == g], SCHEMA)
        assert got[g] == M.threshold_at_sensitivity(own, "y", "z", 0.9).first()[0], g


def test_crossfit_of_a_small_and_a_larger_site(df, spark):
    """Few rows: held-out parts are too small, so every fold takes a temperature of all its rows. More rows: every row has one score, of the other fold."""
    few = K.crossfit_scores(df.where("g = 'a' and z is not null"), "key", "z", "y", repeats=2).collect()
    assert len(few) == 120 and {r.method for r in few} == {"temperature"}
    r = np.random.default_rng(1)
    z = r.normal(size=400) * 2
    rows = [("x", float(v), int(r.random() < 1 / (1 + math.exp(-3 * v))), k) for k, v in enumerate(z)]
    site = spark.createDataFrame(rows, SCHEMA)
    scored = K.crossfit_scores(site, "key", "z", "y", repeats=2).collect()
    assert sorted((r.repeat, r.key) for r in scored) == [(a, b) for a in range(2) for b in range(400)] and all(0 <= r.p <= 1 for r in scored)
    assert len({(r.repeat, r.fold, r.method, r.threshold) for r in scored}) == 4
