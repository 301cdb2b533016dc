"""Order statistics against numpy, with small parts so that ranges are cut again and again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import metrics as M
from caselight.operators import order as Q

AT = [0.0, 0.05, 1 / 3, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize(("parts", "few"), [(4096, 4096), (64, 3)])
def test_quantiles_by_group(spark, monkeypatch, parts, few):
    monkeypatch.setattr(Q, "PARTS", parts), monkeypatch.setattr(Q, "FEW", few)
    r = np.random.default_rng(parts)
    groups = {"ties": r.integers(0, 3, 200).astype(float), "skew": np.exp(r.normal(0, 8, 300)), "one": np.array([7.5]), None: r.normal(size=50), "same": np.full(40, -2.0), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("ties", None), ("skew", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(x.g, x.fraction): x.value for x in Q.quantiles(df, "v", AT, ["g"]).collect()}
    assert len(got) == len(groups) * len(AT)
    for g, v in groups.items():
        if g == "wide":
            continue
        for f in AT:
            assert got[g, f] == pytest.approx(np.quantile(v, f), rel=1e-12, abs=1e-12), (g, f)
    assert got["wide", 0.0] == -1.7e308 and got["wide", 1.0] == 1.7e308
    whole = {x.fraction: x.value for x in Q.quantiles(df.where("g <> 'wide'"), F.col("v") * 2, [0.5, 0.9]).collect()}
    both = np.concatenate([v for g, v in groups.items() if g not in (None, "wide")]) * 2
    assert whole == {f: pytest.approx(np.quantile(both, f)) for f in (0.5, 0.9)}
    assert Q.quantiles(df.limit(0), "v", AT, ["g"]).collect() == []


def test_no_task_gathers_the_values(spark):
    """The plan of a band has no percentile: groups are counts of parts."""
    df = spark.range(20_000).select((F.col("id") % 997 / 1000.0 + 0.001).alias("p"))
    band = M.abstention_bands(df, "p", 0.5, [1.0, 0.85, 0.5])
    assert "percentile" not in band._jdf.queryExecution().toString().lower()
    p = np.array([k % 997 / 1000.0 + 0.001 for k in range(20_000)])
    d = np.abs(np.log(p / (1 - p)))
    got = {r.coverage: (r.low, r.high) for r in band.collect()}
    for c in (0.85, 0.5):
        cut = np.quantile(d, 1 - c)
        assert got[c] == pytest.approx((1 / (1 + np.exp(cut)), 1 / (1 + np.exp(-cut))))
    assert got[1.0] == (0.5, 0.5)
