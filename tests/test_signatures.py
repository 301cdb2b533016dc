"""Signatures, near pairs, and what duplicates leave, against plain walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import signatures as G

SCHEMA = "k long, bits array<long>"


def signed(x):
    return [int(w) - (1 << 64) if w >> 63 else int(w) for w in ((x >> s) & ((1 << 64) - 1) for s in (192, 128, 64, 0))]


@pytest.fixture(scope="module")
def bits():
    r = np.random.default_rng(9)
    draw = lambda: int.from_bytes(r.bytes(32), "big")
    out = []
    for _ in range(25):
        centre = draw()
        for _ in range(int(r.integers(1, 6))):
            x = centre
            for b in r.integers(0, 256, int(r.integers(0, 18))):
                x ^= 1 << int(b)
            out += [x] * int(r.integers(1, 3))
    r.shuffle(out)
    return [out[0] ^ (1 << 255), *out, out[0], out[0]]


def test_pairs_lose_nothing(spark, bits):
    df = spark.createDataFrame([*((k, signed(x)) for k, x in enumerate(bits)), (999, None)], SCHEMA).repartition(4)
    want = {(a, b, d) for a in range(len(bits)) for b in range(a + 1, len(bits)) if (d := (bits[a] ^ bits[b]).bit_count()) <= 12}
    got = [tuple(r) for r in G.probed_pairs(df, "k", "bits", 12).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    exact = {(a, b) for a, b, d in want if d <= 3}
    assert {(r.a, r.b) for r in G.probed_pairs(df, "k", "bits", 3, bands=4).collect()} == exact
    with pytest.raises(ValueError):
        G.probed_pairs(df, "k", "bits", 12, bands=5)


def walk(bits):
    leaders, out = [], {}
    for k, x in enumerate(bits):
        out[k] = next((j for j in leaders if (bits[j] ^ x).bit_count() <= 12), k)
        if out[k] == k:
            leaders.append(k)
    return out


def test_probes_are_not_broadcast(spark, bits, tmp_path):
    """Some 260 probes a row would fill the driver, however small Spark takes the stored table for."""
    spark.createDataFrame([(k, signed(x)) for k, x in enumerate(bits)], SCHEMA).write.parquet(f"{tmp_path}/signed")
    found = G.probed_pairs(spark.read.parquet(f"{tmp_path}/signed"), "k", "bits", 12)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_leaders_equal_the_walk(spark, bits):
    df = spark.createDataFrame([*((k, signed(x)) for k, x in enumerate(bits)), (999, None)], SCHEMA)
    got = {r.k: r.leader for r in G.near_groups(df, "k", "bits", 12).collect()}
    assert got == walk(bits) | {999: 999}
    assert G.near_groups(df.limit(0), "k", "bits", 12).collect() == []


def test_signatures_of_vectors(spark):
    rows = [(1, [0.5, -1.0, 2.0]), (2, None), (3, []), (4, [-0.5, 1.0, -2.0]), (5, [1.0] * 200)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, v array<double>").select("k", G.signature("v").alias("s")).collect()}
    assert got[2] is None and got[3] is None and len(got[5]) == 4
    side = (G.planes(3, 256).astype(float) @ np.array([0.5, -1.0, 2.0]) > 0).tolist()
    assert [b == "1" for w in got[1] for b in f"{w % (1 << 64):064b}"] == side
    assert all(a ^ b == -1 for a, b in zip(got[1], got[4], strict=True))  # opposite vectors differ in all bits


def test_what_duplicates_leave(spark, bits):
    """Near groups first, exact groups that share no row with them, conflicts whole, new numbers."""
    r = np.random.default_rng(2)
    n, led = len(bits), walk(bits)
    label = [int(x) if x < 3 else None for x in r.integers(0, 4, n) // 2 * 2]
    digest = [f"d{int(x)}" for x in r.integers(0, n // 2, n)]
    near = spark.createDataFrame(list(led.items()), "k long, leader long")
    content = spark.createDataFrame([(k, digest[k], label[k]) for k in range(n)], "k long, digest string, label int").repartition(3)
    groups = [g for l in set(led.values()) if 2 <= len(g := [k for k in led if led[k] == l]) <= 3]
    covered = {k for g in groups for k in g}
    groups += [g for d in set(digest) if len(g := [k for k in range(n) if digest[k] == d]) > 1 and not set(g) & covered]
    conflicts = [g for g in groups if len({label[k] for k in g}) > 1]
    gone = {k for g in groups for k in (g if g in conflicts else g[1:])}
    left, told = G.without_duplicates(near, content, "k", "digest", "label", most=3, guard=1.0)
    stay = [k for k in range(n) if k not in gone]
    assert [(x.k, x.subject) for x in left.orderBy("k").collect()] == [(k, f"S{i:05d}") for i, k in enumerate(stay)]
    assert sorted((x.leader, x.n) for x in told.collect()) == sorted((min(g), len(g)) for g in conflicts) and conflicts
    with pytest.raises(ValueError):
        G.without_duplicates(near, content, "k", "digest", "label", most=3, guard=0.01)


def test_numbers_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r.k, r.number) for r in G.numbered(df, "k").orderBy("k").collect()] == [(k, k) for k in range(1000)]
