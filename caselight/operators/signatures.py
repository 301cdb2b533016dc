"""Signatures of many bits by random hyperplanes, pairs of near ones by probed bands, and what duplicates leave of a table."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.operators.curation import flagged_groups, near_walk
from caselight.operators.store import written

#: Longs of a signature of 256 bits, and bands into which it is cut.
WORDS, BANDS = 4, 7


def planes(size: int, bits: int, seed: str = "plane") -> np.ndarray:
    """bits x size of -1 and 1 from hashes: the same in every task and engine."""
    digest = lambda k: b"".join(hashlib.md5(f"{seed}:{k}{f':{lot}' if lot else ''}".encode()).digest() for lot in range(-(-size // 128)))
    raw = np.frombuffer(b"".join(digest(k) for k in range(bits)), dtype=np.uint8).reshape(bits, -1)
    return np.unpackbits(raw, axis=1)[:, :size].astype(np.int8) * 2 - 1


def signature(embedding: str | Column, words: int = WORDS, seed: str = "plane") -> Column:
    """An array of longs with a bit for each hyperplane: on which side of it the vector lies. Null for a null or empty vector."""
    made: dict[int, np.ndarray] = {}

    @F.pandas_udf("array<long>")
    def sides(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        size = vectors.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            plane = made.setdefault(n, planes(n, 64 * words, seed).astype(float))
            bits = np.packbits(np.stack([np.asarray(vectors.iloc[k], dtype=float) for k in at]) @ plane.T > 0, axis=1)
            for k, row in zip(at.tolist(), bits.view(">i8").astype(np.int64).tolist(), strict=True):
                out[k] = row
        return pd.Series(out)

    return sides(F.col(embedding) if isinstance(embedding, str) else embedding)


def _distance(x: Column, y: Column, words: int) -> Column:
    return sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in range(1, words)), F.bit_count(x[0].bitwiseXOR(y[0])))


def probed_pairs(df: DataFrame, key: str, bits: str, distance: int, words: int = WORDS, bands: int = BANDS) -> DataFrame:
    """(a, b, distance) of pairs of rows with a < b whose signatures, arrays of longs, differ in at most `distance` bits.

    Of `bands` bands one differs in at most distance // bands bits, as not all can differ in more. So a row lies in the bucket of each of its bands, and probes the
    buckets that near: wide bands keep buckets small in large tables. A pair is given out by the first such band. Equal signatures should be one row (near_groups).
    """
    radius = distance // bands
    if radius > 1:
        raise ValueError("more bands are needed: a band may differ in one bit at most")
    share = [bands * k // words for k in range(words + 1)]
    cuts = [(w, 64 * j // n, 64 * (j + 1) // n) for w, n in enumerate(b - a for a, b in zip(share[:-1], share[1:], strict=True)) for j in range(n)]
    if any(a == b for a, b in zip(share[:-1], share[1:], strict=True)):
        raise ValueError("a band must lie in each word")
    cut = lambda x, w, a, b: x[w] if b - a == 64 else F.shiftrightunsigned(x[w], a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    rows = df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("x"))
    bucket = lambda n, v: F.struct(F.lit(n).alias("band"), v.alias("part"))
    own = F.array(*[bucket(n, cut(F.col("x"), *c)) for n, c in enumerate(cuts)])
    flips = lambda c: [F.lit(0).cast("long"), *[F.lit(1 << j if j < 63 else -(1 << 63)).cast("long") for j in range(c[2] - c[1])]][: None if radius else 1]
    around = lambda n, c: F.transform(F.array(*flips(c)), lambda f: bucket(n, cut(F.col("x"), *c).bitwiseXOR(f)))
    probes = F.flatten(F.array(*[around(n, c) for n, c in enumerate(cuts)]))
    lying = rows.select("k", "x", F.explode(own).alias("p"))
    asking = rows.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.explode(probes).alias("p"))
    near = _distance(F.col("x"), F.col("x2"), words)
    first = F.coalesce(*[F.when(F.bit_count(cut(F.col("x"), *c).bitwiseXOR(cut(F.col("x2"), *c))) <= radius, F.lit(n)) for n, c in enumerate(cuts)])
    # Spark takes exploded rows for as small as the file and would broadcast the probes, which are some 260 a row.
    found = lying.join(asking.hint("merge"), "p").where((F.col("k") < F.col("k2")) & (near <= distance) & (first == F.col("p.band")))
    return found.select(F.col("k").alias("a"), F.col("k2").alias("b"), near.cast("int").alias("distance"))


def near_groups(df: DataFrame, key: str, bits: str, distance: int = 12, words: int = WORDS, bands: int = BANDS) -> DataFrame:
    """(key, leader): in order of key a row joins the first leader within the distance, else becomes one. Not transitive.

    Rows of one signature go the way of the first of them, so each signature walks once, however many rows have it. Rows without a signature lead themselves.
    """
    rows = df.select(F.col(key).alias("k"), F.col(bits).alias("x"))
    ones = written(rows.where("x is not null").groupBy("x").agg(F.min("k").alias("k")), "signatures")
    led = near_walk(written(probed_pairs(ones, "k", "x", distance, words, bands).select("a", "b"), "pairs"))
    ones = ones.join(led.select(F.col("b").alias("k"), "leader"), "k", "left").select("x", F.coalesce("leader", "k").alias("leader"))
    return rows.join(ones, "x", "left").select(F.col("k").alias(key), F.coalesce("leader", "k").alias("leader"))


def numbered(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Adds the rank of a unique key from 0. Ranges of keys are sorted by themselves and start where the ranges before them end."""
    ranged = written(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    starts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    starts = starts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    rows = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")


def without_duplicates(near: DataFrame, content: DataFrame, key: str, digest: str, label: str, most: int = 8, guard: float = 0.25, prefix: str = "S") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, conflicts) of content, whose keys are unique; near has (key, leader).

    Groups are the near ones of 2 to `most` rows, larger ones are suspicious and stay whole, and those of equal digests that share no row with a near group. Of a group
    that agrees in its label the first row stays; of one that doesn't all rows go, and it is a conflict (leader, n, labels). An error if more than `guard` of
    the rows would go. What stays is numbered anew in the order of keys: subject is the prefix and five digits or more.
    """
    good = flagged_groups(near, most).where("not suspicious").select("leader")
    members = written(near.join(good, "leader", "left_semi").select(F.col(key).alias("k"), "leader"), "near-members")
    touched = content.join(members.select(F.col("k").alias(key)), key, "left_semi").select(digest).distinct()
    free = content.where(F.col(digest).isNotNull()).join(touched, digest, "left_anti")
    exact = free.groupBy(digest).agg(F.min(key).alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = free.join(exact, digest).select(F.col(key).alias("k"), "leader")
    grouped = written(members.unionByName(copies).join(content.select(F.col(key).alias("k"), F.col(label).alias("label")), "k"), "groups")
    # Labels as text, so that a missing one counts as a label of its own.
    told = grouped.groupBy("leader").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce(F.col("label").cast("string"), F.lit("\0"))).alias("labels"))
    gone = written(grouped.join(told, "leader").where((F.col("labels") > 1) | (F.col("k") != F.col("leader"))).select(F.col("k").alias(key)), "gone")
    if gone.count() > guard * content.count():
        raise ValueError("more rows than the guard allows would go")
    left = numbered(content.join(gone, key, "left_anti"), key, "_number")
    digits = F.greatest(F.lit(5), F.length(F.col("_number").cast("string")))
    subject = F.concat(F.lit(prefix), F.lpad(F.col("_number").cast("string"), digits, F.lit("0")))
    return left.withColumn("subject", subject).drop("_number"), told.where("labels > 1")
