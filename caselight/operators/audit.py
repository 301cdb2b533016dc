"""Hash chains over a log, checks of them, and the state of a registry replayed from its events."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.operators.store import written

GENESIS = "0" * 64
#: Entries chained in one task. Each block starts at GENESIS; the last hashes of blocks are chained in turn, in as many levels as it takes.
BLOCK = 256


def chain(log: DataFrame, seq: str, body: str, block: int = BLOCK) -> DataFrame:
    """Adds block, prev_hash and entry_hash = SHA-256 of prev_hash and body. A link needs its predecessor, but only within a block of bounded size."""
    rows = log.withColumn("block", F.floor(F.col(seq) / block).cast("long"))
    schema = rows.select("block", seq).schema.add("prev_hash", "string").add("entry_hash", "string")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part, prev, out = part.sort_values(seq), GENESIS, []
        for text in part[body]:
            now = hashlib.sha256((prev + text).encode()).hexdigest()
            out.append((prev, now))
            prev = now
        return part[["block", seq]].assign(prev_hash=[p for p, _ in out], entry_hash=[n for _, n in out])

    links = rows.select("block", seq, body).groupBy("block").applyInPandas(link, schema)
    return rows.drop("block").join(links, seq)


def heads(chained: DataFrame, seq: str) -> DataFrame:
    """(level, block, entries, head): the last hash of each block, and of blocks of those, up to one."""
    level = 0
    last = lambda df, s: df.groupBy("block").agg(F.count("*").alias("entries"), F.max_by("entry_hash", s).alias("head"))
    now = written(last(chained, seq), "heads")
    out = now.select(F.lit(0).alias("level"), "block", "entries", "head")
    while now.agg(F.max("block")).first()[0]:
        level += 1
        now = written(last(chain(now.select(F.col("block").alias("seq"), F.col("head").alias("body")), "seq", "body"), "seq"), "heads")
        out = out.unionByName(now.select(F.lit(level).alias("level"), "block", "entries", "head"))
    return out


def verify(log: DataFrame, seq: str, body: str, stored_heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, problem): entries whose hash or link is wrong, and blocks that lack their last entry. Nothing is recomputed in sequence."""
    rows = log.withColumn("block", F.floor(F.col(seq) / block).cast("long"))
    before = F.coalesce(F.lag("entry_hash").over(W.partitionBy("block").orderBy(seq)), F.lit(GENESIS))
    altered = F.when(F.sha2(F.concat("prev_hash", body).cast("binary"), 256) != F.col("entry_hash"), "altered")
    broken = F.when(F.col("prev_hash") != F.col("before"), "broken link")
    own = rows.withColumn("before", before).select(F.col(seq).alias("seq"), F.explode(F.array_compact(F.array(altered, broken))).alias("problem"))
    found = rows.groupBy("block").agg(F.max_by("entry_hash", seq).alias("found"))
    ends = stored_heads.where("level = 0").join(found, "block", "left").where(~F.col("head").eqNullSafe(F.col("found")))
    return own.unionByName(ends.select((F.col("block") * block).alias("seq"), F.lit("end missing").alias("problem")))


def verify_heads(stored_heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(level, block, problem): heads above level 0 that don't follow from those below, so that who rewrites a block and its head is
    found up to the root; heads that lack their level above, and a top that isn't one."""
    stored_heads = stored_heads.where("head is not null")
    top = stored_heads.agg(F.max("level")).first()[0]
    out = stored_heads.where("false").select("level", "block", F.lit("").alias("problem"))
    if top is None:
        return out
    for level in range(1, top + 1):
        below = stored_heads.where(F.col("level") == level - 1).select(F.col("block").alias("seq"), F.col("head").alias("body"))
        made = chain(below, "seq", "body", block).groupBy("block").agg(F.max_by("entry_hash", "seq").alias("made"))
        kept = stored_heads.where(F.col("level") == level).select("block", "head")
        wrong = made.join(kept, "block", "full").where(~F.col("made").eqNullSafe(F.col("head")))
        out = out.unionByName(wrong.select(F.lit(level).alias("level"), "block", F.lit("head doesn't follow").alias("problem")))
    roots = stored_heads.where(F.col("level") == top).where("block > 0")
    return out.unionByName(roots.select("level", "block", F.lit("no single root").alias("problem")))


def verified(log: DataFrame, seq: str, body: str, stored_heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ok, entries, head, problems): one row for the whole log, of verify() and verify_heads() together."""
    bad = verify(log, seq, body, stored_heads, block).agg(F.count("*").alias("a")).crossJoin(verify_heads(stored_heads, block).agg(F.count("*").alias("b")))
    root = stored_heads.agg(F.max_by("head", F.struct("level", "block")).alias("head"))
    counted = log.agg(F.count("*").alias("entries"))
    return counted.crossJoin(root).crossJoin(bad).select(((F.col("a") + F.col("b")) == 0).alias("ok"), "entries", "head", (F.col("a") + F.col("b")).alias("problems"))


def anchored(rows: DataFrame, log: DataFrame, key: str, action: str, seq: str = "seq") -> DataFrame:
    """(seq, key, action, legacy): the log's entries with those of missing_entries() appended after its last number; a second run appends none.

    New numbers follow the order of the key, by a sort in ranges; a range's first number comes from the sizes of those before it.
    """
    new = missing_entries(rows, log, key, action).repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    new = written(new.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(key))), "legacy")
    sizes = new.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    last = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_last"))
    numbered = new.join(F.broadcast(before), "_part").crossJoin(F.broadcast(last)).withColumn(seq, F.col("_last") + F.col("_before") + F.col("_at"))
    old = log.select(seq, key, "action", F.lit(False).alias("legacy"))
    return old.unionByName(numbered.select(F.col(seq).cast(log.schema[seq].dataType).alias(seq), key, "action", "legacy"))


def missing_entries(rows: DataFrame, log: DataFrame, key: str, action: str) -> DataFrame:
    """Legacy entries for rows that the log doesn't name yet; none on a second run."""
    known = log.where((F.col("action") == action) & F.col(key).isNotNull()).select(key)
    return rows.join(known, key, "left_anti").select(key, F.lit(action).alias("action"), F.lit(True).alias("legacy"))


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the columns of either; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def append_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old table that the new one changed or lost."""
    columns = [c for c in old.columns if c != key]
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(name))
    j = digest(old, "a").join(digest(new, "b"), key, "left")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("b").isNull(), "deleted").otherwise("updated").alias("problem"))


def registry_status(events: DataFrame) -> DataFrame:
    """(kind, version, status, replaced) from events (kind, version, action, seq): the last one promoted or rolled back to is active, former ones are retired."""
    switch = events.where(F.col("action").isin("promoted", "rolled back"))
    last = switch.groupBy("kind").agg(F.max("seq").alias("at"), F.max_by("version", "seq").alias("active"))
    before = switch.join(F.broadcast(last), "kind").where("seq < at and version <> active").groupBy("kind").agg(F.max_by("version", "seq").alias("replaced"))
    versions = events.groupBy("kind", "version").agg(F.bool_or(F.col("action").isin("promoted", "rolled back")).alias("was"))
    j = versions.join(F.broadcast(last), "kind", "left").join(F.broadcast(before), "kind", "left")
    active = F.coalesce(F.col("version") == F.col("active"), F.lit(False))
    return j.select("kind", "version", F.when(active, "active").when(F.col("was"), "retired").otherwise("candidate").alias("status"), F.when(active, F.col("replaced")).alias("replaced"))


def check_promotions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds problem (null if allowed). requests: kind, version, approver, reason, override. versions: kind, version, not_worse (null: not compared)."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    j = requests.join(versions.select("kind", "version", "not_worse", F.lit(True).alias("known")), ["kind", "version"], "left")
    problem = F.when(empty("approver") | empty("reason"), "no approver or reason").when(F.col("known").isNull(), "unknown version").when(~F.col("not_worse") & empty("override"), "worse than the active version")
    return j.withColumn("problem", problem).drop("known")
