"""Mixing sources to target weights: exponential keys (Efraimidis-Spirakis), prefix sums to a budget, complete epochs first."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import if_small, lookup, stored, words

#: Weights of the sources in the order of their code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST_EPOCHS = 3
#: Rows of one range of keys, about; only the range in which a budget ends is sorted.
RANGE_ROWS = 200_000
#: Sources up to which the plan is broadcast as it is.
SMALL_PLAN = 10_000


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def quality_weight(text: Column) -> Column:
    """A document's sampling weight in [0.05, 1]: its different words against those expected of its length (twice the 0.75th power)."""
    w = words(text)
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.size(F.array_distinct(w)) / (2 * F.pow(n, F.lit(0.75)))))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), the same for the same id and text on every run."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def of_source(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))


def sized(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, of, size, key) of every row. Sorting by key samples without replacement, weighted by quality_weight()."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    key = -F.log(uniform(F.col("id"), F.col("text"), seed)) / quality_weight(F.col("text"))
    return rows.select("id", "source", of_source(F.col("source")).alias("of"), word_count(F.col("text")).alias("size"), key.alias("key"))


def targets(sizes: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row a source.

    share of the sum of all sizes is dealt by weight; a target stops at `most` times its source's size and the excess goes to
    the others by weight until none is above. Sorted by the level at which each source stops, that is one pass of prefix sums.
    """
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * F.lit(float(most)))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    whole = W.partitionBy()
    before = whole.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    among = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("offer", left / among)
    # The first source that can take its offer fixes the level for it and for all after it.
    fits = F.min(F.when(F.col("offer") <= F.col("level"), F.struct("level", F.col("source").isNull(), "source", "offer"))).over(whole)
    level = fits["offer"]
    return rows.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)).alias("target"))


def ranges(rows: DataFrame) -> list[float]:
    """Cuts of the keys into ranges of about RANGE_ROWS rows: no source has more in one, whatever its weights. Some hundred numbers at most for 10^8 rows."""
    n = max(256, math.ceil(rows.count() / RANGE_ROWS))
    cuts = sorted(set(rows.approxQuantile("key", [k / n for k in range(1, n)], 0.5 / n)))
    return [-math.inf, *(cuts or [0.0]), math.inf]


def in_range(rows: DataFrame, cuts: list[float]) -> DataFrame:
    return Bucketizer(splits=cuts, inputCol="key", outputCol="range").transform(rows)


def plan(rows: DataFrame, goals: DataFrame, cuts: list[float]) -> DataFrame:
    """For each source (of): its complete epochs, the range of keys in which its budget ends, and within it `inner`, the last (key, id,
    size) that is taken once more as a whole, and `edge`, the next one, of whose equal rows only `some` are taken; null: none.

    A source may hold a third of all rows: its sizes are summed by ranges of keys first, and only the documents of the range in
    which the budget ends are sorted, after equal ones are counted.
    """
    ranged = in_range(rows, cuts)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("of", of_source(F.col("source"))).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = ranged.groupBy("of", "range").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(W.partitionBy("of").orderBy("range")) - F.col("n"))
    last = sums.join(goals.select("of", "rest"), "of").where("before <= rest and rest > 0")
    last = stored(last.groupBy("of").agg(F.max(F.struct("range", "before")).alias("end"), F.first("rest").alias("rest")), "ends")
    ends = last.select("of", F.col("end.range").alias("range"), F.col("end.before").alias("before"), "rest")
    inside = ranged.join(if_small(ends), ["of", "range"]).groupBy("of", "before", "rest", "key", "id", "size").agg(F.count("*").alias("rows"))
    order = W.partitionBy("of").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order), F.lit(0)))
    fit = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)
    inside = inside.withColumn("some", F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("rest"), F.col("rows")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("rows"), fit))))
    place = F.struct("key", "id", "size")
    # Everything before the first group that is not taken whole; that group is the edge.
    edge = inside.where("some < rows").groupBy("of").agg(F.min(F.struct("key", "id", "size", "some", "rows")).alias("edge"))
    inner = inside.groupBy("of").agg(F.max(place).alias("end_place"))
    done = goals.join(ends.select("of", F.col("range").alias("end_range")), "of", "left").join(inner, "of", "left").join(edge, "of", "left")
    return done.select("of", "source_size", "target", "epochs", "end_range", "edge", F.when(F.col("edge").isNull(), F.col("end_place")).alias("inner"))


def planned(rows: DataFrame, share: float, weights: tuple[int, ...]) -> tuple[DataFrame, list[float]]:
    """The stored plan of a mix, with the number of rows of each source, and the cuts of its ranges."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sizes = stored(sizes, "source-sizes")
    cuts = ranges(rows)
    done = plan(rows, stored(targets(sizes.select("source", "source_size"), share, weights), "targets"), cuts)
    return stored(done.join(sizes.select(of_source(F.col("source")).alias("of"), "n_rows"), "of"), "plan"), cuts


def with_taken(rows: DataFrame, plan: DataFrame, cuts: list[float]) -> DataFrame:
    """Adds source_size, target, epochs and taken to rows that have of, id, size and key.

    Rows before a source's edge are taken once more. Of equal rows at the edge `some` are: they are counted by the partitions of a
    stored table, and each partition takes its part of the number, so that no task gathers them.
    """
    n_plan = plan.count()
    ranged = in_range(rows, cuts)
    if n_plan <= SMALL_PLAN:
        joined = ranged.join(F.broadcast(plan.drop("n_rows")), "of", "left")
    else:
        joined = lookup(ranged, plan, "of", "n_rows", rows.count()).drop("n_rows")
    place = F.struct("key", "id", "size")
    same_id = F.col("id").eqNullSafe(F.col("edge.id")) & (F.col("key") == F.col("edge.key")) & (F.col("size") == F.col("edge.size"))
    at_edge = F.coalesce((F.col("edge.some") > 0) & same_id & (F.col("range") == F.col("end_range")), F.lit(False))
    more = (F.col("range") < F.col("end_range")) | ((F.col("range") == F.col("end_range")) & F.when(F.col("edge").isNull(), place <= F.col("inner")).otherwise(place < F.struct("edge.key", "edge.id", "edge.size")))
    taken = lambda once: F.col("size") * (F.col("epochs") + F.coalesce(once, F.lit(False)).cast("long"))
    extra = ["range", "end_range", "inner", "edge"]
    if not plan.where("edge.some > 0").limit(1).count():
        return joined.withColumn("taken", taken(more)).drop(*extra)
    plain = joined.where(~at_edge).withColumn("taken", taken(more)).drop(*extra)
    edge = stored(joined.where(at_edge).withColumn("__row", F.monotonically_increasing_id()), "edge")
    part = F.shiftright("__row", 33)
    counts = edge.groupBy("of", part.alias("__part")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("of").orderBy("__part")) - F.col("__n")).drop("__n")
    ranked = edge.withColumn("__part", part).withColumn("__rank", F.row_number().over(W.partitionBy("of", "__part").orderBy("__row")))
    ranked = ranked.join(F.broadcast(counts), ["of", "__part"]).withColumn("taken", taken(F.col("__before") + F.col("__rank") <= F.col("edge.some")))
    return plain.unionByName(ranked.drop(*extra, "__row", "__part", "__rank", "__before").select(*plain.columns))


def mix(docs: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", **cols: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of every row of docs; taken counts words with repeats.

    size is the number of words (null text: 0). A null source is a source. Keys come from ids and texts, so reruns agree, and
    rows with a null id differ by their texts. Of equal rows as many are taken as the budget needs. Sources without words have
    target 0. Empty table: no rows. Other columns are ignored.
    """
    rows = stored(sized(docs, seed, **cols), "sizes")
    taken = with_taken(rows, *planned(rows, share, weights))
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "taken")


def mixed_documents(docs: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, with all their columns, mix_words, mix_copies and mix_taken. Texts are not shuffled.

    Rows are as in mix(); documents of no words are in no mix. Empty table: no rows.
    """
    plan, cuts = planned(stored(sized(docs, seed), "sizes"), share, weights)
    own = {c: f"own_{k}" for k, c in enumerate(docs.columns)}
    text = F.col("text").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col("doc_id").cast("long").alias("id"), of_source(F.col("source").cast("string")).alias("of"), text.alias("text"))
    key = -F.log(uniform(F.col("id"), F.col("text"), seed)) / quality_weight(F.col("text"))
    rows = rows.withColumn("size", word_count(F.col("text"))).withColumn("key", key).drop("text")
    taken = with_taken(rows, plan, cuts).where("taken > 0")
    copies = (F.col("taken") / F.col("size")).cast("long")
    return taken.select(*[F.col(n).alias(c) for c, n in own.items()], F.col("size").alias("mix_words"), copies.alias("mix_copies"), F.col("taken").alias("mix_taken"))
