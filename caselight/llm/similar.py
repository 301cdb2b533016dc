"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least a bound, found without loss."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, bounded_batches, if_small, stored, without
from .graph import components
from .simhash import digests, link_fingerprints, majority

#: Words of a shingle, and the least similarity of a link.
SHINGLE, LEAST = 5, 0.8
#: Counters of the sketch that tells common shingles from rare ones (by the top bits of a shingle's hash).
SKETCH_BITS = 20
#: Each so many shingles of a set lengthen its prefix by one, and sets that are alike share one more of their prefixes: prefixes of
#: |x| - 0.8 |x| + t and |y| - 0.8 |y| + t' shingles share the lesser of t and t' at least. Long texts that share a few by chance don't.
MEETING = 20
#: Bins of a set's parities. Two sets differ in at least as many shingles as their parities differ in bins.
BINS = 1024


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles; a text without words has one of its own, so that such texts are alike."""
    found = np.unique(digests(text, shingle))
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def needed(size: int, least: float) -> int:
    """The shingles that a set of this size shares, at least, with any set that is alike."""
    return max(1, math.ceil(round(least * size, 9)))


def prefix(found: np.ndarray, level: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in an order that all sets share, rare ones before common ones: sets that are alike share `meeting` of these."""
    order = np.argsort(level[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return found[order[: len(found) - needed(len(found), least) + 1 + len(found) // MEETING]]


def parities(found: np.ndarray) -> bytes:
    return np.packbits(np.bincount((found % np.uint64(BINS)).astype(np.int64), minlength=BINS) & 1).tobytes()


def _texts(b: pa.RecordBatch, k: int) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(k))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    names, counts = ["id", "key", "fp", "parity", "cell", "often"], np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for b in batches:
        fps, parity = np.zeros(b.num_rows, dtype=np.uint64), []
        for at, text in enumerate(_texts(b, 2)):
            found = digests(text, shingle)
            fps[at] = majority(found)
            parity.append(parities(np.unique(found) if len(found) else shingle_set(b"", shingle)))
            counts[np.unique(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(fps), pa.array(parity, pa.binary()), none, none], names)
    hot = np.flatnonzero(counts > 2 + 4 * counts.mean())
    none = pa.nulls(len(hot), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(hot), pa.binary()), pa.array(hot), pa.array(counts[hot])], names)


def _whole_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first column, cut so that no run of it is split."""
    parts: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        cut = int((cols[0] == cols[0][-1]).argmax())
        if parts and (cut or parts[-1][0][-1] != cols[0][0]):
            whole = [np.concatenate(x) for x in zip(*parts, [c[:0] for c in cols], strict=True)]
            end = int(np.searchsorted(cols[0][: cut or 1], parts[-1][0][-1], side="right")) if cols[0][0] == parts[-1][0][-1] else 0
            yield [np.concatenate([w, c[:end]]) for w, c in zip(whole, cols, strict=True)]
            cols, parts, cut = [c[end:] for c in cols], [], cut - end
        if cut:
            yield [c[:cut] for c in cols]
        parts.append([c[cut:] for c in cols])
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (shingle, key): those of shingles that several texts have, each beside the first text of its shingle."""
    for shingle, key, size in _whole_runs(batches, 3):
        new = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        first = np.repeat(new, np.diff(np.r_[new, len(shingle)]))
        several = np.repeat(np.maximum.reduceat(key, new) > key[new], np.diff(np.r_[new, len(shingle)]))
        at, first = np.flatnonzero(several), first[several]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (shingle[at], key[at], size[at], key[first], size[first])], ["shingle", "key", "size", "seed", "seed_size"])


def _open_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (shingle, component): the pairs of one shingle in different components whose parities allow the similarity, and
    how many shingles of their prefixes they must share."""
    for shingle, c, key, size, *parity in _whole_runs(batches, 4 + BINS // 64):
        bits = np.stack([x.view(np.uint64) for x in parity], axis=1)
        new = np.flatnonzero(np.r_[True, (shingle[1:] != shingle[:-1]) | (c[1:] != c[:-1])])
        last = np.r_[np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, len(shingle)]
        ends = last[np.searchsorted(last, new, side="right")]
        out = []
        for a, z, end in zip(new, np.r_[new[1:], len(shingle)], ends, strict=True):
            for at in range(a, z) if end > z else ():
                other = slice(z, end)
                apart = np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1, dtype=np.int64)
                both, most = size[other] + size[at], np.minimum(size[other], size[at])
                ok = (most >= np.round(least * np.maximum(size[other], size[at]), 9)) & (apart <= np.round(both * (1 - least) / (1 + least), 9))
                if ok.any():
                    out.append(np.stack([np.full(int(ok.sum()), key[at]), key[other][ok], 1 + most[ok] // MEETING]))
        if out:
            u, v, t = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(t)], ["u", "v", "t"])


def _alike(batches: Iterator[pa.RecordBatch], shingle: int, least: float) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    for b in batches:
        u, v, left, right = (b.column(k) for k in range(4))
        hit = np.zeros(b.num_rows, dtype=bool)
        for at, (own, other) in enumerate(zip(_texts(b, 2), _texts(b, 3), strict=True)):
            if own != last:
                last, known = own, shingle_set(own, shingle)
            found = shingle_set(other, shingle)
            both = len(np.intersect1d(known, found, assume_unique=True))
            hit[at] = both >= round(least * (len(known) + len(found) - both), 9)
        yield pa.RecordBatch.from_arrays([u.filter(pa.array(hit)), v.filter(pa.array(hit))], ["u", "v"])


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (u, v) of keys whose texts reach the similarity, by their whole sets of shingles."""
    keys = stored(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "candidates")
    own = stored(among(texts, keys, "key").dropDuplicates(["key"]), "candidate-texts")
    both = pairs.join(own.select(F.col("key").alias("u"), F.col("text").alias("left")), "u").join(own.select(F.col("key").alias("v"), F.col("text").alias("right")), "v")
    return both.select("u", "v", "left", "right").mapInArrow(lambda batches: _alike(batches, shingle, least), "u long, v long")


def links(profile: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(id, component) of keys of texts that are alike.

    Candidates are fingerprints that op1 links through its pivot distances, and texts that share a shingle of their prefixes,
    which no pair that reaches the similarity can miss. The latter are taken in two rounds: each text with the first one of each
    shingle, then the pairs that are still in different components, unless their parities show too many differences. Every link is verified by the whole sets.
    """
    spark = texts.sparkSession
    level = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for r in profile.where("cell is not null").groupBy("cell").agg(F.sum("often").alias("n")).toLocalIterator():
        level[r.cell] = r.n.bit_length()
    held = spark.sparkContext.broadcast(level)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), _texts(b, 1), strict=True):
                found = shingle_set(text, shingle)
                own = prefix(found, held.value, least)
                full = lambda v: pa.array(np.full(len(own), v, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([_signed(own), full(key), full(len(found))], ["shingle", "key", "size"])

    dealt = texts.mapInArrow(postings, "shingle long, key long, size long").repartition("shingle").sortWithinPartitions("shingle", "key")
    shared = stored(dealt.mapInArrow(_shared, "shingle long, key long, size long, seed long, seed_size long"), "postings")
    near = lambda a, b: F.least(a, b) >= F.round(F.greatest(F.col(a), F.col(b)) * least, 9)
    # Any choice of stars will do, as the second round takes all pairs that are left: those that share half of what they must, say.
    stars = shared.where("key <> seed").where(near("size", "seed_size")).groupBy(F.col("seed").alias("u"), F.col("key").alias("v")).agg(F.count("*").alias("n"), F.min("size").alias("size"))
    stars = stars.where(F.col("n") > F.col("size") / (2 * MEETING)).select("u", "v")
    marked = link_fingerprints(profile.where("key is not null").groupBy("fp").agg(F.min("key").alias("id")))
    first = stored(stars.unionByName(marked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct(), "star-pairs")
    sure = stored(alike(first, texts, shingle, least), "star-links")
    known = stored(components(sure), "star-components")
    open_ = shared.join(if_small(known.withColumnRenamed("id", "key")), "key", "left").select("shingle", "key", "size", F.coalesce("component", "key").alias("c"))
    open_ = stored(open_, "labelled")
    several = stored(open_.groupBy("shingle").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("shingle"), "open-shingles")
    rest = stored(open_.join(if_small(several), "shingle", "left_semi"), "open-postings")
    words = [F.conv(F.hex(F.substring("parity", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"p{k}") for k in range(BINS // 64)]
    own = profile.where("key is not null").select("key", "parity").dropDuplicates(["key"])
    rest = rest.join(own, "key").select("shingle", "c", "key", "size", *words).repartition("shingle").sortWithinPartitions("shingle", "c")
    pairs = rest.mapInArrow(lambda batches: _open_pairs(batches, least), "u long, v long, t long").groupBy("u", "v").agg(F.count("*").alias("n"), F.max("t").alias("t"))
    pairs = pairs.where("n >= t").select("u", "v")
    more = stored(pairs.join(first, ["u", "v"], "left_anti"), "open-pairs")
    if not more.limit(1).count():
        return known
    return components(sure.unionByName(alike(more, texts, shingle, least)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one row of each group of texts that are alike: that of the smallest id, or of any if all ids are null.

    Texts are alike if their sets of `shingle`-word shingles (A-Z lower-cased) have a Jaccard similarity of at least `least`; a
    group is all that such links connect. Rows are known by a 64-bit hash of their text, so that null or repeated ids neither
    shield a row nor take others along. Null text counts as empty; texts without words are alike.
    """
    bounded_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    profile = stored(rows.mapInArrow(lambda batches: _profile(batches, shingle), "id long, key long, fp long, parity binary, cell long, often long"), "profile")
    found = links(profile, rows.select("key", "text"), shingle, least).select(F.col("id").alias("key"), "component")
    own = profile.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id")).alias("least"))
    own = own.join(stored(found, "found"), "key", "left")
    heads = found.select(F.col("component").alias("key")).distinct().withColumn("head", F.lit(True))
    members = stored(own.join(heads, "key", "left").where("component is not null or head or n > 1").select("key", "least", F.coalesce("component", "key").alias("component")), "members")
    kept = members.groupBy("component").agg(F.min(F.struct("least", "key")).alias("best")).select(F.col("best.key").alias("__key"), F.col("best.least.id").alias("__id"))
    keyed = docs.withColumn("__key", key)
    once = without(keyed, members.select(F.col("key").alias("__key")), "__key")
    kept = keyed.join(if_small(stored(kept, "kept")), "__key").where(F.col(id_col).cast("long").eqNullSafe(F.col("__id"))).dropDuplicates(["__key"])
    return once.select(*docs.columns).unionByName(kept.select(*docs.columns))
