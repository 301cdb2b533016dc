"""SimHash near-duplicates: fingerprints of word shingles, links by a pivot distance table, components of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, if_small, lookup, stored
from .graph import components

#: Bands of a fingerprint, by the number of distinct ones: 4 differing bits spoil at most 4 bands, so two or more of any linked pair are
#: equal. More fingerprints need keys of more bits, so that a bucket of random ones stays small: 21, 27 and 32 bits.
BANDS = ((2_000_000_000, 6), (100_000_000_000, 7), (math.inf, 8))
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Fingerprints of one bucket that one block holds; larger buckets are compared in pairs of blocks.
BLOCK = 4096
#: Buckets up to this size are compared by shifting the whole batch against itself.
SMALL = 24


def digests(text: bytes, shingle: int = 4) -> np.ndarray:
    """Hashes of the shingles of UTF-8 text, in order, with repeats; fewer words make one shingle, none make no hash."""
    found = text.lower().split()  # of bytes: A-Z only, and exactly the blanks \x20 \x09-\x0D
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < shingle:
        grams = [b" ".join(found)]
    else:
        grams = list(map(b" ".join, zip(*(found[k:] for k in range(shingle)), strict=False)))
    return np.frombuffer(b"".join([xxhash.xxh64_digest(g, 42) for g in grams]), dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Of UTF-8 text: a bit is 1 if it is set in over half the hashes of the shingles. No words: 0."""
    return majority(digests(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to fixed reference fingerprints."""
    references = np.array([xxhash.xxh64_intdigest(f"pivot {k}".encode(), 42) for k in range(pivots)], dtype=np.uint64)
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def _close(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are links: pairs whose distances to some pivot differ by more than most can't be; the others are verified."""
    kept = np.ones(len(left), dtype=bool)
    for p in range(table.shape[1]):
        live = np.flatnonzero(kept)
        if not len(live):
            return kept
        kept[live] = np.abs(table[left[live], p] - table[right[live], p]) <= most
    live = np.flatnonzero(kept)
    kept[live] = np.bitwise_count(fps[left[live]] ^ fps[right[live]]) <= most
    return kept


def _small_runs(run: np.ndarray, fps: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    table, out = pivot_table(fps), []
    for k in range(1, SMALL):
        left = np.flatnonzero(run[:-k] == run[k:]) if k < len(run) else np.empty(0, dtype=np.int64)
        if not len(left):
            break
        hit = left[_close(fps, table, left, left + k, most)]
        out.append((ids[hit], ids[hit + k]))
    return out


def _large_run(fps: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of one block: found fingerprints leave the block, so that a dense group costs about its size."""
    table, rest, left, right = pivot_table(fps), np.argsort(ids, kind="stable"), [], []
    while len(rest):
        seed, rest, front = rest[0], rest[1:], [rest[0]]
        while front and len(rest):
            now, front = np.array(front[:32]), front[32:]
            near = np.ones((len(now), len(rest)), dtype=bool)
            for p in range(table.shape[1]):
                near &= np.abs(table[now, p][:, None] - table[rest, p][None, :]) <= most
                if p % 4 == 3 and near.sum() * 8 < near.size:
                    break
            a, b = np.nonzero(near)
            sure = np.bitwise_count(fps[now[a]] ^ fps[rest[b]]) <= most
            hit = np.zeros(len(rest), dtype=bool)
            hit[b[sure]] = True
            found = rest[hit]
            front.extend(found.tolist())
            left.append(np.full(len(found), ids[seed]))
            right.append(ids[found])
            rest = rest[~hit]
    return np.concatenate(left or [ids[:0]]), np.concatenate(right or [ids[:0]])


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by (key, block), cut so that no run of equal keys is split."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        cut = int(((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])).argmax())
        if cut:
            yield [c[:cut] for c in cols]
        kept = [c[cut:] for c in cols]
    if kept is not None:
        yield kept


def _link(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for key, block, fp, ids in _whole_runs(batches):
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        size = np.diff(np.r_[new, len(key)])
        run = np.repeat(np.arange(len(new)), size)
        fps = fp.view(np.uint64)
        short = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        pairs = _small_runs(run[short], fps[short], ids[short], most) if len(short) else []
        pairs += [_large_run(fps[a : a + n], ids[a : a + n], most) for a, n in zip(new[size > SMALL], size[size > SMALL], strict=True)]
        if pairs:
            u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def band_keys(bands: int, most: int) -> list[list[tuple[int, int]]]:
    """The sets of bands, as (shift, width), of which at least one is equal in any two fingerprints at most bits apart."""
    width = [64 // bands + (k < 64 % bands) for k in range(bands)]
    cuts = [(sum(width[:k]), width[k]) for k in range(bands)]
    return [list(c) for c in combinations(cuts, bands - most)]


def link_fingerprints(distinct: DataFrame, most: int = 4, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, fp) of distinct fingerprints to edges (u, v) between ids that have the components of all links of at most `most` bits.

    Linked fingerprints agree in bands - most bands, so each fingerprint goes to one bucket for every such choice of bands.
    Within buckets, the pivot table discards pairs and the survivors are verified. A bucket of over `block` fingerprints is
    compared in pairs of blocks, each a task's work of bounded size; nothing is capped.
    """
    if bands is None:
        n = distinct.count()
        bands = next(b for limit, b in BANDS if n < limit) - 4 + most
    keys = []
    for k, parts in enumerate(band_keys(bands, most)):
        bits, key = 0, F.lit(k).cast("long")
        for shift, width in parts:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1)))
            bits += width
        if bits > 56:
            raise ValueError("too few bands")
        keys.append(key)
    rows = distinct.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    hot = stored(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("g")), "buckets")
    if hot.limit(1).count():
        rows = rows.join(if_small(hot), "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("g"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda j: F.least(own, j) * F.col("g") + F.greatest(own, j))
        rows = rows.withColumn("block", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)))
    else:
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    dealt = rows.select("key", "block", "fp", "id").repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(lambda batches: _link(batches, most), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_size) of every row of docs.

    A-Z are lower-cased, words are runs of non-blanks, shingles of `shingle` words count with repeats; fewer words make one
    shingle, none the fingerprint zero, which links like any other. Fingerprints link at `most` or fewer differing bits;
    component_id is the smallest id reachable. Null text counts as empty. Rows with a null id get the component of their
    fingerprint (null if it has no id). Rows that share an id are one vertex. Other columns are ignored. Empty table: no rows.
    group_size is the number of rows with the same fingerprint.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    total = fps.count()
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    found = components(link_fingerprints(distinct.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), most))
    classes = distinct.join(found, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("component_id"))
    looked = lookup(fps, stored(classes, "classes"), "fp", "n", total)
    return looked.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n").alias("group_size")
    )

