"""Collocations by dynamic itemset counting: phrases of all lengths are counted in the same scans over shards of the corpus.

Step t scans shard t mod SHARDS. Words are counted from the first step on; a longer phrase is counted from the step after the one in
which both phrases that it consists of without its first and without its last word have reached the threshold, for one full cycle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, stored, text_slices

#: The least count of a phrase, how many of 100 of its occurrences a longer one must have to replace it, and the rows reported for a language.
LEAST, SHARE, FIRST = 10, 50, 2000
#: Parts of the corpus; a full cycle scans each once.
SHARDS = 2
#: Bytes of texts that are counted at a time, and bits of a bitmap at most (16 MB); beyond that more phrases than needed are counted.
SLICE, BITS = 6_000_000, 1 << 27
#: Parts in which a language's phrases are ranked before the first of each part are ranked together.
PARTS = 64
BLANK, BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(BLANK)], KIND[list(BREAK)] = 1, 2
#: A mark is MARK times the step that met a phrase first, and the step in which it reached the threshold, or NEVER.
MARK, NEVER = 1000, 999
COUNTS = "lang string, phrase string, size int, n long"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a pair of words from the words' hashes."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)


def _hashes(langs: list[bytes], words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(lang + b"\0" + word) for lang, word in zip(langs, words, strict=True)), dtype=np.uint64, count=len(words))


class Known:
    """Bitmaps of the words and of the pairs that have reached the threshold, and of those that did within the last cycle.

    A bitmap has a bit for each of its keys and some for others, so that it lets through what isn't wanted, never less. Bitmaps of one run
    have equal sizes: whatever makes a phrase counted makes it counted for a full cycle, so every count that is finished is whole.
    """

    def __init__(self, bits: int, maps: dict[int, np.ndarray]) -> None:
        self.bits, self.maps = bits, maps

    def has(self, which: int, hashes: np.ndarray) -> np.ndarray:
        found = self.maps.get(which)
        if found is None:
            return np.zeros(len(hashes), dtype=bool)
        place = (hashes >> np.uint64(20)) & np.uint64(self.bits - 1)
        return (found[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


WORD, NEW_WORD, PAIR, NEW_PAIR = range(4)


def _cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words in order, the piece and the text of each). A-Z are lower-cased."""
    raw = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = KIND[data]
    word, edge = kind == 0, np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    at = np.flatnonzero(first)
    text = np.searchsorted(offsets, at, "right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[at] + text
    places = np.concatenate(([0], np.cumsum(np.flatnonzero(last) - at + 1)))
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data[word])])
    return words.dictionary_encode(), piece, text


def _counted(texts: pa.Array, langs: pa.Array, known: Known, words_too: bool) -> Iterator[tuple[pa.Array, pa.Array, int, np.ndarray]]:
    """(languages, phrases, size, counts) of the phrases of a slice that are being counted. Size 0 is all words of a language."""
    words, piece, text = _cut(texts)
    if not len(words):
        return
    coded = langs.dictionary_encode()
    lang = coded.indices.to_numpy()[text].astype(np.int64)
    own, w, n = np.unique(lang * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True, return_counts=True)
    of_lang, of_word = own // len(words.dictionary), own % len(words.dictionary)
    name, word = coded.dictionary.take(pa.array(of_lang)), words.dictionary.take(pa.array(of_word))
    if words_too:
        yield coded.dictionary, pa.array([b""] * len(coded.dictionary), pa.large_binary()), 0, np.bincount(lang, minlength=len(coded.dictionary))
        yield name, word, 1, n
    h = _hashes(name.cast(pa.binary()).to_pylist(), word.to_pylist())
    often, new = known.has(WORD, h), known.has(NEW_WORD, h)
    both = (piece[:-1] == piece[1:]) & often[w[:-1]] & often[w[1:]]
    at = np.flatnonzero(both)
    pairs, p, n = np.unique(w[at] * len(own) + w[at + 1], return_inverse=True, return_counts=True)
    a, b = pairs // len(own), pairs % len(own)
    wanted = new[a] | new[b]
    join = lambda *parts: pc.binary_join_element_wise(*[word.take(pa.array(x)) for x in parts], pa.scalar(b" ", pa.large_binary()))
    yield name.take(pa.array(a[wanted])), join(a[wanted], b[wanted]), 2, n[wanted]
    h = _mix(h[a], h[b])
    often, new = known.has(PAIR, h), known.has(NEW_PAIR, h)
    where = np.full(len(w), -1)
    where[at[often[p]]] = p[often[p]]
    at = np.flatnonzero((where[:-1] >= 0) & (where[1:] >= 0))
    at = at[new[where[at]] | new[where[at + 1]]]
    triples, n = np.unique(where[at] * len(pairs) + where[at + 1], return_counts=True)
    x, y = triples // len(pairs), triples % len(pairs)
    yield name.take(pa.array(a[x])), join(a[x], b[x], b[y]), 3, n


def _scan(shard: DataFrame, known: Known, words_too: bool) -> DataFrame:
    shared = shard.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in text_slices(batch.column(1), SLICE):
                for lang, phrase, size, n in _counted(part, batch.column(0).slice(low, len(part)), shared.value, words_too):
                    columns = [lang.cast(pa.string()), phrase.cast(pa.binary()).cast(pa.string(), safe=False), pa.array(np.full(len(n), size, dtype=np.int32)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "n"])

    return shard.select("lang", "text").mapInArrow(work, COUNTS)


def _bitmaps(state: DataFrame, bits: int, step: int, shards: int) -> Known:
    """What the next step needs of the phrases that have reached the threshold: at most four bitmaps of `bits` bits come to the driver."""
    lot = min(bits, 1 << 15)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, phrase, size, reached = (batch.column(k) for k in range(4))
            langs, words, new = lang.cast(pa.binary()).to_pylist(), [x.split(b" ") for x in phrase.cast(pa.binary()).to_pylist()], reached.to_numpy() > step - shards
            size = size.to_numpy()
            h = _hashes(langs, [x[0] for x in words])
            two = np.flatnonzero(size == 2)
            h[two] = _mix(h[two], _hashes([langs[k] for k in two], [words[k][1] for k in two]))
            place = ((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
            which = (size - 1) * 2
            both, place = np.concatenate((which, which[new] + 1)), np.concatenate((place, place[new]))
            yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int32)), pa.array(place // lot), pa.array(place % lot)], ["which", "lot", "bit"])

    reached = F.col("mark") % MARK
    keys = state.where((reached != NEVER) & F.col("size").between(1, 2)).select("lang", "phrase", "size", reached.alias("reached"))
    rows = keys.mapInArrow(work, "which int, lot long, bit long").groupBy("which", "lot").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    maps: dict[int, np.ndarray] = {}
    for r in rows:
        out = maps.setdefault(r.which, np.zeros(bits // 8, dtype=np.uint8))
        out[r.lot * lot // 8 : (r.lot + 1) * lot // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)[: lot // 8]
    return Known(bits, maps)


def _dropped(spark: SparkSession, path: str) -> None:
    """Removes a table of an earlier step."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def count_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> DataFrame:
    """(lang, phrase, size, f): all phrases of one to three words with f >= least, and with size 0 the number of all words of a language."""
    spark = docs.sparkSession
    base = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text", (F.monotonically_increasing_id() % shards).alias("shard"))
    rows.write.partitionBy("shard").parquet(f"{base}/shards")
    parts = spark.read.schema("lang string, text string, shard long").parquet(f"{base}/shards")
    keys = ["lang", "phrase", "size"]
    state, known, bits, step = None, Known(1 << 16, {}), 0, 0
    while True:
        raw = _scan(parts.where(F.col("shard") == step % shards), known, step < shards)
        raw = raw.select(*keys, "n", F.lit(None).cast("long").alias("f"), F.lit(None).cast("long").alias("mark"))
        both = raw if state is None else raw.unionByName(state.withColumn("n", F.lit(None).cast("long")))
        merged = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("f").alias("f"), F.coalesce(F.min("mark"), F.lit(step * MARK + NEVER)).alias("mark"))
        # A phrase is counted in the step that first meets it and in the rest of that cycle; by then all of it is counted.
        last = F.floor(F.col("mark") / MARK) + shards - 1
        f = F.coalesce("f", F.lit(0)) + F.when(last >= step, F.coalesce("n", F.lit(0))).otherwise(0)
        merged = merged.select(*keys, f.alias("f"), "mark", last.alias("last"))
        merged = merged.withColumn("mark", F.when((F.col("mark") % MARK == NEVER) & (F.col("f") >= least), F.col("mark") - NEVER + step).otherwise(F.col("mark")))
        merged = merged.where((F.col("size") == 0) | (F.col("f") >= least) | (F.col("last") > step)).drop("last")
        merged.write.parquet(f"{base}/step-{step}")
        state = spark.read.schema(merged.schema).parquet(f"{base}/step-{step}")
        if step:
            _dropped(spark, f"{base}/step-{step - 1}")
        if not bits:
            words = state.where("size = 0").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0] * shards
            bits = min(BITS, max(1 << 16, 1 << int(words // 4).bit_length()))
        step += 1
        known = _bitmaps(state, bits, step - 1, shards)
        if step >= shards and not known.maps.keys() & {NEW_WORD, NEW_PAIR}:
            break
    _dropped(spark, f"{base}/shards")
    return state.select(*keys, "f").where((F.col("size") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST, share: int = SHARE, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of two and three words, the first of each language.

    a, l and r are counts of a phrase and of the two parts of its weakest cut, n counts the language's words, score is floor(1000000 a a / (l r)). A phrase
    inside a longer one that makes `share` of 100 of its occurrences is left out. A null text is empty, a null language is `und`; repeated rows count each time,
    equal scores go by count and then by the phrase's bytes. No text or phrase is cut short; further columns play no part. Without phrases the result is empty.
    """
    found = count_phrases(docs, least, shards)
    longer = found.where("size >= 2").withColumn("words", F.split("phrase", " "))
    inner = found.where("size = 3").withColumn("words", F.split("phrase", " "))
    within = inner.select("lang", F.explode(F.array(F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", 2, 2), " "))).alias("phrase"), F.col("f").alias("outer"))
    covered = within.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cut = longer.select("lang", "phrase", "words", "size", F.col("f").alias("a"), cuts.alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(words, k + 1, size - k)"), " ").alias("right"))
    part = lambda name, f: found.where("size between 1 and 2").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("w")).select("lang", "phrase", "a", "w.*")
    kept = weakest.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * big("outer") < share * big("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)  # PARTS times the first rows of a language at most
    ranked = stored(near.drop("rank", "part", "outer"), "phrases").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
