"""Benchmark decontamination by template canonicalisation: typed slots, hash-joined windows, slot consistency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, SIEVE_BUCKETS, bounded_batches, if_small, stored, text_slices, without

#: Canonical tokens of a window, and the share of an item's windows that makes a leak.
WINDOW, LEAST = 5, 0.8
#: Units of measure that count as one typed slot.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams kilogram "
    "kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week "
    "weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh watt watts volt volts".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?\Z")
QUANTITY = re.compile(r"[$€£]?\d[\d.,]*([a-z]+)\Z")
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)]
_WORD, _NUM, _NAME, _UNIT, _BREAK = range(5)
SLOTS = [xxhash.xxh64_intdigest(f"<{k}>", 7) for k in range(5)]
EDGES = re.compile(r"^\W+|\W+$")


#: Stands between texts that are worked on together, and at the ends of lines.
SEPARATOR, LINE = "\x01", "\0"


class Vocabulary(dict):
    """Raw token to a number; by that number its hashes within and at the start of a sentence, its kinds, whether a sentence ends, and
    whether a benchmark may have it: slots always, words by the bitmap of its words (None: all)."""

    def __init__(self, words: np.ndarray | None = None) -> None:
        super().__init__()
        self.words = words
        self.value: list[str] = []
        self.mid, self.first = (np.zeros(4096, dtype=np.uint64) for _ in range(2))
        self.kind, self.first_kind = (np.zeros(4096, dtype=np.uint8) for _ in range(2))
        self.ends, self.known = (np.zeros(4096, dtype=bool) for _ in range(2))

        if words is not None:  # all tokens that no benchmark has are one of these two
            self.unknown = [self._add("", _WORD, _WORD, 0, ends, False) for ends in (False, True)]

    def _add(self, low: str, kind: int, first: int, word: int, ends: bool, known: bool) -> int:
        at = len(self.value)
        if at == len(self.mid):
            for name in ("mid", "first", "kind", "first_kind", "ends", "known"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.mid[at] = word if kind == _WORD else SLOTS[kind]
        self.first[at] = word if first == _WORD else SLOTS[first]
        self.kind[at], self.first_kind[at], self.ends[at], self.known[at] = kind, first, ends, known
        self.value.append(low)
        return at

    def __missing__(self, raw: str) -> int:
        if raw == "":
            self[raw] = at = self._add("", _BREAK, _BREAK, 0, False, False)
            return at
        if raw == SEPARATOR:
            self[raw] = at = self._add("", _WORD, _WORD, 0, True, False)
            return at
        plain = raw.isalpha()
        ends = not plain and (raw == "\0" or raw[-1] in ".!?:" or not raw[-1].isalnum() and raw.rstrip("\"')]}»”*%$&#").endswith((".", "!", "?")))
        bare = raw if plain or raw[0].isalnum() and raw[-1].isalnum() else EDGES.sub("", raw)
        low = bare.lower()
        kind = first = _WORD
        if not bare:
            kind = first = _BREAK
        elif bare != low:
            if bare[0].isupper() and bare[1:].islower():
                kind = _NAME
        if low in UNITS:
            kind = first = _UNIT
        elif not plain and bare and (NUMBER.match(bare) or (m := QUANTITY.match(low)) and m[1] in UNITS):
            kind = first = _NUM
        word = xxhash.xxh3_64_intdigest(low)
        if kind == _WORD and self.words is not None and not has_bit(self.words, word):
            at = self.unknown[ends]
        else:
            at = self._add(low, kind, first, word, ends, True)
        self[raw] = at
        return at


def has_bit(bitmap: np.ndarray, value: int) -> bool:
    return bool(bitmap[value % (len(bitmap) * 8) >> 3] >> (value & 7) & 1)


def tokens_of(text: str, vocabulary: Vocabulary) -> np.ndarray:
    return np.fromiter(map(vocabulary.__getitem__, text.replace("\n", f" {LINE} ").split()), dtype=np.int64)


def tokens_of_all(texts: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """The tokens of all texts in order, a separator after each; only different tokens are looked at one by one."""
    clean = pc.replace_substring(pc.fill_null(texts, ""), SEPARATOR, " ")
    marked = pc.binary_join_element_wise(pc.replace_substring(clean, "\n", f" {LINE} "), pa.scalar(SEPARATOR), " ")
    coded = pc.utf8_split_whitespace(marked).flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return np.fromiter(map(vocabulary.__getitem__, distinct), dtype=np.int64, count=len(distinct))[coded.indices.to_numpy()]


class Canonical:
    """The canonical tokens of a text, or of several at once. Given `least`, only runs of that many tokens that a benchmark may have are
    kept; raw tells where they stood, and text in which text."""

    def __init__(self, at: np.ndarray, vocabulary: Vocabulary, least: int | None = None) -> None:
        ends = vocabulary.ends[at]
        start = np.r_[True, ends[:-1]] if len(at) else ends
        word = vocabulary.kind[at] != _BREAK
        if not word.all():  # a break ends the sentence of the word before it
            groups = np.cumsum(word) - word
            breaks = np.zeros(int(word.sum()) + 1, dtype=bool)
            breaks[groups[~word & ends]] = True
            start = start[word] | breaks[:-1]
            at = at[word]
        self.raw = np.arange(len(at))
        self.text = np.zeros(len(at), dtype=np.int64)
        if least is not None:
            ends_text = at == vocabulary[SEPARATOR]
            self.text = np.cumsum(ends_text) - ends_text
            begins = np.r_[0, np.flatnonzero(ends_text) + 1]
            self.raw -= begins[self.text]
        self.gap = np.zeros(len(at), dtype=bool)  # tokens that stand for others that were left out
        if least is not None and len(at):
            known = vocabulary.known[at]
            edge = np.flatnonzero(np.r_[True, known[1:] != known[:-1]])
            size = np.diff(np.r_[edge, len(at)])
            keep = np.repeat(known[edge] & (size >= least), size)
            keep[1:] |= keep[:-1] & ~keep[1:]  # one token after each run keeps it apart from the next
            self.gap = ~known[keep] | np.repeat(size < least, size)[keep]
            at, start, self.raw, self.text = at[keep], start[keep], self.raw[keep], self.text[keep]
        self.at, self.start = at, start
        self.vocabulary = vocabulary

    def readings(self) -> list[Reading]:
        """Capitalised words at the start of sentences as plain words, and as names."""
        v = self.vocabulary
        kind, first = v.kind[self.at], v.first_kind[self.at]
        kind, first = np.where(self.gap, _WORD, kind), np.where(self.gap, _WORD, first)
        plain = Reading(self, np.where(self.start, v.first[self.at], v.mid[self.at]), np.where(self.start, first, kind), self.start)
        opening = self.start & (kind != first)
        return [plain, Reading(self, v.mid[self.at], kind, self.start, opening)] if opening.any() else [plain]

    def small(self) -> Reading:
        """As a text in capitals or in small letters shows it: names are plain words."""
        return Reading(self, self.vocabulary.first[self.at], self.vocabulary.first_kind[self.at], self.start)


class Reading:
    """Canonical tokens of one reading: a run of names within a sentence is one token. place has the first raw token of each."""

    def __init__(self, text: Canonical, hashes: np.ndarray, kind: np.ndarray, start: np.ndarray, changed: np.ndarray | None = None) -> None:
        name = kind == _NAME
        own = np.ones(len(kind), dtype=bool)
        own[1:] = ~(name[1:] & name[:-1] & ~start[1:])
        self.place = np.flatnonzero(own)
        self.hash, self.kind, self.text = hashes[own], kind[own], text
        #: Tokens that differ from the other reading; only windows with one of them are of interest.
        self.changed = None if changed is None else np.flatnonzero(changed[own] | (np.add.reduceat(changed, self.place) > 0 if len(own) else own))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of windows."""
        h, n = self.hash, len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        if self.changed is None:
            at = self._whole(size)
            parts = [h[at + k] for k in range(size)]
        else:
            some = np.zeros(len(h), dtype=bool)
            for k in range(size):
                some[self.changed[self.changed >= k] - k] = True
            at = self._whole(size)
            at = at[some[at]]
            parts = [h[at + k] for k in range(size)]
        out = np.full(len(at), size, dtype=np.uint64)
        for k, part in enumerate(parts):
            out += part * np.uint64(_MULTIPLIERS[k])
            out ^= out >> np.uint64(31)
        return at, out

    def _whole(self, size: int) -> np.ndarray:
        """Where windows without gaps begin."""
        gaps = np.zeros(len(self.hash) + 1, dtype=np.int64)
        np.cumsum(self.text.gap[self.place], out=gaps[1:])
        return np.flatnonzero(gaps[size:] == gaps[:-size])

    def value(self, j: int) -> str:
        end = self.place[j + 1] if j + 1 < len(self.place) else len(self.text.at)
        return " ".join(self.text.vocabulary.value[x] for x in self.text.at[self.place[j] : end])

    def slots(self, j: int, size: int) -> list[str | None]:
        """The values of a window's slots; None where it has words."""
        return [self.value(d) if self.kind[d] != _WORD else None for d in range(j, j + size)]


def item_windows(text: str, vocabulary: Vocabulary, window: int = WINDOW) -> tuple[int, int, list[tuple[int, int, int, list[str | None]]]]:
    """Of an item: its number of windows, of raw tokens, and (place, hash, size, slots) of the windows of all its readings.

    An item of fewer than `window` tokens is one window of its own length. Texts in capitals or in small letters show no names:
    a reading has them as plain words.
    """
    c = Canonical(tokens_of(text, vocabulary), vocabulary)
    if not len(c.at):
        return 0, 0, []
    readings, small = c.readings(), c.small()
    size = min(window, len(readings[0].hash))
    own = set(readings[0].place[: len(readings[0].hash) - size + 1].tolist())
    out = {}
    for r in (*readings, small):
        length = min(window, len(r.hash)) if r is small else size
        for j, w in zip(*(x.tolist() for x in r.windows(length)), strict=True):
            k = int(r.place[j])
            if k in own:
                out.setdefault((w, k, length), (k, w, length, r.slots(j, length)))
    return len(own), len(c.at), list(out.values())


def item_words(text: str, vocabulary: Vocabulary) -> set[int]:
    """The hashes of an item's words, in all its readings."""
    c = Canonical(tokens_of(text, vocabulary), vocabulary)
    hashes = [np.r_[vocabulary.first[c.at], vocabulary.mid[c.at]], np.r_[vocabulary.first_kind[c.at], vocabulary.kind[c.at]]]
    return set(hashes[0][hashes[1] == _WORD].tolist())


def text_windows(texts: pa.Array, vocabulary: Vocabulary, lengths: list[int], sieve: np.ndarray) -> dict[int, list[tuple]]:
    """By a text's place in texts, (place, hash, size, slots) of its windows that the sieve lets through."""
    c = Canonical(tokens_of_all(texts, vocabulary), vocabulary, lengths[0])
    out: dict[int, dict] = {}
    if not len(c.at):
        return out
    bits = np.uint64(len(sieve) * 8)
    for r in c.readings():
        for size in lengths:
            places, w = r.windows(size)
            bit = (w % bits).astype(np.int64)
            for p in np.flatnonzero(sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).tolist():
                j = int(places[p])
                at = r.place[j]
                slots = r.slots(j, size)
                out.setdefault(int(c.text[at]), {})[int(c.raw[at]), int(w[p]), size, tuple(slots)] = None
    return {k: [(place, w, size, list(slots)) for place, w, size, slots in found] for k, found in out.items()}


def _agreed(found: list[tuple]) -> tuple[int, bool]:
    """Of hits (offset, k, slots): how many windows have slots of which each item value stands for one value, and whether some value differs."""
    pairs: dict[str, Counter] = defaultdict(Counter)
    for _, _, own in found:
        for value, other in own:
            pairs[value][other] += 1
    agreed = {value: max(seen.items(), key=lambda x: (x[1], x[0] == value, x[0]))[0] for value, seen in pairs.items()}
    return len({k for _, k, own in found if all(agreed[value] == other for value, other in own)}), any(a != b for a, b in agreed.items())


def _occurrences(found: list[tuple], tokens: int, needed: float) -> Iterator[list[tuple]]:
    """The hits of one place each, with enough windows: those of equal offset to the item, those of offsets close by, and all hits."""
    yield found
    found = sorted(found, key=lambda hit: hit[0])
    for slack in (0, max(2, tokens // 8)):
        count: Counter = Counter()
        low = high = 0
        while high < len(found):
            offset = found[high][0]
            while high < len(found) and found[high][0] == offset:
                count[found[high][1]] += 1
                high += 1
            while found[low][0] < offset - slack:
                k = found[low][1]
                count[k] -= 1
                if not count[k]:
                    del count[k]
                low += 1
            if high - low < len(found) and len(count) >= needed:
                yield found[low:high]


def judged(hits: list[dict], total: int, tokens: int, least: float) -> tuple[int, bool] | None:
    """(windows, re-parameterised) of the best place of an item in a document, None if it isn't contained."""
    found = []
    for h in hits:
        own = []
        for d, (value, other) in enumerate(zip(h["item_slots"], h["slots"], strict=True)):
            if value is not None and other is not None:
                # A name before the item may run into the name it begins with.
                own.append((value, value if not h["k"] and not d and other.endswith(f" {value}") else other))
        found.append((h["place"] - h["k"], h["k"], own))
    if len({k for _, k, _ in found}) < least * total:
        return None
    best = max((_agreed(group) for group in _occurrences(found, tokens, least * total)), key=lambda x: (x[0], not x[1]))
    return best if best[0] >= least * total else None


_WINDOW_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("slots", pa.list_(pa.string()))]))
_WINDOW_SQL = "array<struct<place: int, hash: bigint, size: int, slots: array<string>>>"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _rows(windows: list[tuple]) -> list[dict]:
    return [{"place": k, "hash": _signed(w), "size": n, "slots": s} for k, w, n, s in windows]


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(entry, item, total, tokens, k, hash, size, item_slots): the stored windows of all items, one entry for each distinct (id, text)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("item is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vocabulary, out = Vocabulary(), []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, tokens, windows = item_windows(text, vocabulary, window)
                words = [_signed(w) for w in item_words(text, vocabulary)]
                out.append((f"{item}:{hashlib.md5(text.encode()).hexdigest()}", item, total, tokens, _rows(windows), words))
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), _WINDOW_TYPE, pa.list_(pa.int64()))
            names = ["entry", "item", "total", "tokens", "windows", "words"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    made = rows.mapInArrow(run, f"entry string, item long, total int, tokens int, windows {_WINDOW_SQL}, words array<long>")
    return stored(made.where("total > 0"), "benchmark")


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """The set of a column's 64-bit hashes as bits, by their rest: at most SIEVE_BUCKETS times 4 KB come to the driver, whatever their number."""
    buckets = max(8, min(SIEVE_BUCKETS, 1 << math.ceil(math.log2(1 + values.count() * 64 / SIEVE_BITS))))
    place = F.col(column).bitwiseAND(F.lit(buckets * SIEVE_BITS - 1))  # a power of two: the same rest for signed and unsigned
    bits = values.select(F.floor(place / SIEVE_BITS).alias("bucket"), (place % SIEVE_BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(buckets * SIEVE_BITS // 8, dtype=np.uint8)
    for bucket, found in bits.toLocalIterator():
        out[bucket * (SIEVE_BITS // 8) : (bucket + 1) * (SIEVE_BITS // 8)] = np.frombuffer(found, dtype=np.uint8)
    return out


def candidates(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(doc_id, key, windows) of the rows that have windows which a bitmap of the benchmark's lets through; key is the MD5 of the text."""
    windows = items.select(F.explode("windows").alias("w")).select("w.hash", "w.size")
    lengths = sorted(r.size for r in windows.select("size").distinct().collect())  # numbers up to WINDOW
    if not lengths:
        return None
    held = docs.sparkSession.sparkContext.broadcast((bitmap(items.select(F.explode("words").alias("w")), "w"), bitmap(windows, "hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sieve = held.value
        vocabulary = Vocabulary(words)
        for b in batches:
            out = []
            for low, texts in text_slices(b.column(1)):
                if len(vocabulary) > 300_000:
                    vocabulary = Vocabulary(words)
                for k, found in text_windows(texts, vocabulary, lengths, sieve).items():
                    out.append((b.column(0)[low + k].as_py(), hashlib.md5((texts[k].as_py() or "").encode()).hexdigest(), _rows(found)))
            types = (pa.int64(), pa.string(), _WINDOW_TYPE)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["doc_id", "key", "windows"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id long, key string, windows {_WINDOW_SQL}"), "windows")


def leaks(found: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(key, item_id, containment, windows, reparameterised) of candidate texts: the hash join of windows, then the slots of each pair."""
    texts = found.groupBy("key").agg(F.first("windows").alias("windows"))  # copies are judged once
    mine = texts.select("key", F.explode("windows").alias("w")).select("key", "w.place", "w.hash", "w.size", "w.slots")
    theirs = items.select("entry", "item", "total", "tokens", F.explode("windows").alias("w"))
    theirs = stored(theirs.select("entry", "item", "total", "tokens", F.col("w.place").alias("k"), "w.hash", "w.size", F.col("w.slots").alias("item_slots")), "items")
    hits = mine.join(if_small(theirs), ["hash", "size"])
    pairs = hits.groupBy("key", "entry", "item", "total", "tokens").agg(F.collect_list(F.struct("place", "k", "slots", "item_slots")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, item, total, tokens, hits in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if best := judged(hits, total, tokens, least):
                    out.append((key, item, best[0] / total, best[0], best[1]))
            types = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            names = ["key", "item_id", "containment", "windows", "reparameterised"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    enough = pairs.where(F.size(F.array_distinct(F.col("hits.k"))) >= F.col("total") * least - 1e-9)
    schema = "key string, item_id long, containment double, windows long, reparameterised boolean"
    found = enough.select("key", "item", "total", "tokens", "hits").mapInArrow(run, schema)
    best = F.max(F.struct("containment", (~F.col("reparameterised")).alias("same"), "windows")).alias("best")
    by = found.groupBy("key", "item_id").agg(best)
    return by.select("key", "item_id", "best.containment", "best.windows", (~F.col("best.same")).alias("reparameterised"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, containment, windows, reparameterised): a row for each benchmark item that a document contains.

    Numbers, names (runs of capitalised words) and units become typed slots, case and outer punctuation don't count. A capitalised
    word at the start of a sentence is read both as a word and as a name. An item is contained if at least `least` of its windows of
    five tokens occur in the document, or at one place of it, and there every value of the item's slots stands for one value;
    reparameterised tells that some value differs. Windows are joined by hash; documents send only those that a bitmap of the
    benchmark's windows, of bounded size, lets through. Null text counts as empty; a null doc_id is kept; repeated rows give
    repeated results; of items that share an id the best counts; items with a null id are left out. Empty tables: no rows.
    """
    bounded_batches(docs.sparkSession)
    items = index(benchmark)
    found = candidates(docs, items, id_col, text_col)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double, windows long, reparameterised boolean")
    best = stored(leaks(found, items, least), "leaks")
    return found.select("doc_id", "key").join(if_small(best), "key").select("doc_id", "item_id", "containment", "windows", "reparameterised")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns; rows are told by their texts, which are not shuffled."""
    bounded_batches(docs.sparkSession)
    items = index(benchmark)
    found = candidates(docs.withColumn("__none", F.lit(0)), items, "__none", text_col)
    if found is None:
        return docs
    gone = stored(leaks(found, items, least).select(F.col("key").alias("__text_md5")).distinct(), "leaked-texts")
    keyed = docs.withColumn("__text_md5", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    return without(keyed, gone, "__text_md5").select(*docs.columns)
