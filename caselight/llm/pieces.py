"""SentencePiece encoding that keeps offsets: texts are normalised by the longest prefixes of the model's compiled character map, and
every piece is projected through the recorded alignment to the bytes of the original text that it stands for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import text_slices

#: The symbol that stands for a space in pieces, U+2581 in UTF-8, and what the library puts in the place of a malformed byte.
SPACE, REPLACEMENT = b"\xe2\x96\x81", b"\xef\xbf\xbd"
#: What encode() adds to a row.
OUT = "ids array<int>, begins array<int>, ends array<int>, decoded string"
#: Bytes of texts that are encoded at a time, about: some hundred bytes of memory for each.
SLICE = 1_500_000


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the place where its character begins; each text begins a character."""
    first = (data & 0xC0) != 0x80
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))


def _malformed(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places of the bytes that belong to no well-formed character."""
    found: list[int] = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        rest, at = data[low:high].tobytes(), 0
        while at < len(rest):
            try:
                rest[at:].decode("utf-8")
                break
            except UnicodeDecodeError as bad:
                found.append(low + at + bad.start)
                at += bad.start + 1
    return found


def _symbols(data: np.ndarray) -> np.ndarray:
    """Where a space symbol begins."""
    found = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        found[:-2] = (data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])
    return found


class CharacterMap:
    """The compiled map of a model: a double-array trie over bytes whose leaves point to the strings that replace what they match."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64)
        self.strings = blob[4 + size :]

    def _offset(self, units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 512) >> 6)

    def longest(self, data: np.ndarray, places: np.ndarray, limits: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, bytes matched, replacement) of the longest match at each of the places that have one; all places walk the trie together."""
        length, value = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        walking, node, depth = np.arange(len(places)), np.full(len(places), self._offset(self.units[:1])[0]), 0
        while True:
            inside = places[walking] + depth < limits[walking]
            walking, node = walking[inside], node[inside]
            if not len(walking):
                break
            byte = data[places[walking] + depth].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            unit = np.where(known, self.units[np.where(known, node, 0)], -1)
            on = known & ((unit & 0x800000FF) == byte)
            walking, node, unit, depth = walking[on], node[on] ^ self._offset(unit[on]), unit[on], depth + 1
            leaf = (unit >> 8 & 1) == 1
            length[walking[leaf]] = depth
            value[walking[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        some = np.flatnonzero(length)
        return [(int(places[k]), int(length[k]), self.strings[value[k] : self.strings.index(b"\0", value[k])]) for k in some]


class Encoder:
    """A model's normaliser with its alignment, its pieces, and the library's merges and decoder.

    Normalised texts are cut before each run of space symbols: no piece has one after another character (checked), so no merge
    crosses a cut, and each different part of a slice is merged once. A model whose pieces do cross is merged text by text.
    """

    def __init__(self, model: bytes) -> None:
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must put space symbols before words and fall back to bytes")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with symbols of the user's own are not supported")
        self.model, self.spec = model, proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        space = SPACE.decode()
        self.crossing = any(re.search(f"[^{space}]{space}", p.piece) for p in proto.pieces if p.type == p.NORMAL)
        self.sizes = np.array([len(p.piece.encode()) if p.type in (p.NORMAL, p.UNUSED) else 0 for p in proto.pieces], dtype=np.int64)
        self.bytes = np.array([int(p.piece[3:5], 16) if p.type == p.BYTE else -1 for p in proto.pieces], dtype=np.int64)
        bare = sentencepiece_model_pb2.ModelProto.FromString(model)
        bare.normalizer_spec.precompiled_charsmap = b""
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = False
        self.bare = bare.SerializeToString()

    @cached_property
    def merges(self) -> sentencepiece.SentencePieceProcessor:
        """The model without its normaliser: it gets normalised parts."""
        return sentencepiece.SentencePieceProcessor(model_proto=self.bare)

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of the texts data[offsets[k]:offsets[k + 1]], their offsets, and the alignment: for text k, at out[k] + k and on, for
        each of its normalised bytes and for its end, the place in data of the first byte of what it comes from."""
        origin = _starts(data, offsets)
        changes = {}
        if len(self.map.units):
            places = np.flatnonzero(origin == np.arange(len(data)))
            limit = np.repeat(offsets[1:], np.diff(offsets))
            changes = {p: (n, s) for p, n, s in self.map.longest(data, places, limit[places])}
        try:
            data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            for p in _malformed(data, offsets):
                origin[p] = p
                changes.setdefault(p, (1, REPLACEMENT))
        width, reach, taken = np.ones(len(data), dtype=np.int64), 0, []
        for p in sorted(changes):
            n, s = changes[p]
            if p >= reach:
                width[p : p + n], width[p], origin[p : p + n], reach = 0, len(s), p, p + n
                taken.append((p, s))
        if taken:
            put, changed = np.cumsum(width) - width, np.zeros(len(data), dtype=bool)
            changed[[p for p, _ in taken]] = True
            plain = (width == 1) & ~changed
            out = np.zeros(int(width.sum()), dtype=np.uint8)
            out[put[plain]] = data[plain]
            for p, s in taken:
                out[put[p] : put[p] + len(s)] = np.frombuffer(s, dtype=np.uint8)
            cuts = np.concatenate(([0], np.cumsum(width)))[offsets]
            origin = np.repeat(origin, width)
        else:
            out, cuts = data, offsets
        return self._spaced(out, cuts, origin, offsets)

    def _spaced(self, out: np.ndarray, cuts: np.ndarray, origin: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drops extra spaces if the model wants it, puts space symbols for spaces and one in front of each text."""
        sizes, ends, space = np.diff(cuts), offsets[1:].copy(), out == 0x20
        first = np.where(sizes > 0, offsets[:-1], -1)
        if self.spec.remove_extra_whitespaces and len(out):
            text = np.repeat(np.arange(len(sizes)), sizes)
            before = np.concatenate(([True], space[:-1]))
            before[cuts[:-1][sizes > 0]] = True
            keep = ~(space & before)
            first = np.full(len(sizes), -1)
            kept = np.flatnonzero(keep)[::-1]
            first[text[kept]] = origin[kept]
            sizes = np.bincount(text[keep], minlength=len(sizes))
            out, origin, space = out[keep], origin[keep], space[keep]
        front = np.where((first >= 0) & self.spec.add_dummy_prefix, 3, 0)
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        put = np.cumsum(np.where(space, 3, 1))
        long = int(put[-1]) if len(put) else 0
        heads = np.concatenate(([0], put))[np.concatenate(([0], np.cumsum(sizes)))]
        new = heads + np.concatenate(([0], np.cumsum(front)))
        put = np.concatenate(([0], put[:-1])) + np.cumsum(front)[text] if len(put) else put
        wide, aligned = np.empty(long + int(front.sum()), dtype=np.uint8), np.empty(long + int(front.sum()) + len(sizes), dtype=np.int64)
        wide[put], aligned[put + text], aligned[new[1:] + np.arange(len(sizes))] = out, origin, ends
        spaces, own, lead = put[space], text[space], np.flatnonzero(front)
        for k in range(3):
            wide[spaces + k], wide[new[lead] + k] = SPACE[k], SPACE[k]
            aligned[spaces + own + k], aligned[new[lead] + lead + k] = origin[space], first[lead]
        if self.spec.remove_extra_whitespaces:  # symbols at the end go too, the text's own and the one in front as well
            symbol = _symbols(wide)
            solid = ~(symbol | np.roll(symbol, 1) | np.roll(symbol, 2))
            text, stop = np.repeat(np.arange(len(sizes)), np.diff(new)), new[:-1].copy()
            np.maximum.at(stop, text[solid], np.flatnonzero(solid) + 1)
            keep, each = np.arange(len(wide)) < stop[text], np.arange(len(sizes))
            held = np.arange(len(aligned)) <= np.repeat(stop + each, np.diff(new) + 1)
            wide, aligned, new = wide[keep], aligned[held], np.concatenate(([0], np.cumsum(stop - new[:-1])))
        return wide, new, aligned

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, begins, ends) over a slice of texts, with an end id for each; begins and ends count bytes of the own text."""
        raw = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        out, cuts, aligned = self.normalise(data, offsets)
        symbol = _symbols(out)
        head = symbol.copy()
        head[3:] &= ~symbol[:-3]
        head &= not self.crossing
        head[cuts[:-1][np.diff(cuts) > 0]] = True
        parts = np.append(np.flatnonzero(head), len(out))
        coded = pa.Array.from_buffers(pa.large_binary(), len(parts) - 1, [None, pa.py_buffer(parts.astype(np.int64)), pa.py_buffer(out)]).dictionary_encode()
        own = self.merges.encode([p.decode("utf-8") for p in coded.dictionary.to_pylist()], num_threads=1)
        many = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        ids = np.fromiter(chain.from_iterable(own), dtype=np.int64, count=int(many.sum()))
        width = self._widths(ids)
        heads = np.searchsorted(parts[:-1], cuts)
        which = np.insert(coded.indices.to_numpy().astype(np.int64), heads[1:], len(own))  # an end id after each text
        ids, width, many = np.append(ids, self.library.eos_id()).astype(np.int32), np.append(width, 0), np.append(many, 1)
        count = many[which]
        first = np.cumsum(many) - many
        total = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(first[which] - total[:-1], count) + np.arange(total[-1])
        ids, width = ids[at], width[at]
        stop = np.cumsum(width)
        tokens = total[heads + np.arange(len(heads))]  # of each text, and the end
        text = np.repeat(np.arange(len(texts)), np.diff(tokens))
        stop += text
        return tokens, ids, aligned[stop - width] - offsets[text], aligned[stop] - offsets[text]

    def _widths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece. Of the bytes that stand for one character the last has its width, the others have none."""
        width = self.sizes[ids]
        at = np.flatnonzero(self.bytes[ids] >= 0)
        byte = self.bytes[ids[at]]
        size = np.select([byte < 0x80, byte < 0xC0, byte < 0xE0, byte < 0xF0], [1, 0, 2, 3], 4)  # 0: within a character
        lead = np.flatnonzero(size)
        width[at[lead] + size[lead] - 1] = size[lead]
        return width


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds to each row the ids of its text, an end id last, for each id the bytes of the text, from begins up to ends, that it stands for,
    and, as decoded, the text that the library decodes the ids to.

    Ids are those of the sentencepiece library without sampling. Where several bytes encode one character, the last of them has its span and those
    before are empty, as in the library. A null text counts as empty and has the end id alone; so has an empty one. Ties, repeated rows and null keys
    play no part: each row stands by itself, and an empty table gives an empty one. `keep` names the columns to carry (all but the text if None);
    columns with the names of new ones are replaced. A text of any length is encoded whole, texts are worked on in slices of about a MB.
    """
    new = ["ids", "begins", "ends", "decoded"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in (*new, text)]
    rows = docs.select(*names, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields), OUT])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for low, part in text_slices(batch.column(len(names)), SLICE):
                offsets, *columns = encoder.encode(part)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c, pa.int32())) for c in columns]
                ids, cuts = columns[0].tolist(), offsets.tolist()
                texts = pa.array([encoder.library.decode(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([c.slice(low, len(part)) for c in batch.columns[: len(names)]] + lists + [texts], [*names, *new])

    return rows.mapInArrow(work, schema)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes a row's ids to. Null ids are none and give an empty text; a column named as `out` is replaced."""
    rows = rows.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{out}` string"])
    at = rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = [library.decode(x.tolist()) if x is not None and len(x) else "" for x in batch.column(at).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(work, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """Per document: its number of ids, hashes of the ids and of the decoded text, and a hash of all spans."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )
