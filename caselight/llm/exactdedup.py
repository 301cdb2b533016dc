"""Exact duplicates by an exchange of Golomb-coded fingerprints, with byte verification of the suspects."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, ascii_lower, lookup, stored, without

#: Bits of a fingerprint that are exchanged. Equal ones only make suspects; the texts decide.
BITS = 56
#: Fingerprints that one owner gathers, on average; the number of owners grows with the input.
PER_OWNER = 1_000_000
#: Bytes of answers that are broadcast back to the senders; beyond, messages are shuffled to them.
ANSWER_BYTES = 64_000_000
#: Rows of one sender's message block.
BLOCK_ROWS = 65_536


def golomb_encode(values: np.ndarray, top: int) -> tuple[int, bytes]:
    """Sorted distinct non-negative integers below top to (k, code): the gaps in unary quotients, then k-bit remainders."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=0).astype(np.uint64)
    k = max(0, int(math.log2(max(1.0, 0.69 * top / len(values)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return k, len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=np.uint64)
    bits = int.from_bytes(code[:8], "little")
    size = (bits + 7) // 8
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(code[8 : 8 + size], dtype=np.uint8), count=bits))
    quotients = np.diff(stops, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code[8 + size :], dtype=np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    low = (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _starts(owners: int, bits: int) -> np.ndarray:
    return np.array([(o << bits) // owners for o in range(owners + 1)], dtype=np.uint64)


def _messages(batches: Iterator[pa.RecordBatch], owners: int, bits: int) -> Iterator[pa.RecordBatch]:
    """For each block of a sender's rows and each owner: the distinct fingerprints, coded, and the rows behind them."""
    from pyspark import TaskContext

    context = TaskContext.get()
    sender = context.partitionId() if context else 0
    starts, seq, waiting, held = _starts(owners, bits), 0, [], 0

    def flush(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal seq
        t = pa.Table.from_batches(tables)
        sha = t.column("sha").to_pylist()
        fps = np.frombuffer(b"".join(s[:8] for s in sha), dtype=">u8").astype(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(fps, kind="stable")
        cuts = np.searchsorted(fps[order], starts)
        ids = t.column("id").to_pylist()
        out: dict[str, list] = {c: [] for c in ("owner", "block", "n", "k", "code", "again", "ids", "shas", "slots")}
        for o in range(owners):
            rows = order[cuts[o] : cuts[o + 1]]
            if not len(rows):
                continue
            distinct, slots, counts = np.unique(fps[rows], return_inverse=True, return_counts=True)
            k, code = golomb_encode(distinct - starts[o], int(starts[o + 1] - starts[o]))
            values = (o, (sender << 24) + seq, len(distinct), k, code, np.packbits(counts > 1).tobytes(), [ids[r] for r in rows], [sha[r] for r in rows], slots.tolist())
            for c, v in zip(out, values, strict=True):
                out[c].append(v)
        seq += 1
        types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    for b in batches:
        if b.num_rows:
            waiting.append(b)
            held += b.num_rows
        if held >= BLOCK_ROWS:
            yield from flush(waiting)
            waiting, held = [], 0
    if held:
        yield from flush(waiting)


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner's answer to all senders: a bitmap over the fingerprints of each message, 1 where another row has it too."""
    lists = [golomb_decode(c, n, k) for c, n, k in zip(messages["code"], messages["n"], messages["k"], strict=True)]
    found, counts = np.unique(np.concatenate(lists), return_counts=True)
    again = [np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=n).astype(bool) for a, n in zip(messages["again"], messages["n"], strict=True)]
    more = np.union1d(found[counts > 1], np.concatenate([x[a] for x, a in zip(lists, again, strict=True)]))
    bitmaps = [np.packbits(np.isin(x, more)).tobytes() for x in lists]
    return pd.DataFrame({"owner": messages["owner"], "block": messages["block"], "bitmap": bitmaps})


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, sha, pos, suspect) of every row, stored; pos is unique. sha is of the text with A-Z lower-cased."""
    owners = max(8, math.ceil(docs.count() / PER_OWNER))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(ascii_lower(F.col(text_col).cast("string")), 256)).alias("sha"))
    schema = "owner int, block long, n int, k int, code binary, again binary, ids array<long>, shas array<binary>, slots array<int>"
    sent = stored(rows.mapInArrow(lambda b: _messages(b, owners, bits), schema), "messages")
    answers = sent.select("owner", "block", "n", "k", "code", "again").groupBy("owner").applyInPandas(_answer, "owner int, block long, bitmap binary")
    answers = stored(answers, "answers")
    size = answers.agg(F.sum(F.length("bitmap") + 32)).first()[0] or 0
    # A message meets its answer before its rows are told apart; up to ANSWER_BYTES of bitmaps no sender's rows move at all.
    met = sent.select("owner", "block", "ids", "shas", "slots").join(F.broadcast(answers) if size <= ANSWER_BYTES else answers, ["owner", "block"])
    back = met.select("owner", "block", "bitmap", F.posexplode(F.arrays_zip("ids", "shas", "slots")).alias("at", "row")).select(
        F.col("row.ids").alias("id"), F.col("row.shas").alias("sha"), F.struct("block", "owner", "at").alias("pos"), F.col("row.slots").alias("slot"), "bitmap"
    )
    byte = F.conv(F.hex(F.expr("substring(bitmap, slot div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, 7 - slot % 8) & 1") == 1
    return stored(back.withColumn("byte", byte).select("id", "sha", "pos", bit.alias("suspect")), "suspects")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id
    stays; rows with a null id come last. Of repeated rows with that same id exactly one is kept. Other columns are ignored.
    Empty table: no rows.

    Senders are the scan's partitions: each sends its sorted fingerprints, Golomb-coded, to the owners of their ranges. A
    fingerprint goes once per block, so a text that a third of all rows share costs an owner one entry a block. Owners answer
    with bitmaps. Only texts of suspects are shuffled, after equal ones are counted where they are read.
    """
    found = suspects(docs, id_col, text_col, bits)
    doubtful = found.where("suspect")
    keys = stored(doubtful.select("sha").distinct(), "suspect-keys")
    norm = ascii_lower(F.col(text_col).cast("string"))
    texts = among(docs.select(norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("sha")), keys, "sha")
    verified = texts.groupBy("sha", "norm").agg(F.count("*").alias("n")).groupBy("sha").agg(F.sum("n").alias("group_size"), F.count("*").alias("texts"))
    verified = verified.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts have one SHA-256")).cast("long")))
    keep = doubtful.groupBy("sha").agg(F.max(F.struct("id", "pos")).alias("keep"))
    classes = stored(keep.join(verified, "sha").select("sha", "keep", "group_size"), "classes")
    alone = found.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    shared = lookup(doubtful, classes, "sha", "group_size", found.count()).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("pos") == F.col("keep.pos")).alias("kept"), "sha"
    )
    return alone.unionByName(shared).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, as exact_duplicates() says, all columns kept.

    Rows are told apart by id and text: a null id shields no row, and an id that several texts share takes none of them along. Of
    rows equal in both, the one with the least hash of its raw text, then of its other columns, stays; texts are looked at again
    only where an id has such a group. Null text counts as empty. Empty table: no rows.
    """
    found = stored(exact_duplicates(docs, id_col, text_col), "exact")
    name = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), sha)
    by = found.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("group_size").alias("size"), F.max("kept").alias("kept"))
    by = stored(by.where("size > 1 or n > 1").withColumn("key", name(F.col("doc_id"), F.col("text_sha256"))), "exact-keys")
    ids = stored(by.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "exact-ids")
    gone, several = (stored(by.where(c).select("key"), n) for c, n in (("not kept", "exact-gone"), ("kept and n > 1", "exact-several")))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = without(packed.where("id is not null"), ids, "id").select("row")
    again = among(packed.where("id is not null"), ids, "id").unionByName(packed.where("id is null"))
    again = again.withColumn("key", name(F.col("id"), F.sha2(ascii_lower(F.col("text")), 256)))
    again = without(again, gone, "key")
    out = out.unionByName(without(again, several, "key").select("row"))
    if several.limit(1).count():
        order = F.struct(F.xxhash64("text"), F.xxhash64("row"))
        out = out.unionByName(among(again, several, "key").groupBy("key").agg(F.min_by("row", order).alias("row")).select("row"))
    return out.select("row.*")
