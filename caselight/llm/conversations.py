"""Conversation structure repair: the cheapest edits that give an optional system turn and pairs of user and assistant turns.

The dynamic program over a conversation is cut into blocks of about the square root of its length. Blocks are worked on by
different tasks: first each block's costs between states, then the state-cost vectors at the checkpoints between blocks, backward,
then the blocks again, forward, with the vectors inside a block recomputed and never stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, stored

#: Fixed costs of the edits and of an unfinished text that stays.
INSERT, REROLE, DELETE, UNFINISHED = 3, 3, 4, 3
#: States by the last role: nothing yet, system, user, assistant. An end after user or system is not allowed.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that a user or assistant turn leads to, of which only one may follow.
FOLLOW = np.array([USER, USER, ASSISTANT, USER])
FAR = 1 << 20
#: A shorter conversation is one block; longer ones have blocks of the square root of their length, of this many turns at least.
BLOCK = 64
#: A turn's class is its role's initial, s, u, a or another, and 4 times its fault: none, to be deleted, unfinished.
INITIALS, NONE, GONE, OPEN = "sua", 0, 1, 2
LETTERS = "DKR"
RESULT = "ck string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _kept(state: int, kind: int) -> int | None:
    """The state after a kept turn, None where its role may not stand."""
    initial = kind % 4
    if initial == 0:
        return SYSTEM if state == START else None
    wanted = {1: USER, 2: ASSISTANT}.get(initial)
    return wanted if wanted == FOLLOW[state] else None


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inserts, steps, last): cheapest costs between states by inserts alone, by inserts and then a turn of each class, and to an end."""
    inserts = np.full((4, 4), FAR, dtype=np.int32)
    for q in range(4):
        at = q
        for k in range(3):
            inserts[q, at] = min(inserts[q, at], k * INSERT)
            at = FOLLOW[at]
    steps = np.full((12, 4, 4), FAR, dtype=np.int32)
    for kind in range(12):
        edit = np.full((4, 4), FAR, dtype=np.int32)
        fault = kind // 4
        extra = UNFINISHED if fault == OPEN else 0
        for q in range(4):
            edit[q, q] = DELETE
            if fault != GONE:
                edit[q, FOLLOW[q]] = min(edit[q, FOLLOW[q]], REROLE + extra)
                if (to := _kept(q, kind)) is not None:
                    edit[q, to] = min(edit[q, to], extra)
        steps[kind] = (inserts[:, :, None] + edit[None]).min(1)
    return inserts, steps, inserts[:, list(ENDS)].min(1)


INSERTS, STEPS, LAST = _tables()
KEPT = np.array([[-1 if (to := _kept(q, kind)) is None else to for q in range(4)] for kind in range(12)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by head, so cut that no block lies in two. Blocks are no longer than the square root of a conversation or BLOCK."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        head = table["head"].to_numpy()
        cut = int(np.searchsorted(head, head[-1])) if len(head) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def _classes(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first rows, lengths, kinds padded at the front with -1) of the blocks of a table, blocks of about the same length together."""
    head, kind = table["head"].to_numpy(), table["kind"].to_numpy().astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    size = np.diff(np.append(first, len(head)))
    scale = np.ceil(np.log2(size)).astype(int)
    for s in np.unique(scale):
        own = np.flatnonzero(scale == s)
        longest = int(size[own].max())
        back = np.arange(longest) - (longest - size[own])[:, None]  # place in the block, negative in front of it
        yield first[own], size[own], np.where(back >= 0, kind[np.minimum(first[own][:, None] + np.maximum(back, 0), len(kind) - 1)], -1)


def _backward(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to the end before each turn of each block, and at its end: blocks x (turns + 1) x states (x columns)."""
    out = np.empty((len(kinds), kinds.shape[1] + 1, *ends.shape[1:]), dtype=np.int32)
    out[:, -1] = ends
    for k in range(kinds.shape[1] - 1, -1, -1):
        step, after = STEPS[np.maximum(kinds[:, k], 0)], out[:, k + 1]
        new = np.minimum((step + after[:, None, :]).min(2) if ends.ndim == 2 else (step[:, :, :, None] + after[:, None]).min(2), FAR)
        real = (kinds[:, k] >= 0).reshape(-1, *[1] * (ends.ndim - 1))
        out[:, k] = np.where(real, new, after)
    return out


def _forward(kinds: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks all blocks by tight edits, of which the first in ASCII order is taken. (edits: 3 times the inserts before and the turn's letter, last states)."""
    edits, each, state = np.zeros(kinds.shape, dtype=np.int8), np.arange(len(kinds)), state.copy()
    for k in range(kinds.shape[1]):
        kind, here, after = kinds[:, k], costs[:, k], costs[:, k + 1]
        open_, inserted, letter = kind >= 0, np.zeros(len(kinds), dtype=np.int8), np.zeros(len(kinds), dtype=np.int8)
        kind = np.maximum(kind, 0)
        extra = np.where(kind // 4 == OPEN, UNFINISHED, 0)
        for _ in range(3):
            now, follow = here[each, state], FOLLOW[state]
            delete = open_ & (now == DELETE + after[each, state])
            insert = open_ & ~delete & (now == INSERT + here[each, follow])
            kept = KEPT[kind, state]
            keep = open_ & ~delete & ~insert & (kind // 4 != GONE) & (kept >= 0) & (now == extra + after[each, np.maximum(kept, 0)])
            rerole = open_ & ~delete & ~insert & ~keep
            letter += keep.astype(np.int8) + 2 * rerole.astype(np.int8)
            inserted += insert
            state = np.where(keep, kept, np.where(rerole | insert, follow, state))
            open_ = insert
        edits[:, k] = inserted * 3 + letter
    return edits, state


def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int32)
    for table in _blocks(batches):
        head, ck = table["head"].to_numpy(), table["ck"]
        for first, _, kinds in _classes(table):
            costs = _backward(kinds, np.broadcast_to(unit, (len(kinds), 4, 4)))[:, 0].reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([ck.take(first).combine_chunks(), pa.array(head[first]), pa.array(costs.tolist(), pa.list_(pa.int32()))], ["ck", "head", "costs"])


def _ends(table: pa.Table) -> np.ndarray:
    return np.array(table["end"].to_pylist(), dtype=np.int32).reshape(-1, 4)


def _block_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _blocks(batches):
        head, ck, ends = table["head"].to_numpy(), table["ck"], _ends(table)
        for first, _, kinds in _classes(table):
            costs = _backward(kinds, ends[first])
            exits = np.stack([_forward(kinds, costs, np.full(len(kinds), q))[1] for q in range(4)], 1)
            yield pa.RecordBatch.from_arrays([ck.take(first).combine_chunks(), pa.array(head[first]), pa.array(exits.tolist(), pa.list_(pa.int32()))], ["ck", "head", "exits"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _blocks(batches):
        ends, entry, edit = _ends(table), table["entry"].to_numpy(), np.zeros(len(table), dtype=np.int8)
        for first, size, kinds in _classes(table):
            edits, _ = _forward(kinds, _backward(kinds, ends[first]), entry[first])
            pad = kinds.shape[1] - size
            for f, n, p, e in zip(first, size, pad, edits, strict=True):
                edit[f : f + n] = e[p:]
        yield from table.select(["ck", "g", "kind"]).append_column("edit", pa.array(edit.astype(np.int32))).combine_chunks().to_batches()


def _checkpoints(pdf: pd.DataFrame) -> pd.DataFrame:
    """The vectors at the ends of a conversation's blocks, from its last to its first."""
    pdf, after, ends = pdf.sort_values("head"), LAST.astype(np.int32), []
    for costs in reversed(pdf["costs"].tolist()):
        ends.append(after.tolist())
        after = np.minimum((np.asarray(costs).reshape(4, 4) + after[None]).min(1), FAR)
    return pd.DataFrame({"head": pdf["head"], "end": ends[::-1]})


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states in which the cheapest walk enters a conversation's blocks."""
    pdf, state, entries = pdf.sort_values("head"), START, []
    for exits in pdf["exits"].tolist():
        entries.append(state)
        state = int(exits[state])
    return pd.DataFrame({"head": pdf["head"], "entry": entries})


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its turns in order, each preceded by its edit. Texts are hashed as they pass, none is held."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    now: Told | None = None
    for batch in batches:
        done = []
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for ck, kind, edit, fault, turn, role, text in zip(*columns, strict=True):
            if now is None or now.ck != ck:
                if now is not None:
                    done.append(now.row())
                now = Told(ck)
            if edit is not None:
                now.edit(kind, edit)
            else:
                now.turn(turn, role, text, fault)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in now.row()], names)


class Told:
    """What is known of a conversation so far."""

    def __init__(self, ck: str) -> None:
        self.ck, self.audit, self.sha, self.state, self.cost = ck, [], hashlib.sha256(), START, 0
        self.low = self.high = self.last = self.before = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.kind = self.code = 0

    def edit(self, kind: int, code: int) -> None:
        self.kind, self.code = kind, code

    def line(self, role: str, text: str) -> None:
        self.sha.update((f"{chr(10) if self.state != START else ''}{role}:{text}").encode())

    def insert(self, many: int) -> None:
        for _ in range(many):
            to = int(FOLLOW[self.state])
            self.line("user" if to == USER else "assistant", "")
            self.state, self.cost = to, self.cost + INSERT
        self.audit.append("I" * many)

    def turn(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns, self.last = self.turns + (turn != self.last), turn
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.insert(self.code // 3)
        letter, to = LETTERS[self.code % 3], int(FOLLOW[self.state])
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += (UNFINISHED if self.kind // 4 == OPEN else 0) + (REROLE if letter == "R" else 0)
        self.line(role if letter == "K" else "user" if to == USER else "assistant", text)
        self.state = int(KEPT[self.kind, self.state]) if letter == "K" else to

    def row(self) -> tuple:
        self.insert(int(LAST[self.state]) // INSERT)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        f = self.faults
        return self.ck, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with known faults, by a hash of conversation and turn; nulls count as one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d")).where("d != 0")
    changed = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("c")).drop("c")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _grouped(df: DataFrame, schema: str, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return df.groupBy("ck").applyInPandas(work, schema)


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation (conv_id, turn, role, text) with its faults, the cheapest edits and a hash of the repaired turns.

    Turns go by number, nulls first; equal numbers by role and a hash of the text. A null role or text is one space, null conversations are one
    conversation. Equal turns beyond the first are duplicates, blank ones are blank. Texts are carried whole and hashed as they stream by; a hash of one
    text is sequential by nature, so the texts of one conversation pass through one task in the last step, in sorted batches. All else is dealt out by
    blocks, whatever the conversation. An empty table gives an empty one; further columns are left out.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    keyed = turns.select(_key(F.col("conv_id")).alias("ck"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest"))
    sorted_ = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("at", 33)
    offsets = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each task that sorted
    offsets = offsets.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    numbered = sorted_.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("g", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))

    solid = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.greatest(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0))
    facts = numbered.select("ck", "g", "digest", F.when((initial == 0) | (F.length("role") == 0), 3).otherwise(initial - 1).alias("initial"), solid.alias("solid"))
    firsts = facts.where("solid != ''").groupBy("ck", "digest").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    blank, again, unfinished = F.col("solid") == "", F.col("first").isNull(), ~F.col("solid").isin(".", "!", "?")
    fault = F.when(blank, "blank").when(again, "duplicate").when(unfinished, "truncated").otherwise("")
    weight = F.when(blank | again, GONE).when(unfinished, OPEN).otherwise(NONE)
    marked = stored(facts.join(firsts, "g", "left").select("ck", "g", fault.alias("fault"), (F.col("initial") + 4 * weight).cast("int").alias("kind")), "marked")

    sizes = stored(marked.groupBy("ck").agg(F.count("*").alias("n"), F.min("g").alias("g0")), "sizes")
    step = F.greatest(F.lit(block), F.ceil(F.sqrt("n")))
    head = F.col("g0") + F.floor((F.col("g") - F.col("g0")) / step) * step
    rows = lookup(marked, sizes, "ck", "n", max(1, marked.count())).select("ck", "g", "kind", head.cast("long").alias("head"), (F.col("n") > step).alias("many"))
    rows = stored(rows, "blocks")
    many = rows.where("many").select("ck", "g", "kind", "head")
    dealt = lambda df: df.repartition("head").sortWithinPartitions("head", "g")
    costs = dealt(many).mapInArrow(_block_costs, "ck string, head long, costs array<int>")
    ends = stored(_grouped(costs, "head long, end array<int>", _checkpoints), "checkpoints")
    exits = dealt(many.join(ends, "head")).mapInArrow(_block_exits, "ck string, head long, exits array<int>")
    entries = _grouped(exits, "head long, entry int", _entries)
    known = rows.select("ck", "g", "kind", "head").join(ends.join(entries, "head"), "head", "left")
    whole = known.withColumn("end", F.coalesce("end", F.array(*[F.lit(int(x)) for x in LAST]))).withColumn("entry", F.coalesce("entry", F.lit(START)))
    edits = dealt(whole).mapInArrow(_walk, "ck string, g long, kind int, edit int")

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = edits.select("ck", "g", F.lit(0).alias("after"), "kind", "edit", null("string", "fault"), null("long", "turn"), null("string", "role"), null("string", "text"))
    mark = marked.select("g", "fault")
    said = numbered.join(mark, "g").select("ck", "g", F.lit(1).alias("after"), null("int", "kind"), null("int", "edit"), "fault", "turn", "role", "text")
    told = first.unionByName(said).repartition("ck").sortWithinPartitions("ck", "g", "after").drop("g", "after").mapInArrow(_tell, RESULT)
    conv_id = F.when(F.col("ck") != "", F.substring("ck", 2, 1 << 30)).cast(turns.schema["conv_id"].dataType)
    return told.select(conv_id.alias("conv_id"), *told.columns[1:])


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired; zeros, an empty audit and the hash of an empty text for those without turns then."""
    found = repair(damage(conversations))
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    ids = conversations.select("conv_id").distinct().select(F.col("conv_id"), _key(F.col("conv_id")).alias("__ck"))
    joined = ids.join(found.withColumn("__ck", _key(F.col("conv_id"))).drop("conv_id"), "__ck", "left").drop("__ck")
    return joined.fillna(zeros).fillna({"audit": "", "repaired_sha256": EMPTY})
