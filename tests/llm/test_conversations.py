"""Repairs against a plain dynamic program over whole strings, and against all edits of very short conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from caselight.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, head string, ck long"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        yield from [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)


def follow(state):
    return {"": "u", "s": "u", "u": "a", "a": "u"}[state]


def plain_audit(kinds):
    """(cost, audit) of the least by cost and then ASCII order, over whole strings."""

    @cache
    def best(k, state, inserts):
        found = []
        if inserts < 3:
            cost, rest = best(k, follow(state), inserts + 1)
            found.append((cost + 3, "I" + rest))
        if k == len(kinds):
            if state in ("", "a"):
                found.append((0, ""))
            return min(found, default=(10**9, ""))
        initial, fault = kinds[k]
        extra = 3 if fault == "truncated" else 0
        cost, rest = best(k + 1, state, 0)
        found.append((cost + 4, "D" + rest))
        if fault not in ("blank", "duplicate"):
            if initial == follow(state) or initial == "s" and state == "":
                cost, rest = best(k + 1, initial, 0)
                found.append((cost + extra, "K" + rest))
            cost, rest = best(k + 1, follow(state), 0)
            found.append((cost + 3 + extra, "R" + rest))
        return min(found)

    return best(0, "", 0)


def plain(rows):
    """The result of one conversation's rows in order."""
    seen, kinds, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        if fault:
            count[fault] += 1
    cost, audit = plain_audit(tuple(kinds))
    lines, state, at = [], "", 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][2:]
        at += letter != "I"
        if letter == "D":
            continue
        to = role[:1] if letter == "K" else follow(state)
        lines.append(f"{role if letter == 'K' else 'user' if to == 'u' else 'assistant'}:{text}")
        state = to
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def key(row):
    text = f"{len(row[2])}:{row[2]}:{row[3]}"
    return row[1] is not None, row[1] or 0, row[2].encode(), hashlib.sha256(text.encode()).digest()


def check(got, rows):
    want = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        want[r[0]].append(r)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r[c] for c in names) for r in got}
    assert len(found) == len(got) and found.keys() == want.keys()
    for conv, own in want.items():
        assert found[conv] == plain(sorted(own, key=key)), conv


def made(seed, count, longest):
    r, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "so", " \t", "", None, "a b.  \n", "ü", "what?", "the end .x"]
    for conv in [*range(count), None]:
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "s"])
            rows.append((conv, None if r.random() < 0.05 else turn + r.randint(0, 2), role, f"{r.choice(texts)}{r.randint(0, 99)}." if r.random() < 0.6 else r.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [2, 64])
def test_repairs_equal_the_plain_program(spark, block):
    """Blocks of two turns give the same as whole conversations."""
    rows = made(block, 60, 40)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = conversations.repair(conversations.damage(df), block).collect()
    ids = {r[0] for r in rows} - {r.conv_id for r in got}
    assert all(not [x for x in plain_damage(rows) if x[0] == i] for i in ids)
    if block == 64:
        check(conversations.repaired_after_damage(df).collect(), rows)
    else:
        check(got, [r for r in rows if r[0] not in ids])


def test_tight_edits_against_all_edits():
    """Every audit of up to three inserts between turns, over all short conversations of some kinds."""
    kinds = [("u", ""), ("a", "truncated"), ("s", ""), ("u", "blank"), ("?", "")]
    for n in (0, 1, 2, 3):
        for row in itertools.product(kinds, repeat=n):
            found = []
            for cuts in itertools.product(range(4), repeat=n + 1):
                for letters in itertools.product("DKR", repeat=n):
                    state, cost, audit, good = "", 3 * sum(cuts), "", True
                    for k in range(n + 1):
                        for _ in range(cuts[k]):
                            state, audit = follow(state), audit + "I"
                        if k == n:
                            break
                        (initial, fault), letter = row[k], letters[k]
                        audit += letter
                        if letter == "D":
                            cost += 4
                            continue
                        to = follow(state)
                        good &= fault != "blank" and (letter == "R" or initial == to or (initial == "s" and state == ""))
                        cost += (3 if fault else 0) + 3 * (letter == "R")
                        if not good:
                            break
                        state = initial if letter == "K" else to
                    if good and state in ("", "a"):
                        found.append((cost, audit))
            assert min(found) == plain_audit(row)


def test_empty_tables_and_conversations_that_vanish(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired_after_damage(empty).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    check(conversations.repaired_after_damage(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect(), rows)


def test_the_query_over_the_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.op13_conversations(spark, folder).collect(), rows)
