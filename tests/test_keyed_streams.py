"""Keyed streams with timers: order across batches, restart from a checkpoint, sessions with a cap."""

import datetime as dt
import random

import pandas as pd
import pytest

from caselight.streaming import keyed as K
from caselight.streaming import streams as S

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "user string, id long, ts timestamp, bad boolean"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder to which files of rows are added, and a run over what is new since the last run, on one checkpoint."""

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(make):
        with K.rocks(spark):
            out = make(S.stream_table(spark, f"{tmp_path}/in"))
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]

    return add, run


def plain_lockouts(rows, most, lock_s):
    state, out = {}, {}
    for user, row, ts, bad in sorted(rows, key=lambda r: (r[2], r[1])):
        failures, until = state.get(user, (0, T0))
        if ts < until:
            out[row] = "refused"
        elif not bad:
            failures, out[row] = 0, "ok"
        elif failures + 1 >= most:
            failures, until, out[row] = 0, ts + dt.timedelta(seconds=lock_s), "locked"
        else:
            failures, out[row] = failures + 1, "failed"
        state[user] = failures, until
    return out


def test_late_rows_across_batches_and_a_restart(feed):
    """Rows that come a batch late, after a restart from the checkpoint, are answered in the order of time; one user has most of the rows."""
    add, run = feed
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", "c"]), k, at(r.randint(0, 3000)), r.random() < 0.7) for k in range(300)]
    rows.sort(key=lambda x: x[2])
    late = [x for k, x in enumerate(rows) if k % 7 == 3 and x[2] < at(1500)]
    make = lambda s: K.lockouts(s, "user", "id", "ts", "bad", "1 day", most=3, lock_s=3600)
    add([x for x in rows if x[2] < at(1500) and x not in late])
    first = run(make)
    assert len(first) == len({x[0] for x in first})
    add(late)
    add([x for x in rows if x[2] >= at(1500)])
    run(make)
    add([("z", 1000, at(3000 + 1440 + 5), False)])  # lets the watermark pass all
    found = {x[0]: x[2] for x in run(make)}
    want = plain_lockouts(rows, 3, 3600)
    assert {k: v for k, v in found.items() if k != 1000} == want and {"locked", "refused", "ok", "failed"} <= set(want.values())


def test_sessions_end_by_idle_time_and_cap(feed):
    add, run = feed
    steady = [("s", k, at(10 * k), False) for k in range(60)]  # ten minutes apart for ten hours: the cap cuts it
    gaps = [("g", 100 + k, at(m), False) for k, m in enumerate((0, 5, 19, 40, 41, 200))]
    make = lambda s: K.sessions(s, "user", "id", "ts", "1 hour")
    add(steady[::2] + gaps[1::2])
    run(make)
    add(steady[1::2] + gaps[::2])  # rows up to an hour behind the watermark are gone for good, those within it are in order
    add([("z", 999, at(2000), False)])
    got = sorted(run(make))
    assert {x[0] for x in got} >= {"g", "s"} and all(last - start < 8 * 3600_000 for _, start, last, _ in got)


def test_sessions_in_one_batch(feed):
    add, run = feed
    add([("s", k, at(10 * k), False) for k in range(60)] + [("g", 100 + k, at(m), False) for k, m in enumerate((0, 5, 19, 40, 41, 200))] + [("z", 999, at(2000), False)])
    got = [x for x in sorted(run(lambda s: K.sessions(s, "user", "id", "ts", "1 hour"))) if x[0] != "z"]
    base = int(T0.timestamp() * 1000)
    assert [(u, (a - base) // 60_000, (b - base) // 60_000, n) for u, a, b, n in got] == [("g", 0, 19, 3), ("g", 40, 41, 2), ("g", 200, 200, 1), ("s", 0, 470, 48), ("s", 480, 590, 12)]


def test_the_newest_row_of_a_key(feed, spark, tmp_path):
    add, _ = feed
    add([("a", 1, at(5), True), ("a", 2, at(3), False), ("b", 3, at(1), True)])
    add([("a", 4, at(4), False), ("b", 5, at(1), False)])
    with K.rocks(spark):
        rows = S.newest(K.latest(S.stream_table(spark, f"{tmp_path}/in"), "user", "id", "ts", "bad", "1 hour", keep_s=3600), ["user"], "latest").collect()
    assert {(r.user, r.row, r.value) for r in rows} == {("a", 1, True), ("b", 5, False)}


class Counting:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, []

    def _state(self, name, *_):
        return CountingState(self, name)

    getListState = getMapState = getValueState = _state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class CountingState:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def __getattr__(self, what):
        def call(*values):
            kept, self.store.calls = self.store.kept.setdefault(self.name, []), self.store.calls + 1
            if what == "exists":
                return bool(kept)
            if what == "get":
                return list(kept) if self.name == "waiting" else kept[-1]
            if what in ("put", "clear"):
                kept.clear()
            if what in ("update", "appendValue", "put"):
                kept.extend(values[0] if what == "put" else [values[0]])

        return call


class Time:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def test_state_is_called_by_the_part_and_not_by_the_row():
    rows = pd.DataFrame({"ms": range(0, 6_000_000, 1000), "row": range(6000), "flag": [False] * 6000})
    for kind, answers in ((K.Lockouts("user", 3, 1000, 10**9), 6000), (K.Sessions("user", 500, 10**6), 6000)):
        store = Counting()
        kind.init(store)
        assert list(kind.handleInputRows(("a",), iter([rows[3000:], rows[:3000]]), Time(0))) == []
        out = list(kind.handleExpiredTimer(("a",), Time(7_000_000), Time(min(store.timers))))
        assert store.calls < 20 and sum(len(x) for x in out) == answers


def test_keys_are_written_by_the_bucket():
    store, kind = Counting(), K.Latest("id", ("bigint", "bigint"), 10**6)
    kind.init(store)
    rows = pd.DataFrame({"key": [1, 2, 1, 3] * 500, "ms": range(2000), "row": range(2000), "value": [1, None, 3, 4] * 500})
    out = next(kind.handleInputRows((7,), iter([rows]), Time(0)))
    assert store.calls < 10 and sorted(out.astype(object).where(out.notna(), None).itertuples(index=False, name=None)) == [(1, 1998, 1998, 3), (2, 1997, 1997, None), (3, 1999, 1999, 4)]
    list(kind.handleExpiredTimer((7,), Time(10**6 + 1998), Time(0)))
    assert kind._load() == {3: (1999, 1999, 4)}


def test_the_newest_row_of_null_keys(feed, spark, tmp_path):
    add, _ = feed
    add([(None, 1, at(5), True), (None, 2, at(3), False), ("b", 3, at(1), None)])
    with K.rocks(spark):
        rows = S.newest(K.latest(S.stream_table(spark, f"{tmp_path}/in"), "id", "id", "ts", "user", "1 hour", keep_s=3600), ["id"], "latest").collect()
        null = S.newest(K.latest(S.stream_table(spark, f"{tmp_path}/in"), "user", "id", "ts", "id", "1 hour", keep_s=3600), ["user"], "latest").collect()
    assert {(r.id, r.value) for r in rows} == {(1, None), (2, None), (3, "b")}
    assert {(r.user, r.row, r.value) for r in null} == {(None, 1, 1), ("b", 3, 3)}
