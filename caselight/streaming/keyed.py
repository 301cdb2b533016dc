"""Streams of keyed events in the order of event time: rows wait in the state store until the watermark has passed them, timers let them go."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows go together, by the minute.
SLOT_MS = 60_000
#: Rows of a key that are worked on at a time.
SLICE = 50_000
#: Buckets of keys whose latest rows lie together, and the types of whole numbers.
BUCKETS, WHOLE = 16_384, ("tinyint", "smallint", "int", "bigint")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State of the queries that start inside lies on disk, as these operators need; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _slot(ms: int) -> int:
    return -(-ms // SLOT_MS) * SLOT_MS


class InOrder(StatefulProcessor):
    """Keeps a key's rows (ms, row, flag) until no earlier one can come, then hands them to advance() by time and row.

    Calls of the state store cost more than the rows, so a part of the input is one entry of a list, and one timer lets all rows go that the watermark has passed.
    A task then holds the rows of one key that wait, 17 bytes each, and hands over SLICE of them at a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms binary, row binary, flag binary")

    def _keep(self, ms: np.ndarray, row: np.ndarray, flag: np.ndarray) -> tuple[bytes, bytes, bytes]:
        return ms.tobytes(), row.tobytes(), flag.tobytes()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        least = None
        for part in rows:
            ms = part["ms"].to_numpy(np.int64)
            self.waiting.appendValue(self._keep(ms, part["row"].to_numpy(np.int64), part["flag"].to_numpy(bool)))
            least = int(ms.min()) if least is None else min(least, int(ms.min()))
        if least is not None:
            self.handle.registerTimer(_slot(least))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() // SLOT_MS * SLOT_MS)
        kept = list(self.waiting.get())
        ms, row, flag = (np.concatenate([np.frombuffer(x[k], kind) for x in kept] or [np.empty(0, kind)]) for k, kind in enumerate((np.int64, np.int64, bool)))
        due, late = ms <= upto, None
        if due.any():
            if due.all():
                self.waiting.clear()
            else:
                self.waiting.put([self._keep(ms[~due], row[~due], flag[~due])])
        if not due.all():
            late = _slot(int(ms[~due].min()))
        ms, row, flag = ms[due], row[due], flag[due]
        order = np.lexsort((row, ms))
        ms, row, flag = ms[order], row[order], flag[order]
        last = np.append((ms[1:] != ms[:-1]) | (row[1:] != row[:-1]), True)[: len(ms)]  # a row that came twice counts as it came last
        ms, row, flag = ms[last], row[last], flag[last]
        cuts = range(0, len(ms), SLICE)
        wake = yield from self.advance(key, (list(zip(ms[k : k + SLICE].tolist(), row[k : k + SLICE].tolist(), flag[k : k + SLICE].tolist(), strict=True)) for k in cuts), upto)
        for time in {late, wake} - {None}:
            self.handle.registerTimer(time)

    def advance(self, key: Any, due: Iterator[list[tuple[int, int, bool]]], upto: int) -> Generator[pd.DataFrame, None, int | None]:
        """Returns when the key is to be looked at again, if no row comes before."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Lockouts(InOrder):
    """`most` failures lock for a time and reset the counter, a success resets it, attempts while locked are refused and not counted."""

    def __init__(self, name: str, most: int, lock_ms: int, keep_ms: int) -> None:
        self.name, self.most, self.lock_ms, self.keep_ms = name, most, lock_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "failures int, until long, last long")

    def advance(self, key: Any, due: Iterator[list[tuple[int, int, bool]]], upto: int) -> Generator[pd.DataFrame, None, int | None]:
        before = now = tuple(self.state.get()) if self.state.exists() else None
        failures, until, last = now or (0, -1, None)
        for rows in due:
            out = []
            for ms, _, bad in rows:
                if last is not None and _slot(ms) > _slot(last + self.keep_ms):  # forgotten before this minute
                    failures, until = 0, -1
                last = ms
                if ms < until:
                    out.append("refused")
                elif not bad:
                    failures = 0
                    out.append("ok")
                elif failures + 1 >= self.most:
                    failures, until = 0, ms + self.lock_ms
                    out.append("locked")
                else:
                    failures += 1
                    out.append("failed")
            yield pd.DataFrame({"row": [x[1] for x in rows], self.name: [key[0]] * len(rows), "outcome": out})
        if last is None:
            return None
        if _slot(last + self.keep_ms) <= upto:
            self.state.clear()
            return None
        if (failures, until, last) != before:
            self.state.update((failures, until, last))
        return _slot(last + self.keep_ms)


class Sessions(InOrder):
    """A session ends after idle time, and at the cap at the latest; it is given out once the watermark has passed the minute of a row of the key, or of
    the idle time after one, that isn't before its end."""

    def __init__(self, name: str, idle_ms: int, cap_ms: int) -> None:
        self.name, self.idle_ms, self.cap_ms = name, idle_ms, cap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "first long, last long, n long, capped long")

    def advance(self, key: Any, due: Iterator[list[tuple[int, int, bool]]], upto: int) -> Generator[pd.DataFrame, None, int | None]:
        before = now = tuple(self.open.get()) if self.open.exists() else None
        idle, cap = self.idle_ms, self.cap_ms
        first, last, n, capped = now or (0, 0, 0, None)
        done: list[tuple[int, int, int]] = []

        def answer() -> pd.DataFrame:
            a, b, c = (np.array(x, dtype=np.int64) for x in zip(*done, strict=True))
            out = pd.DataFrame({self.name: [key[0]] * len(done), "start_ms": a, "last_ms": b, "n": c})
            done.clear()
            return out

        for rows in due:
            for ms, _, _ in rows:
                if n and ms >= min(last + idle, first + cap):
                    done.append((first, last, n))
                    n = 0
                first, last, n, capped = (ms, ms, 1, None) if n == 0 else (first, ms, n + 1, capped)
                if capped is None and ms + idle + SLOT_MS > first + cap:  # the first minute at which the cap is noticed
                    capped = min((t for t in (_slot(ms), _slot(ms + idle)) if t >= first + cap), default=None)
                elif capped is not None and first + cap <= _slot(ms) < capped:
                    capped = _slot(ms)
            if done:
                yield answer()
        if not n:
            return None
        end = min(last + idle, first + cap)
        wake = capped if capped is not None and end == first + cap else _slot(last) if _slot(last) >= end else _slot(last + idle)
        if wake <= upto:
            done.append((first, last, n))
            yield answer()
            if before is not None:
                self.open.clear()
            return None
        if (first, last, n, capped) != before:
            self.open.update((first, last, n, capped))
        return wake


class Latest(StatefulProcessor):
    """The newest row of each key, given out whenever a newer one comes. A key is forgotten once the watermark is keep_ms past its newest row.

    Keys lie together in buckets, each of which is read and written at once: a call of the state store costs more than some hundred keys.
    """

    def __init__(self, name: str, kinds: tuple[str, str], keep_ms: int) -> None:
        self.name, self.kinds, self.keep_ms = name, kinds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "keys array<{}>, ms array<long>, row array<long>, value array<{}>".format(*self.kinds))

    def _load(self) -> dict[Any, tuple[int, int, Any]]:
        keys, ms, row, value = self.best.get() if self.best.exists() else ((), (), (), ())
        return dict(zip(keys, zip(ms, row, value, strict=True), strict=True))

    def _store(self, best: dict[Any, tuple[int, int, Any]]) -> None:
        if not best:
            self.best.clear()
            return
        ms, row, value = (list(x) for x in zip(*best.values(), strict=True))
        self.best.update((list(best), ms, row, value))
        self.handle.registerTimer(_slot(min(ms) + self.keep_ms))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self._load()
        changed = set()
        for part in rows:
            top = part.sort_values(["ms", "row"], kind="stable")
            top = top.drop_duplicates("key", keep="last")
            values = [None if lost else int(x) if self.kinds[1] in WHOLE else x for x, lost in zip(top["value"].tolist(), top["value"].isna().tolist(), strict=True)]
            names = [None] * len(top) if key[0] < 0 else top["key"].tolist()
            for name, ms, row, value in zip(names, top["ms"].tolist(), top["row"].tolist(), values, strict=True):
                before = best.get(name)
                if before is None or (ms, row) >= before[:2] and (ms, row, value) != before:
                    best[name] = (ms, row, value)
                    changed.add(name)
        if changed:
            self._store(best)
            out = list(changed)
            columns = [pd.Series([best[x][k] for x in out], dtype=kind) for k, kind in ((0, "int64"), (1, "int64"), (2, "object"))]
            yield pd.DataFrame({self.name: pd.Series(out, dtype="object"), "ms": columns[0], "row": columns[1], "value": columns[2]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        best = self._load()
        kept = {k: v for k, v in best.items() if v[0] + self.keep_ms > upto}
        if len(kept) < len(best):
            self._store(kept)
        return iter(())

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, key: str, row: str, ts: str, flag: str | None, lateness: str) -> DataFrame:
    ms = F.unix_millis(ts).alias("ms")
    return stream.withWatermark(ts, lateness).select(key, ts, ms, F.col(row).cast("long").alias("row"), (F.lit(False) if flag is None else F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).alias("flag"))


def lockouts(stream: DataFrame, key: str, row: str, ts: str, failed: str, lateness: str, most: int = 5, lock_s: int = 900, keep_s: int = 7 * 86400) -> DataFrame:
    """(row, key, outcome) of attempts, in the order of time whatever batch they came in; row ids of a key are unique. An attempt is answered once the
    watermark has passed its minute, and a key without attempts for keep_s is forgotten. Start the query inside rocks()."""
    kind = stream.schema[key].dataType.simpleString()
    rows = _timed(stream, key, row, ts, failed, lateness)
    return rows.groupBy(key).transformWithStateInPandas(Lockouts(key, most, lock_s * 1000, keep_s * 1000), f"row long, `{key}` {kind}, outcome string", "append", "eventTime")


def sessions(stream: DataFrame, key: str, row: str, ts: str, lateness: str, idle_s: int = 900, cap_s: int = 8 * 3600) -> DataFrame:
    """(key, start_ms, last_ms, n) of sessions that ended by idle time or by the cap, rows in the order of time whatever batch they came in. Start the query inside rocks()."""
    kind = stream.schema[key].dataType.simpleString()
    rows = _timed(stream, key, row, ts, None, lateness)
    return rows.groupBy(key).transformWithStateInPandas(Sessions(key, idle_s * 1000, cap_s * 1000), f"`{key}` {kind}, start_ms long, last_ms long, n long", "append", "eventTime")


def latest(stream: DataFrame, key: str, row: str, ts: str, value: str, lateness: str, keep_s: int) -> DataFrame:
    """(key, ms, row, value): the newest row of each key by time and row, again whenever it changes. Rows behind the watermark are left out, and a key is forgotten
    when the watermark is keep_s past its newest row. Start the query inside rocks()."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, value)}
    # Null keys have a bucket of their own; whole numbers go as decimals, which pandas keeps beside nulls.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")
    sent = F.col(value).cast("decimal(20,0)") if kinds[value] in WHOLE else F.col(value)
    rows = stream.withWatermark(ts, lateness).select(bucket.alias("bucket"), F.col(key).alias("key"), ts, F.unix_millis(ts).alias("ms"), F.col(row).cast("long").alias("row"), sent.alias("value"))
    out = f"`{key}` {kinds[key]}, ms long, row long, value {kinds[value]}"
    return rows.groupBy("bucket").transformWithStateInPandas(Latest(key, (kinds[key], kinds[value]), keep_s * 1000), out, "update", "eventTime")
