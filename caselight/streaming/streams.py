"""Structured Streaming forms of the case operators, and a sink that keeps the newest row of each key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from caselight.operators.store import folder


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet file or folder at path, new files as they come."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may name a single file


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all that is there now, into Parquet, and reads the result."""
    spark, path = stream.sparkSession, f"{folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def newest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an update stream over all that is there now. Batches are written side by side under their number, so that one written again after a failure replaces itself; the newest row of each key counts."""
    spark, path = stream.sparkSession, f"{folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema, columns = StructType([*stream.schema.fields, StructField("batch", LongType())]), [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/part={number}")

    run = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{path}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(*keys, "r.*")


def decided(stream: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each case decided as it comes; no state."""
    return decide(stream)


def window_rates(stream: DataFrame, ts: str, lateness: str, width: str, step: str | None = None, start: str | None = None) -> DataFrame:
    """(start, n, refer_rate, manual_rate, ungradable_rate) by window of event time."""
    share = lambda c: F.avg(c.cast("double"))
    span = F.window(ts, width, step, start)
    rows = stream.withWatermark(ts, lateness).groupBy(span.alias("w")).agg(
        F.count("*").alias("n"), share(F.col("decision") == "REFER").alias("refer_rate"), share(F.col("decision") == "MANUAL_REVIEW").alias("manual_rate"), share(F.col("gradable") == 0).alias("ungradable_rate")
    )
    return rows.select(F.col("w.start").alias("start"), "n", "refer_rate", "manual_rate", "ungradable_rate")


def weekly_rates(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Weeks start on Mondays; the epoch was a Thursday."""
    return window_rates(stream, ts, lateness, "7 days", None, "4 days")


def latest(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    return stream.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, "v.*")


def sessions(stream: DataFrame, key: str, ts: str, idle: str, lateness: str) -> DataFrame:
    """(key, start, end, n): a session ends after idle time; it appears once no late row can reach it."""
    rows = stream.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, idle).alias("s")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def _forget(state: GroupState, last: float, keep_s: int | None) -> None:
    """A key's state goes when the watermark is keep_s past its last event."""
    if keep_s is not None:
        state.setTimeoutTimestamp(max(int((last + keep_s) * 1000), state.getCurrentWatermarkMs() + 1))


def _times(parts: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """A key's rows in the order of time, as plain arrays: some bytes a row, whatever else the parts hold."""
    found = [np.concatenate(x) for x in zip(*([p[c].to_numpy() for c in columns] for p in parts), strict=True)]
    order = np.lexsort(tuple(reversed(found)))
    return [x[order] for x in found]


def _watched(stream: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return stream if lateness is None else stream.withWatermark(ts, lateness)


def capped_sessions(stream: DataFrame, key: str, ts: str, idle_s: int, cap_s: int, lateness: str | None = None, keep_s: int | None = None) -> DataFrame:
    """(key, at, session): each event with the number of its session, which ends after idle time and after the cap at the latest.

    With a lateness and keep_s, keys without events for so long are forgotten; without them, state stays for every key ever seen.
    """

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, number = state.get if state.exists else (-1.0, -1.0, 0)
        (times,) = _times(parts, "at")
        out = []
        for at in times.tolist():
            if number == 0 or at - last >= idle_s or at - first >= cap_s:
                first, number = at, number + 1
            last = at
            out.append(number)
        state.update((first, last, number))
        _forget(state, last, keep_s)
        yield pd.DataFrame({key: k[0], "at": times, "session": out})

    kind = stream.schema[key].dataType.simpleString()
    timed = _watched(stream, ts, lateness).select(key, ts, F.col(ts).cast("double").alias("at"))
    timeout = GroupStateTimeout.NoTimeout if keep_s is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, session int", "first double, last double, number int", "append", timeout)


def lockouts(stream: DataFrame, key: str, row: str, ts: str, failed: str, most: int = 5, lock_s: int = 900, lateness: str | None = None, keep_s: int | None = None) -> DataFrame:
    """(row, key, outcome) of attempts: `most` failures lock for a time and reset the counter, a success resets it, attempts while locked are refused and not counted.

    With a lateness and keep_s, keys without attempts for so long are forgotten, and their failures with them.
    """

    def step(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, until = state.get if state.exists else (0, -1.0)
        times, rows, wrong = _times(parts, "at", "row", "bad")
        out = []
        for at, bad in zip(times.tolist(), wrong.tolist(), strict=True):
            if at < until:
                out.append("refused")
            elif not bad:
                failures = 0
                out.append("ok")
            else:
                failures += 1
                out.append("failed")
                if failures >= most:
                    failures, until = 0, at + lock_s
                    out[-1] = "locked"
        state.update((failures, until))
        _forget(state, float(times[-1]), keep_s)
        yield pd.DataFrame({"row": rows, key: k[0], "outcome": out})

    kind = stream.schema[key].dataType.simpleString()
    timed = _watched(stream, ts, lateness).select(F.col(row).cast("long").alias("row"), key, ts, F.col(ts).cast("double").alias("at"), F.col(failed).cast("boolean").alias("bad"))
    timeout = GroupStateTimeout.NoTimeout if keep_s is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy(key).applyInPandasWithState(step, f"row long, {key} {kind}, outcome string", "failures int, until double", "append", timeout)
