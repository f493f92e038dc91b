"""Keyed state of streams on transformWithState: machines with timers and time to live, pushes on change, caches that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspan.streaming.machines import Machine, run_machine

#: The store that keyed state with timers and time to live needs; a session sets it before its streams start.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ready(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class MachineProcessor(StatefulProcessor):
    """A machine's state by key. A state that becomes due gets a timer; at its end the machine moves on without a row."""

    def __init__(self, machine: Machine, key: str, ttl_ms: int | None, timed: bool):
        self.machine, self.key, self.ttl_ms, self.timed = machine, key, ttl_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.machine.state, self.ttl_ms)

    def _keep(self, state: tuple) -> None:
        self.state.update(state)
        if self.timed:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            due = self.machine.due(state)
            if due is not None:
                self.handle.registerTimer(int(due) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.machine.start
        out, state = run_machine(self.machine, _sorted(rows, ["ats", "item_id"]), state, ["item_id", self.key])
        self._keep(state)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state, shown = self.machine.expire(tuple(self.state.get()))
        self._keep(state)
        yield pd.DataFrame([(None, key[0], *shown)], columns=["item_id", self.key, *self.machine.output_names()]).astype({"item_id": "Int64"})

    def close(self) -> None:
        pass


def stream_machine(queue: DataFrame, machine: Machine, key: str = "source_id", ttl_ms: int | None = None, at: str | None = None, late: str = "0 seconds") -> DataFrame:
    """item_id, key and the machine's output for each row of a stream; keys that are idle for ttl_ms are forgotten.

    Within a batch rows are taken in order of time. With `at`, a column of time, machines that become due move on by
    themselves once the stream's time, less `late`, has passed: such a row has no item_id. A key's rows are one task's
    work in a batch and no key waits for another batch's; the state is a few values, whatever the history.
    """
    ready(queue.sparkSession)
    out = f"item_id long, {key} long, {machine.output}"
    rows = queue.withWatermark(at, late) if at else queue
    return rows.groupBy(key).transformWithStateInPandas(MachineProcessor(machine, key, ttl_ms, bool(at)), out, "append", "EventTime" if at else "None")


class PushProcessor(StatefulProcessor):
    """The last status of each row of a change feed; a row passes when it enters the status."""

    def __init__(self, status: str, names: list[str]):
        self.status, self.names = status, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, ats long, change_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else (None, None, None)
        changes, entered = _sorted(rows, ["ats", "change_id"]), []
        for status, ats, change in zip(changes["status"], changes["ats"], changes["change_id"], strict=True):
            later = last[1] is None or (ats, change) > (last[1], last[2])
            entered.append(later and status == self.status and last[0] != self.status)
            if later:  # a change that is seen again, or one older than what is known, changes nothing
                last = (status, int(ats), int(change))
        self.last.update(last)
        yield changes[pd.Series(entered, index=changes.index, dtype=bool)][self.names]

    def close(self) -> None:
        pass


def push_body(rows: DataFrame, columns: list[str]) -> Column:
    """The record that is pushed, as the receiver expects it."""
    parts = [F.lit("INSERT").alias("type"), F.lit("raw_event_staging").alias("table"), F.lit("public").alias("schema")]
    return F.to_json(F.struct(*parts, F.struct(*[rows[c] for c in columns]).alias("record"), F.lit(None).cast("string").alias("old_record")), {"ignoreNullFields": "false"})


def entered(changes: DataFrame, status: str = "awaiting_enrichment") -> DataFrame:
    """The rows (item_id, change_id, ats, status, ...) of a change feed at which an item enters the status: a table or a stream.

    An item that stays in the status passes once; one that leaves it and comes back passes again. On a stream the last
    status is state, so this holds over batches and restarts; changes delivered twice, and such that arrive after a
    younger one of their item, don't count.
    """
    if changes.isStreaming:
        ready(changes.sparkSession)
        return changes.groupBy("item_id").transformWithStateInPandas(PushProcessor(status, changes.columns), changes.schema, "append", "None")
    before = F.lag("status").over(Window.partitionBy("item_id").orderBy("ats", "change_id"))
    return changes.withColumn("_before", before).filter((F.col("status") == status) & ~F.col("_before").eqNullSafe(F.lit(status))).drop("_before")


def push_to(path: str):
    """A sink for foreachBatch: each batch is one folder that is written anew when the batch is run again, so nothing is pushed twice."""

    def push(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return push


class CacheProcessor(StatefulProcessor):
    """An entry of a cache by key: made, found, and gone when its time is over. Its rows travel in batches of many keys."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created_at long, hit_count long, last_hit_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.entry.get()
        entry, found, made = tuple(known) if known is not None else None, [], None
        for row in rows:
            if row.ats is None:
                continue
            if row.kind == "hit":
                found.append(row.ats)
            elif row.kind == "put":
                made = row.ats if made is None else min(made, row.ats)
        if entry is None:
            if made is None:
                return
            entry = (made, 1, None)
            self.handle.registerTimer((made + self.seconds) * 1000)
        found = [at for at in found if entry[0] <= at < entry[0] + self.seconds]
        if found:
            entry = (entry[0], entry[1] + len(found), max(found) if entry[2] is None else max(entry[2], *found))
        self.entry.update(entry)
        yield self._row(key, entry, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = tuple(self.entry.get())
        self.entry.clear()
        yield self._row(key, entry, False)

    def _row(self, key, entry: tuple, alive: bool) -> Row:
        return Row(key=key[0], created_at=entry[0], hit_count=entry[1], last_hit_at=entry[2], expires_at=entry[0] + self.seconds, alive=alive)

    def close(self) -> None:
        pass


def cached(actions: DataFrame, days: int = 180, late: str = "0 seconds") -> DataFrame:
    """A cache as a stream's state: actions (key, ats, kind put or hit, at timestamp) give each key's entry as it changes.

    The first put makes the entry, a hit within its life counts and is remembered, also one that comes in late as long
    as the entry is there. When the stream's time, less `late`, passes the end of its life the entry is shown once more,
    not alive, and its state goes; a later put makes a new one.
    """
    ready(actions.sparkSession)
    out = "key long, created_at long, hit_count long, last_hit_at long, expires_at long, alive boolean"
    return actions.withWatermark("at", late).groupBy("key").transformWithState(CacheProcessor(days * 86400), out, "update", "EventTime")
