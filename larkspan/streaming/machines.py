"""State machines of sources and items: one step function each, run over a stream's keyed state or replayed over a table.

A machine is a step (state, row) -> (state, output) of plain values; Spark partitions by key and holds the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.storage import written


@dataclass(frozen=True)
class Machine:
    """state: DDL and first values; output: DDL of what each row adds; step: the transition."""

    state: str
    start: tuple
    output: str
    step: Callable[[tuple, object], tuple[tuple, tuple]]
    #: What the step reads of a row besides ats.
    reads: tuple[str, ...] = ()
    #: When a state moves on without a row (seconds, or None), and how. Replays take the same step with the next row.
    due: Callable[[tuple], int | None] = lambda state: None
    expire: Callable[[tuple], tuple[tuple, tuple]] | None = None

    def output_names(self) -> list[str]:
        return [part.split()[0] for part in self.output.split(", ")]


def _rate_window(state: tuple, row) -> tuple[tuple, tuple]:
    """A window opens with the first request after the last one ended; its first requests pass, the others wait for its end."""
    start, used = state
    if start is None or row.ats - start > RATE_SECONDS:
        start, used = row.ats, 0
    allowed = used < RATE_MOST
    wait = 0 if allowed else int((start + RATE_SECONDS - row.ats) * 1000)
    return (start, used + 1 if allowed else used), (start, bool(allowed), wait)


def _breaker(state: tuple, row) -> tuple[tuple, tuple]:
    """CLOSED opens after five failures without a success; OPEN is HALF_OPEN once it has cooled down; a success closes.

    Cooling takes 30 minutes, doubled for each opening since the last success, a day at most.
    """
    name, failures, opens, until = state
    if name == "OPEN" and until <= row.ats:
        name = "HALF_OPEN"
    if not row.failed:
        name, failures, opens, until = "CLOSED", 0, 0, 0
    else:
        failures += 1
        if name in ("CLOSED", "HALF_OPEN") and failures >= 5:
            until, name, opens = row.ats + min(1800 * 2**opens, 86400), "OPEN", opens + 1
    return (name, failures, opens, until), (name, failures, opens)


def _cooling(state: tuple) -> int | None:
    return state[3] if state[0] == "OPEN" else None


def _cooled(state: tuple) -> tuple[tuple, tuple]:
    """An open breaker whose time is over lets the next request try."""
    after = ("HALF_OPEN", *state[1:])
    return after, after[:3]


def _escalation(state: tuple, row) -> tuple[tuple, tuple]:
    """Three pages in a row without events move a source to the next fetcher, as long as there is one."""
    level, empty = state
    empty = 0 if row.value >= EMPTY_BELOW else empty + 1
    if empty >= 3 and level < len(FETCHERS) - 1:
        level, empty = level + 1, 0
    return (level, empty), (FETCHERS[level], empty)


def _health(state: tuple, row) -> tuple[tuple, tuple]:
    """Health falls by 20 on failure, rises by 10 for a complete result, else by 2; below 40 disables, 50 after that enables."""
    health, enabled = state
    after = max(0, min(100, health + (-20 if row.failed else 10 if row.stage == "indexed" else 2)))
    enabled = False if after < 40 else True if health < 40 and after >= 50 else enabled
    return (after, enabled), (after, bool(enabled))


def _failures(state: tuple, row) -> tuple[tuple, tuple]:
    """A source is quarantined at its sixth failure in a row and loses 0.05 of its reliability with each, in hundredths."""
    run, quarantined, hundredths = state
    if row.failed:
        quarantined, run, hundredths = quarantined or run >= 5, run + 1, max(0, hundredths - 5)
    else:
        run = 0
    return (run, quarantined, hundredths), (run, bool(quarantined), hundredths)


RATE_SECONDS, RATE_MOST = 86400, 2
FETCHERS = ("static", "puppeteer", "scrapingbee")
EMPTY_BELOW = 60.0

MACHINES = {
    "rate_window": Machine("start long, used long", (None, 0), "window_start long, allowed boolean, wait_ms long", _rate_window),
    "breaker": Machine("name string, failures long, opens long, until long", ("CLOSED", 0, 0, 0), "breaker string, failures long, opens long", _breaker, ("failed",), _cooling, _cooled),
    "escalation": Machine("level long, empty long", (0, 0), "fetcher string, empty_pages long", _escalation, ("value",)),
    "health": Machine("health long, enabled boolean", (70, True), "health long, enabled boolean", _health, ("failed", "stage")),
    "failures": Machine("run long, quarantined boolean, hundredths long", (0, False, 100), "failures_in_a_row long, quarantined boolean, reliability_hundredths long", _failures, ("failed",)),
}


def run_machine(machine: Machine, ordered: pd.DataFrame, state: tuple, keep: list[str]) -> tuple[pd.DataFrame, tuple]:
    out = []
    for row in ordered.itertuples(index=False):
        state, result = machine.step(state, row)
        out.append(result)
    return pd.concat([ordered[keep].reset_index(drop=True), pd.DataFrame(out, columns=machine.output_names())], axis=1), state


def _walk(machine: Machine, begins: dict[int, tuple], batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple], list[tuple]]]:
    """Batches of blocks' rows in order: each with what its rows show, and with the blocks (number, state) that it ends.

    Only a batch and a state are held, whatever a block's length. A block's first key begins in its state of `begins`.
    """
    block = key = state = None
    for rows in batches:
        shown, ended = [], []
        keys = rows["_key"].astype(object).where(rows["_key"].notna(), None)
        for row, number, name in zip(rows.itertuples(index=False), rows["_block"], keys, strict=True):
            if number != block:
                if block is not None:
                    ended.append((block, state))
                block, key, state = int(number), name, begins.get(number, machine.start)
            elif name != key:
                key, state = name, machine.start
            state, result = machine.step(state, row)
            shown.append(result)
        if shown:
            yield rows, shown, ended
    if block is not None:
        yield pd.DataFrame(), [], [(block, state)]


def replay(queue: DataFrame, name: str, key: str = "source_id", block_rows: int = 500_000, blocks: int | None = None) -> DataFrame:
    """item_id, key and the machine's output for each row of a table, in order of time within the key.

    The table is range-partitioned by key and time into blocks of about `block_rows` rows, so a source with a third of
    all rows is spread over many. A block of one key needs the state that the block before it ends in. All blocks run
    from the first state at once; those that turn out to begin in another state run again, until no end changes. Most
    histories forget how they began (a success closes a breaker, an idle hour ends a rate window, health meets its
    bounds), so few blocks run twice; the result is exact in any case. The driver holds one state a block. Last, each
    block gives its rows, from the state in which it begins. A block is a partition that Spark sorts and hands to Python
    in Arrow batches; a worker never holds it whole.
    """
    machine, spark = MACHINES[name], queue.sparkSession
    count = blocks or max(spark.sparkContext.defaultParallelism, -(-queue.count() // block_rows))
    kind = queue.schema[key].dataType.simpleString()
    needed = dict.fromkeys(["item_id", key, "ats", *machine.reads])
    sorted_rows = queue.select(*needed).repartitionByRange(count, key, "ats", "item_id").sortWithinPartitions(key, "ats", "item_id")
    placed = written(sorted_rows.withColumns({"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), "_key": F.col(key).cast("string")}).drop(key), "blocks")
    seen = placed.groupBy("_block").agg(F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"), (F.min(F.coalesce("_key", F.lit(""))) == F.max(F.coalesce("_key", F.lit("")))).alias("one")).orderBy("_block").collect()
    onward = {a["_block"]: b for a, b in zip(seen[:-1], seen[1:], strict=True) if a["last"] == b["first"]}  # blocks whose last key goes on in the next
    last = spark.createDataFrame([(r["_block"], r["last"]) for r in seen if r["_block"] in onward], "_block int, _last string")
    ending = placed.join(F.broadcast(last), "_block").filter(F.col("_key").eqNullSafe(F.col("_last")))
    begins: dict[int, tuple] = {}
    ends: dict[int, tuple] = {}

    def laid(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(count, F.col("_block")).sortWithinPartitions("_block", "_at")

    def final(begins: dict[int, tuple]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, _, ended in _walk(machine, begins, batches):
                yield pd.DataFrame([(block, json.dumps(state)) for block, state in ended], columns=["block", "state"])

        return run

    one = {r["_block"] for r in seen if r["one"]}
    again = list(onward)
    while again:
        rows = laid(ending.filter(F.col("_block").isin(again))).mapInPandas(final({b: s for b, s in begins.items() if b in one}), "block int, state string")
        ends |= {r["block"]: tuple(json.loads(r["state"])) for r in rows.collect()}
        after = {b["_block"]: ends[a] for a, b in onward.items()}
        again = [b for b in onward if b in one and after.get(b, machine.start) != begins.get(b, machine.start)]
        begins = after

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, shown, _ in _walk(machine, begins, batches):
            if shown:
                yield pd.concat([rows[["item_id", "_key"]].reset_index(drop=True), pd.DataFrame(shown, columns=machine.output_names())], axis=1)

    shown = laid(placed).mapInPandas(run, f"item_id long, _key string, {machine.output}")
    return shown.select("item_id", F.col("_key").cast(kind).alias(key), *machine.output_names())
