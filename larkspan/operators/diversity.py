"""Re-ranking for diversity over whole tables: queues by category, a page of picks at a time."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.storage import new_path, numbered, written

#: Rows that a page's task holds, of all categories together.
HELD_ROWS = 2_000_000
_PICKS = pa.schema([("event_id", pa.int64()), ("category", pa.string()), ("final_score", pa.float64()), ("diverse_score", pa.float64()), ("place", pa.int64())])
_PICKS_DDL = "event_id long, category string, final_score double, diverse_score double, place long"


def factor(last: list, category: str | None, memory: int) -> float:
    """What a category's score is multiplied by: the older of the remembered categories loses more, a new one nothing."""
    return 1 - (len(last) - last.index(category)) / (memory + 1) if category in last else 1.0


def greedy(queues: dict, last: list, memory: int, most: int, going_on: frozenset = frozenset()) -> list[tuple]:
    """Up to `most` picks (category, place in its queue, diverse score) from queues (scores, ids) in order.

    Each pick takes the greatest score after marking the last categories down; of equals, the one that is first by
    score and id. Within a queue order never changes, so only heads compete, and of the categories that aren't
    remembered only the best one: a pick looks at memory + 1 heads, whatever the numbers of rows and of categories.
    Of the queues `going_on` only a first part is given; the picks stop where one of these parts is used up.
    """
    key = lambda c, i: (-queues[c][0][i], queues[c][1][i] is not None, queues[c][1][i] or 0)
    head = {c: 0 for c, (scores, _) in queues.items() if scores}
    others = [(*key(c, 0), c) for c in head if c not in last]  # heads of categories that aren't remembered
    heapq.heapify(others)
    out, last = [], list(last)
    while head and len(out) < most:
        known = {c: factor(last, c, memory) for c in last if c in head}
        marked = [(-queues[c][0][head[c]] * f, *key(c, head[c]), c) for c, f in known.items()]
        if others:
            marked.append((others[0][0], *others[0]))
        best = min(marked)
        category = best[-1]
        if category not in known:
            heapq.heappop(others)
        out.append((category, head[category], -best[0]))
        head[category] += 1
        if head[category] == len(queues[category][0]):
            if category in going_on:
                break
            del head[category]
        was, last = last, [*last, category][-memory:] if memory else []
        for c in {*was, category} - set(last):
            if c in head:
                heapq.heappush(others, (*key(c, head[c]), c))
    return out


def _page(names: list, last: list, memory: int, most: int, start: int, going_on: frozenset):
    """The function of a page's rows, (queue, place, event_id, score); it knows the categories' names and the last picks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        queue, scores, ids = table.column("queue").to_numpy(), table.column("final_score"), table.column("event_id")
        edges = np.flatnonzero(np.diff(queue, prepend=-1, append=-1)) if len(queue) else np.zeros(0, int)
        queues = {int(queue[a]): (scores.slice(a, b - a).to_pylist(), ids.slice(a, b - a).to_pylist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        rows = [(queues[c][1][i], names[c], queues[c][0][i], marked, start + n) for n, (c, i, marked) in enumerate(greedy(queues, last, memory, most, going_on))]
        return pa.Table.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _PICKS.types, strict=True)], schema=_PICKS) if rows else _PICKS.empty_table()

    return run


def diversified(ranked: DataFrame, memory: int = 2, top: int | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """All rows of (event_id, category, final_score) in the order of a greedy choice, or the first `top` of it.

    Each pick remembers the last `memory` categories: at place i of n remembered ones a category's scores are multiplied
    by 1 - (n - i) / (memory + 1). A pick depends on the last categories and on how much of each queue is gone, and on
    nothing else. So the rows are sorted into a queue for each category, in a table that is read by ranges, and picked
    page by page: a page's task holds the next rows of each queue, `held_rows` at most over all categories, picks until
    it has used up what it holds of one that goes on, and hands the places it reached to the next page. Nothing is cut,
    and no task grows with the table; the number of pages does, as each choice waits for the one before it.

    Null is a category. A null score counts as 0, ties go by event_id. Of repeated rows each is picked. An empty table
    gives no rows. place counts from 1.
    """
    spark = ranked.sparkSession
    rows = ranked.select("event_id", "category", F.coalesce("final_score", F.lit(0.0)).cast("double").alias("final_score"))
    placed = numbered(rows, [F.col("category").asc_nulls_first(), F.desc("final_score"), F.col("event_id").asc_nulls_first()], "place")
    spans = placed.groupBy("category").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()  # a row for each category
    if not spans:
        return spark.createDataFrame([], _PICKS_DDL)
    names = [s["category"] for s in spans]
    begins, ends = [s["first"] for s in spans], [s["first"] + s["n"] for s in spans]
    starts = F.array(*[F.lit(b) for b in begins])
    queues = written(placed.withColumn("queue", F.size(F.filter(starts, lambda b: b <= F.col("place"))) - 1).drop("category"), "queues")
    path, total = new_path(spark, "picks"), sum(s["n"] for s in spans) if top is None else min(top, sum(s["n"] for s in spans))
    size, done, last = max(1, held_rows // len(names)), 0, []
    while done < total:
        held = min(size, total - done)
        wanted = [f"(place >= {b} AND place < {min(b + held, e)})" for b, e in zip(begins, ends, strict=True) if b < e]
        going_on = frozenset(q for q, (b, e) in enumerate(zip(begins, ends, strict=True)) if b + held < e)
        page = queues.filter(" OR ".join(wanted)).groupBy().applyInArrow(_page(names, last, memory, total - done, done + 1, going_on), _PICKS_DDL)
        page.write.parquet(f"{path}/page={done}")
        picks = spark.read.schema(_PICKS_DDL).parquet(f"{path}/page={done}")
        taken = {r["category"]: r["count"] for r in picks.groupBy("category").count().collect()}
        begins = [b + taken.get(c, 0) for b, c in zip(begins, names, strict=True)]
        done += sum(taken.values())
        remembered = picked(spark, path).filter((F.col("place") > done - memory) & (F.col("place") <= done)).orderBy("place").collect()
        last = [names.index(r["category"]) for r in remembered]
    return picked(spark, path)


def picked(spark: SparkSession, path: str) -> DataFrame:
    """The picks of all pages so far."""
    return spark.read.schema(_PICKS_DDL).parquet(path).select(*_PICKS.names)
