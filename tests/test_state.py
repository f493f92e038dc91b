"""Machines in blocks and on keyed state, pushes over restarts, and caches that expire in the stream's time."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import changes
from larkspan.streaming import machines, state

QUEUE = "item_id long, source_id long, ats long, stage string, failed boolean, value double"


def rows_of(rng, n, sources):
    """A third of all rows belong to one source, some to none; long runs of failures, ties in time."""
    out = []
    for i in range(n):
        source = 1 if i % 3 == 0 else None if i % 17 == 0 else rng.choice(sources)
        out.append((i, source, rng.randrange(n * 900), rng.choice(["indexed", "failed"]), rng.random() < (0.9 if i < n // 2 else 0.4), rng.choice([10.0, 90.0])))
    return out


@pytest.mark.parametrize("name", sorted(machines.MACHINES))
def test_blocks_give_what_one_pass_gives(spark, name):
    rows = rows_of(random.Random(3), 900, [2, 3, 4, 5])
    machine, want = machines.MACHINES[name], []
    held = {}
    frame = spark.createDataFrame(rows, QUEUE)
    for row in sorted(frame.collect(), key=lambda r: (r.ats, r.item_id)):
        held[row.source_id], out = machine.step(held.get(row.source_id, machine.start), row)
        want.append((row.item_id, row.source_id, *out))
    for blocks in (1, 7, 40):
        got = [tuple(r) for r in machines.replay(frame.repartition(5), name, blocks=blocks).collect()]
        assert sorted(got) == sorted(want)
    assert machines.replay(spark.createDataFrame([], QUEUE), name).count() == 0


def test_blocks_of_one_source_hand_on_a_state_that_is_never_forgotten(spark):
    """Failures without end: each block depends on all before it."""
    frame = spark.range(400).select(F.col("id").alias("item_id"), F.lit(1).cast("long").alias("source_id"), (F.col("id") * 10).alias("ats"), F.lit("failed").alias("stage"), F.lit(True).alias("failed"), F.lit(0.0).alias("value"))
    got = {r.item_id: r.failures for r in machines.replay(frame, "breaker", blocks=9).collect()}
    assert got == {i: i + 1 for i in range(400)}


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, sink, checkpoint, mode="append"):
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def put(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


CHANGES = "item_id long, change_id long, ats long, status string"


def test_pushes_once_over_batches_and_restarts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    first = [(1, 1, 10, "awaiting_enrichment"), (1, 2, 11, "awaiting_enrichment"), (2, 3, 10, "done"), (3, 4, 9, "awaiting_enrichment"), (3, 5, 12, "done")]
    put(spark, first, CHANGES, source, "a=1")
    stream = lambda: state.entered(feed(spark, source / "*", CHANGES))
    run(stream(), state.push_to(out), tmp_path / "check")
    second = [(1, 2, 11, "awaiting_enrichment"), (1, 6, 20, "awaiting_enrichment"), (2, 7, 20, "awaiting_enrichment"), (3, 8, 11, "awaiting_enrichment"), (3, 9, 21, "awaiting_enrichment"), (4, 10, 1, None), (4, 11, 2, "awaiting_enrichment")]
    put(spark, second, CHANGES, source, "a=2")
    run(stream(), state.push_to(out), tmp_path / "check")
    pushed = lambda: sorted((r.item_id, r.change_id) for r in spark.read.parquet(out).collect())
    assert pushed() == [(1, 1), (2, 7), (3, 4), (3, 9), (4, 11)]
    # A batch that is delivered again takes the place of its first delivery.
    state.push_to(out)(spark.read.parquet(f"{out}/batch=1"), 2)
    state.push_to(out)(spark.read.parquet(f"{out}/batch=1"), 2)
    assert len(pushed()) == 5 + spark.read.parquet(f"{out}/batch=1").count()


def test_table_and_stream_push_alike(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(6), i, rng.randrange(500), rng.choice(["awaiting_enrichment", "done", "failed", None])) for i in range(300)]
    put(spark, rows, CHANGES, tmp_path / "in", "a=1")
    run(state.entered(feed(spark, tmp_path / "in" / "*", CHANGES)), state.push_to(str(tmp_path / "out")), tmp_path / "check")
    table = state.entered(spark.createDataFrame(rows, CHANGES))
    got = sorted(r.change_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.change_id for r in table.collect()) and len(got) > 40
    body = table.filter("item_id = 3").select(state.push_body(table, ["item_id", "status"]).alias("b")).first().b
    assert body == '{"type":"INSERT","table":"raw_event_staging","schema":"public","record":{"item_id":3,"status":"awaiting_enrichment"},"old_record":null}'


def test_breakers_cool_down_without_a_row(spark, tmp_path):
    """A timer in the stream's time makes an open breaker half open; what follows is as in a replay."""
    schema = QUEUE + ", at timestamp"
    row = lambda i, source, ats, failed: (i, source, ats, "x", failed, 0.0)
    parts = [[row(i, 1, 100 + i, True) for i in range(5)], [row(10, 2, 5000, False)], [row(11, 1, 5001, True), row(12, 2, 9000, False)]]
    for n, part in enumerate(parts):
        frame = spark.createDataFrame(part, QUEUE).withColumn("at", F.timestamp_seconds("ats"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"a={n}"))
        run(state.stream_machine(feed(spark, tmp_path / "in" / "*", schema), machines.MACHINES["breaker"], at="at"), state.push_to(str(tmp_path / "out")), tmp_path / "check")
    got = [(r.item_id, r.source_id, r.breaker, r.failures, r.opens) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (None, 1, "HALF_OPEN", 5, 1) in got and (11, 1, "OPEN", 6, 2) in got
    replayed = {tuple(r) for r in machines.replay(spark.createDataFrame([r for p in parts for r in p], QUEUE), "breaker").collect()}
    assert {g for g in got if g[0] is not None} == replayed


ACTIONS = "key long, ats long, kind string, at timestamp"


def test_caches_count_late_and_repeated_hits_and_expire(spark, tmp_path):
    day = 86400
    parts = [
        [(1, 10 * day, "put"), (1, 12 * day, "hit"), (2, 11 * day, "hit"), (3, 9 * day, "put"), (1, 9 * day, "hit")],
        [(1, 12 * day, "hit"), (1, 11 * day, "hit"), (2, 13 * day, "put"), (1, 14 * day, "put"), (3, 12 * day - 1, "hit")],
        [(2, 14 * day, "hit"), (1, 13 * day, "hit"), (9, 40 * day, "put")],
        [(2, 15 * day, "hit"), (1, 41 * day, "put"), (9, 41 * day, "hit")],
    ]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, "key long, ats long, kind string").withColumn("at", F.timestamp_seconds("ats")).coalesce(1).write.parquet(str(tmp_path / "in" / f"a={n}"))
        run(state.cached(feed(spark, tmp_path / "in" / "*", ACTIONS), days=3, late="2 days"), state.push_to(str(tmp_path / "out")), tmp_path / "check", "update")
    shown = spark.read.parquet(str(tmp_path / "out")).collect()
    ended = {(r.key, r.created_at // day): (r.hit_count, r.last_hit_at) for r in shown if not r.alive}
    assert ended == {(1, 10): (4, 12 * day), (3, 9): (2, 12 * day - 1), (2, 13): (2, 14 * day)}
    assert {r.key for r in shown if r.alive and r.created_at >= 40 * day} == {1, 9}
    # The same entries and look-ups as one table: what counts while an entry lives is the same.
    cache = spark.createDataFrame([(1, 10 * day, 1, None), (3, 9 * day, 1, None), (2, 13 * day, 1, None)], "key long, created_at long, hit_count long, last_hit_at long")
    hits = spark.createDataFrame([(k, t) for p in parts[:3] for k, t, kind in p if kind == "hit"], "key long, ats long")
    table = {r.key: (r.hit_count, r.last_hit_at) for r in changes.cache_after(cache, hits, 0, days=3).collect()}
    assert table == {1: (4, 12 * day), 3: (2, 12 * day - 1), 2: (2, 14 * day)}
