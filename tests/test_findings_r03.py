"""Cases of round 3: each failed before its query was mended."""

import os
import shutil

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from larkspan.llm import common, packing, registry, suffix_dedup
from larkspan.operators import diversity, rituals, vector_index
from larkspan.plans import catalog, views
from larkspan.streaming import state
from tests.test_queries import rows


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = catalog.queries()[name](spark, str(folder))
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert rows(got.toPandas()) == rows(want)
    return got


@pytest.fixture
def tables(tmp_path, sf_dir):
    """The smallest tables, in a folder where a test may replace some."""
    for f in os.listdir(sf_dir):
        shutil.copy(f"{sf_dir}/{f}", tmp_path / f)
        (tmp_path / f).chmod(0o644)
    return tmp_path


def replace(tables, name, sql):
    duckdb.connect().execute(f"COPY ({sql}) TO '{tables}/{name}.new' (FORMAT parquet)")
    os.replace(f"{tables}/{name}.new", f"{tables}/{name}.parquet")


def test_cache_gives_one_entry_a_key_before_the_join(spark, tables, sf_dir):
    replace(tables, "supplier", f"SELECT * REPLACE (s_suppkey + i * 1000 AS s_suppkey) FROM '{sf_dir}/supplier.parquet', range(200) r(i)")
    plan = same_as_sql(spark, tables, "j18_geocode_variants")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]


def test_words_end_at_letters_with_marks_as_in_sql(spark, tables, sf_dir):
    texts = ["n lesérééo dans", "de les é", "runé", "zo'n filmé show", "fairé", "een reply", "een reply\n", "é talké", None, ""]
    values = ", ".join(f"({i}, {'NULL' if t is None else repr(t) if chr(39) not in t else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)})" for i, t in enumerate(texts)).replace("\\n'", "' || chr(10)")
    replace(tables, "documents", f"SELECT i::BIGINT AS doc_id, t::VARCHAR AS text, 'nl' AS lang, 'web' AS source, 1::BIGINT AS n_chars FROM (VALUES {values}) v(i, t)")
    same_as_sql(spark, tables, "c1_categories")


@pytest.mark.parametrize("name", ["wt1_rate_windows", "wt7_source_failures", "wt8_circuit_breaker", "wt11_fetcher_escalation", "wt12_source_health"])
def test_replays_hold_a_batch_not_a_block(spark, tables, sf_dir, name):
    """One source has two thirds of the rows, so its state goes on over blocks and over batches of 37 rows."""
    replace(tables, "events", f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN user_id ELSE 1 END AS user_id) FROM '{sf_dir}/events.parquet'")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        plan = same_as_sql(spark, tables, name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan


def test_ritual_series_are_sized_by_combination(spark, tables, sf_dir):
    """Five copies of a venue's events: none is sorted by its series, and sizes are those of a plain count."""
    replace(tables, "orders", f"SELECT * REPLACE (o_orderkey + i * 840000 AS o_orderkey) FROM '{sf_dir}/orders.parquet', range(5) r(i)")
    got = catalog.queries()["k11_ritual_events"](spark, str(tables))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    events = views.events(spark, str(tables)).withColumn("description", F.lit(""))
    rest = events.filter(~rituals.has_keyword(F.col("title"), F.col("description")))
    sizes = rituals.series(rest).join(rest, "event_id").toPandas()
    sizes["n"] = sizes.groupby("series")["event_id"].transform("size")
    want = {(r.event_id, r.n) for r in sizes.itertuples() if r.n >= 3 and r.event_date.timestamp() >= views.NOW}
    assert {(r.event_id, r.occurrences) for r in got.filter("reason = 'series'").collect()} == want and want


def test_cache_asks_its_state_once_a_key():
    """A key costs one look at the state, and a row, not a frame of its own; rows without a time count for nothing."""

    class Store:
        asked, value, timers = 0, None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.append(at)

    store, cache = Store(), state.CacheProcessor(100)
    cache.init(store)
    rows = [Row(ats=None, kind="put"), Row(ats=50, kind="hit"), Row(ats=20, kind="put"), Row(ats=10, kind="put"), Row(ats=110, kind="hit"), Row(ats=5, kind="hit")]
    assert [tuple(r) for r in cache.handleInputRows((7,), iter(rows), None)] == [(7, 10, 2, 50, 110, True)]
    assert [tuple(r) for r in cache.handleInputRows((7,), iter([Row(ats=40, kind="hit")]), None)] == [(7, 10, 3, 50, 110, True)]
    assert store.asked == 2 and store.timers == [110_000]


def test_a_page_picks_until_a_queue_that_goes_on_is_used_up():
    queues = {0: ([0.9, 0.8], [1, 2]), 1: ([0.7, 0.6], [3, 4]), 2: ([0.1], [5])}
    whole = diversity.greedy(queues, [], 2, 5)
    assert diversity.greedy(queues, [], 2, 5, frozenset({1})) == whole[: [c for c, _, _ in whole].index(1, [c for c, _, _ in whole].index(1) + 1) + 1]
    assert len(whole) == 5


def test_a_long_text_is_not_copied_for_each_of_its_pieces():
    """The pipeline's packing: pieces' rows hold no texts, whose copies would grow with the square of a text's length."""
    text = "river stone 17 " * 60_000
    names = ["doc_id", "group", "start", "length", "ids_crc32", "doc_tokens"]
    run = packing._pieces(None, 2048, 1, False, pa.schema([(c, pa.int64()) for c in names]))
    batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([0]), pa.array([text])], names=["doc_id", "group", "text"])
    before = pa.total_allocated_bytes()
    (out,) = run(iter([batch]))
    assert len(out) > 80 and sum(out.column(3).to_pylist()) == out.column(5)[0].as_py()
    (size,) = [pa.total_allocated_bytes() - before for _ in run(iter([batch]))]
    assert size < 4 * len(text)


def test_a_query_goes_once_to_a_bin_of_many_cells(spark, tmp_path, monkeypatch):
    """v1_index_recall: sent and found rows grew with queries times cells."""
    vectors = [(i, [float(i % 7) + 1, float(i % 11), float(i % 13), 1.0]) for i in range(400)]
    index = vector_index.build(spark.createDataFrame(vectors, "event_id long, embedding array<float>"), str(tmp_path / "i"), cells=40)
    assert index.cells.count() > 20

    def met(queries, held):
        names = queries.column("query_id").to_pylist() if len(held) else []
        return pa.table({"query_id": pa.array(names, pa.int64()), "event_id": pa.array(names, pa.int64()), "similarity": pa.array([0.0] * len(names)), "cell": pa.array([0] * len(names), pa.int32())})

    monkeypatch.setattr(vector_index, "_best_of", lambda limit: met)
    asked = index.vectors.select(F.col("event_id").alias("query_id"), "embedding").filter("query_id % 20 = 0")
    for probes in (None, 15):
        sent = vector_index.search_many(index, asked, limit=1000, probes=probes).groupBy("query_id").count().collect()
        assert {(r["query_id"], r["count"]) for r in sent} == {(i, 1) for i in range(0, 400, 20)}


def test_texts_pass_packing_in_small_batches(spark, monkeypatch):
    """The pipeline's packing: an executor held up to 10 000 whole texts in one batch, in its JVM and in Python."""
    pieces = packing._pieces

    def watched(*given):
        run = pieces(*given)

        def small(batches):
            for batch in batches:
                assert len(batch) <= 1000 and batch.nbytes <= 8 << 20, (len(batch), batch.nbytes)
                yield from run(iter([batch]))

        return small

    monkeypatch.setattr(packing, "_pieces", watched)
    docs = spark.range(6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('river stone ', if(id < 400, 5000, 2))").alias("text"))
    own = {k: spark.conf.get(k) for k in common.BATCH}
    packed = packing.pack(docs)
    assert own == {k: spark.conf.get(k) for k in common.BATCH}
    assert packed.selectExpr("count(distinct doc_id)", "sum(length)").first() == (6000, 400 * 10_001 + 5600 * 5)


def test_a_ranking_needs_no_python_workers(spark):
    """The pipeline's mixing: offsets made from a list kept a second set of Python workers on the executors."""
    ranks = common.ranked(spark.range(500, numPartitions=5), [F.col("id").desc()])
    assert ranks.filter("rank != 499 - id").count() == 0
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
    assert common.ranked(spark.range(0), [F.col("id")]).count() == 0


def test_passages_go_by_their_bytes_not_by_their_words(spark):
    """op10: of repeated passages over 50 words, those of 400 bytes and more go whole and shorter ones stay, as its contract asks."""
    passage = lambda letter, words, width: " ".join(f"{letter}{i:0{width - 1}d}" for i in range(words))
    short, least, more = passage("a", 57, 6) + "x", passage("b", 57, 6) + "xx", passage("c", 60, 9)
    assert [len(x) for x in (short, least, more)] == [399, 400, 599] and all(len(x.split()) > 50 for x in (short, least, more))
    texts = [(2 * k + i, f"{'<>'[i]}{x}{'()'[i]}{k}") for k, x in enumerate((short, least, more)) for i in (0, 1)] + [(6, "no copy of any " + passage("d", 90, 7))]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), 400).collect()}
    assert got == {0: 0, 1: 0, 2: 400, 3: 400, 4: 599, 5: 599, 6: 0}


def test_periodic_runs_equal_their_sql_with_nulls(spark, sf_dir):
    """op11's rows as values: pandas shows a null of a long as nan or <NA>, as the versions of DuckDB and Spark have it."""
    query = registry.OP11_SQL.replace("FROM documents)", f"FROM '{sf_dir}/documents.parquet')")
    want = duckdb.connect().execute(query)
    columns = [c[0] for c in want.description]
    got = registry.op11_periodic_runs(spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    assert any(None in tuple(r) for r in got)
