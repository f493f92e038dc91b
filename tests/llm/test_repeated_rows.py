"""A third of all rows, or more, equal in text and id: none of them meet whole in one task."""

import pytest
from pyspark.sql import functions as F

from larkspan.llm import exact_dedup, jaccard_join, sequences, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    others = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of its own "), F.col("id").cast("string")).alias("text"))
    same = spark.range(30_000, numPartitions=12).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    return others.unionByName(same).withColumns({"lang": F.lit("en"), "source": F.lit("a")})


@pytest.mark.parametrize("remove", [lambda d: substring_dedup.remove_repeats(d, 35), lambda d: suffix_dedup.remove_repeats(d, 400)])
def test_rows_come_back_spread(spark, docs, remove):
    got = remove(docs)
    assert got.count() == 30_060 and got.filter("doc_id IS NULL").count() == 30_000


def test_portions_are_dealt_out(spark):
    results = spark.createDataFrame([(b"a", 1), (b"b", 2), (b"c", 3)], "uid binary, v int").coalesce(1)
    repeated = spark.createDataFrame([(b"a", 200_001), (b"b", 2)], "uid binary, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequences.again(results, repeated, portion=1000)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_004 and len(sizes) >= 4 and max(sizes) < 100_000
    assert {r.v: r["count"] for r in got.groupBy("v").count().collect()} == {1: 200_001, 2: 2, 3: 1}
    assert {r.v: r["count"] for r in sequences.again(results, repeated).groupBy("v").count().collect()} == {1: 200_001, 2: 2, 3: 1}


@pytest.mark.parametrize("keep", [exact_dedup.deduplicate, jaccard_join.one_of_each])
def test_one_row_is_passed_on_by_each_task(spark, docs, keep):
    kept = keep(docs)
    assert kept.filter("doc_id IS NULL").count() == 1 and kept.columns == docs.columns
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
