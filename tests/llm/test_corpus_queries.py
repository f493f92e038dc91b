"""The registered corpus queries against their SQL, and the pipeline's stages in a row."""

import os

import duckdb
import pytest

from larkspan.llm import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, spark, sf_dir, duck):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda frame: sorted(map(str, frame[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, counts = source, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == source.columns
    assert source.count() >= counts[0] >= counts[1] >= counts[2] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", 0), (2, "", None, None, 0)]])
def test_pipeline_of_nothing_and_of_nulls(spark, rows):
    """Texts without a letter leave at the first stage; the later ones take an empty table."""
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""))
        assert docs.count() == 0 and (name == "packing" or docs.columns == columns)
