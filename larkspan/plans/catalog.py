"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.plans import curation, derived, operations, ranking, reports, streams, texts, writes

#: (query, SQL or None) by name; names begin with the operators' handles.
_ALL = {**ranking.QUERIES, **operations.QUERIES, **texts.QUERIES, **streams.QUERIES, **derived.QUERIES, **curation.QUERIES, **writes.QUERIES, **reports.QUERIES}


def entry(spark: SparkSession) -> DataFrame:
    return ranking.personalised_feed(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
