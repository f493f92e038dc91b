"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import SALTS, SPACE, as_rows, materialise, salt, sifted, unpacked


def normalised(text: Column) -> Column:
    """The text with each run of blanks and controls 9 to 13 as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, a row for each salt in which they occur."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("_salt").alias("_salts")).filter("_n > 1")
    return groups.select(*keys, F.explode("_salts").alias("_salt"))


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, salts: int = SALTS) -> DataFrame:
    """One narrow row a document: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Rows are grouped by length; those whose length repeats by a hash of the first `prefix` characters as well; those
    whose (length, prefix) repeats by the full SHA-256. Only groups that survive take part in the next grouping; the
    digest of the others is reported and never compared. Texts leave the scan as digests, so no text is shuffled.
    Each grouping aggregates before its shuffle; what it finds is joined back by key and salt, so that a group of
    copies with a third of all rows is spread over `salts` keys.

    Null text counts as empty, and empty texts form one group. Of equal texts the row with the smallest id is kept,
    null ids last; of repeated rows that share that id, one. An empty table gives no rows. Other columns are ignored.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
        "_id",
        F.monotonically_increasing_id().alias("_row"),
        F.octet_length("_t").alias("_len"),
        F.xxhash64(F.substring("_t", 1, prefix)).alias("_pre"),
        F.unhex(F.sha2("_t", 256)).alias("_sha"),
    )
    rows = materialise(rows.withColumn("_salt", salt("_row", salts=salts)))

    lengths = _repeated(rows, ["_len"])
    by_length = rows.select("_len", "_pre", "_salt").join(lengths, ["_len", "_salt"], "left_semi")
    prefixes = _repeated(by_length, ["_len", "_pre"])
    survivors = rows.join(prefixes, ["_len", "_pre", "_salt"], "left_semi")
    first = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    groups = (
        survivors.groupBy("_len", "_pre", "_sha")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"), F.collect_set("_salt").alias("_salts"))
        .filter("_n > 1")
        .select("_len", "_pre", "_sha", "_n", F.col("_first.id").alias("_keep"), F.col("_first.row").alias("_keep_row"), F.explode("_salts").alias("_salt"))
    )
    joined = rows.join(groups, ["_len", "_pre", "_sha", "_salt"], "left")
    alone = F.col("_n").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that `refine` keeps, all columns unchanged. Cases are as there.

    Rows whose digest and id no dropped row has stay where they are; only the others, and the few that a table of bits
    can't tell from them, meet the kept ones by digest and id. Of repeated rows one stays.
    """
    found = materialise(refine(docs, id_col, text_col).select(F.col(id_col).alias("_keep_id"), F.unhex("text_sha256").alias("_keep_sha"), "kept"))
    dropped = materialise(found.filter("not kept").select(F.xxhash64("_keep_sha", "_keep_id").alias("_key")))
    keyed = as_rows(docs).withColumn("_own_sha", F.unhex(F.sha2(normalised(F.col("_r")[text_col]), 256)))
    clear, doubtful = sifted(keyed, F.xxhash64("_own_sha", F.col("_r")[id_col]), dropped, "_key")
    _, keep = sifted(found.filter("kept").drop("kept"), F.xxhash64("_keep_sha", "_keep_id"), dropped, "_key")
    place = F.row_number().over(Window.partitionBy("_own_sha", "_own_id").orderBy("_own_sha"))
    once = doubtful.withColumn("_own_id", F.col("_r")[id_col]).withColumn("_place", place).filter("_place = 1")  # each task passes on one of its rows that repeat
    met = once.join(keep, once["_own_sha"].eqNullSafe(keep["_keep_sha"]) & once["_own_id"].eqNullSafe(keep["_keep_id"]))
    return unpacked(clear.select("_r").unionByName(met.select("_r")))
