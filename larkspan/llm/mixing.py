"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import WORD, as_rows, join_checked, materialise, ranked, thresholds, unpacked

#: Bits of a document's hash. 15 hexadecimal digits, so that other engines can form it too.
KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(id_: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the same in every run, and different for copies with different ids."""
    whole = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Adds to (source, source_size) each source's target: `share` of all sizes, split by the repeated weights.

    No target exceeds `most` times its source's size; what a source can't take is shared again by weight among the
    others until none is above. Each round is one sum over the sources; the driver sees the sums only.
    """
    place = ranked(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    held = materialise(place.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * most).cast("double")))
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_cap") < F.lit(level) * F.col("_weight")
        got = held.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if not got["weight"] or got["n"] == capped:
            break
        capped, level = got["n"], (share * (got["total"] or 0) - got["taken"]) / got["weight"]
    want = F.lit(float(level or 0.0)) * F.col("_weight")
    return held.select("source", "source_size", F.when(F.col("_cap") < want, F.col("_cap")).otherwise(want).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a source: source, source_size, target, whole (times each document is taken), threshold.

    The target is taken as whole passes over the source, and from the rest of it the documents whose hash lies below
    the source's threshold. Thresholds come from sums by source and hash bucket, refined in the boundary bucket only;
    the thresholds of growing budgets are nested, so a larger share keeps what a smaller one took.
    """
    rows = materialise(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash_key(F.col(id_col), F.col(text_col)).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = materialise(targets(sizes, weights, share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    budgets = wanted.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    cuts = thresholds(rows, "source", "key", "size", budgets, KEY_BITS).select(F.col("source").alias("_s"), "threshold")
    return materialise(wanted.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """row (the document's columns), size (words), source_size, target, and copies, how often the mix takes the document.

    Documents are filtered by comparing their hash with the source's threshold: no sort, and no shuffle of texts.
    Null text has size 0; null is a source of its own, the last. Rows that agree in id and text share a hash and are
    taken alike. An empty table gives no rows. Extra columns pass through in the row, whatever their names.
    """
    held = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    row = as_rows(docs, "row")
    keyed = row.select("row", F.col("row")[source_col].alias("source"), n_words(F.col("row")[text_col]).alias("size"), hash_key(F.col("row")[id_col], F.col("row")[text_col]).alias("key"))
    met = join_checked(keyed, held, ["source"])
    return met.select("row", "size", "source_size", "target", (F.col("whole") + (F.col("key") < F.col("threshold")).cast("long")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them: absent, once or repeated; all columns unchanged."""
    taken = mix(docs, **options).filter("copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), "row")
