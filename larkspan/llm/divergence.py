"""Source divergence audit: the terms and the other sources from which a source's words differ most, within its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import sequences as S
from larkspan.llm.common import join_checked, lean, materialise, ranked


class Sizes(NamedTuple):
    """How much meets at once; results don't depend on it."""

    held: int = 300_000  #: entries that a task counts before it sends them on
    block: int = 256  #: sources that meet another block's
    entries: int = 500_000  #: entries of two blocks in one task
    pairs: int = 1 << 18  #: pairs of entries that are computed at once

_COUNTS_DDL = "lang string, source string, term string, n long, docs long"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS_DDL = "lang string, a long, b long, sum long, shared long"
_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("sum", pa.int64()), ("shared", pa.int64())])


def _term_table() -> bytes:
    """Bytes of terms as they are, A to Z in lower case, all others as a blank."""
    keep = [c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)]
    return bytes(keep).translate(bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))))


def _slices(text: bytes, most: int = 4_000_000) -> Iterator[list[bytes]]:
    """The terms of a text of terms and blanks, some megabytes at a time."""
    begin = 0
    while begin < len(text):
        stop = text.find(b" ", begin + most)
        stop = stop if stop >= 0 else len(text)
        yield text[begin:stop].split()
        begin = stop


def _counter(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs) of what a task reads, added up to `most` entries at a time."""
        table, held, size = _term_table(), {}, 0

        def send() -> Iterator[pa.RecordBatch]:
            rows = ((lang, source, term.decode(), n, docs) for (lang, source), terms in held.items() for term, (n, docs) in terms.items())
            while some := list(islice(rows, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _COUNTS.types, strict=True)], schema=_COUNTS)

        for batch in batches:
            for begin, stop in S.portions(batch.column(2)):
                part = batch.slice(begin, stop - begin)
                data, offsets = S.utf8(part.column(2))
                for i, group in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    own, seen = held.setdefault(group, {}), Counter()
                    for terms in _slices(data[offsets[i] : offsets[i + 1]].tobytes().translate(table)):
                        seen.update(terms)
                    size -= len(own)
                    for term, n in seen.items():
                        before = own.get(term)
                        own[term] = (n, 1) if before is None else (before[0] + n, before[1] + 1)
                    size += len(own)
                    if size >= most:
                        yield from send()
                        held, size = {}, 0
        yield from send()

    return lean(run)


def _probability(n: str) -> Column:
    """1 + floor(10 ** 9 * (n + 2) / (total + 2 * kept)) in decimals, exact for any counts; null where no term is kept."""
    wide = "cast({} as decimal(20,0))".format
    whole = f"(cast(1000000000 as decimal(10,0)) * ({wide(n)} + 2)) div ({wide('total')} + 2 * {wide('kept')})"
    return F.expr(f"CASE WHEN kept > 0 THEN 1 + {whole} END")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def postings(docs: DataFrame, least_docs: int, lang_col: str, source_col: str, text_col: str, held: int = Sizes().held) -> DataFrame:
    """(lang, source, term, n, lang_n, leads): how often each kept term occurs; one row of each (lang, term) leads.

    Counts leave a task added up; one shuffle by (lang, term) serves both sums, as a term's sources meet in it anyway.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counter(held), _COUNTS_DDL).repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    place = F.row_number().over(term.orderBy("source"))
    known = summed.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("_docs"), (place == 1).alias("leads"))
    return materialise(known.filter(F.col("_docs") >= least_docs).drop("_docs"))


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row for each (lang, source) that occurs: its number, total, terms and base (p of a term that it lacks); its lang's kept and lang_total."""
    occurring = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("kept"), F.sum("n").alias("lang_total"))
    met = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "kept", "lang_total"])
    return materialise(ranked(met, [F.col("lang"), F.col("source")], "number").withColumn("base", _probability("0")))


def most_divergent_terms(kept: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms of greatest value among those that it has more often than its lang.

    Terms of a group fall into buckets by count; small counts have one of their own, others share one with counts of the
    same six leading bits. The value grows with the group's probability and falls with the lang's, so a bucket's
    greatest and least bound all its terms. Best first: buckets are opened by bound until they hold k terms, then all
    those whose bound isn't below the k-th value found; no term of the others is evaluated.
    """
    with_p = join_checked(kept, groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"], "inner").withColumn("p", _probability("n"))
    with_q = with_p.withColumn("total", F.col("lang_total")).withColumn("q", _probability("lang_n"))
    shift = F.greatest(F.floor(F.log2("n")).cast("int") - 5, F.lit(0))
    terms = with_q.select("lang", "source", "term", "p", "q", (shift.cast("long") * 64 + F.call_function("shiftright", F.col("n"), shift)).alias("bucket"))
    buckets = terms.groupBy("lang", "source", "bucket").agg(F.max("p").alias("_p"), F.min("q").alias("_q"), F.count_if(F.col("p") > F.col("q")).alias("_n")).filter("_n > 0").withColumn("bound", _distance("_p", "_q"))
    earlier = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialise(buckets.select("lang", "source", "bucket", "bound", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) < k).alias("opened")))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def evaluated(chosen: DataFrame) -> DataFrame:
        met = join_checked(terms, materialise(chosen.select("lang", "source", "bucket")), ["lang", "source", "bucket"], "inner")
        return met.filter("p > q").select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))

    first = materialise(best(evaluated(buckets.filter("opened"))))
    kth = first.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    unseen = buckets.filter("NOT opened").join(kth, ["lang", "source"]).filter("bound >= kth")
    return best(first.drop("rank").unionByName(evaluated(unseen)))


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _cells(sizes: Sizes):
    def cell(key: tuple, table: pa.Table) -> pa.Table:
        """Sums over a slice of terms for all pairs of sources of two blocks; rows without a term are the sources themselves."""
        lang, first, second, _ = (k.as_py() for k in key)
        number, p = (table.column(c).to_numpy() for c in ("number", "p"))
        term = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        sides = []
        for block in (first, second):
            of = number // sizes.block == block
            names, base = number[of & (term < 0)], p[of & (term < 0)]
            order = np.argsort(names)
            held = of & (term >= 0)
            sides.append((names[order], base[order], np.searchsorted(names[order], number[held]), term[held], p[held]))
        (a_names, a_base, a, a_term, a_p), (b_names, b_base, b, b_term, b_p) = sides
        sums, shared = np.zeros((len(a_names), len(b_names)), np.int64), np.zeros((len(a_names), len(b_names)), np.int64)
        for own, values, base, into in ((a, a_p, b_base, sums), (b, b_p, a_base, sums.T)):
            same, times = np.unique(np.stack((own, values)), axis=1, return_counts=True)
            step = max(1, sizes.pairs // max(1, len(base)))
            for i in range(0, len(times), step):
                j = slice(i, i + step)
                np.add.at(into, same[0, j], _distances(same[1, j, None], base[None, :]) * times[j, None])
        by = np.argsort(b_term, kind="stable")
        low, high = np.searchsorted(b_term[by], a_term, "left"), np.searchsorted(b_term[by], a_term, "right")
        ends = np.cumsum(high - low)
        begin = 0
        while begin < len(ends):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + sizes.pairs, "right")))
            times = (high - low)[begin:stop]
            x = np.repeat(np.arange(begin, stop), times)
            y = by[low[x] + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)]
            gain = _distances(a_p[x], b_p[y]) - _distances(a_p[x], b_base[b[y]]) - _distances(a_base[a[x]], b_p[y])
            np.add.at(sums, (a[x], b[y]), gain)
            np.add.at(shared, (a[x], b[y]), 1)
            begin = stop
        i, j = np.nonzero(a_names[:, None] < b_names[None, :])
        return pa.Table.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(a_names[i]), pa.array(b_names[j]), pa.array(sums[i, j]), pa.array(shared[i, j])], schema=_SUMS)

    return cell


def source_pairs(kept: DataFrame, groups: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(lang, source, item, value, rank): each source's distance over all kept terms to each other source of its lang.

    The terms of a pair that neither source has give one value, times their number. What one source alone has depends
    on its probability and the other's base, once for each different probability. Only terms that both have are paired,
    from the postings. Sources meet in blocks and terms in slices, so a task holds two blocks' entries of a slice, and
    sums over the slices are added up: the work beyond the pairs asked for follows the postings.
    """
    span = groups.groupBy("lang").agg(F.min(F.expr(f"number div {sizes.block}")).alias("low"), F.max(F.expr(f"number div {sizes.block}")).alias("high"), F.sum("terms").alias("_entries"))
    span = materialise(span.select("lang", "low", "high", (1 + F.expr(f"(2 * _entries) div ((high - low + 1) * {sizes.entries})")).alias("slices")))
    known = groups.select("lang", "source", "number", "total", "kept", "base")
    entries = join_checked(kept, known, ["lang", "source"], "inner").select("lang", "number", "term", _probability("n").alias("p"))
    entries = join_checked(entries, span, ["lang"], "inner").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")))
    bases = join_checked(groups.select("lang", "number", F.lit(None).cast("string").alias("term"), F.coalesce("base", F.lit(1)).alias("p")), span, ["lang"], "inner")
    bases = bases.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    other, own = F.col("other"), F.expr(f"number div {sizes.block}")
    placed = entries.unionByName(bases).withColumn("other", F.explode(F.sequence("low", "high")))
    cells = placed.select("lang", F.least(own, other).alias("first"), F.greatest(own, other).alias("second"), "slice", "number", "term", "p")
    sums = cells.groupBy("lang", "first", "second", "slice").applyInArrow(_cells(sizes), _SUMS_DDL)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("sum").alias("sum"), F.sum("shared").alias("shared"))
    side = lambda s: groups.select(F.col("number").alias(s), F.col("source").alias(f"{s}_source"), F.col("terms").alias(f"{s}_terms"), F.col("base").alias(f"{s}_base"), *["kept"] * (s == "a"))
    met = join_checked(join_checked(sums, side("a"), ["a"], "inner"), side("b"), ["b"], "inner")
    neither = F.expr("(kept - a_terms - b_terms + shared) * (((a_base - b_base) * (a_base - b_base)) div (a_base + b_base))")
    value = F.when(F.col("kept") > 0, F.col("sum") + neither).otherwise(F.lit(0).cast("long")).alias("value")
    both = met.select("lang", value, F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("_s"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return both.select("lang", "_s.source", "_s.item", "value").withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, k: int = 10, least_docs: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """Parts `pair` and `term` of each (lang, source), as (lang, source, part, item, value, rank).

    Terms are runs of letters A to Z and of characters beyond ASCII; only A to Z are lower-cased. A lang keeps the terms
    that `least_docs` of its documents hold. Values are floor((p - q) ** 2 / (p + q)) in whole numbers; a pair's is
    their sum over all kept terms, 0 if there are none. Ties go by item.

    Null lang, source and text count as ''. A group without terms has pairs and no terms; a lang with one source has no
    pairs. Repeated rows count as documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    kept = postings(docs, least_docs, lang_col, source_col, text_col, sizes.held)
    groups = groups_of(docs, kept, lang_col, source_col)
    parts = [source_pairs(kept, groups, sizes).withColumn("part", F.lit("pair")), most_divergent_terms(kept, groups, k).withColumn("part", F.lit("term"))]
    pairs, terms = (p.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")) for p in parts)
    return pairs.unionByName(terms)
