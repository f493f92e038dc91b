"""An inverted-file index over embeddings: k-means cells, stored by cell, searched with exact scores in the cells that count."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import vectors
from larkspan.operators import search
from larkspan.storage import written

#: Cells at most: their centres are the only table that goes to every task, a few megabytes at any number of rows.
MOST_CELLS = 4096
#: Rows on which the centres are fitted at most. All rows are indexed.
SAMPLE_ROWS = 100_000
#: Vectors in a file. A larger cell is stored in pieces of about as many.
PIECE_ROWS = 20_000
#: Bound on what rounding adds to a similarity.
SLACK = 1e-6
#: Bound on what a product of matrices adds to a similarity; within it of the last place, similarities are formed anew.
NEAR = 1e-12
#: Queries that a group holds, about.
BLOCK_ROWS = 16_384

_FOUND_DDL = "query_id long, event_id long, similarity double, cell int"
_FOUND = pa.schema([("query_id", pa.int64()), ("event_id", pa.int64()), ("similarity", pa.float64()), ("cell", pa.int32())])


class Index(NamedTuple):
    """A stored index: the folder of vectors by cell, and the table of cells (cell, centre, reach, n, pieces)."""

    spark: SparkSession
    path: str

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")


def _usable(embedding: Column) -> Column:
    """Vectors with a direction: no null or non-finite component, and a length that isn't 0."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & sound & (vectors.norm(embedding.cast("array<double>")) > 0)


def build(events: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, piece_rows: int = PIECE_ROWS, seed: int = 1) -> Index:
    """Index the rows of events (event_id, embedding, ...) under `path`; their other columns are stored with them.

    Centres come from k-means by cosine on at most `sample_rows` rows, about the square root of the number of rows and
    no more than MOST_CELLS. Every row with a direction goes to its nearest centre. A cell's reach is the largest angle
    between its centre and a member, so a search knows which cells can't hold what it looks for. Cells that copies or
    a dense region fill are stored in pieces, by a hash of the id, so no task and no file holds a whole hot cell.
    """
    spark = events.sparkSession
    kept = events.filter(_usable(F.col("embedding")))
    n = kept.count()
    if not n:
        kept.withColumns({"cell": F.lit(0), "piece": F.lit(0)}).write.parquet(f"{path}/vectors")
        spark.createDataFrame([], "cell int, centre array<double>, reach double, n long, pieces int").write.parquet(f"{path}/cells")
        return Index(spark, path)
    count = max(2, min(MOST_CELLS, cells or math.isqrt(n), n))
    point = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    sample = kept.select(point) if n <= sample_rows else kept.orderBy(F.xxhash64("event_id", F.lit(seed))).limit(sample_rows).select(point).repartition(spark.sparkContext.defaultParallelism)  # a limit leaves one partition
    model = KMeans(k=count, seed=seed, distanceMeasure="cosine", maxIter=15, predictionCol="cell").fit(sample)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]  # MOST_CELLS at most
    placed = written(model.transform(kept.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))).drop("features"), "cells")
    centre = F.broadcast(spark.createDataFrame(centres, "cell int, centre array<double>"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine(F.col("embedding"), F.col("centre")))))
    table = placed.join(centre, "cell").groupBy("cell").agg(F.first("centre").alias("centre"), F.max(angle).alias("reach"), F.count(F.lit(1)).alias("n"))
    table.withColumn("pieces", F.ceil(F.col("n") / piece_rows).cast("int")).write.parquet(f"{path}/cells")
    index = Index(spark, path)
    pieces = F.broadcast(index.cells.select("cell", "pieces"))
    split = placed.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("event_id"), "pieces").cast("int")).drop("pieces")
    split.repartition("cell", "piece").write.partitionBy("cell", "piece").parquet(f"{path}/vectors")
    return index


def _cosine(a: Column, b: Column) -> Column:
    a = a.cast("array<double>")
    return vectors.dot(a, b) / (vectors.norm(a) * vectors.norm(b))


def cells_for(index: Index, query: list[float], threshold: float, probes: int | None = None) -> list[int]:
    """The cells that may hold a vector of similarity above the threshold, nearest centre first; the first `probes` of them.

    A member is at most `reach` from the centre, so its angle to the query is at least the centre's less the reach.
    """
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.cosine_to(F.col("centre"), query))))
    held = index.cells.select("cell", near.alias("angle"), F.cos(F.greatest(F.lit(0.0), near - F.col("reach"))).alias("bound"))
    chosen = held.filter(F.col("bound") + SLACK > threshold).orderBy("angle", "cell")
    return [r["cell"] for r in (chosen if probes is None else chosen.limit(probes)).collect()]


def match(index: Index, query: list[float], threshold: float = 0.7, limit: int = 10, category: str | None = None, probes: int | None = None) -> DataFrame:
    """`search.match` over the index: only the files of the chosen cells are read. Exact unless `probes` limits the cells."""
    chosen = cells_for(index, query, threshold, probes)
    return search.match(index.vectors.filter(F.col("cell").isin(chosen)).drop("cell", "piece"), query, threshold, limit, category)


def find_similar(index: Index, event_id: int, threshold: float = 0.7, limit: int = 10, probes: int | None = None) -> DataFrame:
    """The events most similar to one of the index, itself left out; raises if it has no vector there."""
    query = search.vector_of(index.vectors, event_id)
    return match(index, query, threshold, limit + 1, probes=probes).filter(F.col("event_id") != event_id).limit(limit)


def _nearest_cells(centres: list[tuple[int, list[float]]], probes: int):
    names, matrix = np.array([c for c, _ in centres], np.int32), np.array([v for _, v in centres], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)

    @F.pandas_udf("array<int>")
    def nearest(embedding: pd.Series) -> pd.Series:
        found = []
        for begin in range(0, len(embedding), 1024):
            scores = np.array(embedding.iloc[begin : begin + 1024].tolist(), np.float64) @ matrix.T
            found += list(names[np.argsort(-scores, axis=1, kind="stable")[:, :probes]])
        return pd.Series(found)

    return nearest


def _bins(table: list, bin_rows: int) -> list[tuple[int, int, int]]:
    """(cell, piece, bin): pieces in the order of their cells, as many to a bin as make about `bin_rows` vectors."""
    out, bin_, held = [], 0, 0
    for r in table:
        each = -(-r["n"] // r["pieces"])
        for piece in range(r["pieces"]):
            if held and held + each > bin_rows:
                bin_, held = bin_ + 1, 0
            out.append((r["cell"], piece, bin_))
            held += each
    return out


def _sent(table: list, bins: list[tuple[int, int, int]], probes: int):
    """Each query once for each bin that holds any of its nearest cells, with these cells; null if they are all of the bin's."""
    names, matrix = np.array([r["cell"] for r in table], np.int32), np.array([r["centre"] for r in table], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    place = {int(c): i for i, c in enumerate(names)}
    members: dict[int, set[int]] = {}
    for cell, _, bin_ in bins:
        members.setdefault(bin_, set()).add(place[cell])
    cells_of = {b: np.array(sorted(m)) for b, m in members.items()}

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                chosen = np.ones((len(part), len(names)), bool)
                if probes < len(names):
                    chosen[:] = False
                    np.put_along_axis(chosen, np.argsort(-(_matrix(part.column("embedding")) @ matrix.T), axis=1, kind="stable")[:, :probes], True, axis=1)
                for bin_, cells in cells_of.items():
                    mine = chosen[:, cells]
                    rows = np.flatnonzero(mine.any(axis=1))
                    if not len(rows):
                        continue
                    mine = mine[rows]
                    whole = mine.all(axis=1)
                    mine[whole] = False
                    ends = np.concatenate(([0], np.cumsum(mine.sum(axis=1)))).astype(np.int32)
                    probed = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[cells[np.nonzero(mine)[1]]]), mask=pa.array(whole))
                    took = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([took.column("query_id"), took.column("embedding"), took.column("block"), pa.array(np.full(len(rows), bin_, np.int32)), probed], ["query_id", "embedding", "block", "bin", "cells"])

    return run


def _matrix(column) -> np.ndarray:
    """Vectors of equal length, none of them null, as rows of length 1."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best_of(limit: int):
    """The best `limit` of a bin for each of the queries that look into it, some queries at a time.

    Products of matrices differ in the last bits with their shape. So whatever is within NEAR of the last place is
    scored again, alone: equal vectors then tie, and a pair scores the same whichever way it is met.
    """

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not len(queries) or not len(held):
            return _FOUND.empty_table()
        held = held.sort_by("event_id")
        ids, cells, matrix = held.column("event_id").to_numpy(), held.column("cell").to_numpy(), _matrix(held.column("embedding"))
        kinds, kind = np.unique(cells, return_inverse=True)
        names, asked, out = queries.column("query_id").to_numpy(), _matrix(queries.column("embedding")), []
        first, last = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
        for begin in range(0, len(names), 128):
            scores = asked[begin : begin + 128] @ matrix.T
            probed = queries.column("cells").slice(begin, 128).combine_chunks()
            some = np.flatnonzero(np.asarray(probed.is_valid()))
            if len(some):
                allowed = np.zeros((len(some), len(kinds)), bool)
                at = np.repeat(np.arange(len(some)), np.diff(probed.take(pa.array(some)).offsets.to_numpy()))
                wanted = probed.take(pa.array(some)).flatten().to_numpy()
                spot = np.minimum(np.searchsorted(kinds, wanted), len(kinds) - 1)
                met = kinds[spot] == wanted
                allowed[at[met], spot[met]] = True
                scores[some] = np.where(allowed[:, kind], scores[some], -np.inf)
            for i in np.flatnonzero(last[begin : begin + 128] > first[begin : begin + 128]):
                scores[i, first[begin + i] : last[begin + i]] = -np.inf
            floor = np.partition(scores, len(ids) - limit, axis=1)[:, len(ids) - limit] - NEAR if limit < len(ids) else np.full(len(scores), -np.inf)
            for i, row in enumerate(scores):
                near = np.flatnonzero((row >= floor[i]) & (row > -np.inf))
                exact = np.einsum("ij,j->i", matrix[near], asked[begin + i])
                order = np.lexsort((ids[near], -exact))[:limit]
                out.append((np.full(len(order), names[begin + i]), ids[near[order]], exact[order], cells[near[order]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_FOUND)

    return run


def search_many(index: Index, queries: DataFrame, limit: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, event_id, similarity, cell, rank): for each query (query_id, embedding) the best events but itself.

    Each query looks into its `probes` nearest cells (all cells if None, which is exact). Cells are searched in bins of
    up to PIECE_ROWS vectors: a query goes once to each bin that holds any of its cells, however many, and the bin
    passes on `limit` for it. So rows sent and passed on grow with queries times bins, not with queries times cells.
    Ties go to the smaller id.
    """
    table = index.cells.select("cell", "centre", "n", "pieces").orderBy("cell").collect()  # MOST_CELLS at most
    if not table:
        return index.spark.createDataFrame([], f"{_FOUND_DDL}, rank int")
    total = sum(r["n"] for r in table)
    bins = _bins(table, min(PIECE_ROWS, max(1000, -(-total // 32))))
    asked = queries.filter(_usable(F.col("embedding"))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    sent = asked.mapInArrow(_sent(table, bins, min(probes or len(table), len(table))), f"query_id {asked.schema['query_id'].dataType.simpleString()}, embedding array<double>, block int, bin int, cells array<int>")
    placed = F.broadcast(index.spark.createDataFrame(bins, "cell int, piece int, bin int"))
    held = index.vectors.select("cell", "piece", "event_id", "embedding").join(placed, ["cell", "piece"]).drop("piece")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sent.groupBy("block", "bin").cogroup(held.groupBy("block", "bin")).applyInArrow(_best_of(limit), _FOUND_DDL)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "event_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= limit)


def tuned_probes(index: Index, queries: DataFrame, limit: int = 10, recall: float = 0.95, most_queries: int = 200) -> int:
    """The least number of cells to look into for which `recall` of the true neighbours of the queries are found.

    At most `most_queries` of the queries are answered exactly; where their neighbours' cells stand in each query's
    order of cells says what any number of probes would find.
    """
    table = index.cells.select("cell", "centre").orderBy("cell").collect()
    if not table:
        return 1
    sample = written(queries.filter(_usable(F.col("embedding"))).orderBy(F.xxhash64("query_id")).limit(most_queries), "queries")
    ordered = sample.select("query_id", _nearest_cells([(r["cell"], r["centre"]) for r in table], len(table))(F.col("embedding").cast("array<double>")).alias("order"))
    met = search_many(index, sample, limit).join(ordered, "query_id")
    places = met.select(F.array_position("order", F.col("cell")).alias("place")).groupBy("place").count().orderBy("place").collect()  # a row for each cell at most
    total, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= recall * total:
            return int(r["place"])
    return len(table)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, neighbours and the share of the exact ones that were found."""
    hit = exact.join(found.select("query_id", "event_id", F.lit(1).alias("hit")), ["query_id", "event_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
