"""Exact top-k inner-product search with multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import materialise

#: Segments a vector, coarse to fine.
LEVELS = (1, 4, 16, 32)
#: Queries and vectors whose bounds are held at once, and pairs that are scored at once.
QUERIES, VECTORS, PAIRS = 2048, 1024, 1 << 15
#: Bytes of vectors (as doubles) in a block.
BLOCK_BYTES = 16 << 20


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Each segment's mean and deviation, scaled so that the product of two rows bounds the inner product from above.

    With means m and deviations s over w components, x.y = w m_x m_y + (x - m_x).(y - m_y) <= w m_x m_y + w s_x s_y in
    each segment; as |x - y|^2 = |x|^2 + |y|^2 - 2 x.y, that is the lower bound on the distance.
    """
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    width = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / width
    centred = vectors - np.repeat(mean, width, axis=1)
    deviation = np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1) / width)
    return np.hstack([mean, deviation]) * np.tile(np.sqrt(width), 2)


def _pairwise(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows a[i] and b[j]."""
    out = np.zeros(len(i), a.dtype)
    for begin in range(0, len(i), PAIRS):
        part = slice(begin, begin + PAIRS)
        out[part] = (a[i[part]] * b[j[part]]).sum(axis=1)
    return out


def block_top_k(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, vector_rows: np.ndarray, order: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of each query's k best in a block, ties by `order`, and how many pairs were scored.

    Each pair has its bound from the coarsest statistics first and from finer ones as long as that reaches the query's
    k-th best so far; only pairs whose bounds all do are scored. Exact: bounds only drop losers.
    """
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))]
    scored = 0
    if len(queries) and len(vectors):
        whole = float(np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1]) >= 2**53
        levels = tuple(s for s in levels if s < queries.shape[1])
        of_vectors = [segment_statistics(vectors, s) for s in levels]
        best_first = np.argsort(-(vectors * vectors).sum(axis=1), kind="stable")
        exact_vectors = vectors.astype(int).astype(object) if whole else vectors
    for top in range(0, len(queries) if len(vectors) else 0, QUERIES):
        mine = queries[top : top + QUERIES]
        exact = mine.astype(int).astype(object) if whole else mine
        of_queries = [segment_statistics(mine, s) for s in levels]
        least = np.full(len(mine), np.iinfo(np.int64).min)
        kept = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))
        begin, chunk = 0, max(4 * k, 64)  # a short first one, for bounds to be compared with
        while begin < len(vectors):
            columns = best_first[begin : begin + chunk]
            begin, chunk = begin + chunk, VECTORS
            enough = np.where(least > np.iinfo(np.int64).min, least.astype(float), -np.inf)
            alive = query_rows[top : top + QUERIES, None] != vector_rows[columns][None, :]
            pairs = None
            for of_query, of_vector in zip(of_queries, of_vectors, strict=True) if np.isfinite(enough).any() else ():
                if pairs is None and alive.mean() > 0.1:
                    bound = of_query @ of_vector[columns].T
                    alive &= bound + 1e-9 * np.abs(bound) + 1e-6 >= enough[:, None]
                else:
                    i, j = np.nonzero(alive) if pairs is None else pairs
                    bound = _pairwise(of_query, of_vector[columns], i, j)
                    fit = bound + 1e-9 * np.abs(bound) + 1e-6 >= enough[i]
                    pairs = i[fit], j[fit]
            i, j = np.nonzero(alive) if pairs is None else pairs
            scored += len(i)
            score = _pairwise(exact, exact_vectors[columns], i, j).astype(np.int64)
            fit = score >= least[i]
            q, v, s = (np.concatenate(x) for x in zip(kept, (i[fit], columns[j[fit]], score[fit]), strict=True))
            by = np.lexsort((order[v], -s, q))
            q, v, s = q[by], v[by], s[by]
            first = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1))
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            kept = (q[place < k], v[place < k], s[place < k])
            least[q[place == k - 1]] = s[place == k - 1]
        found.append((kept[0] + top, *kept[1:]))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), scored


def search(vectors: DataFrame, queries_where: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank from 1, vec_id, score.

    Components become floor(scale * x). Queries are the rows that `queries_where` selects; candidates are all rows but
    the query's own. Queries and candidates are dealt to blocks of about `block_bytes` and each pair of blocks meets in
    one task: queries go to all candidate blocks and candidates to all query blocks, so larger blocks are sent less
    often. There, bounds from segment means and deviations, coarse to fine, drop pairs that can't reach the query's k-th
    best so far; the others are scored in full. At last the blocks' winners, k a query and block, are ranked.

    Vectors that are null, empty, or hold null or non-finite components take no part. Vectors of different length don't
    meet. Ties go to the smaller id, null ids last, then to the earlier row. Repeated rows are candidates of each other.
    A query with fewer candidates has fewer rows. An empty table gives no rows. Extra columns are ignored. Scores must
    fit a long; sums beyond 2^53 are formed and compared as whole numbers.
    """
    usable = F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.expr(queries_where).alias("_query"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False))).filter("_ok").select("_id", "_v", F.coalesce("_query", F.lit(False)).alias("_query"), F.size("_v").alias("_dim"), F.monotonically_increasing_id().alias("_row"))
    rows = materialise(rows)
    n = rows.agg(F.sum("_dim").alias("all"), F.sum(F.when(F.col("_query"), F.col("_dim"))).alias("queries"), F.count(F.lit(1)).alias("rows")).first()
    blocks = lambda components: max(1, -(-8 * (components or 0) // block_bytes))
    # Few vectors are dealt to more blocks, of 2048 at least, so that all cores have work.
    query_blocks, vector_blocks = blocks(n["queries"]), max(blocks(n["all"]), min(vectors.sparkSession.sparkContext.defaultParallelism, n["rows"] // 2048))
    mine = lambda of: F.pmod(F.xxhash64("_row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asked = rows.filter("_query").withColumn("_qb", mine(query_blocks)).withColumn("_vb", every(vector_blocks)).withColumn("_asks", F.lit(True))
    given = rows.withColumn("_vb", mine(vector_blocks)).withColumn("_qb", every(query_blocks)).withColumn("_asks", F.lit(False))

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        whole = np.floor(np.stack(block["_v"].to_numpy()).astype(float) * scale)
        asks = block["_asks"].to_numpy(bool)
        row, ids = block["_row"].to_numpy(), block["_id"].astype("Int64")
        order = np.argsort(np.lexsort((row[~asks], ids[~asks].fillna(0).to_numpy(), ids[~asks].isna().to_numpy(bool))))
        q, v, s, _ = block_top_k(whole[asks], row[asks], whole[~asks], row[~asks], order, k)
        return pd.DataFrame({"query_id": ids[asks].to_numpy()[q], "_asker": row[asks][q], "vec_id": ids[~asks].to_numpy()[v], "_found": row[~asks][v], "score": s}).astype({"query_id": "Int64", "vec_id": "Int64", "score": "int64"})

    columns = ["_dim", "_qb", "_vb", "_asks", "_row", "_id", "_v"]
    met = asked.select(columns).unionByName(given.select(columns)).groupBy("_dim", "_qb", "_vb").applyInPandas(meet, "query_id long, _asker long, vec_id long, _found long, score long")
    place = F.row_number().over(Window.partitionBy("_asker").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_found"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
