"""Exact top-k search by inner product over integer vectors, in tiles.

Queries and candidates are dealt into blocks by a hash; each pair of blocks is one matrix product in one
task, which selects its k best per query at once, so that no more than k rows per query leave a pair. The
lists of the blocks are then merged in a tree: a round joins the lists of FAN candidate blocks, until one
list per query is left; lists that one task has of several blocks are merged there before they are dealt out. A pair of blocks holds QUERY_BLOCK + CANDIDATE_BLOCK vectors at most on average,
whatever the size of the tables.

Defined results: null vectors and vectors with null, NaN or infinite components take no part, nor do rows of null id; neither do
candidates of another length than the query's. A repeated query row is asked once; an id with several vectors is as many
queries, each with a list of its own under that id. Repeated candidate
rows are candidates each, but a row with the query's own id never is. Ties go to the smaller id. Products
beyond 64 bits saturate. Empty tables, and tables without a query, give no rows; vectors of any length are multiplied whole; columns of other names take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
QUERY_EVERY = 50
SCALE = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Blocks that tables are dealt into at least, so that small ones use all cores too.
LEAST_BLOCKS = 96
FAN = 64

_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v (array of double with integral values): floor(scale * x) of each component."""
    usable = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector)).filter(F.col("id").isNotNull() & F.col(vector).isNotNull() & usable).select("id", v.alias("v"))


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of integral vectors: by floating point where no sum can lose a digit."""
    top = lambda m: float(np.abs(m).max()) if m.size else 0.0
    bound = top(queries) * top(candidates) * max(queries.shape[1], 1)
    if bound < 2.0**53:
        return (queries @ candidates.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    out = exact(queries) @ exact(candidates).T
    return np.array([[min(max(int(x), _LONG[0]), _LONG[1]) for x in row] for row in out], dtype=np.int64).reshape(out.shape)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; a partial selection, then a sort of few."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        if len(at) > 4 * k:  # many ties at the edge: those above it, and the smallest ids of those on it
            above, edge = at[scores[at] > floor], at[scores[at] == floor]
            at = np.concatenate([above, edge[np.argsort(ids[edge], kind="stable")[: k - len(above)]]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _tile(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            widths = right["v"].map(len)
            for width, queries in left.groupby(left["q_v"].map(len)):
                near = right[widths == width]
                if not len(near):
                    continue
                q_ids, q_hashes, c_ids = queries["q_id"].to_numpy(), queries["q_h"].to_numpy(), near["id"].to_numpy()
                c = np.array(near["v"].tolist(), dtype=np.float64).reshape(len(near), width)
                for low in range(0, len(queries), 256):
                    q = np.array(queries["q_v"].iloc[low : low + 256].tolist(), dtype=np.float64).reshape(-1, width)
                    for q_id, q_h, scores in zip(q_ids[low : low + 256], q_hashes[low : low + 256], products(q, c), strict=True):
                        if len(own := np.flatnonzero(c_ids == q_id)):
                            keep = np.delete(np.arange(len(c_ids)), own)
                            at = keep[best(scores[keep], c_ids[keep], k)]
                        else:
                            at = best(scores, c_ids, k)
                        found += zip([q_id] * len(at), [q_h] * len(at), c_ids[at], scores[at], strict=True)
        block = int(right["c"].iloc[0]) if len(right) else 0
        return pd.DataFrame(found, columns=["query_id", "q_h", "vec_id", "score"]).astype("int64").assign(c=block)

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among the candidates (both as of quantised())."""
    n_queries, n_candidates = queries.count(), candidates.count()
    c_blocks = max(math.ceil(n_candidates / CANDIDATE_BLOCK), min(LEAST_BLOCKS, math.ceil(n_candidates / 64)), 1)
    q_blocks = max(math.ceil(n_queries / QUERY_BLOCK), 1)
    deal = lambda blocks: F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.dropDuplicates(["id", "v"]).select(F.col("id").alias("q_id"), F.xxhash64("v").alias("q_h"), F.col("v").alias("q_v"), deal(q_blocks).alias("qq")).withColumn("qc", each(c_blocks))
    right = candidates.select("id", "v", deal(c_blocks).alias("c")).withColumn("q", each(q_blocks))
    lists = left.groupBy("qc", "qq").cogroup(right.groupBy("c", "q")).applyInPandas(_tile(k), "query_id long, q_h long, vec_id long, score long, c int")
    blocks = c_blocks
    while blocks > FAN:
        blocks = math.ceil(blocks / FAN)
        lists = _merged(lists.withColumn("c", (F.col("c") / FAN).cast("int")), ["query_id", "q_h", "c"], k).drop("rank")
    return _merged(lists, ["query_id", "q_h"], k).select("query_id", "rank", "vec_id", "score")


def _merged(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op8(embeddings: DataFrame) -> DataFrame:
    rows = quantised(embeddings)
    return search(rows.filter(F.col("id") % QUERY_EVERY == 0), rows)


OP8_SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
