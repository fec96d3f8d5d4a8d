"""Exact top-k by inner product over an impact-ordered index.

Vectors are dealt into shards. A shard's index keeps, for each dimension, its
vectors in segments of one quantised impact (a negative query component reads
its dimension from the other end). A query reads segments of all dimensions
by descending impact and adds contributions to its accumulators, score at a
time. Vectors drop out only on proof: when all that unread segments can still
add does not lift them to the k-th accumulator. What may still be a member is
rescored exactly, so quantisation orders the work and never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import named, stage
from lorespark.session import prepare

#: Most vectors of a shard and queries of a block; together they bound a task.
SHARD, BLOCK = 1 << 13, 1 << 12
#: Levels that the impacts of a dimension are quantised to.
LEVELS = 16
#: Shares of the postings after which the bounds are looked at.
LOOKS = (0.5, 0.75, 0.9, 1.0)


class Index:
    """Impact-ordered postings of one shard of whole-number vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, size = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = ((vectors - low) // width).astype(np.int16)
        order = np.argsort(level, axis=0, kind="stable").T  # dimension by dimension
        self.postings = np.ascontiguousarray(order).ravel()
        self.impacts = np.ascontiguousarray(vectors[order, np.arange(size)[:, None]]).ravel()
        sorted_level = level.T[np.arange(size)[:, None], order].ravel()
        edge = np.ones(n * size, bool)
        edge[1:] = sorted_level[1:] != sorted_level[:-1]
        edge[np.arange(size) * n] = True
        self.starts = np.flatnonzero(edge)
        self.ends = np.append(self.starts[1:], n * size)
        self.dims = self.starts // n
        self.floors = np.minimum.reduceat(self.impacts, self.starts)
        self.tops = np.maximum.reduceat(self.impacts, self.starts)
        self.first = np.searchsorted(self.dims, np.arange(size))

    def members(self, query: np.ndarray, keep: int) -> np.ndarray:
        """Places of all vectors that may be among the ``keep`` best, ties too."""
        n = len(self.vectors)
        if n <= keep or not len(query):
            return np.arange(n)
        weight = query[self.dims]
        least = np.minimum.reduceat(np.minimum(weight * self.floors, weight * self.tops), self.first)
        # what the segment's best posting has above the least of its dimension
        gain = np.maximum(weight * self.floors, weight * self.tops) - least[self.dims]
        order = np.argsort(-gain, kind="stable")
        size = self.ends[order] - self.starts[order]
        read = np.cumsum(size)
        score = np.zeros(n)
        at = 0
        for share in LOOKS:
            stop = int(np.searchsorted(read, share * read[-1])) + 1
            part = np.sort(order[at:stop])
            if len(part):
                span = self.ends[part] - self.starts[part]
                place = np.repeat(self.starts[part] - np.cumsum(span) + span, span) + np.arange(span.sum())
                dim = np.repeat(self.dims[part], span)
                score += np.bincount(self.postings[place], query[dim] * self.impacts[place] - least[dim], n)
            at = max(at, stop)
            unread = np.zeros(len(query), np.int64)
            np.maximum.at(unread, self.dims[order[at:]], gain[order[at:]])
            bound = np.partition(score, n - keep)[n - keep]
            left = np.flatnonzero(score + int(unread.sum()) >= bound)
            if len(left) <= max(8 * keep, n // 32):
                break
        return left


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


_FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        out: list[list[np.ndarray]] = [[] for _ in names]
        if vectors.num_rows and queries.num_rows:
            index, asked = Index(_matrix(vectors)), _matrix(queries)
            rows, ids = vectors.column("row").to_numpy(), vectors.column("vec_id").to_numpy()
            own, own_id = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
            for i, query in enumerate(asked):
                places = index.members(query, k + 1)
                places = places[rows[places] != own[i]]
                score = index.vectors[places] @ query
                best = np.lexsort((rows[places], ids[places], -score))[:k]
                some = np.ones(len(best), np.int64)
                for values, part in zip((own[i] * some, own_id[i] * some, rows[places[best]], ids[places[best]], score[best]), out):
                    part.append(values)
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
        return pa.table(arrays, names=names)

    return run


def top_k(vectors: DataFrame, asks: Column, ident: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` best rows for each row that ``asks``, by whole-number inner product.

    Components become floor(scale * x). Rows with a null id or vector, or with
    a null or non-finite component, take no part; only vectors of the query's
    length are compared. A row is no candidate for itself, but a repeated row
    is one for the other. Ties go to the smaller id. Returns query_id, rank,
    vec_id, score; fewer rows if there are fewer candidates, and none for an
    empty table. Components should stay below 2**20. Runs jobs.
    """
    prepare(vectors.sparkSession)
    v = named(vectors, vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.filter(named(vectors, ident).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    whole = usable.select(
        named(vectors, ident).cast("long").alias("vec_id"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )
    held = stage(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = held.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    sizes = sizes.select("d", F.ceil(F.col("n") / SHARD).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("q") / BLOCK)).alias("blocks"))
    placed = held.withColumn("d", F.size("v")).join(sizes, "d")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    left = placed.withColumn("shard", own("shards")).withColumn("block", numbers(F.col("blocks")))
    right = placed.filter("asks").withColumn("block", own("blocks")).withColumn("shard", numbers(F.col("shards")))
    keys, cells = ["d", "shard", "block"], ["d", "shard", "block", "row", "vec_id", "v"]
    found = left.select(*cells).groupBy(*keys).cogroup(right.select(*[F.col(c).alias(c) for c in cells]).groupBy(*keys)).applyInArrow(_search(k), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
