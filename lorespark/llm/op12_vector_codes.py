"""Vector codes by product quantisation with ball k-means.

Whole-number vectors are cut into parts; each part position has its own
codebook, fitted by a fixed number of rounds over all vectors. A codebook's
entries are balls: the part's distance to its former entry bounds which other
entries can be as near. Entries farther than twice the ball's radius are no
neighbours and are never looked at; parts in the stable core, nearer than half
the way to the next neighbour, keep their entry without any comparison; the
others are compared with those neighbours only whose ring they reach. All
distances are whole numbers, so the bounds are exact and so are the codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import named, stage, unstage
from lorespark.session import prepare

#: Components count as at most this much, so that sums of squares fit 64 bits.
LARGEST = 1 << 26
#: Most cells of one block of distances.
CELLS = 1 << 21
#: Groups with at most this many rows may be broadcast to the rows they label.
SMALL = 1 << 16


def nearest(parts: np.ndarray, book: np.ndarray, former: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of ``book`` for each row of ``parts`` (lower index on ties).

    ``former`` is any entry per row; the nearer it is, the less is compared.
    Returns entries, squared distances and the number of distances computed.
    """
    k = len(book)
    away = ((parts - book[former]) ** 2).sum(axis=1)
    between = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    code, best, work = former.copy(), away.copy(), len(parts)
    for entry in range(k):
        own = np.flatnonzero(former == entry)
        if not len(own):
            continue
        # neighbours by distance; a part beyond half the way (4 d² >= D²) may leave
        order = np.argsort(between[entry], kind="stable")
        order = order[order != entry]
        neighbours = order[between[entry][order] <= 4 * away[own].max()]
        if not len(neighbours):
            continue
        ring = np.searchsorted(between[entry][neighbours], 4 * away[own], "right")
        reached = np.argsort(-ring, kind="stable")  # rows of the outer rings first
        own, ring = own[reached], ring[reached]
        for at, other in enumerate(neighbours):
            inside = own[: int(np.searchsorted(-ring, -at, "left"))]  # rings beyond this neighbour
            if not len(inside):
                break
            apart = ((parts[inside] - book[other]) ** 2).sum(axis=1)
            work += len(inside)
            wins = (apart < best[inside]) | ((apart == best[inside]) & (other < code[inside]))
            code[inside[wins]], best[inside[wins]] = other, apart[wins]
    return code, best, work


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), size)


def _assign_batches(books: np.ndarray):
    """Codes of each vector, and one row per batch with the sums of its parts."""
    places, entries, width = books.shape
    wide = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = _matrix(batch.column("v"), places * width)
            former = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, places)
            codes = np.empty((n, places), np.uint8)
            error = np.zeros(n, np.int64)
            total = np.zeros((places, entries, width + 1), np.int64)
            for p in range(places):
                part = vectors[:, p * width : (p + 1) * width]
                for lo in range(0, n, max(1, CELLS // width)):
                    hi = min(n, lo + max(1, CELLS // width))
                    code, away, _ = nearest(part[lo:hi], books[p], former[lo:hi, p].astype(np.int64))
                    codes[lo:hi, p] = code
                    error[lo:hi] += away
                np.add.at(total[p, :, width], codes[:, p], 1)
                np.add.at(total[p, :, :width], codes[:, p], part)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.concat_arrays([batch.column(c), pa.nulls(1, batch.column(c).type)]) for c in ("vec_id", "label")],
                    pa.concat_arrays([batch.column("v").cast(wide), pa.nulls(1, wide)]),
                    pa.array([c.tobytes() for c in codes] + [None], pa.binary()),
                    pa.array([*error.tolist(), None], pa.int64()),
                    pa.array([None] * n + [total.ravel()], wide),
                ],
                names=["vec_id", "label", "v", "code", "error", "sums"],
            )

    return run


def _round(held: DataFrame, books: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """One pass: all vectors with their new codes, and the entries' new means."""
    kinds = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    out = held.select("vec_id", "label", "v", "code").mapInArrow(
        _assign_batches(books), f"{kinds}, v array<bigint>, code binary, error long, sums array<bigint>"
    )
    # sums and rows come from the same written pass, so a repeated task counts once
    done = stage(out.withColumn("summary", F.col("sums").isNotNull()), "codes")
    cells = done.filter("summary").select(F.posexplode("sums").alias("cell", "value"))
    total = np.zeros(books.size + books.shape[0] * books.shape[1], object)
    # one number per component of a codebook, whatever the input
    for cell, value in cells.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        total[cell] = int(value)
    total = total.reshape(*books.shape[:2], -1)
    count = total[:, :, -1:]
    means = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books.astype(object)).astype(np.int64)
    return done.filter("NOT summary").drop("summary", "sums"), means


def vector_codes(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors and the codebooks (part, entry, position).

    The table has vec_id, code (two hex digits per part), error (squared
    distance over all parts) and label_error (errors summed over rows of an
    equal label, nulls together). Components become floor(scale * x), kept
    within ±2^26. Each codebook starts as its part of the vectors with the
    smallest ids (nulls last, repeated ids by vector); fewer vectors than
    ``entries`` give fewer entries. Entries without parts stay as they are;
    equal distances go to the lower index, so that repeated rows get equal
    codes. Vectors that are null or empty, or hold null or non-finite
    components, take no part, nor do vectors of another length than the one
    with the smallest id; that length must be a multiple of ``parts``, else it
    is an error. An empty table gives an empty table and an empty codebook.
    Other columns are not read. Runs jobs.
    """
    spark = prepare(vectors.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256: a code is one byte a part")
    v = named(vectors, vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    bound = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale).cast("long")))
    whole = vectors.filter(v.isNotNull() & (F.size(v) > 0) & finite).select(
        named(vectors, ident).alias("vec_id"), named(vectors, label).alias("label"), F.transform(v, lambda x: bound(x).cast("long")).alias("v")
    )
    held = stage(whole, "vectors")
    empty = held.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
    order = [F.col("vec_id").isNull(), "vec_id", "v"]
    first = held.orderBy(*order).limit(1).select(F.size("v").alias("size")).first()
    if first is None:
        return empty, np.zeros((parts, 0, 0), np.int64)
    size = first["size"]
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    held = held.filter(F.size("v") == size)
    seeds = np.array([r["v"] for r in held.orderBy(*order).limit(entries).select("v").collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    state = held.withColumn("code", F.lit(bytes(parts)))
    for _ in range(rounds):
        former, (state, books) = state, _round(state, books)
        unstage(former)
    former, (state, _) = state, _round(state, books)
    unstage(former)
    return _with_label_errors(state), books


def _with_label_errors(state: DataFrame) -> DataFrame:
    """Codes as hex digits, with the errors summed by label joined back."""
    sums = stage(state.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    if sums.count() <= SMALL:
        sums = F.broadcast(sums)  # otherwise labels are so many that none dominates, or the join is split by size
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    joined = coded.join(sums.withColumnRenamed("label", "_of"), F.col("label").eqNullSafe(F.col("_of")), "left")
    return joined.select("vec_id", "code", "error", "label_error")


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components in decimals, by part, entry and position."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, folder: str) -> DataFrame:
    found, books = vector_codes(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))
    return found.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same fit in SQL: one pair of tables (assigned parts, new entries) per round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM (
  SELECT c.row, c.p, b.e, c.x, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM cut c JOIN b{r} b ON b.p = c.p) GROUP BY row, p)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.x, o.x) AS x FROM b{r} o LEFT JOIN (
  SELECT p, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, len(x)) g(i) GROUP BY p, e, i) GROUP BY p, e) m
  ON m.p = o.p AND m.e = o.e)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row,
           list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
    SELECT row, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, generate_series(0, {parts - 1}) g(p)
), b0 AS MATERIALIZED (SELECT p, row - 1 AS e, x FROM cut WHERE row <= {entries}),{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (row), book
"""


SQL = _sql()
