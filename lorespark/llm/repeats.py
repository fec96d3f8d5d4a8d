"""Windows of fixed length that occur more than once in a corpus, exactly.

Shared by the byte and the word de-duplication. A window's anchor is the
smallest hash among its grams, so equal windows have equal anchors. The plan:

1. One scan finds the anchors (about two per window length) and stages them.
2. Anchors that occur once cannot lie in a repeat and go. Exact copies of a
   text are known by their hash: all of them are repeated, one stands for all.
3. The stretches around the remaining anchors meet by anchor, and a resolver
   (suffix array, or seed and extend) finds the repeated windows among them.
4. An anchor with more than ``hot_bytes`` of stretches is not brought to one
   task: its windows are counted by a 128-bit hash, with map-side sums.

Texts are shuffled once, by row, and the exchange is used again at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import blocks, byte_texts, mix, named, sliding_min, stage, text_of
from lorespark.session import prepare

#: Longest stretch handed over at once, in windows.
MAX_RUN = 4096
#: Text resolved at once, in bytes; a larger anchor group is taken whole.
CHUNK = 1 << 19

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class Unit:
    """What windows are made of: bytes or words.

    ``grams(texts)`` yields (first row, gram hashes, unit bounds of the rows,
    first unit); ``cut(text, starts, counts)`` gives stretches of units;
    ``resolve(stretches, sizes)`` says for each stretch which of its windows
    are repeated, as (first, end) pairs; ``digests(stretch, n)`` gives two
    hashes of each window; ``apply(text, spans)`` removes unit spans.
    """

    length: int
    gram: int
    count: Callable
    grams: Callable
    cut: Callable
    resolve: Callable
    digests: Callable
    apply: Callable
    kept_type: T.DataType


#: Bits that hold a position while minima are taken; pieces are shorter.
PLACE = 22


def anchor_runs(grams: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: row, first window, windows, anchor.

    The count is negative if the anchor occurs at several places of the run
    (periodic text), so that its windows may repeat each other. Of equal
    minima the leftmost counts, in every text alike.
    """
    place = np.uint64((1 << PLACE) - 1)
    low = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), low
    at = np.arange(len(low))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(low)]
    inside = at + length <= bounds[row + 1]
    place_of = (low & place).astype(np.int64)
    anchor = grams[place_of]
    moved = np.ones(len(low), bool)
    moved[1:] = place_of[1:] != place_of[:-1]
    new = np.ones(len(low), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ((at[1:] - bounds[row[1:]]) % MAX_RUN == 0)
    first = np.flatnonzero(new & inside)
    if not len(first):
        return first, first, first, anchor[:0]
    count = np.add.reduceat(inside, first, dtype=np.int64)
    places = np.add.reduceat((moved | new) & inside, first, dtype=np.int64)
    return row[first], first - bounds[row[first]], np.where(places > 1, -count, count), anchor[first]


def _find(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("_t"))
            n = len(texts)
            size = np.array([unit.count(x) for x in texts], np.int64) if n else np.zeros(0, np.int64)
            rows, starts, counts, anchors = [], [], [], []
            for lo, hi in blocks(texts):
                for grams, bounds, origin in unit.grams(texts[lo:hi]):
                    r, s, c, a = anchor_runs(grams, bounds, unit.length, unit.gram)
                    rows.append(r + lo)
                    starts.append(s + origin)
                    counts.append(c)
                    anchors.append(a)
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(join(anchors, np.uint64).view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(join(starts, np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(join(counts, np.int32))),
            ]
            keys = [batch.column(c) for c in ("_a", "_b", "_c")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(size), *lists], names=["_a", "_b", "_c", "n", "anchors", "starts", "counts"])

    return run


_FOUND = "_a long, _b long, _c long, n long, anchors array<long>, starts array<long>, counts array<int>"


def _row_texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return byte_texts(batch.column("_row").field(text))


def _cut(unit: Unit, text: str, hot: bool):
    """Stretches around the wanted anchors, or window hashes of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _row_texts(batch, text)
            keys = batch.column("_a").to_numpy(), batch.column("_b").to_numpy()
            wanted = batch.column("wanted").to_pylist()
            lines, out = [], []

            def flush():
                of = np.array([x[0] for x in lines], np.int64)
                anchors, starts = (np.array([x[i] for x in lines], np.int64) for i in (1, 2))
                if not hot:
                    arrays = [anchors, keys[0][of], keys[1][of], starts, np.array([x[3] for x in lines], np.int32)]
                    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(out, pa.binary())], names=["anchor", "_a", "_b", "start", "size", "stretch"])
                found = [unit.digests(s, x[3]) for s, x in zip(out, lines)]
                sizes = [len(x[0]) for x in found]
                of, first = np.repeat(of, sizes), np.repeat(starts, sizes)
                within = np.concatenate([np.arange(x) for x in sizes])
                arrays = [np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1)]
                arrays += [keys[0][of], keys[1][of], first + within]
                return pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["d1", "d2", "_a", "_b", "start"])

            size = 0
            for i, (body, picks) in enumerate(zip(texts, wanted)):
                parts = unit.cut(body, [p["start"] for p in picks], [p["size"] for p in picks])
                for p, part in zip(picks, parts):
                    lines.append((i, p["anchor"], p["start"], p["size"]))
                    out.append(part)
                    size += len(part) * (30 if hot else 1)
                if size > 1 << 23:
                    yield flush()
                    lines, out, size = [], [], 0
            if lines:
                yield flush()

    return run


def _resolve(unit: Unit):
    """Repeated windows among the stretches of each anchor, as unit spans."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        found = unit.resolve([x[4] for x in held], [x[3] for x in held])
        of = np.repeat(np.arange(len(held)), [len(x) for x in found])
        flat = np.array([p for x in found for p in x], np.int64).reshape(-1, 2)
        a, b, start = (np.array([x[i] for x in held], np.int64)[of] for i in (0, 1, 2))
        arrays = [a, b, start + flat[:, 0], start + flat[:, 1] - 1 + unit.length]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["_a", "_b", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "_a", "_b", "start", "size", "stretch")]
            for anchor, *rest in zip(*columns):
                if size > CHUNK and anchor != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(rest)
                size += len(rest[4])
                last = anchor
        if held:
            yield settle(held)

    return run


def _apply(unit: Unit, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, merged = [], []
            for body, found in zip(_row_texts(batch, text), batch.column("found").to_pylist()):
                spans = merge_spans([(x["start"], x["end"]) for x in found or []])
                merged.append([{"start": s, "end": e} for s, e in spans])
                kept.append(unit.apply(body, spans))
            row = batch.column("_row")
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            last = pa.array(kept, pa.binary())
            if isinstance(unit.kept_type, T.StringType):
                last = last.cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[row.field(c) for c in names], pa.array([unit.count(x) for x in _row_texts(batch, text)], pa.int64()), pa.array(merged, kind), last],
                names=[*names, "n_units", "spans", "kept"],
            )

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, unit: Unit, ident: str, text: str, hot_bytes: int) -> DataFrame:
    """``docs`` with ``n_units``, ``spans`` (removed units) and ``kept``.

    Runs one job that stages the anchors. Input columns named like a new one
    are replaced. Rows with the same id and text are separate documents.
    """
    spark = prepare(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_units", "spans", "kept") or c in (ident, text)]
    body = text_of(docs, text)
    rows = docs.select(
        F.struct(*[named(docs, c) for c in names]).alias("_row"),
        F.xxhash64(named(docs, ident)).alias("_a"),
        F.xxhash64(body).alias("_b"),
    )
    plain = docs.select(
        F.xxhash64(named(docs, ident)).alias("_a"),
        F.xxhash64(body).alias("_b"),
        F.xxhash64(F.lit(1), body).alias("_c"),
        body.cast("binary").alias("_t"),
    )
    found = stage(plain.mapInArrow(_find(unit), _FOUND), "anchors")

    same = ["_b", "_c"]
    copies = found.groupBy(*same).agg(F.count("*").alias("copies"), F.min("_a").alias("first")).filter("copies > 1")
    marked = found.join(copies, same, "left")
    whole = marked.filter(F.col("first").isNotNull() & (F.col("n") >= unit.length)).select(
        "_a", "_b", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")
    )
    seen = marked.filter("first is null or first = _a").select(
        "_a", "_b", F.explode(F.arrays_zip("anchors", "starts", "counts")).alias("x")
    ).select("_a", "_b", F.col("x.anchors").alias("anchor"), F.col("x.starts").alias("start"), F.col("x.counts").alias("count")).select(
        "_a", "_b", "anchor", "start", F.abs("count").alias("size"), (F.col("count") < 0).alias("periodic")
    )
    again = (
        seen.groupBy("anchor")
        .agg(F.count("*").alias("times"), (F.sum("size") + F.count("*") * unit.length).alias("volume"), F.max("periodic").alias("periodic"))
        .filter("times > 1 or periodic")
        .select("anchor", (F.col("volume") > hot_bytes).alias("hot"))
    )
    picks = stage(seen.drop("periodic").join(again, "anchor"), "repeated_anchors")

    def around(hot: bool, schema: str) -> DataFrame:
        wanted = (
            picks.filter(F.col("hot") == hot)
            .groupBy("_a", "_b")
            .agg(F.collect_list(F.struct("anchor", "start", "size")).alias("wanted"))
        )
        joined = rows.join(wanted.hint("merge"), ["_a", "_b"]).select("_row", "_a", "_b", "wanted")
        return joined.mapInArrow(_cut(unit, text, hot), schema)

    stretches = around(False, "anchor long, _a long, _b long, start long, size int, stretch binary")
    cold = (
        stretches.repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(_resolve(unit), "_a long, _b long, start long, end long")
    )
    parts = [cold, whole]
    if not picks.filter("hot").isEmpty():
        windows = stage(around(True, "d1 long, d2 long, _a long, _b long, start long"), "hot_windows")
        often = windows.groupBy("d1", "d2").count().filter("count > 1").select("d1", "d2")
        parts.append(
            windows.join(often, ["d1", "d2"]).select("_a", "_b", "start", (F.col("start") + unit.length).alias("end"))
        )
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    spans = spans.groupBy("_a", "_b").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = rows.join(spans.hint("merge"), ["_a", "_b"], "left").select("_row", "_a", "_b", "found")
    schema = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("n_units", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept", unit.kept_type)]
    )
    return joined.mapInArrow(_apply(unit, text, names), schema)


def window_digests(values: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the first ``n`` windows of values."""
    out = []
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        total = np.zeros(n, np.uint64)
        for i in range(length):
            total *= np.uint64(base)
            total += values[i : i + n]
        out.append(mix(total))
    return out[0], out[1]
