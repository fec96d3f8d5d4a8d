"""Periodic runs of words by block convolution.

A run of period q and length at least 2q holds an aligned block of 2^k words,
with 2^(k+1) - 1 <= q, that comes again q words later. At each such scale the
blocks are compared with every place of the window of distances that belongs
to the scale: the sums of squared differences come from a number-theoretic
transform, and a sum of zero is an occurrence without mismatch. Its distance
seeds a run, which is then extended word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import blocks, byte_texts, named, replaced
from lorespark.session import prepare

#: A prime of the form 15 * 2^27 + 1 and one of its primitive roots.
PRIME, ROOT = 15 * 2**27 + 1, 31
_P = np.uint64(PRIME)
#: Cells that one batch of transforms may hold.
CELLS = 1 << 19


@lru_cache(maxsize=64)
def _roots(half: int, back: bool) -> np.ndarray:
    """Powers 0 … half-1 of a root of unity of order 2 * half (or its inverse)."""
    step = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    step = pow(step, -1, PRIME) if back else step
    out = np.ones(half, np.uint64)
    size = 1
    while size < half:
        out[size : 2 * size] = out[:size] * np.uint64(pow(step, size, PRIME)) % _P
        size *= 2
    return out


def _less(x: np.ndarray) -> np.ndarray:
    # below 2 * PRIME: the wrapped difference is larger unless x >= PRIME
    return np.minimum(x, x - _P)


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of each row; results stand in bit-reversed order."""
    rows, size = a.shape
    half = size // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        a = np.stack([_less(low + high), (low + _P - high) * _roots(half, False) % _P], axis=2)
        half //= 2
    return a.reshape(rows, size)


def transform_back(a: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``."""
    rows, size = a.shape
    half = 1
    while half < size:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1] * _roots(half, True) % _P
        a = np.stack([_less(low + high), _less(low + _P - high)], axis=2)
        half *= 2
    return a.reshape(rows, size) * np.uint64(pow(size, -1, PRIME)) % _P


def zero_mismatches(block: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Where each row of ``block`` may stand in its row of ``window``.

    Marks the places whose sum of squared differences is zero modulo the
    prime; a real occurrence is always marked.
    """
    width, span = block.shape[1], window.shape[1]
    size = 1 << (span - 1).bit_length()
    x = np.zeros((len(block), size), np.uint64)
    x[:, :width] = block[:, ::-1]
    y = np.zeros((len(block), size), np.uint64)
    y[:, :span] = window
    cross = transform_back(transform(x) * transform(y) % _P)[:, width - 1 : span]
    squares = np.zeros((len(block), span + 1), np.uint64)
    np.cumsum(window.astype(np.uint64) ** np.uint64(2) % _P, axis=1, out=squares[:, 1:])
    ahead = (squares[:, width:] - squares[:, :-width]) % _P
    own = (block.astype(np.uint64) ** np.uint64(2) % _P).sum(axis=1) % _P
    return (own[:, None] + ahead) % _P == cross * np.uint64(2) % _P


def _reach(words: np.ndarray, at: np.ndarray, apart: np.ndarray, most: int, step: int) -> np.ndarray:
    """How many words from ``at`` on, at most ``most``, equal those ``apart`` later."""
    out = np.zeros(len(at), np.int64)
    n = len(words)
    live = np.arange(len(at))
    done, width = 0, 4
    while len(live) and done < most:
        width = min(width, most - done)
        some = max(1, CELLS // width)
        going = []
        for lo in range(0, len(live), some):
            part = live[lo : lo + some]
            place = at[part, None] + step * (done + np.arange(width))
            inside = (place >= 0) & (place + apart[part, None] < n)
            place = np.where(inside, place, 0)
            same = inside & (words[place] == words[np.where(inside, place + apart[part, None], 0)])
            count = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[part] += count
            going.append(part[count == width])
        live = np.concatenate(going)
        done += width
        width *= 2
    return out


class _Cover:
    """Known runs as intervals that can be asked for the one reaching farthest."""

    def __init__(self, runs: np.ndarray):
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        self.starts = runs[:, 0]
        self.reach = np.maximum.accumulate(runs[:, 1]) if len(runs) else runs[:, 1]

    def holds(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether one known run holds [first, end)."""
        if not len(self.starts):
            return np.zeros(len(first), bool)
        at = np.searchsorted(self.starts, first, "right") - 1
        return (at >= 0) & (self.reach[at] >= end)


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block width, smallest, greatest distance); together all distances from 1 on."""
    yield 2, 1, 6  # runs of up to 5 words a period are 12 long, so they hold such a block too
    width = 4
    while 2 * width - 1 <= longest:
        yield width, 2 * width - 1, 4 * width - 2
        width *= 2


def find_runs(words: np.ndarray, edges: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of ``least`` words or more.

    ``words`` are numbers, of several texts one after the other; ``edges`` are
    the texts' first places and the end. No number may occur in two texts.
    ``least`` is at least 12.
    """
    n = len(words)
    sizes = np.diff(edges)
    longest = int(sizes.max(initial=0)) // 2
    found = np.zeros((0, 3), np.int64)
    if not longest:
        return found
    base = np.repeat(words[np.minimum(edges[:-1], n - 1)], sizes)
    local = np.where(words >= base, words - base, 0).astype(np.int64)
    size_at = np.repeat(sizes, sizes)
    order = np.argsort(words, kind="stable")
    where = words[order].astype(np.int64) * n + order  # sorted by (word, place)

    def comes_again(place: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word at each place occurs ``low`` to ``high`` words later."""
        key = words[place].astype(np.int64) * n + place
        next_at = np.searchsorted(where, key + low)
        return where[np.minimum(next_at, n - 1)] - key == np.clip(where[np.minimum(next_at, n - 1)] - key, low, high)

    for width, low, high in _scales(longest):
        start = np.arange(0, n - width - low + 1, width)
        start = start[(size_at[start] >= 2 * low) & (size_at[start] >= least)]
        # all distances of a window inside one run of a short period are its multiples
        short = found[found[:, 2] <= width]
        cover = _Cover(short)
        start = start[~cover.holds(start, start + high + width)]
        # a block with a word that the window lacks has no occurrence
        for i in dict.fromkeys([0, width // 2, width - 1, width // 4, 3 * width // 4, *range(0, width, max(1, width // 16))]):
            start = start[comes_again(start + i, low, high)]
        span = high - low + width
        some = max(1, CELLS // (4 * width))
        seeds = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(start), some):
            part = start[lo : lo + some]
            window = part[:, None] + low + np.arange(span)
            ahead = np.where(window < n, local[np.minimum(window, n - 1)], PRIME - 1)
            row, shift = np.nonzero(zero_mismatches(local[part[:, None] + np.arange(width)], ahead))
            seeds.append(np.stack([part[row], shift + low]))
        at, apart = np.concatenate(seeds, axis=1)
        keep = (at + apart + width <= n) & ~cover.holds(at, at + apart + width)
        at, apart = at[keep], apart[keep]
        keep = _reach(words, at, apart, width, 1) == width
        at, apart = at[keep], apart[keep]
        if not len(at):
            continue
        # neighbouring blocks at one distance lie in one stretch; its ends are less than a block away
        order = np.lexsort((at, apart))
        at, apart = at[order], apart[order]
        new = np.ones(len(at), bool)
        new[1:] = (apart[1:] != apart[:-1]) | (at[1:] != at[:-1] + width)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        apart = apart[first]
        begin = at[first] - _reach(words, at[first] - 1, apart, n, -1)
        end = at[last] + width
        end = end + _reach(words, end, apart, n, 1) + apart
        long = end - begin >= np.maximum(least, 2 * apart)
        found = np.concatenate([found, np.stack([begin, end, apart], axis=1)[long]])
        # a stretch that has a shorter period too is that run
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        once = np.ones(len(found), bool)
        once[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[once]
    return found


def word_numbers(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of several texts, none shared between texts, and the texts' edges."""
    out, edges, used = [], [0], 0
    for words in lists:
        table: dict[bytes, int] = {}
        out.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)) + used)
        used += len(table)
        edges.append(edges[-1] + len(words))
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(edges)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _run_batches(rewrite: Callable | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = byte_texts(batch.column("_t")), batch.column("id").to_pylist()
            for lo, hi in blocks(texts):
                lists = [t.split() for t in texts[lo:hi]]
                if rewrite is not None:
                    lists = [rewrite(i, words) for i, words in zip(ids[lo:hi], lists)]
                numbers, edges = word_numbers(lists)
                found = find_runs(numbers, edges, least)
                start, end, period = found.T
                counts = np.diff(np.searchsorted(start, edges))
                change = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                kept = np.cumsum(change[:-1]) == 0
                whole = [
                    b" ".join([w for w, k in zip(words, kept[a : a + len(words)]) if k] if count else words)
                    for words, a, count in zip(lists, edges.tolist(), counts.tolist())
                ]
                own = start - np.repeat(edges[:-1], counts)
                values = pa.StructArray.from_arrays([pa.array(own), pa.array(end - start), pa.array(period)], fields=list(_RUNS.value_type))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), runs, pa.array(whole, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"]
                )

    return run


def periodic_runs(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 12,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(id, runs, collapsed)`` for each row of ``docs``.

    ``runs`` are all maximal stretches of at least two periods and ``least``
    (12 or more) words, as (start, length, period) by start, then period;
    ``collapsed`` is the text's words, joined by one space, without those that
    a run has after its first period. ``rewrite`` may replace the words of a
    text, by its id, before the search. A null, empty or blank text has no
    runs and collapses to the empty string. Rows are judged one by one:
    repeated rows give repeated results, null ids stay, other columns of
    ``docs`` are not read, and an empty table gives an empty table. A text of
    any length is searched whole, in memory of about 100 bytes a word.
    """
    prepare(docs.sparkSession)
    if least < 12:
        raise ValueError("least must be 12 or more: shorter runs need not hold a block")
    plain = docs.select(named(docs, ident).alias("id"), named(docs, text).alias("_t"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(_run_batches(rewrite, least), f"id {kind}, {_OUT}")


def cycled(ident: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, by its id, with a cycle from some word on."""
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    found = periodic_runs(docs, rewrite=cycled)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # greatest length, then smallest start, then smallest period
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    best = found.withColumn("_best", F.array_max(ranked)).withColumn("_lines", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
    return best.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.length div -_best.p").alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
