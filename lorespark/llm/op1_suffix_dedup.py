"""Repeated byte strings, found in suffix arrays.

The suffix array is built in two stages: suffixes smaller than their
successor are sorted directly, the others are induced from them by one scan
over the buckets of first bytes. Common prefixes of neighbours then tell which
windows are repeated. ``repeats.py`` brings together what can be equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.repeats import Unit, remove_repeats, window_digests
from lorespark.llm.common import mix, stable_values

GRAM = 16
_VALUES = stable_values(256, 5)


def _views(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as unsigned numbers."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))


def _gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the 16 bytes from each position on."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    eight = _views(data)
    return mix(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))


class _Bytes:
    def __init__(self, length: int):
        self.length = length

    def grams(self, texts: list[bytes]):
        """Blocks of rows; a long text comes in overlapping pieces."""
        if len(texts) == 1 and len(texts[0]) > 1 << 21:
            step = 1 << 20
            for at in range(0, len(texts[0]), step):
                piece = texts[0][at : at + step + self.length - 1]
                yield _gram_hashes(piece), np.array([0, len(piece)]), at
        else:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            yield _gram_hashes(b"".join(texts)), bounds, 0

    def cut(self, text: bytes, starts: list[int], counts: list[int]) -> list[bytes]:
        return [text[s : s + n + self.length - 1] for s, n in zip(starts, counts)]

    def digests(self, stretch: bytes, n: int):
        return window_digests(_VALUES[np.frombuffer(stretch, np.uint8)], self.length, n)

    def resolve(self, stretches: list[bytes], sizes: list[int]) -> list[list[tuple[int, int]]]:
        return repeated_windows(stretches, sizes, self.length)

    @staticmethod
    def apply(text: bytes, spans: list[tuple[int, int]]) -> bytes:
        parts, at = [], 0
        for start, end in spans:
            parts.append(text[at:start])
            at = end
        parts.append(text[at:])
        return b"".join(parts)


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor."""
    change = np.flatnonzero(data[1:] != data[:-1])
    if not len(change):
        return np.zeros(len(data), bool)
    rise = data[change] < data[change + 1]
    runs = np.diff(np.concatenate([[-1], change]))
    tail = np.zeros(len(data) - 1 - change[-1], bool)
    return np.concatenate([np.repeat(rise, runs), tail])


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least.

    Stage one sorts the suffixes that are smaller than their successor; stage
    two scans the buckets upwards: the predecessor of each suffix met, if it
    is larger than its successor, is the next one of its own bucket.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    small = smaller_than_next(data)
    direct = np.flatnonzero(small)
    as_text = text.decode("latin-1")
    keys = [as_text[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if keys else direct

    size = np.bincount(data, minlength=256)
    direct_size = np.bincount(data[direct], minlength=256)
    head = np.cumsum(size) - size
    end = head + size
    order = np.empty(n, np.int64)
    at = 0
    for c in np.flatnonzero(direct_size).tolist():
        order[end[c] - direct_size[c] : end[c]] = direct[at : at + direct_size[c]]
        at += direct_size[c]

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if not len(before):
            return
        bucket = data[before]
        rank = np.argsort(bucket, kind="stable")
        bucket, before = bucket[rank], before[rank]
        count = np.bincount(bucket, minlength=256)
        within = np.arange(len(before)) - (np.cumsum(count) - count)[bucket]
        order[head[bucket] + within] = before
        np.add(head, count, out=head)

    order[head[data[-1]]] = n - 1  # larger than the empty suffix behind it
    head[data[-1]] += 1
    start = np.cumsum(size) - size
    for c in np.flatnonzero(size).tolist():
        low = start[c]
        while low < head[c]:
            high = head[c]
            induce(order[low:high])
            low = high
        if direct_size[c]:
            induce(order[end[c] - direct_size[c] : end[c]])
    return order


def common_prefixes(text: bytes, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, up to ``depth``."""
    eight = _views(text + bytes(depth + 16))
    length = np.full(len(left), depth, np.int64)
    alive = np.arange(len(left))
    for step in range(0, depth, 8):
        odd = eight[left[alive] + step] ^ eight[right[alive] + step]
        stop = odd != 0
        low = odd[stop]
        zeros = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        length[alive[stop]] = np.minimum(depth, step + zeros // 8)
        alive = alive[~stop]
    return length


def repeated_windows(stretches: list[bytes], sizes: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each stretch the (first, end) runs of windows that also start elsewhere.

    Equal stretches are counted and kept once; the suffix array orders what
    is left, and only suffixes that start a whole window are compared.
    """
    number: dict[bytes, int] = {}
    of = [number.setdefault(x, len(number)) for x in stretches]
    times = np.bincount(of, minlength=len(number))
    window = np.zeros(len(number), np.int64)
    window[of] = sizes
    text = b"".join(number)
    start = np.concatenate([[0], np.cumsum([len(x) for x in number])]).astype(np.int64)
    begins = np.zeros(len(text) + 1, np.int8)
    np.add.at(begins, start[:-1], 1)
    np.add.at(begins, start[:-1] + window, -1)
    valid = np.cumsum(begins[:-1]).astype(bool)

    order = suffix_array(text, length)
    order = order[valid[order]]
    same = common_prefixes(text, order[:-1], order[1:], length) >= length
    again = np.zeros(len(text), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= np.repeat(times > 1, np.diff(start)) & valid

    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    # a stretch is longer than its windows, so runs never cross stretches
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(len(number))]
    owner = np.searchsorted(start, first, "right") - 1
    for k, s, e in zip(owner.tolist(), (first - start[owner]).tolist(), (last - start[owner]).tolist()):
        runs[k].append((s, e))
    return [runs[k] for k in of]


def suffix_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 200, hot_bytes: int = 4 << 20) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts elsewhere.

    Returns the input columns with ``n_units`` (bytes), ``spans`` (maximal
    removed byte runs) and ``kept`` (binary: a cut may fall inside a
    character). Null texts count as empty; texts shorter than ``length`` are
    kept whole; repeated rows are copies of each other; an empty table gives
    an empty table. Windows are judged on the input. Runs jobs.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    b = _Bytes(length)
    unit = Unit(length, GRAM, len, b.grams, b.cut, b.resolve, b.digests, b.apply, T.BinaryType())
    return remove_repeats(docs, unit, ident, text, hot_bytes)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return suffix_dedup(docs).select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
