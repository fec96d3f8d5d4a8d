"""Repeated word sequences by seed and extend.

Seeds are winnowed anchors: the smallest hash of five words in each window.
Documents are joined on seeds that occur again. A seed comes with the words
that its windows reach to the left and to the right, and matches are extended
over them for a whole group at once: classes of equal sequences grow from one
word to two, four, ... up to a window, so a group of m occurrences costs m
steps and not m² pairs. Consecutive shared windows form the maximal repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import hashed_words, mix, word_bounds
from lorespark.llm.repeats import Unit, remove_repeats, window_digests

GRAM = 5


def _gram_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for i in range(1, GRAM):
        total *= np.uint64(0xA0761D6478BD642F)
        total += words[i : i + n]
    return mix(total)


class _Words:
    def __init__(self, length: int):
        self.length = length

    @staticmethod
    def count(text: bytes) -> int:
        return len(text.split())

    def grams(self, texts: list[bytes]):
        """Blocks of rows; a long text comes in overlapping pieces."""
        starts, _, words = hashed_words(b" ".join(texts), 1 << 21)
        if len(texts) == 1 and len(words) > 1 << 20:
            step = 1 << 20
            for at in range(0, len(words), step):
                piece = words[at : at + step + self.length - 1]
                grams = _gram_hashes(piece)
                yield grams, np.array([0, len(piece)]), at
        else:
            ends = np.cumsum([len(x) + 1 for x in texts])
            bounds = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
            yield _gram_hashes(words), bounds, 0

    def cut(self, text: bytes, starts: list[int], counts: list[int]) -> list[bytes]:
        begin, end = word_bounds(np.frombuffer(text, np.uint8))
        return [text[begin[s] : end[s + n + self.length - 2]] for s, n in zip(starts, counts)]

    def digests(self, stretch: bytes, n: int):
        return window_digests(hashed_words(stretch)[2], self.length, n)

    def resolve(self, stretches: list[bytes], sizes: list[int]) -> list[list[tuple[int, int]]]:
        return shared_windows(stretches, sizes, self.length)

    @staticmethod
    def apply(text: bytes, spans: list[tuple[int, int]]) -> bytes:
        words, parts, at = text.split(), [], 0
        for start, end in spans:
            parts += words[at:start]
            at = end
        return b" ".join(parts + words[at:])


def sequence_classes(words: np.ndarray, length: int) -> np.ndarray:
    """For each place the class of the ``length`` words from there on."""

    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right
        return np.unique(code, return_inverse=True)[1]

    known, size = words, 1
    while size * 2 <= length and len(known) > size:
        known = pair(known[:-size], known[size:])
        size *= 2
    rest = length - size
    if rest and len(known) > rest:
        known = pair(known[:-rest], known[rest:])
    return known


def shared_windows(stretches: list[bytes], sizes: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each stretch the (first, end) runs of windows that also start elsewhere.

    Stretches of the same words are counted and kept once. Words are compared
    as they are, not by hash.
    """
    number: dict[bytes, int] = {}
    of, parts = [], []
    for x in stretches:
        words = x.split()
        k = number.setdefault(b" ".join(words), len(number))
        if k == len(parts):
            parts.append(words)
        of.append(k)
    times = np.bincount(of, minlength=len(parts))
    window = np.zeros(len(parts), np.int64)
    window[of] = sizes
    start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for p in parts for w in p), np.int64, start[-1])
    begins = np.zeros(len(words) + 1, np.int64)
    np.add.at(begins, start[:-1], 1)
    np.add.at(begins, start[:-1] + window, -1)
    valid = np.cumsum(begins[:-1]).astype(bool)

    classes = sequence_classes(words, length)
    place = np.flatnonzero(valid)
    again = np.zeros(len(words), bool)
    again[place] = np.bincount(classes[place], minlength=1)[classes[place]] > 1
    again |= np.repeat(times > 1, np.diff(start)) & valid

    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs: list[list[tuple[int, int]]] = [[] for _ in parts]
    owner = np.searchsorted(start, first, "right") - 1
    for k, s, e in zip(owner.tolist(), (first - start[owner]).tolist(), (last - start[owner]).tolist()):
        runs[k].append((s, e))
    return [runs[k] for k in of]


def substring_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = 35, hot_bytes: int = 4 << 20) -> DataFrame:
    """Remove each word covered by ``length`` words that also start elsewhere.

    Returns the input columns with ``n_units`` (words), ``spans`` (maximal
    removed runs, in words) and ``kept`` (the kept words joined by one space).
    Null texts count as empty; shorter texts lose nothing; repeated rows are
    copies of each other; an empty table gives an empty table. Windows are
    judged on the input. Runs jobs.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    w = _Words(length)
    unit = Unit(length, GRAM, w.count, w.grams, w.cut, w.resolve, w.digests, w.apply, T.StringType())
    return remove_repeats(docs, unit, ident, text, hot_bytes)


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return substring_dedup(docs).select(
        "doc_id", F.col("n_units").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
    SELECT doc_id, place, list(word) OVER (
        PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win
    FROM words
), repeated AS (
    SELECT doc_id, place FROM (
        SELECT doc_id, place, count(*) OVER (PARTITION BY array_to_string(win, ' ')) AS n
        FROM windows WHERE len(win) = 35)
    WHERE n > 1
), covered AS (
    SELECT w.doc_id, w.place, w.word, max(r.place) OVER (
        PARTITION BY w.doc_id ORDER BY w.place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM words w LEFT JOIN repeated r USING (doc_id, place)
), per_doc AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
    FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN per_doc USING (doc_id)
"""
