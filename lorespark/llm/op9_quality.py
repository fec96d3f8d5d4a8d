"""Quality rules with the frequency of lines across a host's documents.

One scan measures each document and hashes its normalised lines. A line that
too many distinct documents of a host share is boilerplate: it is removed from
the text, and a document that loses too much of itself is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import blocks, byte_texts, hashed_words, mix, named, stage
from lorespark.session import prepare

#: A line is boilerplate in more documents of its host than both limits: a
#: number, and a share of the host's documents.
LINE_DOCS, LINE_SHARE = 20, 0.0005
#: A document is depleted with less than this share of its words left.
LEFT_SHARE = 0.3

_SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def _bounds(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text."""
    spaced = [x + b" " for x in texts]
    data = np.frombuffer(b"".join(spaced), np.uint8)
    bounds = _bounds(spaced)
    starts, ends, words = hashed_words(data.tobytes(), 1 << 21)
    first = np.searchsorted(starts, bounds)
    n_words = np.diff(first)
    # code points of words: bytes that start a character and are no blank
    is_start = ((data & 0xC0) != 0x80) & ~np.isin(data, list(b" \t\n\v\f\r"))
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        row = np.repeat(np.arange(len(texts)), n_words)
        code = words[:-2].copy()
        for part in (words[1:-1], words[2:]):
            code = code * np.uint64(0xA0761D6478BD642F) + part
        inside = row[:-2] == row[2:]
        code = mix(code + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = np.flatnonzero(inside)
        order = place[np.argsort(code[place], kind="stable")]
        same = code[order[1:]] == code[order[:-1]]
        again = np.concatenate([order[1:][same], order[:-1][same]])
        for i in range(3):
            repeated[again + i] = True
    return {
        "n_words": n_words,
        "word_chars": _sums(is_start, bounds),
        "n_symbols": _sums(_IS_SYMBOL[data], bounds),
        "n_repeat_words": _sums(repeated, first),
    }


def normal_form(words: list[bytes]) -> bytes:
    return b" ".join(words).lower().translate(_DIGITS)


def line_key(form: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(form) - (1 << 63)


def lines_of(text: bytes) -> tuple[list[int], list[bytes], int]:
    """Words and normal form of each line with a word, and repeated such lines.

    Normal form: lower case in A–Z, digits as 0, words joined by one space.
    """
    sizes, forms, seen, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            repeats += line in seen
            seen.add(line)
            sizes.append(len(words))
            forms.append(normal_form(words))
    return sizes, forms, repeats


_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def without_lines(text: bytes, gone: set[int]) -> bytes:
    """The text without the lines whose keys are ``gone``; the others stay as they are."""
    left = []
    for line in text.split(b"\n"):
        words = line.split()
        if not words or line_key(normal_form(words)) not in gone:
            left.append(line)
    return b"\n".join(left)


def _cut(text: Column, gone: Column) -> Column:
    """``without_lines`` where lines go; other texts do not reach the worker."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        found = [None if t is None else without_lines(t, set(k)) for t, k in zip(texts.cast(pa.binary()).to_pylist(), keys.to_pylist())]
        return pa.array(found, pa.binary()).cast(pa.string())

    return F.when(gone.isNull(), text).otherwise(cut(F.when(gone.isNotNull(), text), gone))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_texts(batch.column("_t"))
        parts = [measure(texts[lo:hi]) for lo, hi in blocks(texts)]
        columns = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
        sizes, hashes, repeats = [], [], []
        for text in texts:
            counts, forms, again = lines_of(text)
            by_line: dict[int, int] = {}
            for n, form in zip(counts, forms):
                h = line_key(form)
                by_line[h] = by_line.get(h, 0) + n
            hashes.append(list(by_line))
            sizes.append(list(by_line.values()))
            repeats.append(again)
        arrays = [*(pa.array(v, pa.int64()) for v in columns.values()), pa.array(repeats, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _CARRIED), *arrays],
            names=[*_CARRIED, *columns, "n_dup_lines", "lines", "line_words"],
        )


_CARRIED = ["id", "host", "number", "_t", "_rest"]


def _judged(docs: DataFrame, ident: str, text: str, host: str, line_docs: int, line_share: float, left_share: float) -> DataFrame:
    """Columns of ``quality_rules``, and ``_rest``: the other columns of ``docs``."""
    prepare(docs.sparkSession)
    rest = F.struct(*[named(docs, c) for c in docs.columns if c != text])
    plain = docs.select(named(docs, ident).alias("id"), named(docs, host).alias("host"), named(docs, text).cast("string").alias("_t"), rest.alias("_rest"))
    plain = plain.withColumn("number", F.monotonically_increasing_id()).select(*_CARRIED)
    kinds = [f"{c} {plain.schema[c].dataType.simpleString()}" for c in _CARRIED]
    schema = ", ".join([*kinds, *(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_dup_lines")), "lines array<long>", "line_words array<long>"])
    rows = stage(plain.mapInArrow(_measure_batches, schema), "measures")

    # hosts by hash, so that null is one too
    placed = rows.withColumn("host_key", F.xxhash64("host"))
    single = placed.select("host_key", "id", F.explode("lines").alias("line"))
    # an id's rows may repeat: first one row for each (host, line, id), then the count
    often = single.distinct().groupBy("host_key", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > line_docs)
    hosts = placed.select("host_key", "id").distinct().groupBy("host_key").agg(F.count("*").alias("host_docs"))
    frequent = often.join(hosts, "host_key").filter(F.col("docs") > line_share * F.col("host_docs")).select("host_key", "line")
    own = placed.select("host_key", "number", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    own = own.select("host_key", "number", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    lost = own.join(frequent, ["host_key", "line"]).groupBy("number")
    # the keys of a row's lines in one list, so that texts are joined once
    lost = lost.agg(F.sum("words").alias("n_line_words"), F.collect_list("line").alias("gone"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words") >= left_share * F.col("n_words")
    judged = rows.join(lost, "number", "left").fillna(0, ["n_line_words"])
    return judged.select(
        "id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words",
        base.alias("base_failed"), (~base & left).alias("kept"), _cut(F.col("_t"), F.col("gone")).alias("cleaned"), "_rest",
    )


def quality_rules(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source",
    line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE,
) -> DataFrame:
    """Measures, verdict and text of each row: id, host, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_line_words (words in boilerplate lines),
    base_failed, kept, cleaned (the text without boilerplate lines).

    Base rules fail under 50 words, or with more than half the words in
    repeated three-word windows. A line is compared in normal form, within
    its host (null is a host), and counted once for each distinct id; lines
    above both limits go, and a document left with less than
    ``left_share`` of its words is rejected. Null texts have no words and stay
    null; repeated rows are judged alike; an empty table gives an empty table.
    Runs a job.
    """
    return _judged(docs, ident, text, host, line_docs, line_share, left_share).drop("_rest")


def clean_documents(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source",
    line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE,
) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, texts without boilerplate lines.

    Rules as in ``quality_rules``. Runs a job.
    """
    kept = _judged(docs, ident, text, host, line_docs, line_share, left_share).filter("kept")
    return kept.select(*[F.col("cleaned").alias(c) if c == text else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    return quality_rules(docs).withColumnRenamed("id", "doc_id").drop("host", "cleaned")


SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), lines AS (
    SELECT doc_id, host, line, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (
        SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place FROM texts)
), forms AS (
    SELECT doc_id, host, line, place, len(w) AS n,
           regexp_replace(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS form
    FROM lines WHERE len(w) > 0
), host_docs AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM texts GROUP BY host
), frequent AS (
    SELECT host, form FROM forms JOIN host_docs USING (host)
    GROUP BY host, form, host_docs HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.0005 * host_docs
), per_line AS (
    SELECT doc_id, sum(CASE WHEN f.form IS NOT NULL THEN n ELSE 0 END)::BIGINT AS n_line_words,
           (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
    FROM forms LEFT JOIN frequent f USING (host, form) GROUP BY doc_id
), grams AS (
    SELECT doc_id, place, w[place] || ' ' || w[place + 1] || ' ' || w[place + 2] AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS place FROM texts WHERE len(w) > 2)
), again AS (
    SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (
        SELECT doc_id, unnest([place, place + 1, place + 2]) AS p FROM again) GROUP BY doc_id
), base AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(n_line_words, 0) AS n_line_words
    FROM texts LEFT JOIN per_line USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_line_words >= 0.3 * n_words AS kept
FROM base
"""
