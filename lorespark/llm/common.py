"""Helpers the operators share: staged tables, row keys, blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.session import new_run_folder, prepare

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a lookup over bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The same rule for Spark's regular expressions (linear, no group).
WORD_RULE = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; runs a job.

    A lost executor then repeats only what reads the table, and a result that
    several plans use is computed once.
    """
    spark = prepare(df.sparkSession)
    path = new_run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the staged table that ``df`` reads; nothing may read it afterwards."""
    context = df.sparkSession.sparkContext
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def join_one(rows: DataFrame, values: DataFrame, key: str, times: str, most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row per key.

    ``times`` says how often a key comes in ``rows``. Keys with over one part
    in ``most`` of all rows, ``most`` at the utmost, are joined by broadcast,
    so that no task gets all rows of a hot key. ``rows`` and ``values`` are
    read twice and should be staged or cheap. Runs a job.
    """
    total = values.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * most > total
    often, rest = values.filter(hot & (F.col(times) > most)).drop(times), values.filter(~(hot & (F.col(times) > most))).drop(times)
    keys = F.broadcast(often.select(key))
    return rows.join(F.broadcast(often), key).unionByName(rows.join(keys, key, "left_anti").join(rest, key))


def named(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(named(df, column), F.lit(""))


def share(ident: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(ident).cast("string").cast("binary")), F.lit(modulus))


def held_out(ident: str, modulus: int, remainder: int) -> Column:
    """Rows kept from training. A null id has no remainder: it trains."""
    return F.coalesce(share(ident, modulus) == remainder, F.lit(False))


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` and the new ones; a clashing old column goes."""
    new = {k.lower() for k in columns}
    kept = [named(df, c) for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(data)]])
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stable_values(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_BYTE = stable_values(256, 11)
_STEP = 0xD6E8FEB86659FD93
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size <= 1 << 22:
            _powers[base] = table
    return table[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes.

    Polynomial in an odd base, so that a prefix sum gives every word at once.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_STEP, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power_table(_INVERSE, len(data))[starts]
    return mix(value ^ (ends - starts).astype(np.uint64))


def hashed_words(text: bytes, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes of one text, long texts piece by piece."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    if len(data) <= limit:
        return starts, ends, word_hashes(data, starts, ends)
    parts, first = [], 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + limit, "right")))
        piece = data[origin : ends[last - 1]]
        parts.append(word_hashes(piece, starts[first:last] - origin, ends[first:last] - origin))
        first = last
    return starts, ends, np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in two block scans."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])
