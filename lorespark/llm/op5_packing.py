"""Best-fit decreasing packing of token pieces into sequences.

Tokens are made in one scan. Packing needs only how many pieces there are of
each length, so the plan for any number of pieces is made from at most
``size`` counts: bins of equal remaining capacity are handled together, and a
segment tree over the capacities finds the tightest open bin in logarithmic
time. The result is that of placing the pieces one by one. Each piece then
finds its place by its rank among the pieces of its length, and carries its
token ids there.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import named, stage, text_of
from lorespark.session import prepare

SIZE = 2048
#: Bytes of token ids that a worker hands on at once.
HANDED = 1 << 24
#: Characters of the texts that are encoded together; a longer text stands alone.
BLOCK = 1 << 22
#: Cached words of a worker; the cache starts anew when full.
CACHE = 800_000


def _odd(part: str) -> bool:
    """Whether a token may span the places where the encoder cuts: further white space."""
    return part in (" ", "\n") or bool(_SPACE.search(part, 1)) or part[:1].isspace() and part[0] not in " \n"


_SPACE = re.compile(r"\s")


def _le_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _plain_bpe(path: str):
    """The same byte-level merges without the bookkeeping of encodings, or None.

    Ids of such a vocabulary are in the order of its merges, so they serve as
    ranks. It encodes single words only, five times as fast.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """Token ids as little-endian bytes, by word.

    The byte-level pattern starts a token at every single space or line feed,
    after a line feed, and between a letter and a comma or full stop, so the
    ids of a text are those of such parts joined. A part with other white space has no ids here;
    texts with one are encoded whole.
    """

    def __init__(self, path: str, literal: bool):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = literal
        added = self.model.get_added_tokens_decoder().values()
        #: texts with one of these are encoded whole
        self.markers = [x.content for x in added if not (literal and x.special)]
        self.plain = _plain_bpe(path)
        self.line = self._encode(["\n"])[0]
        #: two bytes hold any id of a small vocabulary
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4"

    def _encode(self, parts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(parts, add_special_tokens=False)
        return [_le_bytes(x.ids) for x in found]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that begin with their only white space, a single space, or have none.

        A line feed in front of such a part is always a token of its own, so
        all parts are encoded as the lines of one text.
        """
        if self.plain is None or not parts:
            return self._encode(parts)
        ids = self.plain.encode_to_numpy("\n".join(parts)).astype("<u4")
        ends = np.flatnonzero(ids == int.from_bytes(self.line, "little"))
        if len(ends) != len(parts) - 1:
            return self._encode(parts)
        at, data = [-4, *(4 * ends).tolist(), 4 * len(ids)], ids.tobytes()
        return [data[lo + 4 : hi] for lo, hi in zip(at, at[1:])]

    def _split(self, part: str) -> tuple[str, str] | None:
        if len(part) > 1 and part[-1] in ",." and part[-2].isalpha():
            return part[:-1], part[-1]
        if len(part) > 1 and part[0] == "\n":
            return part[0], part[1:]
        return None

    def __missing__(self, part: str) -> bytes:
        if not part[1:].isalpha() and _odd(part):
            return b""
        cut = self._split(part)
        if not part:
            ids = b""
        elif cut:
            ids = (self.line if cut[0] == "\n" else self[cut[0]]) + self[cut[1]]
        elif part[0].isspace() and part[0] != " ":
            ids = self._encode([part])[0]
        else:
            ids = self._encode_parts([part])[0]
        if len(part) <= 64:
            self[part] = ids
        return ids

    def _learn(self, parts: list[str]) -> None:
        """Cache the ids of parts that are not cached yet."""
        if len(self) + len(parts) > CACHE:
            self.clear()
        new = set()
        for part in parts:
            if len(part) > 64 or not part:
                continue
            if not part[1:].isalpha() and _odd(part):
                self[part] = b""
                continue
            while cut := self._split(part):
                part = cut[1] if part[0] == "\n" else cut[0]
            if part[0] == " " or not part[0].isspace():
                new.add(part)
        new = [x for x in new if x not in self]
        self.update(zip(new, self._encode_parts(new)))

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of the texts by number, first part of each text, and the ids and id bounds by number.

        Every distinct part is looked up once for all texts; one with other
        white space has number -1 in place of its own.
        """
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(marked, "\0")
        coded = lists.values.dictionary_encode()
        number = coded.indices.to_numpy()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        self._learn([distinct[i] for i in missing])
        for i in missing:
            found[i] = self[distinct[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        odd = (size == 0) & (pc.binary_length(coded.dictionary).to_numpy() > 0)
        return np.where(odd[number], -1, number), lists.offsets.to_numpy(), np.frombuffer(b"".join(found), "<u4").astype(self.kind), np.append(0, np.cumsum(size))

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        whole = pc.match_substring(texts, "\0")
        for marker in self.markers:
            whole = pc.or_(whole, pc.match_substring(texts, marker))
        whole = whole.to_numpy(zero_copy_only=False)
        empty = pa.scalar("", texts.type)
        number, first, ids, bounds = self._parts(pc.if_else(pa.array(whole), empty, texts))
        # a text holds one part or more
        whole |= np.minimum.reduceat(number, first[:-1]) < 0
        size = np.where(number < 0, 0, np.diff(bounds)[number])
        size[np.repeat(whole, np.diff(first))] = 0
        ends = np.cumsum(size)
        at = np.repeat(bounds[:-1][number] - (ends - size), size)
        at += np.arange(len(at))
        flat, cuts = ids[at], np.append(0, ends)[first]
        if not whole.any():
            return flat, cuts
        odd = np.flatnonzero(whole)
        own = self._encode(texts.take(pa.array(odd)).to_pylist())
        pieces, last = [], 0
        for i, x in zip(odd.tolist(), own):
            pieces += [flat[last : cuts[i]], np.frombuffer(x, "<u4").astype(self.kind)]
            last = cuts[i]
        sizes = np.diff(cuts)
        sizes[odd] = [len(x) // 4 for x in own]
        return np.concatenate([*pieces, flat[last:]]), np.append(0, np.cumsum(sizes))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Four little-endian bytes for each id of each text."""
        if not texts:
            return []
        flat, cuts = self.block(pa.array(texts, pa.string()))
        wide = flat.astype("<u4")
        return [wide[lo:hi].tobytes() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_encoders: dict[tuple[str, bool], Encoder] = {}


def _pieces(path: str, size: int, end_id: int, literal: bool):
    """Pieces of each text: start, length, number among the task's pieces of that length, and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get((path, literal)) or _encoders.setdefault((path, literal), Encoder(path, literal))
        tail = np.array([end_id], encoder.kind)
        width = tail.itemsize
        seen = [0] * (size + 1)
        for batch in batches:
            texts, idents = batch.column("_t"), batch.column("id")
            rows, numbers, ids, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                piece, start, length, nth = zip(*numbers)
                arrays = [idents.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, nth)), pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "nth", "ids"])

            for lo, hi in _blocks(pc.utf8_length(texts).to_pylist()):
                flat, cuts = encoder.block(texts.slice(lo, hi - lo))
                cuts = cuts.tolist()
                for i in range(lo, hi):
                    body = np.append(flat[cuts[i - lo] : cuts[i - lo + 1]], tail)
                    n, at, number = len(body), 0, 0
                    while at < n:
                        # the first piece takes what does not fill a sequence
                        step = (n % size or size) if number == 0 else size
                        rows.append(i)
                        numbers.append((number, at, step, seen[step]))
                        ids.append(body[at : at + step].tobytes())
                        seen[step] += 1
                        at, number, held = at + step, number + 1, held + width * step
                        if held >= HANDED:
                            yield made()
                            rows, numbers, ids, held = [], [], [], 0
            if rows:
                yield made()

    return run


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` characters."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > BLOCK:
            yield lo, i
            lo, held = i, 0
        held += n
    if sizes:
        yield lo, len(sizes)


def _widened(ids: pa.BinaryArray, lengths: np.ndarray) -> pa.BinaryArray:
    """Four bytes for each id, from two or four."""
    bounds = np.append(0, np.cumsum(lengths))
    data = b"".join(ids.to_pylist())
    kind = "<u2" if len(data) == 2 * bounds[-1] else "<u4"
    wide = np.frombuffer(data, kind).astype("<u4").tobytes()
    offsets = pa.py_buffer((4 * bounds).astype(np.int32).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(wide)])


class OpenBins:
    """Bins by remaining capacity, under a segment tree of what is open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int) -> None:
        at = capacity + self.leaves
        self.open[at] = bool(self.bins[capacity])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.bins[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        group = self.bins[capacity].pop()
        self._mark(capacity)
        return group

    def tightest(self, length: int) -> int | None:
        """Smallest open capacity of at least ``length``."""
        at = length + self.leaves
        if at < 2 * self.leaves and self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces, longest first.

    Rows (length, first rank, first bin, offset in the bin, pieces per bin):
    ranks from there on fill bins one after the other. A bin that takes one
    piece of a length stays the tightest, so it takes as many as fit.
    """
    bins, made, plan = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity = size
                first, count = made, -(-left // (size // length))
                made += count
            else:
                first, count = bins.take(capacity)
            each = capacity // length
            whole = min(count, left // each)
            if whole:
                plan.append((length, rank, first, size - capacity, each))
                bins.put(capacity - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
                first, count = first + whole, count - whole
            if count and 0 < left < each:
                plan.append((length, rank, first, size - capacity, each))
                bins.put(capacity - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            bins.put(capacity, first, count)
    return plan


def _place(plan: np.ndarray, size: int):
    """Sequence and offset by length and rank, from the broadcast plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1]
            beyond = rank - row[:, 1]
            sequence = row[:, 2] + beyond // row[:, 4]
            offset = row[:, 3] + beyond % row[:, 4] * length
            columns = [batch.column(c) for c in ("id", "piece", "start", "length")]
            yield pa.RecordBatch.from_arrays(
                [*columns, _widened(batch.column("ids"), length), pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = 0, literal: bool = False
) -> DataFrame:
    """Pieces with their place: id, piece, start, length, ids, sequence_id, offset, ids_crc32.

    ``ids`` has four little-endian bytes a token: the pieces of a
    ``sequence_id`` by ``offset`` are the sequence. A text's ids end with
    ``end_id``; null counts as empty, which gives one piece of one token.
    Longer texts are cut from the end, so the first piece may be shorter.
    Special tokens written out in a text get their ids, as the tokenizer has
    it; with ``literal`` they are encoded like other text. Other columns are
    not read. Repeated rows are packed once each; an empty table gives an empty table.
    Runs jobs; the driver sees one count for each length.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.select(named(docs, ident).alias("id"), text_of(docs, text).alias("_t"))
    kind = plain.schema["id"].dataType.simpleString()
    columns = f"id {kind}, piece int, start long, length long"
    made = plain.mapInArrow(_pieces(tokenizer, size, end_id, literal), f"{columns}, nth long, ids binary")
    pieces = stage(made.withColumn("part", F.spark_partition_id()), "pieces")

    per_part = pieces.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    plan = np.array(sorted(best_fit(counts, size)), np.int64).reshape(-1, 5)
    # the table's length depends on ``size`` alone: a few rows for each length and capacity
    shared = spark.sparkContext.broadcast(plan)

    # a piece's rank: pieces of its length in the parts before, and before it in its own
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(offsets, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids", (F.col("ahead") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_place(shared, size), f"{columns}, ids binary, sequence_id long, offset long")
    return placed.withColumn("ids_crc32", F.crc32("ids"))


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    found = pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
    # the registered columns: ids by their checksum
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
