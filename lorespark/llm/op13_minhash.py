"""Near duplicates by HyperMinHash.

A document's set of word shingles is hashed into buckets; each bucket keeps the
leading zeros and a few following bits (the mantissa) of its least hash, one
byte in all. Empty buckets borrow from others by a fixed sequence, so that the
share of equal registers estimates the Jaccard similarity for small sets too.
Bands of registers are the keys under which sets meet. Sets that meet are
compared by their registers, with chance collisions of the short registers
taken out, and what may be similar is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import blocks, byte_texts, join_one, mix, named, stage, text_of
from lorespark.llm.components import components
from lorespark.session import prepare

SEED = 42
#: Registers of a band, and bands. Two sets at a similarity of 0.8 miss each
#: other in all bands with a chance of (1 - 0.8^5)^38, below 3 in 10 million.
BAND, BANDS = 5, 38
REGISTERS = BAND * BANDS
#: Bits of a register behind the leading zeros.
MANTISSA = 3
#: Sets of fewer shingles are confirmed without an estimate.
SURE = 64
#: Standard deviations that an estimate may fall short of the threshold.
DEVIATIONS = 4.5
#: Sets of one band key that are compared in one task; more are dealt into several.
BLOCK = 2048


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles; fewer words are one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh3_64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(start, end[width - 1 :].tolist())], np.uint64))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Registers (set, bucket) and band keys (set, band) of non-empty sets."""
    n = len(sets)
    if not n:
        return np.zeros((0, REGISTERS), np.uint8), np.zeros((0, BANDS), np.int64)
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    value = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * REGISTERS + bucket, value)
    filled = np.bincount(owner * REGISTERS + bucket, minlength=n * REGISTERS) > 0
    registers = compressed(least)
    source = np.tile(np.arange(REGISTERS), n)
    empty = np.flatnonzero(~filled)
    turn = 0
    while len(empty):  # every bucket asks others in an order of its own until one is filled
        turn += 1
        place = empty % REGISTERS
        other = (mix(place.astype(np.uint64) + np.uint64(turn * 1_000_003)) % np.uint64(REGISTERS)).astype(np.int64)
        lender = empty - place + other
        hit = filled[lender]
        registers[empty[hit]] = registers[lender[hit]]
        source[empty[hit]] = other[hit]
        empty = empty[~hit]
    key = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    cells = (source * 256 + registers).astype(np.uint64).reshape(n, BANDS, BAND)
    for i in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
    return registers.reshape(n, REGISTERS), key.view(np.int64)


def compressed(value: np.ndarray) -> np.ndarray:
    """One byte: up to 31 leading zeros, and the bits behind the first one."""
    exponent = np.frexp((value >> np.uint64(11)).astype(np.float64))[1]  # 53 bits, exact
    zeros = np.minimum(53 - exponent, 31)
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    bits = (value >> np.uint64(11)) >> shift & np.uint64((1 << MANTISSA) - 1)
    return (zeros * (1 << MANTISSA)).astype(np.uint8) + bits.astype(np.uint8)


def _collisions() -> np.ndarray:
    """Chance that two unrelated sets of 2^(i/4) hashes a bucket have equal registers."""
    zeros, bits = np.divmod(np.arange(32 << MANTISSA), 1 << MANTISSA)
    low = 2.0 ** -(zeros + 1.0) * (1 + bits / (1 << MANTISSA))
    high = 2.0 ** -(zeros + 1.0) * (1 + (bits + 1) / (1 << MANTISSA))
    load = 2.0 ** (np.arange(100) / 4)
    inside = np.exp(-load[:, None] * low) - np.exp(-load[:, None] * high)
    return ((inside / inside.sum(axis=1, keepdims=True)) ** 2).sum(axis=1)


_CHANCE = _collisions()


def may_link(equal: np.ndarray, small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    """The estimate where a pair may be similar, else -1.

    ``equal`` is the number of equal registers, ``small`` and ``large`` are the
    sizes of the two sets.
    """
    load = np.clip(4 * np.log2(np.maximum(1, small / REGISTERS)), 0, len(_CHANCE) - 1).astype(np.int64)
    chance = _CHANCE[load]
    estimate = (equal / REGISTERS - chance) / (1 - chance)
    least = percent / 100
    # filled buckets draw from the union without replacement; borrowed ones weigh some draws more
    union = (small + large) / (1 + least)
    drawn = REGISTERS * (1 - np.exp(-union / REGISTERS))
    weight = REGISTERS / drawn
    spread = np.maximum(0, 1 / drawn - 1 / union) + (weight - 1) / (weight**2 * drawn)
    margin = DEVIATIONS * np.sqrt(least * (1 - least) * spread + chance / REGISTERS) + 0.01
    open_ = (100 * small >= percent * large) & ((estimate >= least - margin) | (small < SURE))
    return np.where(open_, np.maximum(estimate, 0), -1.0)


def _sketch_batches(width: int):
    """Sizes, set numbers and sketches; a set's text and sketch go with its first row in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = byte_texts(batch.column("_t"))
            for lo, hi in blocks(texts):
                sets = [shingle_set(t, width) for t in texts[lo:hi]]
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes(), SEED) if len(s) else None for s in sets]
                nodes = [x - (1 << 64) if x is not None and x >> 63 else x for x in nodes]
                new = []
                for i, node in enumerate(nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        new.append(i)
                registers, keys = sketches([sets[i] for i in new])
                carried = {name: [None] * (hi - lo) for name in ("text", "registers", "keys")}
                for at, i in enumerate(new):
                    carried["text"][i] = texts[lo + i]
                    carried["registers"][i] = registers[at].tobytes()
                    carried["keys"][i] = keys[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(carried["text"], pa.binary()),
                        pa.array(carried["registers"], pa.binary()),
                        pa.array(carried["keys"], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "node", "text", "registers", "keys"],
                )

    return run


class _Shard:
    """Sets that share a band key, with their sizes and parts."""

    def __init__(self, batch: dict[str, np.ndarray]):
        self.node, self.n, self.part, self.registers = (batch[c] for c in ("node", "n", "part", "registers"))

    def compare(self, i: np.ndarray, other: _Shard, j: np.ndarray, percent: int) -> np.ndarray:
        """Estimates of the pairs (i, j), -1 for pairs of one part and those ruled out."""
        n, m = self.n[i], other.n[j]
        equal = (self.registers[i] == other.registers[j]).sum(axis=-1)
        score = may_link(equal, np.minimum(n, m), np.maximum(n, m), percent)
        return np.where(self.part[i] == other.part[j], -1.0, score)


def _pairs_of(ask: _Shard, held: _Shard, percent: int, best_only: bool) -> tuple[np.ndarray, ...]:
    """Pairs (asking, held) that may link; only the best partner of each asking set if so wished."""
    out = []
    step = max(1, (1 << 22) // (REGISTERS * len(held.node)))
    for lo in range(0, len(ask.node), step):
        i = np.arange(lo, min(lo + step, len(ask.node)))
        score = ask.compare(i[:, None], held, np.arange(len(held.node))[None], percent)
        if best_only:
            j = score.argmax(axis=1)
            good = score[np.arange(len(i)), j] >= 0
            out.append((ask.node[i[good]], held.node[j[good]], score[np.arange(len(i)), j][good]))
        else:
            row, j = np.nonzero(score >= 0)
            out.append((ask.node[i[row]], held.node[j], score[row, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _small_pairs(shard: _Shard, group: np.ndarray, percent: int, best_only: bool) -> tuple[np.ndarray, ...]:
    """The same for many small groups, whose rows stand together."""
    left, right, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.repeat(np.diff(np.append(first, len(group))), np.diff(np.append(first, len(group))))
    rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    for apart in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(rank + apart < size)
        for lo in range(0, len(i), 1 << 14):
            part = i[lo : lo + (1 << 14)]
            score = shard.compare(part, shard, part + apart, percent)
            good = score >= 0
            left.append(part[good])
            right.append(part[good] + apart)
            scores.append(score[good])
    i, j, s = np.concatenate(left), np.concatenate(right), np.concatenate(scores)
    if best_only:
        i, j, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
        order = np.lexsort((-s, i))
        i, j, s = i[order], j[order], s[order]
        top = np.ones(len(i), bool)
        top[1:] = i[1:] != i[:-1]
        i, j, s = i[top], j[top], s[top]
    return shard.node[i], shard.node[j], s


def _whole_shards(batches: Iterator[pa.RecordBatch], read, most: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows of some whole shards at a time; rows come sorted by shard, residents before askers.

    ``read`` gives the columns of a batch, with ``weight``; a shard whose askers
    outweigh ``most`` comes in turns, with its residents marked ``done`` from
    the second turn on.
    """
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = read(batch)
        for c in ("node", "n", "part", "asks"):
            rows[c] = batch.column(c).to_numpy(zero_copy_only=False)
        rows["done"] = np.zeros(batch.num_rows, bool)
        rows["shard"] = np.stack([batch.column("key").to_numpy(), batch.column("salt").to_numpy()], axis=1)
        held.append(rows)
        size += rows["weight"].sum()
        if size < most:
            continue
        whole = {k: np.concatenate([x[k] for x in held]) for k in rows}
        edge = np.flatnonzero((whole["shard"][1:] != whole["shard"][:-1]).any(axis=1))
        if len(edge):
            cut = int(edge[-1]) + 1
            yield {k: v[:cut] for k, v in whole.items()}
            held = [{k: v[cut:] for k, v in whole.items()}]
        elif whole["asks"][-1] and not whole["asks"].all():
            yield whole
            whole["done"][:] = True
            held = [{k: v[~whole["asks"]] for k, v in whole.items()}]
        elif whole["asks"].all():  # no residents: nobody to ask
            held = []
        else:
            held = [whole]
        size = sum(x["weight"].sum() for x in held)
    if held:
        yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}


def _starts(shard: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]).any(axis=1)]))


def _asking(own: dict[str, np.ndarray]) -> np.ndarray:
    """Rows that ask: askers, and residents outside of the shard's largest part."""
    names, of, times = np.unique(own["part"], return_inverse=True, return_counts=True)
    return ~own["done"] & (own["asks"] | (times[of] < times.max()) | (names[of] != names[times.argmax()]))


def _candidate_batches(percent: int, best_only: bool, most: int = 1 << 15, few: int = 12, dense: int = 4):
    """Pairs that may link, shard by shard; or the shard itself if it has too many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch):
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8)
            return {"registers": registers.reshape(-1, REGISTERS), "weight": np.ones(batch.num_rows, np.int64)}

        for rows in _whole_shards(batches, read, most):
            first = _starts(rows["shard"])
            count = np.diff(np.append(first, len(rows["node"])))
            plain = ~np.logical_or.reduceat(rows["asks"], first) & (count <= few)
            pick = np.repeat(plain, count)
            group = np.repeat(np.arange(len(first)), count)[pick]
            found = [_small_pairs(_Shard({k: v[pick] for k, v in rows.items()}), group, percent, best_only)]
            crowded = []
            for at, n in zip(first[~plain], count[~plain]):
                own = {k: v[at : at + n] for k, v in rows.items()}
                held = _Shard({k: v[~own["asks"]] for k, v in own.items()})
                ask = ~own["done"] if best_only else _asking(own)
                if not len(held.node) or not ask.any():
                    continue
                pairs = _pairs_of(_Shard({k: v[ask] for k, v in own.items()}), held, percent, best_only)
                if not best_only and len(pairs[0]) > dense * n:
                    crowded.append(own["shard"][0])
                else:
                    found.append(pairs)
            a, b, score = (np.concatenate(x) for x in zip(*found))
            key, salt = np.array(crowded, np.int64).reshape(-1, 2).T
            none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
            columns = [(pa.array(a), none(len(key))), (pa.array(b), none(len(key))), (pa.array(score), none(len(key), pa.float64()))]
            columns += [(none(len(a)), pa.array(key)), (none(len(a)), pa.array(salt))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "score", "key", "salt"])

    return run


def common_counts(ask: list[np.ndarray], held: list[np.ndarray], columns: int = 1 << 11) -> np.ndarray:
    """Sizes of the intersections of all sets of ``ask`` with all of ``held``."""
    out = np.zeros((len(ask), len(held)), np.float32)  # exact below 2^24
    if not ask or not held:
        return out.astype(np.int64)
    values = np.concatenate([*ask, *held])
    sizes = np.array([len(s) for s in [*ask, *held]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    ours = np.bincount(column, row < len(ask)) > 0
    theirs = np.bincount(column, row >= len(ask)) > 0
    number = np.cumsum(ours & theirs) - 1  # shingles of both sides only
    use = (ours & theirs)[column]
    column, row = number[column[use]], row[use]
    for lo in range(0, int(number[-1]) + 1, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        table = np.zeros((len(sizes), columns), np.float32)
        table[row[a:b], column[a:b] - lo] = 1
        out += table[: len(ask)] @ table[len(ask) :].T
    return out.astype(np.int64)


def _exact_batches(width: int, percent: int, most: int = 1 << 25):
    """Links inside crowded shards, confirmed on full sets: one for each pair of parts that become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch):
            texts = np.empty(batch.num_rows, object)
            texts[:] = byte_texts(batch.column("text"))
            return {"text": texts, "weight": np.fromiter(map(len, texts), np.int64, len(texts))}

        for rows in _whole_shards(batches, read, most):
            first = _starts(rows["shard"])
            left, right = [], []
            for at, n in zip(first, np.diff(np.append(first, len(rows["node"])))):
                own = {k: v[at : at + n] for k, v in rows.items()}
                ask, held = np.flatnonzero(_asking(own)), np.flatnonzero(~own["asks"])
                sets = {i: shingle_set(own["text"][i], width) for i in np.union1d(ask, held)}
                for lo in range(0, len(ask), 256):
                    part = ask[lo : lo + 256]
                    both = common_counts([sets[i] for i in part], [sets[j] for j in held])
                    total = own["n"][part, None] + own["n"][held][None] - both
                    i, j = np.nonzero((100 * both >= percent * total) & (own["part"][part, None] != own["part"][held][None]))
                    i, j = part[i], held[j]
                    once = np.unique(np.stack([own["part"][i], own["part"][j]]), axis=1, return_index=True)[1]
                    left.append(own["node"][i[once]])
                    right.append(own["node"][j[once]])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + left)), pa.array(np.concatenate(none + right))], names=["a", "b"])

    return run


def _confirm_batches(width: int, percent: int):
    """Pairs with the exact test on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b")):
                for node, text in ((x, s), (y, t)):
                    if node not in sets:
                        sets[node] = shingle_set(text.as_py(), width)
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def linked_sets(nodes: DataFrame, texts: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """``(node, component)`` of sets that are linked with others.

    ``nodes`` has node, n, registers and keys, one row per set, and ``texts``
    a text for each. First each set is tried with its best partners under all
    its keys. Then, where the sets of a key still lie in several components,
    all pairs between different components whose registers allow a link are
    tried, so that no link between components stays unseen. A key of more than
    ``block`` sets is dealt into several tasks; in the second step its sets
    outside of its largest component ask in all of them.
    """
    able = nodes.filter(100 * F.col("n") >= percent * (F.col("n") + 1))  # smaller ones equal or differ too much
    keyed = able.select("node", "n", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("all")).filter("count > 1")
    salts = F.ceil(F.greatest(F.col("count") / block, F.col("all") / (block * 1024))).cast("long")
    shards = keyed.join(often, "key").select("key", "node", salts.alias("salts")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    shards = stage(shards, "shards")
    met = shards.select("node").distinct()
    texts = stage(texts.join(met, "node", "left_semi").dropDuplicates(["node"]), "met_texts")
    sketch = able.select("node", "n", "registers")

    def dealt(rows: DataFrame, columns: DataFrame, *names: str) -> DataFrame:
        joined = rows.join(columns, "node").select("key", "salt", "asks", "node", "n", "part", *names)
        return joined.repartition("key", "salt").sortWithinPartitions("key", "salt", "asks")

    def candidates(rows: DataFrame, best_only: bool) -> DataFrame:
        found = dealt(rows, sketch, "registers").mapInArrow(
            _candidate_batches(percent, best_only), "a long, b long, score double, key long, salt long"
        )
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        return found.groupBy(*pair, "key", "salt").agg(F.max("score").alias("score"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_confirm_batches(width, percent), "a long, b long, linked boolean")

    first = stage(candidates(shards.withColumns({"asks": F.lit(False), "part": F.col("node")}), True), "best_partners")
    # a set has at most one row per band here
    own = first.select("a", "b", "score", F.explode(F.array("a", "b")).alias("node"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "a", "b"))
    tried = stage(confirmed(own.withColumn("place", place).filter("place <= 3").select("a", "b").distinct()), "tried")
    links = tried.filter("linked").select("a", "b")
    parts = stage(components(links), "first_parts")
    split = shards.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    split = stage(split, "parts")
    spread = split.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    split = split.join(spread, "key", "left_semi")
    residents = split.select("key", "salt", "node", "part", F.lit(False).alias("asks"))
    many = split.filter("salts > 1")
    sizes = many.groupBy("key", "part").count()
    main = sizes.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    askers = many.join(main, "key").filter("part <> main").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "node", "part", F.lit(True).alias("asks")
    )
    asking = stage(residents.unionByName(askers), "asking")
    more = stage(candidates(asking, False), "later_pairs")
    late = confirmed(more.filter("a IS NOT NULL").join(tried, ["a", "b"], "left_anti")).filter("linked").select("a", "b")
    crowded = asking.join(more.filter("key IS NOT NULL").select("key", "salt").distinct(), ["key", "salt"], "left_semi")
    exact = dealt(crowded, texts.join(able.select("node", "n"), "node"), "text").mapInArrow(_exact_batches(width, percent), "a long, b long")
    return components(links.unionByName(late).unionByName(exact))


def minhash_groups(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, block: int = BLOCK
) -> DataFrame:
    """``(id, n_shingles, component)`` for each row of ``docs``.

    Words are lower-cased in A–Z. Rows are linked if 100 * intersection >=
    ``percent`` * union of their sets of distinct ``width``-word shingles; a
    text of fewer words is one shingle. Null, empty and blank texts have an
    empty set and are linked with nothing: their component is their own id.
    The component of other rows is the smallest id reachable (null only if all
    its ids are null). Equal sets are one node, so repeated rows and large
    groups of copies cost one; sets are compared as sets of 64-bit hashes.
    Texts of any length are read whole. Other columns of ``docs`` are not
    read; an empty table gives an empty table. Runs jobs.
    """
    prepare(docs.sparkSession)
    plain = docs.select(named(docs, ident).alias("id"), text_of(docs, text).alias("_t"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = plain.mapInArrow(_sketch_batches(width), f"id {kind}, n long, node long, text binary, registers binary, keys array<bigint>")
    rows = stage(rows, "sketches")
    carried = rows.filter("registers IS NOT NULL")
    nodes = stage(carried.select("node", "n", "registers", "keys").dropDuplicates(["node"]), "nodes")
    linked = stage(linked_sets(nodes, carried.select("node", "text"), width, percent, block), "components")
    least = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    placed = least.join(linked, "node", "left").select("node", "least", "rows", F.coalesce("component", "node").alias("part"))
    placed = stage(placed, "placed")
    lowest = placed.groupBy("part").agg(F.min("least").alias("component"), F.count("*").alias("times"))
    named_nodes = stage(join_one(placed, lowest, "part", "times").select("node", "component", "rows"), "named_nodes")
    full = join_one(rows.filter("node IS NOT NULL").select("id", "n", "node"), named_nodes, "node", "rows")
    bare = rows.filter("node IS NULL").select("id", "n", F.col("id").alias("component"))
    return full.select("id", "n", "component").unionByName(bare).select("id", F.col("n").alias("n_shingles"), "component")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    found = minhash_groups(docs)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
