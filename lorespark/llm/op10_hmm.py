"""Scoring texts by a hidden Markov language model.

Words are counted over all training texts. Frequent words (each at least
``2 ** -HEAVY`` of all tokens, so at most ``2 ** HEAVY`` of them) are symbols
of their own; a text ends with an end symbol, and every other word is the
symbol "rare" times its share among rare words, which a join with the counts
supplies. Baum-Welch counts of all training texts are summed across tasks;
the scaled forward recursion then gives the exact likelihood of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import held_out, named, stable_values, stage, text_of
from lorespark.session import prepare

HEAVY = 18
#: Latent states; Baum-Welch passes, each over all training texts.
STATES, PASSES = 6, 14
#: Training texts are read in stretches of so many tokens.
STRETCH = 128
#: Stretches that are read in step.
BLOCK = 4096
#: Tokens whose emissions are summed by symbol at once.
TOGETHER = 1 << 20
#: Tokens that are counted or scored at once.
MANY = 1 << 22
#: Steps after which probabilities are scaled again; the smallest that a step
#: can have (1e-16 of the token before) stay far above 1e-308 until then.
TURN = 8
#: Pseudo-tokens of a state, spread like the symbols overall.
PRIOR = 200.0
#: The end of a text among the counted words; no word is empty.
END = b""


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a batch of texts, and the number of each word's text."""
    # seen as strings without a check: only bytes below 128 are looked at
    texts = pc.fill_null(column.cast(pa.binary()), b"").view(pa.string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at an edge leaves an empty part
    return words.filter(full).view(pa.binary()), pc.list_parent_indices(parts).filter(full).to_numpy()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    texts = 0

    def flush() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([found.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([found.field(1), pa.array([texts], pa.int64())])],
            names=["word", "n"],
        )

    for batch in batches:
        held.append(words_of(batch.column("_t"))[0])
        texts += batch.num_rows
        if sum(map(len, held)) >= MANY:
            yield flush()
            held, texts = [], 0
    if texts:
        yield flush()


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _symbol_batches(shared):
    """Texts as symbols, with their rare words and the counts of the others.

    Symbols are four bytes each in one value: every pass reads them, and arrays
    would be taken apart and put together again number by number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, logs = shared.value
        end, rare = len(heavy), len(heavy) + 1
        heavy = pa.array(list(heavy), pa.binary())  # in the order of their numbers
        for batch in batches:
            n = batch.num_rows
            words, text = words_of(batch.column("_t"))
            words = words.dictionary_encode()
            code = pc.index_in(words.dictionary, heavy).fill_null(rare).to_numpy()
            word = words.indices.to_numpy()
            symbols = code[word]
            bounds = np.searchsorted(text, np.arange(n + 1)) + np.arange(n + 1)
            body = np.full(len(symbols) + n, end, "<i4")
            body[np.arange(len(symbols)) + text] = symbols
            coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(body)])
            # one entry for each text and rare word of it
            light = np.flatnonzero(symbols == rare)
            pairs, times = np.unique(text[light] * max(1, len(code)) + word[light], return_counts=True)
            owner, which = np.divmod(pairs, max(1, len(code)))
            per_text = np.searchsorted(owner, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "trains", "number")), coded,
                    _lists(per_text, words.dictionary.take(pa.array(which))), _lists(per_text, pa.array(times, pa.int64())),
                    pa.array(np.bincount(text, logs[symbols], n)),
                ],
                names=["id", "trains", "number", "symbols", "rare", "times", "heavy_log"],
            )

    return run


@dataclass
class Hmm:
    """Start, start of a later stretch, transitions, and emissions by symbol."""

    start: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol by state


def first_model(shares: np.ndarray, states: int = STATES) -> Hmm:
    """A fixed start: sticky states, emissions that differ a little."""
    noise = (stable_values(len(shares) * states, 10) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    emit = shares[:, None] * (0.5 + noise.reshape(-1, states))
    even = np.full(states, 1 / states)
    move = np.full((states, states), 0.3 / max(1, states - 1))
    np.fill_diagonal(move, 0.7)
    return Hmm(even, even.copy(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


@dataclass
class Counts:
    """Expected starts, later starts, transitions and emissions."""

    start: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def none(symbols: int, states: int) -> Counts:
        return Counts(np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def stretches(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and "begins a text" of each stretch."""
    count = -(-np.diff(bounds) // STRETCH)
    text = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[text] + within * STRETCH
    return first, np.minimum(STRETCH, bounds[text + 1] - first), within == 0


def expect(model: Hmm, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, begins: np.ndarray, into: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Add the Baum-Welch counts of stretches, all of them in step, but for emissions.

    Those are returned: symbols, and the state probabilities at each of them.
    Probabilities ahead are scaled every ``TURN`` steps; those back begin with
    one over a stretch's total, so that their products need no division.
    """
    order = np.argsort(-size, kind="stable")
    first, size, begins = first[order], size[order], begins[order]
    longest = int(size[0]) if len(size) else 0
    states, kind = into.move.shape[0], model.emit.dtype
    if not longest:
        return np.zeros(0, np.int64), np.zeros((0, states), kind)
    # step by step, the stretches that still go on; a row for each of them
    active = len(size) - np.searchsorted(size[::-1], np.arange(longest), "right")
    edges = [0, *np.cumsum(active).tolist()]
    places = symbols[np.concatenate([first[:n] + t for t, n in enumerate(active.tolist())])].astype(np.int64)
    seen = model.emit.take(places, axis=0)
    ahead = np.empty_like(seen)
    scale: dict[int, np.ndarray] = {}
    for t in range(longest):
        lo, hi = edges[t], edges[t + 1]
        a = ahead[lo:hi]
        if t == 0:
            a[:] = np.where(begins[:, None], model.start, model.later)
        else:
            np.matmul(ahead[edges[t - 1] : edges[t - 1] + hi - lo], model.move, out=a)
        a *= seen[lo:hi]
        if t % TURN == TURN - 1:
            scale[t] = 1 / a.sum(axis=1, keepdims=True)
            a *= scale[t]
    back, follow = np.empty((len(first), states), kind), np.empty((len(first), states), kind)
    moved, come_from, m = np.zeros((states, states)), np.ascontiguousarray(model.move.T), 0
    for t in range(longest - 1, -1, -1):
        lo, hi = edges[t], edges[t + 1]
        if m:
            then = follow[:m]
            np.multiply(back[:m], seen[hi : hi + m], out=then)
            if t + 1 in scale:
                then *= scale[t + 1]
            moved += ahead[lo : lo + m].T @ then
            np.matmul(then, come_from, out=back[:m])
        back[m : hi - lo] = 1 / ahead[lo + m : hi].sum(axis=1, keepdims=True)  # stretches that end here
        m = hi - lo
        ahead[lo:hi] *= back[:m]  # the earlier steps do not need it any more
    into.move += moved * model.move
    into.start += ahead[: edges[1]][begins].sum(axis=0)
    into.later += ahead[: edges[1]][~begins].sum(axis=0)
    return places, ahead


def add_emissions(found: list[tuple[np.ndarray, np.ndarray]], into: Counts) -> None:
    """Sum the state probabilities by symbol."""
    places = np.concatenate([x for x, _ in found])
    for k in range(into.emit.shape[1]):
        into.emit[:, k] += np.bincount(places, np.concatenate([x[:, k] for _, x in found]), len(into.emit))


def maximise(counts: Counts, shares: np.ndarray) -> Hmm:
    """The model of the counts, smoothed towards the overall shares."""
    even = 1 / len(counts.start)
    start = (counts.start + even) / (counts.start.sum() + 1)
    later = (counts.later + even) / (counts.later.sum() + 1)
    move = (counts.move + even) / (counts.move.sum(axis=1, keepdims=True) + 1)
    emit = (counts.emit + PRIOR * shares[:, None]) / (counts.emit.sum(axis=0) + PRIOR)
    return Hmm(start, later, move, emit)


def _symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a batch, and the place where each text begins; no text is without one."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(data, "<i4", int(bounds[-1])), bounds


def _together(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold so many symbols."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column("symbols").nbytes for b in held) >= 4 * tokens:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _expect_batches(shared, n_symbols: int, states: int):
    """Baum-Welch counts of a task: one row for each symbol that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        total = Counts.none(n_symbols, states)
        found, held = [], 0
        for batch in _together(batches, TOGETHER):
            symbols, bounds = _symbols_of(batch.column("symbols"))
            first, size, begins = stretches(symbols, bounds)
            # stretches of like lengths in blocks of like sizes
            for part in np.array_split(np.argsort(-size, kind="stable"), -(-len(first) // BLOCK) or 1):
                found.append(expect(model, symbols, first[part], size[part], begins[part], total))
                held += len(found[-1][0])
                if held >= TOGETHER:
                    add_emissions(found, total)
                    found, held = [], 0
        if found:
            add_emissions(found, total)
        used = np.flatnonzero(total.emit.any(axis=1))
        # after the symbols: starts, later starts and the rows of transitions
        extra = np.stack([total.start, total.later, *total.move])
        key = np.concatenate([used, n_symbols + np.arange(len(extra))])
        rows = np.concatenate([total.emit[used], extra])
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(rows[:, k].copy()) for k in range(states))], names=["key", *(f"s{k}" for k in range(states))])

    return run


def baum_welch(texts: DataFrame, model: Hmm, shares: np.ndarray) -> Hmm:
    """One pass over all training texts; the counts of tasks are summed by key."""
    states, n = len(model.start), len(shares)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]
    schema = "key long, " + ", ".join(f"{c} double" for c in names)
    summed = texts.mapInArrow(_expect_batches(shared, n, states), schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
    found = summed.toPandas()  # at most one row for each symbol
    table = np.zeros((n + 2 + states, states))
    table[found["key"].to_numpy()] = found[names].to_numpy()
    return maximise(Counts(table[n], table[n + 1], table[n + 2 :], table[:n]), shares)


def log_likelihoods(model: Hmm, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's probability by the scaled forward recursion."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, ordered = bounds[:-1][order], size[order]
    total = np.zeros(len(order))
    # texts that hold each step, and none after the last
    active = np.searchsorted(-ordered, -np.arange(int(ordered[0]) + 1 if len(ordered) else 1), "left").tolist()
    state = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, (n, more) in enumerate(zip(active, active[1:])):
        if t:
            state = state[:n] @ model.move
        state = state * model.emit.take(symbols[first[:n] + t], axis=0)
        if more < n:
            total[more:n] += np.log(state[more:].sum(axis=1))
        if t % TURN == TURN - 1:
            scale = state[:more].sum(axis=1)
            state[:more] /= scale[:, None]
            total[:more] += np.log(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        rare = len(model.emit) - 1
        # one long text alone takes as many steps as with thousands beside it
        for batch in _together(batches, MANY):
            symbols, bounds = _symbols_of(batch.column("symbols"))
            score = log_likelihoods(model, symbols, bounds) / np.log(10)
            n_rare = np.add.reduceat(symbols == rare, bounds[:-1], dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("number"), pa.array(np.diff(bounds)), pa.array(n_rare), batch.column("heavy_log"), pa.array(score)],
                names=["id", "number", "n_tokens", "n_rare", "heavy_log", "forward"],
            )

    return run


def score_texts(docs: DataFrame, train: Column, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Learns from the rows where ``train`` holds, words lower-cased in A–Z.
    ``base_score`` is the add-one unigram log10 probability, ``score`` that of
    the hidden Markov model. Null and empty texts are the end token alone;
    without training rows nothing is known and words count as one rare
    symbol; repeated rows train and score once each; an empty table gives an
    empty table. Runs jobs.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.select(
        named(docs, ident).alias("id"), F.coalesce(train, F.lit(False)).alias("trains"),
        F.monotonically_increasing_id().alias("number"), text_of(docs, text).cast("binary").alias("_t"),
    )
    counted = plain.filter("trains").select("_t").mapInArrow(_count_batches, "word binary, n long")
    counts = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = F.col("word") == F.lit(END)
    ends = counts.filter(end).select("n").first()
    n_end = ends["n"] if ends else 0
    is_heavy = (F.col("n") * float(1 << HEAVY) >= size["n"]) & ~end
    frequent = counts.filter(is_heavy).orderBy(F.desc("n"), "word").collect()  # at most 2 ** HEAVY rows
    heavy = [bytes(r["word"]) for r in frequent]
    amounts = np.array([*(r["n"] for r in frequent), n_end], np.float64)
    n_rare, v_rare = size["n"] - int(amounts.sum()), size["v"] - len(heavy) - bool(ends)
    logs = np.log10(np.append(amounts, 0) + 1)  # nothing for a rare word, which is joined
    kind = plain.schema["id"].dataType.simpleString()
    schema = f"id {kind}, trains boolean, number long, symbols binary, rare array<binary>, times array<long>, heavy_log double"
    coded = stage(plain.mapInArrow(_symbol_batches(spark.sparkContext.broadcast((heavy, logs))), schema), "symbols")

    shares = (np.append(amounts, n_rare) + 1) / (size["n"] + len(amounts) + 1)
    model = first_model(shares)
    texts = coded.filter("trains").select("symbols")
    if size["n"]:
        for _ in range(PASSES):
            model = baum_welch(texts, model, shares)

    scored = coded.select("id", "number", "symbols", "heavy_log").mapInArrow(
        _score_batches(spark.sparkContext.broadcast(model)),
        f"id {kind}, number long, n_tokens long, n_rare long, heavy_log double, forward double",
    )
    single = coded.select("number", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "number", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    known = single.join(counts.filter(~is_heavy & ~end), "word").groupBy("number").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log")
    )
    joined = scored.join(known, "number", "left").fillna(0, ["rare_known"]).fillna(0.0, ["rare_log"])
    base_norm = float(np.log10(size["n"] + size["v"] + 1))
    rare_norm = float(np.log10(n_rare + v_rare + 1))
    return joined.select(
        "id", "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + F.col("rare_known") - F.lit(0 if ends else 1)).alias("n_known"),
        F.lit(int(size["n"])).cast("long").alias("train_tokens"),
        (F.col("heavy_log") + F.lit(float(logs[len(heavy)])) + F.col("rare_log") - F.col("n_tokens") * F.lit(base_norm)).alias("base_score"),
        (F.col("forward") + F.col("rare_log") - F.col("n_rare") * F.lit(rare_norm)).alias("score"),
    )


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    scored = score_texts(docs, ~held_out("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
