"""Keyword classification, keyword search and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql import types as T

from lorespark.functions import rules, text as tx
from lorespark.operators.chunking import let
from lorespark.session import cut_lineage

#: Query tokens up to this number are sent to every task.
SMALL_TABLE = 200_000
#: Runs whose tokens a task remembers; frequent ones come early, later ones are searched in every block.
KNOWN_RUNS = 1 << 18
#: Bytes that query tokens hold; a lowered text is searched run by run of them.
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"abcdefghijklmnopqrstuvwxyz0123456789_'-")] = True


def classify(
    text: Column, keywords: Mapping[str, Sequence[str]] = rules.CLASSIFIER_KEYWORDS
) -> Column:
    """Category with the most substring hits; earlier category wins a tie."""

    def ranked(lowered: Column) -> Column:
        scores = [
            sum((tx.count_substring(lowered, F.lit(k)) for k in words), F.lit(0))
            for words in keywords.values()
        ]
        return F.array_max(F.array(
            *[
                F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))
                for i, (name, score) in enumerate(zip(keywords, scores))
            ]
        ))

    # a filter on the category would else count once for each use of the winner
    best = lambda b: F.when(b["score"] > 0, b["name"]).otherwise("general")
    return let(let(F.lower(text), ranked), best)


def detect_categories(
    text: Column, category_rules: Sequence[rules.CategoryRule] = rules.CATEGORY_RULES
) -> Column:
    """All categories hit by a whole-term keyword, with parents, in rule order."""
    hits = {
        rule.name: any_term(text, rule.keywords) for rule in category_rules if rule.keywords
    }
    for rule in category_rules:
        if rule.parent and rule.name in hits:
            hits[rule.parent] = hits.get(rule.parent, F.lit(False)) | hits[rule.name]
    names = [rules.BROAD_CATEGORY] if rules.BROAD_CATEGORY in hits else []
    names += [
        r.name
        for r in category_rules
        if r.name in hits and r.name not in (rules.BROAD_CATEGORY, rules.DEFAULT_CATEGORY)
    ]
    return F.array_compact(
        F.array(*[F.when(hits[n], F.lit(n)) for n in names], F.lit(rules.DEFAULT_CATEGORY))
    )


def primary_category(
    text: Column, category_rules: Sequence[rules.CategoryRule] = rules.CATEGORY_RULES
) -> Column:
    """First narrow rule that hits, then the broad one, then the default."""
    narrow = [
        r
        for r in category_rules
        if r.keywords and r.name not in (rules.BROAD_CATEGORY, rules.DEFAULT_CATEGORY)
    ]
    broad = [r for r in category_rules if r.name == rules.BROAD_CATEGORY]
    options = [F.when(any_term(text, r.keywords), F.lit(r.name)) for r in narrow + broad]
    return F.coalesce(*options, F.lit(rules.DEFAULT_CATEGORY))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    # one alternation instead of one scan of the text per keyword
    return text.rlike(tx.any_term_pattern(terms))


def search(
    chunks: DataFrame,
    queries: DataFrame,
    query_id: str,
    query_text: str,
    chunk_key: Sequence[str],
    content: str,
    limit: int = 10,
    category: str | None = None,
) -> DataFrame:
    """Exact top ``limit`` chunks per query by summed token counts.

    ``category`` keeps only chunks whose ``category`` column has that value,
    before any text is cut into tokens.

    A query token is a substring of a chunk exactly when it is a substring of
    one of the chunk's distinct maximal token runs, because tokens hold only
    run characters. So distinct runs (a vocabulary) are matched with distinct
    query tokens, which gives postings (chunk, token, count) by an equi-join.

    That path exchanges every scored pair, so it serves only query sets of
    more than ``SMALL_TABLE`` tokens. Smaller ones are sent to the tasks, which
    count tokens in their chunks and keep the best ``limit`` of each query
    (``TopChunks``); then only those rows are exchanged. Runs jobs.
    """
    terms = (
        queries.select(query_id, F.explode(tx.query_tokens(F.col(query_text))).alias("token"))
        .groupBy(query_id, "token")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    terms = cut_lineage(terms)
    if category is not None:
        chunks = chunks.filter(F.col("category") == category)
    lowered = F.lower(F.col(content))
    sample = terms.limit(SMALL_TABLE + 1).collect()
    if len(sample) <= SMALL_TABLE:
        scored = _best_in_tasks(chunks.select(*chunk_key, lowered.alias("__text")), sample, terms.select(query_id), list(chunk_key), limit)
    else:
        scored = _scored_pairs(chunks, lowered, terms, query_id, list(chunk_key))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), *chunk_key)
    return (
        scored.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
    )


def _scored_pairs(chunks: DataFrame, lowered: Column, terms: DataFrame, query_id: str, chunk_key: list[str]) -> DataFrame:
    """(query, chunk key, score) of all pairs with a hit, by joins on runs and tokens."""
    runs = chunks.select(*chunk_key, F.explode(F.regexp_extract_all(lowered, F.lit(r"([a-z0-9_'-]{2,})"), 1)).alias("run"))
    runs = runs.groupBy(*chunk_key, "run").agg(F.count(F.lit(1)).alias("times"))
    hits = vocabulary_hits(runs.select("run").distinct(), terms.select("token").distinct())
    # counts per chunk and token first: far fewer rows than runs times queries
    counted = runs.join(hits, "run").groupBy(*chunk_key, "token").agg(
        F.sum(F.col("times") * F.col("occurrences")).alias("n")
    )
    return (
        counted.join(terms, "token")
        .groupBy(query_id, *chunk_key)
        .agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    )


def _best_in_tasks(chunks: DataFrame, terms: Sequence[Row], ids: DataFrame, chunk_key: list[str], limit: int) -> DataFrame:
    """(query, chunk key, score): at most ``limit`` rows per query and task."""
    names = list(dict.fromkeys(t[0] for t in terms))
    number = {name: i for i, name in enumerate(names)}
    weights = [(number[q], token, weight) for q, token, weight in terms]
    keys = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in chunk_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopChunks(weights, len(names), limit)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column("__text"), batch.select(chunk_key))
        yield from best.rows()

    found = chunks.mapInArrow(run, f"__query long, {keys}, score long")
    table = chunks.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("__query", T.LongType()), ids.schema[0]]))
    return found.join(F.broadcast(table), "__query").select(ids.columns[0], *chunk_key, "score")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, … of each of the sizes, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _runs_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of token characters, and the row of each."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if data is None:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IN_RUN[body]
    edge = bounds[(bounds > 0) & (bounds < len(body))]  # a run ends with its text
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    first = np.flatnonzero(begins)
    places = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - first)])
    buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(body[inside])]
    return pa.Array.from_buffers(pa.large_string(), len(first), buffers), np.searchsorted(bounds, first, "right") - 1


class TopChunks:
    """The best chunks of every query among those added so far.

    Token counts of a block of chunks form a matrix. The largest count of each
    token in the block bounds the score that a query can reach there; blocks
    that cannot beat a query's current last place are skipped for it, and the
    others are scored by one matrix product.
    """

    def __init__(self, weights: Sequence[tuple[int, str, int]], queries: int, limit: int, columns: int = 1 << 12):
        self.limit, self.columns = limit, columns
        tokens = list(dict.fromkeys(t for _, t, _ in weights))
        place = {t: i for i, t in enumerate(tokens)}
        self.finder = ahocorasick.Automaton()
        # a token that can overlap itself is counted like str.count does
        self.again = np.zeros(len(tokens), np.int64)
        for token, i in place.items():
            if any(token.startswith(token[k:]) for k in range(1, len(token))):
                self.again[i] = len(token)
            self.finder.add_word(token, i)
        self.finder.make_automaton()
        self.size, self.queries = len(tokens), queries
        self.query = np.array([q for q, _, _ in weights], np.int64)
        self.token = np.array([place[t] for _, t, _ in weights], np.int64)
        self.weight = np.array([w for _, _, w in weights], np.float64)
        self.least = np.zeros(queries)
        self.kept: pa.Table | None = None
        # runs met before: their places, and where their tokens lie in ``tokens``
        self.known: dict[str, int] = {}
        self.size_of, self.first_of, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _found(self, runs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(run, token) of all occurrences in the runs, in the order of runs."""
        # a blank is part of no token, so none is found across two runs
        ends = np.cumsum([len(run) + 1 for run in runs])
        found = np.fromiter(chain.from_iterable(self.finder.iter(" ".join(runs))), np.int64).reshape(-1, 2)
        at, token = found[:, 0], found[:, 1]
        keep = np.ones(len(at), bool)
        last: dict[int, int] = {}
        for i in np.flatnonzero(self.again[token] > 0).tolist():
            end, which = int(at[i]), int(token[i])
            if end - self.again[which] < last.get(which, -1):
                keep[i] = False
            else:
                last[which] = end
        return np.searchsorted(ends, at[keep], "right"), token[keep]

    def _tokens_of(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens of each distinct run, and the first of them in an array of tokens."""
        place = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(place < 0)
        run, token = self._found([runs[i] for i in new.tolist()])
        size = np.bincount(run, minlength=len(new))
        first = np.cumsum(size) - size + len(self.tokens)
        place[new] = len(self.size_of) + np.arange(len(new))
        sizes, firsts, tokens = (np.concatenate(x) for x in ((self.size_of, size), (self.first_of, first), (self.tokens, token)))
        room = max(0, KNOWN_RUNS - len(self.known))
        if room and len(new):
            n = min(room, len(new))
            self.known.update(zip((runs[i] for i in new[:n].tolist()), range(len(self.size_of), len(self.size_of) + n)))
            self.size_of, self.first_of = sizes[: len(self.size_of) + n], firsts[: len(self.first_of) + n]
            self.tokens = tokens[: len(self.tokens) + int(size[:n].sum())]
        return sizes[place], firsts[place], tokens

    def _cells(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that occur, and the row and the place among them of each occurrence.

        Tokens hold run characters only, so each distinct run is searched once.
        """
        words, row = _runs_of(pa.array(texts, pa.string()) if isinstance(texts, Sequence) else texts)
        words = words.dictionary_encode()
        size, first, tokens = self._tokens_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        token = tokens[_ranges(first, size)]
        used = np.flatnonzero(np.bincount(token, minlength=self.size))
        place = np.zeros(self.size, np.int64)
        place[used] = np.arange(len(used))
        # the places of each distinct run, then those of each of its occurrences
        place, first = place[token], np.cumsum(size) - size
        at = words.indices.to_numpy()
        hit = np.flatnonzero(size[at])
        at = at[hit]
        return used, np.repeat(row[hit], size[at]), place[_ranges(first[at], size[at])]

    def counts(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, token) cells of all occurrences, one entry each."""
        used, row, cell = self._cells(texts)
        return row, used[cell]

    def add(self, texts: Sequence[str] | pa.Array, keys: pa.RecordBatch) -> None:
        if not self.size:
            return
        used, row, cell = self._cells(texts)
        column = np.full(self.size, -1)
        column[used] = np.arange(len(used))
        table = np.bincount(row * len(used) + cell, minlength=len(texts) * len(used)).reshape(len(texts), -1)
        hit = column[self.token] >= 0
        query, place, weight = self.query[hit], column[self.token[hit]], self.weight[hit]
        bound = np.bincount(query, weight * table.max(axis=0, initial=0)[place], self.queries)
        open_ = np.flatnonzero((bound > 0) & (bound >= self.least))  # a tie may win by its key
        # whole numbers up to 2 ** 24 are exact in four bytes, in sums of any order
        kind = np.float32 if bound.max(initial=0) < 1 << 24 else np.float64
        table = table.astype(kind)
        number = np.full(self.queries, -1)
        number[open_] = np.arange(len(open_))
        found = []
        for lo in range(0, len(open_), self.columns):
            part = open_[lo : lo + self.columns]
            mine = (number[query] >= lo) & (number[query] < lo + len(part))
            matrix = np.zeros((len(used), len(part)), kind)
            matrix[place[mine], number[query[mine]] - lo] = weight[mine]
            score = table @ matrix
            top = np.partition(score, -self.limit, axis=0)[-self.limit] if len(texts) > self.limit else np.zeros(len(part))
            i, j = np.nonzero((score > 0) & (score >= np.maximum(top, self.least[part])))
            found.append((part[j], i, score[i, j].astype(np.int64)))
        if found:
            of, i, score = (np.concatenate(x) for x in zip(*found))
            self._keep(of, pa.Table.from_batches([keys]).take(pa.array(i)), score)

    def _keep(self, query: np.ndarray, keys: pa.Table, score: np.ndarray) -> None:
        new = pa.table([pa.array(query), *keys.columns, pa.array(score)], names=["__query", *keys.column_names, "score"])
        both = pa.concat_tables([self.kept, new]) if self.kept is not None else new
        order = [("__query", "ascending"), ("score", "descending"), *[(c, "ascending") for c in keys.column_names]]
        both = both.take(pc.sort_indices(both, sort_keys=order, null_placement="at_start"))
        query = both.column("__query").to_numpy()
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        last = rank == self.limit - 1
        self.least[query[last]] = both.column("score").to_numpy()[last]
        self.kept = both.filter(pa.array(rank < self.limit))

    def rows(self) -> list[pa.RecordBatch]:
        return self.kept.combine_chunks().to_batches() if self.kept is not None else []


def vocabulary_hits(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(run, token, occurrences) for every token contained in a vocabulary run.

    Containment becomes an equi-join on the token's length and text: each run
    is cut into its substrings of the lengths that tokens really have.
    """
    lengths = tokens.select(F.collect_set(F.length("token"))).scalar()
    pieces = F.flatten(
        F.transform(
            F.filter(F.col("lengths"), lambda n: n <= F.length("run")),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, n)
            ),
        )
    )
    # one small array: as many values as there are token lengths
    cut = vocabulary.withColumn("lengths", lengths).select(
        "run", F.explode(F.array_distinct(pieces)).alias("token")
    )
    return cut.join(tokens, "token").select(
        "run", "token", tx.count_substring(F.col("run"), F.col("token")).alias("occurrences")
    )


def corpus_statistics(chunks: DataFrame, category: str, first: Column) -> DataFrame:
    """(measure, category, n): documents, chunks and chunks per category.

    ``first`` marks one chunk of each document. The chunks are read once: all
    rows come from one aggregate per category, which is kept. Runs a job.
    """
    per = cut_lineage(chunks.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("__docs")))
    none = F.lit(None).cast("string").alias("category")

    def total(measure: str, column: str) -> DataFrame:
        n = F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
        return per.agg(n.alias("n")).select(F.lit(measure).alias("measure"), none, "n")

    each = per.select(F.lit("category").alias("measure"), F.col(category).alias("category"), "n")
    return total("documents", "__docs").unionByName(total("chunks", "n")).unionByName(each)
