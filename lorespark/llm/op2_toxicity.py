"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents carry labels. A sentence's probability is logistic in its
words, a document's is the noisy-or of its sentences, and the weights follow
from the document labels through that formula. The same weights then say
which sentences offend.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import held_out, named, stage, text_of
from lorespark.session import prepare

#: The classifier is fitted on at most so many labelled documents.
SAMPLE = 20_000
#: Words it may weigh: at most so many, in at least ``MIN_DOCS`` sampled
#: documents, and so many standard errors more frequent in labelled ones.
WORDS, MIN_DOCS, ERRORS = 4096, 4, 3.5

#: ASCII sentence ends become line feeds, other ASCII non-word signs spaces.
_SIGNS = bytes(
    10 if chr(b) in ".!?\n" else b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256)
)


def sentences(text: str) -> list[bytes]:
    """Lower-cased sentences, words parted by spaces."""
    return text.lower().encode("utf-8", "replace").translate(_SIGNS).split(b"\n")


@dataclass
class Bags:
    """Labelled documents as (document, sentence kind, word) index arrays."""

    label: np.ndarray
    bag: np.ndarray  # document of each distinct sentence
    times: np.ndarray  # how often the document has it
    sentence: np.ndarray  # pairs: sentence, word
    word: np.ndarray


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        """Document probability, and sentences with a word that counts."""
        parts = sentences(text)
        known = self.weights.keys() & set(b" ".join(parts).split())
        quiet = len(parts)
        log_clean, found = 0.0, []
        if known:
            for i, part in enumerate(parts):
                hits = known.intersection(part.split())
                if hits:
                    z = self.bias + sum(self.weights[w] for w in sorted(hits))
                    log_clean -= np.logaddexp(0.0, z)
                    found.append((i, float(1 / (1 + np.exp(-z)))))
                    quiet -= 1
        log_clean -= quiet * np.logaddexp(0.0, self.bias)
        return float(min(1.0, max(0.0, -np.expm1(log_clean)))), found


def fit(bags: Bags, n_words: int, steps: int = 300, rate: float = 0.1, shrink: float = 2e-5) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the noisy-or likelihood of the labels.

    Weights stay at or above zero: a word can make a sentence offend and none
    can excuse it. Adam on the whole sample; deterministic.
    """
    weights, bias = np.zeros(n_words), -6.0
    moment, power = np.zeros(n_words + 1), np.zeros(n_words + 1)
    n = len(bags.label)
    for step in range(1, steps + 1):
        z = bias + np.bincount(bags.sentence, weights[bags.word], len(bags.bag))
        p = 1 / (1 + np.exp(-z))
        log_clean = -np.bincount(bags.bag, bags.times * np.logaddexp(0, z), n)
        dirty = -np.expm1(np.minimum(log_clean, -1e-9))
        slope = np.where(bags.label == 1, (1 - dirty) / dirty, -1.0)
        pull = slope[bags.bag] * bags.times * p / n
        gradient = np.append(np.bincount(bags.word, pull[bags.sentence], n_words) - shrink * weights, pull.sum())
        moment = 0.9 * moment + 0.1 * gradient
        power = 0.99 * power + 0.01 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-9)
        weights = np.maximum(0, weights + move[:-1])
        bias = min(-2.0, bias + float(move[-1]))
    return bias, weights


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, labelled documents, other documents) summed per batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, label in zip(batch.column("_t").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(set(b" ".join(sentences(text)).split()))
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())],
            names=["word", "toxic", "clean"],
        )


def _bag_batches(words: dict[bytes, int]):
    """Distinct sentences of each document by the words that may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, picks = [], []
            for text in batch.column("_t").to_pylist():
                kinds: Counter = Counter(
                    tuple(sorted({words[w] for w in part.split() if w in words})) for part in sentences(text)
                )
                times.append(list(kinds.values()))
                picks.append([list(k) for k in kinds])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(times, pa.list_(pa.int64())), pa.array(picks, pa.list_(pa.list_(pa.int32())))],
                names=["label", "times", "picks"],
            )

    return run


def train(sample: DataFrame) -> Model:
    """Fit on ``sample(label, _t)``, a bounded table. Runs jobs.

    With one class only, or no rows, every document gets a constant score:
    the share of labelled ones (0 without rows).
    """
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return Model(700.0 if toxic else -700.0)
    counted = sample.mapInArrow(_word_counts, "word binary, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b")
    )
    both = (F.col("a") + F.col("b")) / (toxic + clean)
    error = F.sqrt(both * (1 - both) * (1 / toxic + 1 / clean)) + 1e-9
    ranked = counted.filter(F.col("a") + F.col("b") >= MIN_DOCS).withColumn("z", (F.col("a") / toxic - F.col("b") / clean) / error)
    chosen = ranked.filter(F.col("z") >= ERRORS).orderBy(F.desc("z"), "word").limit(WORDS).collect()
    words = {bytes(r["word"]): i for i, r in enumerate(chosen)}
    rows = sample.mapInArrow(_bag_batches(words), "label int, times array<long>, picks array<array<int>>").collect()
    bag, times, sentence, word = [], [], [], []
    for d, r in enumerate(rows):
        for n, kind in zip(r["times"], r["picks"]):
            sentence += [len(bag)] * len(kind)
            word += kind
            bag.append(d)
            times.append(n)
    bags = Bags(*(np.array(x, np.int64) for x in ([r["label"] for r in rows], bag, times, sentence, word)))
    bias, weights = fit(bags, len(words))
    return Model(bias, {w: float(weights[i]) for w, i in words.items() if weights[i] > 0.05})


def _score_batches(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, offending = [], []
            for text in batch.column("_t").to_pylist():
                score, found = model.score(text)
                scores.append(score)
                offending.append([{"sentence": i, "score": p} for i, p in found if p >= 0.5])
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(offending, kind)], names=[*names, "score", "offending"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, train_on, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``id``, ``score`` and ``offending`` (sentence numbers with scores) of each row.

    Trains on labelled documents where ``train_on(id column name)`` holds, at
    most ``SAMPLE`` of them, drawn by hash. Null labels are ignored; of
    several labels of one id the largest counts. Null texts score like empty
    ones; repeated rows score alike; an empty table gives an empty table.
    Runs jobs on the sample.
    """
    spark = prepare(docs.sparkSession)
    known = labels.select(named(labels, ident).alias("id"), named(labels, label).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & train_on("id"))
    drawn = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(named(docs, ident).alias("id"), text_of(docs, text).alias("_t"))
    # the broadcast side has at most SAMPLE rows of two numbers
    sample = stage(texts.join(F.broadcast(drawn), "id").select("label", "_t"), "labelled")
    shared = spark.sparkContext.broadcast(train(sample))
    kind = T.StructType(
        [
            T.StructField("id", texts.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("offending", T.ArrayType(T.StructType([T.StructField("sentence", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
        ]
    )
    return texts.mapInArrow(_score_batches(shared, ["id"]), kind)


def query(spark, folder: str) -> DataFrame:
    base = folder.rstrip("/")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, labels, lambda c: ~held_out(c, 5, 0)).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"),
    )
