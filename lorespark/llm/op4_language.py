"""Language ID by n-gram filters over language bitmasks.

All languages share one bit-sliced Bloom filter: every slot holds a mask with
one bit for each language, in as many words of 64 bits as there are languages for,
and the AND of an n-gram's slots gives all the languages that contain it. A text's language is the one whose bit is set most
often among its n-grams, after the expected false positives are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import blocks, byte_texts, held_out, mix, named, stage, text_of
from lorespark.session import prepare

#: Characters of an n-gram; white space and signs count as one blank.
GRAM = 4
#: Least share of a language's n-grams: a filter holds at most 1 / SHARE of them.
SHARE = 2e-5
#: Least share in a language against the language where the n-gram is most frequent.
RATIO = 0.2
#: Slots of the filter, hashes of an n-gram, and bits of a word of the mask.
SLOTS, HASHES, MASK = 1 << 21, 3, 64

_letters: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point its place if it is a letter, else a blank."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        table[letters] = letters
        _letters.append(table)
    return _letters[0]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams with a letter as 64-bit keys, and the row of each.

    Texts are lower-cased; runs of other signs are one blank, and every text
    has a blank before and behind it.
    """
    codes = np.frombuffer("".join(f" {x} " for x in texts).lower().encode("utf-32-le", "replace"), np.uint32)
    # lower-casing may lengthen a text, so lengths are taken behind it
    sizes = np.array([len(x.lower()) + 2 for x in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    folded = _folded()[codes]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (row[1:] != row[:-1])
    folded, row = folded[keep].astype(np.uint64), row[keep]
    n = len(folded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for i in range(GRAM):
        key = key * np.uint64(0x100000001B3) + folded[i : i + n]
    one_text = row[:n] == row[GRAM - 1 :]
    return mix(key[one_text]), row[:n][one_text]


def slots_of(keys: np.ndarray) -> list[np.ndarray]:
    """The filter slots of each n-gram."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return [((keys + np.uint64(i) * step) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    """Languages in code point order, their false positive rates, and the masks.

    ``masks`` has one row of ``SLOTS`` words for every ``MASK`` languages.
    """

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected share of each text's n-grams in each language."""
        keys, row = grams_of(texts)
        slots = slots_of(keys)
        total = np.maximum(1, np.bincount(row, minlength=len(texts)))
        out = np.zeros((len(texts), len(self.languages)))
        for first, words in zip(range(0, len(self.languages), MASK), self.masks):
            mask = words[slots[0]]
            for s in slots[1:]:
                mask &= words[s]
            for i in range(first, min(first + MASK, len(self.languages))):
                hits = np.bincount(row, (mask >> np.uint64(i - first)) & np.uint64(1), len(texts)) / total
                out[:, i] = (hits - self.wrong[i]) / (1 - self.wrong[i])
        return np.clip(out, 0, 1)


def filters_of(languages: list[str], masks: np.ndarray) -> Filters:
    """Filters with the false positive rates that follow from their filled bits."""
    filled = [np.count_nonzero(masks[i // MASK] & np.uint64(1 << i % MASK)) / SLOTS for i in range(len(languages))]
    return Filters(languages, masks, np.minimum(0.999, np.array(filled) ** HASHES))


def build(languages: list[str], keys: np.ndarray, members: np.ndarray) -> Filters:
    """Filters of at most ``MASK`` languages from n-gram keys and the mask of each."""
    masks = np.zeros((1, SLOTS), np.uint64)
    for slots in slots_of(keys):
        np.bitwise_or.at(masks[0], slots, members)
    return filters_of(languages, masks)


def _slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, word, bits) of every hash of (gram, word, bits)."""
    for batch in batches:
        keys = batch.column("gram").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for slots in slots_of(keys):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots.astype(np.int32)), batch.column("word"), batch.column("bits")], names=["slot", "word", "bits"]
            )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) of all training texts, summed per task in bounded parts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def flush():
        for lang, parts in sorted(held.items()):
            keys, counts = merge(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"]
            )

    for batch in batches:
        texts, langs = batch.column("_t").to_pylist(), batch.column("lang").to_pylist()
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(texts, langs):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            sizes = [b"" if x is None else x.encode("utf-8", "replace") for x in own]
            for lo, hi in blocks(sizes, 1 << 21):
                keys, counts = np.unique(grams_of(own[lo:hi])[0], return_counts=True)
                held.setdefault(lang, []).append((keys, counts))
                size += len(keys)
                if len(held[lang]) > 8:
                    before = sum(len(p[0]) for p in held[lang])
                    held[lang] = [merge(held[lang])]
                    size += len(held[lang][0][0]) - before
        if size > 2_000_000:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def learn(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> Filters:
    """Count the n-grams of all training rows and fill the filters. Runs jobs.

    Any number of languages is taken. The tasks OR the bits of each slot, so
    the driver gets the masks alone: 16 MB for every 64 languages.
    """
    rows = docs.filter(train & named(docs, lang).isNotNull()).select(named(docs, lang).alias("lang"), text_of(docs, text).alias("_t"))
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts, "gram_counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()
    totals.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in totals]
    masks = np.zeros((-(-len(languages) // MASK), SLOTS), np.uint64)
    if not languages:
        return filters_of(languages, masks)
    places = counts.sparkSession.createDataFrame(
        [(r["lang"], i // MASK, i % MASK, r["total"]) for i, r in enumerate(totals)], "lang string, word int, bit int, total long"
    )
    shares = counts.join(F.broadcast(places), "lang").select(
        "gram", "word", F.expr("shiftleft(1L, bit)").alias("bits"), (F.col("n") / F.col("total")).alias("p")
    ).filter(F.col("p") >= SHARE)
    best = shares.groupBy("gram").agg(F.max("p").alias("most"), F.collect_list(F.struct("word", "bits", "p")).alias("langs"))
    own = best.select("gram", F.explode(F.filter("langs", lambda x: x["p"] >= RATIO * F.col("most"))).alias("x"))
    members = own.groupBy("gram", "x.word").agg(F.bit_or("x.bits").alias("bits"))
    slots = members.mapInArrow(_slot_batches, "slot int, word int, bits long").groupBy("slot", "word").agg(F.bit_or("bits").alias("bits"))
    found = slots.toArrow()
    word, slot, bits = (found.column(c).to_numpy() for c in ("word", "slot", "bits"))
    masks[word, slot] = bits.astype(np.int64).view(np.uint64)
    return filters_of(languages, masks)


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        names = np.array([*filters.languages, "und"], object)
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            found, scores = [], []
            for lo, hi in blocks(byte_texts(batch.column("_t")), 1 << 21):
                own = texts[lo:hi]
                lettered = np.array([any(map(str.isalpha, x)) for x in own], bool)
                if filters.languages:
                    share = filters.shares(own)
                    best = np.where(lettered, share.argmax(axis=1), len(names) - 1)
                    scores += np.where(lettered, share.max(axis=1), 0.0).tolist()
                else:
                    best = np.full(len(own), len(names) - 1)
                    scores += [0.0] * len(own)
                found += names[best].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def language(docs: DataFrame, train: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", of: DataFrame | None = None) -> DataFrame:
    """``(id, lang_pred, score)`` for each row of ``docs``, learnt from its rows where ``train`` holds.

    The score is the corrected share of the text's n-grams that the language
    has. Texts that are null or have no letter are ``und`` with score 0, and
    so is every text if there is no training row. Ties go to the first
    language by code point; repeated rows get one prediction each; an empty
    table gives an empty table. ``of`` names other rows to predict. Runs jobs.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learn(docs, train, lang, text))
    rows = docs if of is None else of
    texts = rows.select(named(rows, ident).alias("id"), text_of(rows, text).alias("_t"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_predict_batches(shared), f"id {kind}, lang_pred string, score double")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
    found = language(docs, ~held_out("doc_id", 4, 2)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
