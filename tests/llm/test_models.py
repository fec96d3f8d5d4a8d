"""Language, toxicity, quality rules and language model."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.llm import op4_language, op9_quality
from lorespark.llm.common import held_out
from lorespark.llm.op2_toxicity import toxicity
from lorespark.llm.op4_language import build, grams_of, language, slots_of
from lorespark.llm.op9_quality import quality_rules
from lorespark.llm.op10_hmm import Counts, Hmm, _score_batches, add_emissions, expect, first_model, log_likelihoods, maximise, score_texts, words_of


def test_mask_of_an_ngram_has_all_its_languages():
    keys = np.unique(grams_of(["some words", "mots divers"])[0])
    members = np.array([1 + i % 3 for i in range(len(keys))], np.uint64)
    filters = build(["a", "b"], keys, members)
    found = np.bitwise_and.reduce([filters.masks[0][s] for s in slots_of(keys)])
    assert ((found & members) == members).all()


def test_language_of_odd_texts(edge_docs, no_docs, spark):
    rows = language(edge_docs, F.lit(True)).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    und = [r for r in rows if r.lang_pred == "und"]
    assert len(und) == sum(1 for r in edge_docs.select("text").collect() if not any(c.isalpha() for c in r.text or ""))
    assert language(no_docs, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language(edge_docs, F.lit(False)).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word(spark):
    """Filters give what exact sets of n-grams give, for 200 languages."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rng.choices(letters, k=6)) for _ in range(12)] for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words[i % 200], k=30)), f"l{i % 200:03}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts: dict[str, Counter] = {}
    for i, text, lang in rows:
        if not held(i):
            counts.setdefault(lang, Counter()).update(grams_of([text])[0].tolist())
    share = {x: {g: n / c.total() for g, n in c.items() if n / c.total() >= op4_language.SHARE} for x, c in counts.items()}
    most: dict[int, float] = {}
    for own in share.values():
        for g, p in own.items():
            most[g] = max(p, most.get(g, 0))
    sets = {x: {g for g, p in own.items() if p >= op4_language.RATIO * most[g]} for x, own in share.items()}
    got = {r.id: r for r in language(docs, ~held_out("doc_id", 4, 2)).collect()}
    assert len(got) == 600 and len(sets) > 150
    for i, text, _ in rows:
        grams = grams_of([text])[0].tolist()
        exact = {x: sum(g in own for g in grams) / len(grams) for x, own in sets.items()}
        assert got[i].lang_pred == min(exact, key=lambda x: (-exact[x], x))
        assert abs(got[i].score - max(exact.values())) < 0.01


def test_language_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language(docs, ~held_out("doc_id", 4, 2)).join(docs.withColumnRenamed("doc_id", "id"), "id")
    share = found.filter(held_out("id", 4, 2)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.95


def toxic_set(spark, n=400):
    rng = random.Random(4)
    calm = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        parts = [[rng.choice(calm) for _ in range(6)] for _ in range(5)]
        if i % 3 == 0:
            parts[i % 5][2] = ("vile", "awful")[i % 2]
        rows.append((i, ". ".join(" ".join(p) for p in parts)))
        labels.append((i, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_finds_the_sentence(spark):
    docs, labels = toxic_set(spark)
    rows = toxicity(docs, labels, lambda c: ~held_out(c, 5, 0)).collect()
    for r in rows:
        assert (r.score >= 0.5) == (r.id % 3 == 0)
        assert [x.sentence for x in r.offending] == ([r.id % 5] if r.id % 3 == 0 else [])


def test_toxicity_of_odd_rows(spark, edge_docs, no_docs):
    docs, labels = toxic_set(spark)
    trained = toxicity(docs.unionByName(edge_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text")), labels, lambda c: F.lit(True))
    assert all(0 <= r.score <= 1 for r in trained.collect())
    nothing = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in toxicity(edge_docs, nothing, lambda c: F.lit(True)).collect())
    assert toxicity(no_docs, labels, lambda c: F.lit(True)).count() == 0


def test_quality_equals_its_sql(spark, edge_docs, edge_rows):
    seen = set()
    once = [r for r in edge_rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]
    shared = "This very line is in many documents of one host and has words."
    more = [(1000 + i, f"{shared}\nown{i} " + " ".join(f"t{i}x{j}" for j in range(60 if i % 2 else 3)) , "en", None) + r[4:] for i, r in enumerate(once[:30])]
    docs = spark.createDataFrame(once + more, edge_docs.schema)
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(op9_quality.SQL)
    columns = sorted(want.columns)
    got = quality_rules(docs).withColumnRenamed("id", "doc_id").select(*columns).collect()
    rows = duckdb.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()
    assert Counter(map(tuple, got)) == Counter(rows)
    assert any(r.n_line_words and not r.kept for r in got) and any(r.n_line_words and r.kept for r in got)


def test_boilerplate_lines_leave_the_texts(spark):
    shared = "This very line\tis in 25 documents."
    body = [" ".join(f"t{i}x{j}" for j in range(60)) for i in range(30)]
    texts = {i: f"{body[i]}\n\nTHIS  very line is in {10 + i} documents.\r\nend {i}" for i in range(25)}
    want = {i: f"{body[i]}\n\nend {i}" for i in range(25)}
    # another host, too short, mostly boilerplate, none, null
    texts |= {25: f"{shared}\n{body[25]}", 26: f"{shared}\nshort", 27: f"{shared}\n" * 50 + "own words", 28: body[28], 29: None}
    want |= {25: texts[25], 26: "short", 27: "own words", 28: body[28], 29: None}
    rows = [(t, i, "b" if i == 25 else None, i * 7, "k") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "text string, doc_id long, source string, n int, kept string")
    got = {r.id: r for r in quality_rules(docs).collect()}
    assert {i: r.cleaned for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == {*range(26), 28}
    out = op9_quality.clean_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [(want[i], i, "b" if i == 25 else None, i * 7, "k") for i in (*range(26), 28)]


def test_quality_of_repeated_rows(edge_docs, no_docs):
    assert quality_rules(edge_docs).count() == edge_docs.count()
    assert quality_rules(no_docs).count() == 0


def test_forward_recursion_is_exact():
    model = first_model(np.array([0.5, 0.2, 0.2, 0.1]), 3)
    text = [0, 1, 3, 2]
    paths = itertools.product(range(3), repeat=4)
    total = sum(
        model.start[p[0]] * model.emit[text[0], p[0]] * math.prod(model.move[p[i - 1], p[i]] * model.emit[text[i], p[i]] for i in (1, 2, 3))
        for p in paths
    )
    found = log_likelihoods(model, np.array([2, *text], np.int32), np.array([0, 1, 5]))
    assert found[1] == pytest.approx(math.log(total))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(0)
    symbols = np.concatenate([np.append(rng.integers(3 * (i % 2), 3 + 3 * (i % 2), 40), 6) for i in range(60)]).astype(np.int32)
    bounds = np.arange(0, len(symbols) + 1, 41)
    shares = np.bincount(symbols, minlength=8) + 1.0
    model = first_model(shares / shares.sum(), 2)
    before = log_likelihoods(model, symbols, bounds).sum()
    for _ in range(15):
        counts = Counts.none(8, 2)
        add_emissions([expect(model, symbols, bounds[:-1], np.diff(bounds), np.ones(60, bool), counts)], counts)
        model = maximise(counts, shares / shares.sum())
    assert log_likelihoods(model, symbols, bounds).sum() > before + 50


def test_counts_of_stretches_equal_those_of_all_paths():
    # states that all but exclude each other's symbols, over more steps than lie between two scalings
    emit = np.array([[1 - 2e-15, 1e-15, 0.3], [1e-15, 1 - 2e-15, 0.3], [1e-15, 1e-15, 0.4]])
    move = np.array([[0.9, 0.1 - 1e-12, 1e-12], [1e-12, 0.8, 0.2 - 1e-12], [0.3, 0.3, 0.4]])
    model = Hmm(np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.2, 0.6]), move, emit)
    rng = np.random.default_rng(5)
    size = np.array([1, 30, 8, 9, 16, 17, 30, 2])
    bounds = np.concatenate([[0], np.cumsum(size)])
    symbols, begins = rng.integers(0, 3, bounds[-1]).astype(np.int32), np.arange(len(size)) % 2 == 0
    want, logs = Counts.none(3, 3), []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        text = symbols[lo:hi]
        ahead = [(model.start if begins[i] else model.later) * emit[text[0]]]
        for s in text[1:]:
            ahead.append((ahead[-1] @ move) * emit[s])
        back = [np.ones(3)]
        for s in text[:0:-1]:
            back.insert(0, move @ (emit[s] * back[0]))
        total = ahead[-1].sum()
        (want.start if begins[i] else want.later)[:] += ahead[0] * back[0] / total
        for t, s in enumerate(text):
            want.emit[s] += ahead[t] * back[t] / total
            if t:
                want.move += np.outer(ahead[t - 1], emit[s] * back[t]) * move / total
        logs.append(math.log((ahead[-1] if begins[i] else np.array([np.nan])).sum()))
    got = Counts.none(3, 3)
    add_emissions([expect(model, symbols, bounds[:-1], size, begins, got)], got)
    for name in ("start", "later", "move", "emit"):
        assert getattr(got, name) == pytest.approx(getattr(want, name), rel=1e-9, abs=1e-12)
    assert log_likelihoods(model, symbols, bounds)[begins] == pytest.approx(np.array(logs)[begins])


def test_words_of_odd_white_space():
    texts = [b" \x0b A\tb  \x0c\r\n c\x85\xa0 ", b"", b"   ", b"x", None, "ÄÖ İ B\x1cC\u2003d\u00a0e".encode(), b"\xff\xfe Z"]
    words, text = words_of(pa.array(texts, pa.binary()))
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or b"").lower())]
    assert list(zip(text.tolist(), words.to_pylist())) == want


def test_batches_are_scored_in_step():
    # a long text in each batch would cost its number of steps each time
    model, rng = first_model(np.array([0.4, 0.3, 0.2, 0.1])), np.random.default_rng(7)
    texts = [rng.integers(0, 4, n).astype("<i4") for n in (3, 500, 1, 400, 2, 600)]
    columns = {"id": range(6), "number": range(6), "symbols": [t.tobytes() for t in texts], "heavy_log": [0.0] * 6}
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    found = list(_score_batches(SimpleNamespace(value=model))(iter(table.to_batches(max_chunksize=2))))
    assert [b.num_rows for b in found] == [6]
    want = log_likelihoods(model, np.concatenate(texts), np.cumsum([0, *map(len, texts)])) / math.log(10)
    assert found[0].column("forward").to_pylist() == pytest.approx(want.tolist())


def test_every_pass_reads_all_training_texts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 4, rng.integers(1, 4)) + 4 * (i % 2)) for i in range(9000)]
    count = Counter(w for t in texts for w in t.split())
    heavy = sorted(count, key=lambda w: (-count[w], w))
    code = {w: i for i, w in enumerate(heavy)}
    symbols = np.array([s for t in texts for s in (*(code[w] for w in t.split()), len(heavy))], np.int32)
    size = np.array([len(t.split()) + 1 for t in texts])
    bounds = np.concatenate([[0], np.cumsum(size)])
    amounts = np.array([*(count[w] for w in heavy), len(texts), 0.0])
    shares = (amounts + 1) / (len(symbols) + len(amounts))
    model = first_model(shares)
    for _ in range(14):
        counts = Counts.none(len(shares), len(model.start))
        add_emissions([expect(model, symbols, bounds[:-1], size, np.ones(len(size), bool), counts)], counts)
        model = maximise(counts, shares)
    want = log_likelihoods(model, symbols, bounds) / math.log(10)
    rows = score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(True)).collect()
    got = {r.id: r.score for r in rows}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), rel=1e-7)


def test_base_scores_of_odd_rows(edge_docs, edge_rows, no_docs):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    count = Counter(w for r in edge_rows if trains(r[0]) for w in words(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in edge_rows:
        text = words(r[1])
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in text)
        want[(r[0], len(text), sum(count[w] > 0 for w in text), n, round(base, 6))] += 1
    got = score_texts(edge_docs, ~held_out("doc_id", 7, 2)).collect()
    assert Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    untrained = score_texts(edge_docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in untrained)
    assert score_texts(no_docs, F.lit(True)).count() == 0
