"""Periodic runs against brute force over all periods."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from lorespark.llm import op11_periodic_runs as runs


def all_runs(words, least=12):
    """(start, length, smallest period) of every maximal run, by trying all periods."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, hit in enumerate(same):
            if hit and start is None:
                start = i
            elif not hit and start is not None:
                if i + q - start >= max(least, 2 * q):
                    found.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def digest_row(ident, text):
    words = (text or "").encode().split()
    if ident is not None and words:
        h = zlib.crc32(str(ident).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    found = all_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    shown = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return (
        ident, len(found), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha256(shown).hexdigest(), sha256(collapsed(words, found)).hexdigest(),
    )


def planted(rng):
    size = rng.choice([0, 1, 2, 11, 12, 13, 60, 300])
    letters = rng.choice([1, 2, 3, 40])
    words = [b"w%d" % rng.randrange(letters) for _ in range(size)]
    for _ in range(rng.randrange(4)):
        if size > 3:
            first, period = rng.randrange(size), rng.randint(1, size // 2)
            for i in range(first + period, min(size, first + rng.randint(1, size))):
                words[i] = words[i - period]
    return words


def test_runs_against_all_periods():
    rng = random.Random(4)
    for _ in range(60):
        lists = [planted(rng) for _ in range(rng.randint(1, 6))]
        numbers, edges = runs.word_numbers(lists)
        got = [tuple(map(int, r)) for r in runs.find_runs(numbers, edges)]
        want = [(s + int(e), s + n + int(e), q) for words, e in zip(lists, edges) for s, n, q in all_runs(words)]
        assert got == sorted(want)


def test_transform_finds_every_place():
    rng = np.random.default_rng(2)
    window = rng.integers(0, 3, (5, 23))
    block = np.array([w[i : i + 6] for i, w in enumerate(window)])
    want = np.array([[(w[j : j + 6] == b).all() for j in range(18)] for w, b in zip(window, block)])
    assert (runs.zero_mismatches(block, window) == want).all()
    a = rng.integers(0, runs.PRIME, (3, 64)).astype(np.uint64)
    assert (runs.transform_back(runs.transform(a)) == a).all()


@pytest.mark.parametrize("words, want", [
    ([b"a"] * 300_000, (0, 300_000, 1)),
    ([b"a", b"b", b"c"] * 90_001, (0, 270_003, 3)),
    ([b"%d" % (i % 50_021) for i in range(130_000)], (0, 130_000, 50_021)),
])
def test_very_long_texts(words, want):
    found = runs.find_runs(*runs.word_numbers([words]))
    assert found.tolist() == [[want[0], want[1], want[2]]]


def test_operator_on_edge_cases(edge_docs, edge_rows, no_docs):
    got = Counter((r.id, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(edge_docs).collect())
    want = Counter()
    for row in edge_rows:
        words = (row[1] or "").encode().split()
        found = all_runs(words)
        want[row[0], tuple(found), collapsed(words, found).decode()] += 1
    assert got == want
    assert runs.periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(no_docs, least=5)


def test_query_on_edge_cases(spark, folders, edge_rows):
    got = runs.query(spark, folders["edge"])
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(digest_row(r[0], r[1]) for r in edge_rows)
    assert runs.query(spark, folders["none"]).count() == 0


def test_query_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len((d.text or "").split()) < 800]
    got = {r.doc_id: tuple(r) for r in runs.query(spark, small).collect()}
    assert len(got) == len(docs)
    assert [got[d.doc_id] for d in short] == [digest_row(d.doc_id, d.text) for d in short]
    assert any(r[1] for r in got.values())
