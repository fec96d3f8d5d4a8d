"""Vector codes against plain k-means on Python's whole numbers, and against SQL."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from lorespark.llm import op12_vector_codes as codes
from tests.oracle import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, error long, sums int, row long"


def plain_codes(rows, parts=8, entries=16, rounds=6, limit=1 << 26):
    """Counter of (vec_id, code, error, label_error) and the digest, by trying all entries."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [max(-limit, min(limit, math.floor(4096 * x))) for x in v], label) for i, v, label in kept]
    if not kept:
        return Counter(), sha256(b"").hexdigest()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(c):
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book)) for x, book in zip(c, books)]

    for _ in range(rounds):
        members = defaultdict(list)
        for c in cut:
            for p, (_, e) in enumerate(assign(c)):
                members[p, e].append(c[p])
        for (p, e), xs in members.items():
            books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [(i, assign(c), label) for (i, _, label), c in zip(kept, cut)]
    total = Counter()
    for _, a, label in found:
        total[label] += sum(d for d, _ in a)
    digest = sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), total[label]) for i, a, label in found), digest


def edge_vectors():
    rng = random.Random(3)
    grid = lambda n: [rng.randrange(-6, 6) / 4 for _ in range(n)]  # noqa: E731  many ties
    rows = [(i * 3, grid(16), (None, 1, 1, 2)[i % 4]) for i in range(90)]
    rows += [rows[5], rows[5], (3, grid(16), 2), (None, grid(16), 1), (400, None, 1), (401, [], 1), (402, [None] * 16, 1)]
    rows += [(403, [math.nan] * 16, 1), (404, [math.inf] + [0.0] * 15, None), (405, grid(24), 1), (406, [1e30, -1e30] * 8, 9)]
    return rows


def test_against_plain_k_means(spark):
    rows = edge_vectors()
    found, books = codes.vector_codes(spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in rows], SCHEMA))
    want, digest = plain_codes(rows)
    assert Counter(map(tuple, found.collect())) == want
    assert codes.books_digest(books) == digest


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = edge_vectors()[:n] + [(7000, None, 1)]
    found, books = codes.vector_codes(spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in rows], SCHEMA))
    want, digest = plain_codes(rows)
    assert Counter(map(tuple, found.collect())) == want
    assert codes.books_digest(books) == digest


def test_lengths_that_do_not_divide(spark):
    with pytest.raises(ValueError):
        codes.vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1, "c", 1, 2, 3, 4)], SCHEMA))


def test_rings_leave_out_only_what_is_farther():
    rng = np.random.default_rng(8)
    book = rng.integers(-400, 400, (16, 4))
    parts = book[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 4))
    away = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    want = away.argmin(axis=1)
    for former in (want, rng.integers(0, 16, 3000)):
        code, best, work = codes.nearest(parts, book, former)
        assert (code == want).all() and (best == away.min(axis=1)).all()
    assert codes.nearest(parts, book, want)[2] < 3000 * 6  # a third of all distances


def test_query_against_sql(spark, small):
    status, rows, _, note = compare(spark, connect(small), small, "op12_vector_codes", codes.query, codes.SQL)
    assert status == "ok" and rows, note
