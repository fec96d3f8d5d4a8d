"""HyperMinHash groups against all pairs of plain shingle sets."""

import random
from collections import Counter

import numpy as np
import pytest

from lorespark.llm import op13_minhash as mh


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) or frozenset([tuple(words)] if words else [])


def plain_groups(rows, percent=80):
    """Counter of (id, set size, smallest id reachable)."""
    sets = [plain_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = min(least.get(root(i), ident), ident)
    return Counter((ident, len(sets[i]), least.get(root(i))) for i, (ident, _) in enumerate(rows))


def near_copies(seed, groups=6, size=40):
    """Texts around a base text each, some linked to the base or each other only."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 30, 120, 400]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate(("a b", "b a", "A B", "a", "a  ", "a b c d e", "a b c d e f"))]
    return rows


def test_edge_cases(edge_docs, edge_rows, no_docs):
    got = Counter(map(tuple, mh.minhash_groups(edge_docs).collect()))
    assert got == plain_groups([(r[0], r[1]) for r in edge_rows])
    assert mh.minhash_groups(no_docs).count() == 0


@pytest.mark.parametrize("block, size", [(2048, 40), (7, 40), (2048, 150)])
def test_groups_of_near_copies(spark, block, size):
    rows = near_copies(3, 240 // size, size)
    got = Counter(map(tuple, mh.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()))
    assert got == plain_groups(rows)


def test_a_long_text_and_its_copy(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(10**6)) for _ in range(700_000)]
    other = words[:60_000] + ["new"] * 9 + words[60_000:]
    rows = [(7, " ".join(words)), (3, " ".join(other)), (9, "x " * 2_000_000), (1, "x" * 5_000_000)]
    got = {r.id: (r.n_shingles, r.component) for r in mh.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == (1, 9) and got[1] == (1, 1)
    assert got[7][1] == got[3][1] == 3 and got[7][0] > 690_000


def test_estimates_are_close():
    rng = np.random.default_rng(5)
    for size in (100, 1000, 30_000):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            a, b = both[: int(size * 0.9)], both[int(size * 0.1) :]
            registers, keys = mh.sketches([a, b])
            found = mh.may_link((registers[:1] == registers[1:]).sum(axis=1), np.array([len(a)]), np.array([len(b)]), 80)
            errors.append(found[0] - 0.8)
            assert found[0] >= 0 and (keys[0] == keys[1]).any()
        assert abs(np.mean(errors)) < 0.02
    assert (mh.may_link(np.array([40, 190]), np.array([500, 70]), np.array([500, 100]), 80) == -1).all()


def test_counts_of_common_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 5000, rng.integers(0, 3000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]
    assert mh.common_counts(sets[:3], sets[3:]).tolist() == want


def test_registers_hold_zeros_and_mantissa():
    value = np.array([1 << 63, (1 << 63) + (1 << 62), (1 << 60) + (5 << 57), 0], np.uint64)
    assert mh.compressed(value).tolist() == [0, 4, 3 * 8 + 5, 31 * 8]


def test_query(spark, folders, edge_rows, small):
    got = mh.query(spark, folders["edge"])
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = Counter()
    for (ident, n, part), times in plain_groups([(r[0], r[1]) for r in edge_rows]).items():
        want[ident, n, part, ident == part] += times
    assert Counter(map(tuple, got.collect())) == want
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert Counter(map(tuple, mh.query(spark, small).drop("kept").collect())) == plain_groups(docs)
