"""SimHash groups and components against brute force."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash

from lorespark.llm.components import components
from lorespark.llm.op7_simhash import linked_prints, simhash_groups


def print_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def merged(points, linked):
    parent = {p: p for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(points):
        for b in points[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {p: root(p) for p in points}


def test_groups_against_brute_force(edge_docs, edge_rows):
    prints = [print_of(r[1]) for r in edge_rows]
    part = merged(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for r, p in zip(edge_rows, prints):
        least[part[p]] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{p:016x}", min(least[part[p]], default=None)) for r, p in zip(edge_rows, prints))
    assert Counter(map(tuple, simhash_groups(edge_docs).collect())) == want


@pytest.mark.parametrize("shard_rows", [1 << 16, 15])
def test_dense_groups_lose_no_link(spark, shard_rows):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    flip = lambda x: x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(8))})
    points = sorted({flip(c) for c in centres for _ in range(120)})
    signed = {p: p - (1 << 64) if p >> 63 else p for p in points}
    got = {r.node: r.component for r in linked_prints(spark.createDataFrame([(x,) for x in signed.values()], "print long"), 4, shard_rows).collect()}
    want, have = defaultdict(set), defaultdict(set)
    for p, root in merged(points, lambda a, b: (a ^ b).bit_count() <= 4).items():
        want[root].add(signed[p])
        have[got.get(signed[p], signed[p])].add(signed[p])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(5, 5), (1000, 1001), (1001, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_no_rows(spark, no_docs):
    assert simhash_groups(no_docs).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
