"""Top-k, packing and mixing against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorespark.llm.op3_topk import Index, top_k
from lorespark.llm.op5_packing import best_fit, pack
from lorespark.llm.op8_mixing import mix_sources, take_words, targets

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_index_keeps_all_members():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-300, 300, (500, 8))
    vectors[100:160] = vectors[7]  # ties
    index = Index(vectors)
    for query in vectors[:20]:
        scores = vectors @ query
        best = np.sort(scores)[-11]
        assert set(np.flatnonzero(scores >= best)) <= set(index.members(query, 11).tolist())


def test_top_k_with_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i) for i in range(260)]
    rows += [(300, None, 0), (301, [1.0, None, 0.0, 0.0], 0), (302, [float("nan")] * 4, 0), (303, [float("inf")] * 4, 0), (304, [], 0), (None, [1.0] * 4, 0)]
    rows += [(400, [1.0, 1.0], 0), (401, [1.0, 2.0], 0), (0, rows[0][1], 0)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, a) in enumerate(whole):
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n and len(b) == len(a))
            want.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1))
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long"), F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, got.collect())) == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def one_by_one(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


@pytest.mark.parametrize("size", [1, 10, 97])
def test_plan_equals_best_fit_decreasing(size):
    rng = random.Random(size)
    for _ in range(30):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 200))]
        used = Counter()
        by_length = defaultdict(list)
        for row in best_fit(Counter(lengths), size):
            by_length[row[0]].append(row)
        for length, n in Counter(lengths).items():
            for rank in range(n):
                _, first, start, offset, each = max(r for r in by_length[length] if r[1] <= rank)
                used[start + (rank - first) // each] += length
        assert sorted(size - x for x in used.values()) == one_by_one(lengths, size)


@pytest.mark.parametrize("size", [2048, 16])
def test_pieces_are_the_texts(edge_docs, edge_rows, size):
    model = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in edge_rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
        for n, (a, b) in enumerate(zip(cut, cut[1:])):
            want[(r[0], n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    rows = pack(edge_docs, TOKENIZER, size=size).collect()
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= size
    assert len(bins) == len(one_by_one([r.length for r in rows], size))


@pytest.mark.parametrize("size", [2048, 16])
def test_sequences_hold_the_token_ids(spark, edge_docs, edge_rows, size):
    model = Tokenizer.from_file(TOKENIZER)
    rows = pack(edge_docs.repartition(3), TOKENIZER, size=size).collect()
    sequences = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.offset):
        assert len(sequences[r.sequence_id]) == r.offset
        sequences[r.sequence_id] += np.frombuffer(r.ids, "<u4").tolist()
    # a text comes back from the places of its pieces alone
    got = Counter()
    for r in rows:
        ids = sequences[r.sequence_id][r.offset : r.offset + r.length]
        got[r.id, r.start, tuple(ids)] += 1
    want = Counter()
    for r in edge_rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [0]
        cut = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
        want.update((r[0], a, tuple(ids[a:b])) for a, b in zip(cut, cut[1:]))
    assert got == want


def test_pipeline_ends_in_token_ids(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "and more")], "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    model = Tokenizer.from_file(TOKENIZER)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {
        i: model.encode(t, add_special_tokens=False).ids + [0] for i, t in ((1, "some words"), (2, "and more"))
    }


@pytest.mark.parametrize("literal", [False, True])
def test_odd_white_space_and_special_tokens(spark, literal):
    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = literal
    texts = ["a  b", " lead", "tail ", "x \n y", "tab\there", "nul\0 x", " nb sp", "it's, ok.\nNew...", "a\n\nb", "<|endoftext|> x", "w" * 500 + " z", "3,4. 5.", "é, ñ."]
    texts += ["a <|endoftext|> b", "a<|endoftext|><|endoftext|>\nb  c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.ids_crc32 for r in pack(docs, TOKENIZER, literal=literal).collect()}
    assert got == {i: zlib.crc32(np.array(model.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in enumerate(texts)}


def shared_out(sizes, weights=(5, 2, 1), passes=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = {s: weight[s] for s in names if s not in capped}
        left = (total - sum(capped.values())) / sum(rest.values()) if rest else 0
        more = {s: passes * sizes[s] for s in rest if left * weight[s] > passes * sizes[s]}
        if not more:
            return {s: capped.get(s, left * weight[s]) for s in names}
        capped |= more


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 4}, {"b": 1, "a": 1}, {"x": 0, "y": 0}, {f"s{i}": (i * 37) % 50 for i in range(30)}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = shared_out(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_takes_its_targets(edge_docs, edge_rows):
    mixed = mix_sources(edge_docs, F.lit(None))
    rows = mixed.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mix_sources(edge_docs, F.lit(None)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(rows) == len(edge_rows)
    want = shared_out(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) < 3
    words = Counter()
    for r in take_words(mixed).collect():
        words[r.source] += len(r.text.split())
    assert +words == +taken


def test_empty_tables(no_docs):
    assert pack(no_docs, TOKENIZER).count() == 0
    assert mix_sources(no_docs, F.lit(1.0)).count() == 0
