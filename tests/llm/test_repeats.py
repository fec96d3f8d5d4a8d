"""Repeat removal against brute force on all windows."""

import re
from collections import Counter

import pytest

from lorespark.llm.op1_suffix_dedup import common_prefixes, suffix_array, suffix_dedup
from lorespark.llm.op6_substring_dedup import substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(sequences, length):
    """For each sequence the flags of units in a window that also starts elsewhere."""
    count = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - length + 1):
            if count[tuple(s[i : i + length])] > 1:
                flags[i : i + length] = [True] * length
        yield flags


def runs(flags):
    return sum(f and (i == 0 or not flags[i - 1]) for i, f in enumerate(flags))


@pytest.mark.parametrize("text", [b"a", b"banana", b"aaaaaaaa", b"abababab" * 9, bytes(range(255, -1, -1)) * 2])
def test_suffix_array_is_sorted(text):
    order = suffix_array(text, 40)
    assert sorted(order) == list(range(len(text)))
    cut = [text[i : i + 40] for i in order]
    assert cut == sorted(cut)


def test_common_prefixes():
    text = b"abcabcabd"
    assert list(common_prefixes(text, suffix_array(text, 9)[:1], suffix_array(text, 9)[1:2], 9)) == [5]


@pytest.mark.parametrize("hot_bytes", [1 << 22, 100])
def test_bytes_against_brute_force(edge_docs, edge_rows, hot_bytes):
    texts = [(r[1] or "").encode() for r in edge_rows]
    want = Counter()
    for r, t, flags in zip(edge_rows, texts, covered(texts, 40)):
        want[(r[0], len(t), bytes(b for b, f in zip(t, flags) if not f), runs(flags))] += 1
    got = suffix_dedup(edge_docs, length=40, hot_bytes=hot_bytes)
    assert set(edge_docs.columns) | {"n_units"} == set(got.columns)
    assert Counter((r.doc_id, r.n_units, bytes(r.kept), len(r.spans)) for r in got.collect()) == want


@pytest.mark.parametrize("hot_bytes", [1 << 22, 100])
def test_words_against_brute_force(edge_docs, edge_rows, hot_bytes):
    texts = [WORD.findall((r[1] or "").encode()) for r in edge_rows]
    want = Counter()
    for r, t, flags in zip(edge_rows, texts, covered(texts, 12)):
        want[(r[0], len(t), b" ".join(w for w, f in zip(t, flags) if not f).decode(), runs(flags))] += 1
    got = substring_dedup(edge_docs, length=12, hot_bytes=hot_bytes).collect()
    assert Counter((r.doc_id, r.n_units, r.kept, len(r.spans)) for r in got) == want


def test_empty_tables(no_docs):
    assert suffix_dedup(no_docs).count() == 0
    assert substring_dedup(no_docs).count() == 0
