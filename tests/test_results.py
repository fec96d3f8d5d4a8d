"""Hash trees of results, listings of runs, nested rows, claims and statistics."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph, registry, sections


def blocks(n=3000):
    rng = random.Random(5)
    return [(d, s, p, f"text {rng.random()} ä\"\n", "p") for d in range(4) for s in range(3) for p in range(n // (12 if d else 1))]


def tree(spark, rows):
    df = spark.createDataFrame(rows, "doc long, sec long, pos long, text string, kind string").repartition(5)
    return registry.hash_tree(df, "doc", "sec", "pos", ["text", "kind"])


def test_a_hash_tree_does_not_depend_on_the_order_of_rows(spark):
    rows = blocks()
    first = {r.doc: r.sha256 for r in tree(spark, rows)["document"].collect()}
    random.Random(1).shuffle(rows)
    assert {r.doc: r.sha256 for r in tree(spark, rows)["document"].collect()} == first
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    one = tree(spark, [(1, 0, 0, 'a "b"', None), (1, 0, 1, "c", "p")])
    leaves = [sha('{"kind":null,"position":0,"text":"a \\"b\\""}'), sha('{"kind":"p","position":1,"text":"c"}')]
    assert [r.sha256 for r in one["block"].orderBy("pos").collect()] == leaves
    section = sha(sha("".join(leaves)))
    assert one["section"].first().sha256 == section
    assert one["document"].first().sha256 == sha(sha(section))


def test_one_change_of_each_level_is_found(spark):
    old = blocks()
    new = [r for r in old if r[:2] != (2, 1) and r[0] != 3 and r[:3] != (1, 1, 4)]  # a section, a document, a block
    new = [(*r[:3], r[3] + "!", r[4]) if r[:3] == (0, 2, 2000) else r for r in new]
    new += [(1, 2, 999, "late", "p"), (7, 0, 0, "new", "p")]
    found = registry.changed_parts(tree(spark, old), tree(spark, new), "doc", "sec", "pos").collect()
    assert sorted((r.level, r.doc, -1 if r.sec is None else r.sec, -1 if r.pos is None else r.pos, r.finding) for r in found) == sorted([
        ("document", 0, -1, -1, "changed"), ("section", 0, 2, -1, "changed"), ("block", 0, 2, 2000, "changed"),
        ("document", 1, -1, -1, "changed"), ("section", 1, 1, -1, "changed"), ("block", 1, 1, 4, "missing"),
        ("section", 1, 2, -1, "changed"), ("block", 1, 2, 999, "added"),
        ("document", 2, -1, -1, "changed"), ("section", 2, 1, -1, "missing"),
        ("document", 3, -1, -1, "missing"), ("document", 7, -1, -1, "added")])
    assert registry.changed_parts(tree(spark, old), tree(spark, old), "doc", "sec", "pos").count() == 0


def test_runs_are_completed_only_by_the_same_output(spark):
    runs = spark.createDataFrame(
        [(1, "parsing", "md", "1", None), (2, "succeeded", "md", "1", "a"), (3, "succeeded", "md", "1", "a"), (4, "failed", "md", "1", None),
         (5, "parsing", "md", "2", None), (6, "parsing", "md", "1", None), (7, None, None, None, None)],
        "id long, status string, parser_name string, parser_version string, content_hash string")
    outputs = spark.createDataFrame([(i, "md", "1", "a" if i != 3 else "b") for i in (1, 2, 3, 4, 5)], runs.drop("status").schema)
    got = {r.id: (r.accepted, r.reasons) for r in registry.completed_runs(runs, outputs, "id").collect()}
    assert got == {
        1: (True, []), 2: (True, []), 3: (False, ["output differs from the stored result"]), 4: (False, ["run is not being parsed"]),
        5: (False, ["output of another parser"]), 6: (False, ["no output"]), 7: (False, ["run is not being parsed", "no output"])}


def test_run_listing_filters_sorts_and_pages(spark):
    start = datetime(2024, 1, 1)
    digest = [hashlib.sha256(bytes([i])).hexdigest() for i in range(3)]
    rows = [(i, "Failed" if i % 4 == 0 else "succeeded", f"p{i % 2}", digest[i % 3], start + timedelta(hours=i // 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, status string, parser string, sha string, created_at timestamp")
    ids = lambda **k: [r.id for r in registry.run_listing(df, "id", **k).collect()]
    newest = sorted(rows, key=lambda r: (r[4], r[0]), reverse=True)
    assert ids() == [r[0] for r in newest][:50]
    assert ids(status="FAILED ", equals={"parser": " p0 "}) == [r[0] for r in newest if r[0] % 4 == 0]
    assert ids(hashes={"sha": " " + digest[1].upper()}, created_from=rows[10][4], created_to=rows[21][4]) == [
        r[0] for r in newest if r[0] % 3 == 1 and 10 <= r[0] <= 21]
    mixed = [r[0] for r in sorted(rows, key=lambda r: (-r[4].timestamp(), r[0]))]
    assert ids(tie_descending=False, limit=7) == mixed[:7]
    last = rows[mixed[6]]
    assert ids(tie_descending=False, limit=100, after=(last[4], last[0])) == mixed[7:]
    assert ids(sort_by="parser", sortable=["parser"], descending=False, limit=3, offset=1) == [2, 4, 6]
    assert registry.run_listing(df, "id", status="failed", limit=2).first().total == 15
    for wrong in ({"hashes": {"sha": "xyz"}}, {"sort_by": "sha", "sortable": ["id"]}, {"limit": 0}):
        with pytest.raises(ValueError):
            ids(**wrong)


def test_nested_rows_in_position_order(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id long, title string")
    parts = spark.createDataFrame(
        [(1, 2, "y"), (1, 1, "x"), (1, 2, "w"), (3, None, "n"), (3, None, "m"), (9, 0, "lost"), (None, 0, "none")] + [(2, i, "z") for i in range(12)],
        "parent long, position long, text string")
    out = {r.title: r for r in graph.nested(parents, "id", {"parts": (parts, "parent", "position", ["text"])}, most=10).collect()}
    assert [tuple(x) for x in out["a"].parts] == [(1, "x"), (2, "w"), (2, "y")]
    assert (out["a"].parts_count, out["a"].parts_repeated) == (3, [2])
    assert (out["b"].parts, out["b"].parts_count, out["b"].parts_repeated) == (None, 12, None)
    assert [tuple(x) for x in out["c"].parts] == [(None, "m"), (None, "n")] and out["c"].parts_repeated == [None]
    assert (out["d"].parts, out["d"].parts_count, out["d"].parts_repeated) == ([], 0, [])
    tree = graph.nested(parents.limit(0), "id", {"parts": (parts, "parent", "position", [])})
    assert tree.count() == 0


def test_claims_and_their_evidence(spark):
    claims = spark.createDataFrame(
        [(1, 10, "fact", "active", 0.9, "Rates RISE 5%"), (2, 10, "view", "active", 0.2, "rates fall"), (3, 11, "fact", None, None, None)],
        "claim long, concept long, claim_type string, status string, confidence double, statement string")
    ids = lambda **k: sorted(r.claim for r in graph.matching_claims(claims, **k).collect())
    assert ids() == ids(q="", claim_type="", status="") == [1, 2, 3]
    assert ids(q="rates") == [1, 2] and ids(q="s%5") == [1] and ids(min_confidence=0.9) == [1]
    assert ids(concept=10, claim_type="view") == [2] and ids(status="active", q="FALL") == [2]
    evidence = spark.createDataFrame([(1, 5, "study", 0.5), (1, None, "study", 0.5), (2, 6, "note", 1.0), (8, 5, "study", 0.5)],
                                     "claim long, source long, evidence_type string, strength double")
    count = lambda **k: graph.matching_evidence(evidence, **k).count()
    assert (count(claim=1), count(source=5), count(evidence_type="note"), count(strength=0.5), count()) == (2, 2, 1, 3, 4)
    concepts = spark.createDataFrame([(10, "Rates")], "concept long, title string")
    sources = spark.createDataFrame([(5, "Bank")], "source long, name string")
    chain = graph.evidence_chain(concepts, claims, evidence, sources)
    assert sorted((r.title, r.claim, r.source or 0, r["name"] or "") for r in chain.collect()) == [
        ("Rates", 1, 0, ""), ("Rates", 1, 5, "Bank"), ("Rates", 2, 6, "")]


def test_statistics_must_equal_the_stored_ones(spark):
    docs = spark.createDataFrame([(1, "two words", 1), (2, "  ", 1), (3, "text", 0), (4, "text", None), (5, "text", 2)], "id long, text string, pages int")
    paragraphs = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "id long")
    tables = spark.createDataFrame([(1,)], "id long")
    count = lambda **k: sections.document_statistics(docs, "id", "text", {"paragraph_count": paragraphs, "table_count": tables}, pages="pages", **k)
    rows = {r.id: r for r in count().collect()}
    assert {i: r.valid for i, r in rows.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert (rows[1].page_count, rows[1].word_count, rows[1].character_count, rows[1].paragraph_count, rows[1].table_count) == (1, 2, 9, 2, 1)
    kept = count().drop("valid")
    assert {r.id for r in count(stored=kept).filter("valid").collect()} == {1}
    assert count(stored=kept.withColumn("table_count", F.lit(7))).filter("valid").count() == 0
    assert count(stored=kept.limit(0)).filter("valid").count() == 0
