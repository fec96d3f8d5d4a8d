"""Order-dependent helpers with a hot key, and replays against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from lorespark.functions.ordered import with_neighbour, with_running
from lorespark.operators import graph, history, knowledge, learning, quality
from lorespark.plans import catalog_history as ch, views
from lorespark.plans.catalog_learning import lesson_events
from lorespark.streaming import streams
from lorespark.plans.registry import Tables

START = datetime(2024, 1, 1)


def hot_rows(n=3000):
    """Two thirds of all rows belong to one key."""
    rng = random.Random(2)
    return [(0 if rng.random() < 0.66 else rng.randint(1, 40), START + timedelta(seconds=rng.randint(0, 400_000)), i)
            for i in range(n)]


def test_segmented_windows_with_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k int, ts timestamp, id int")
    seg = F.date_trunc("hour", F.col("ts"))
    out = with_neighbour(df, "k", ["ts", "id"], seg, {"prev": "id"})
    out = with_neighbour(out, "k", ["ts", "id"], seg, {"next": "id"}, forward=True)
    out = with_running(out, "k", ["ts", "id"], seg, {"n": F.lit(1)})
    got = {r.id: (r.prev, r.next, r.n) for r in out.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        ids = [i for _, i in sorted((t, i) for kk, t, i in rows if kk == k)]
        for at, i in enumerate(ids):
            want[i] = (ids[at - 1] if at else None, ids[at + 1] if at + 1 < len(ids) else None, at + 1)
    assert got == want


def test_job_history_golden(spark):
    steps = ["queued", "reserved", "running", "failed", "retrying", "reserved", "running", "succeeded", "queued"]
    rows = [(1, START + timedelta(minutes=i), i, s, f"p{i}") for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, status string, props string")
    legal = [r.legal for r in history.transitions(df).orderBy("event_id").collect()]
    assert legal == [True] * 8 + [False]
    tries = history.attempts(df).orderBy("attempt_number").collect()
    assert [(r.attempt_number, r.status, r.duration_ms) for r in tries] == [(1, "failed", 60000), (2, "succeeded", 60000)]
    state = history.current_states(df, "props").first()
    assert (state.status, state.completed_at, state.last_error) == ("queued", None, None)
    assert history.retry_budget(df).first().retries_left == 2


def test_closure_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6)], "src long, dst long")
    reach = graph.closure(edges)
    assert {(r.src, r.dst, r.depth) for r in reach.collect() if r.src < 4} == {(i, j, (j - i) % 3 or 3) for i in (1, 2, 3) for j in (1, 2, 3)}
    assert {r.node for r in graph.on_cycles(graph.strong_components(edges), edges).collect()} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        graph.closure(spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), max_depth=5)
    links = spark.range(50).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    assert {(r.node, r.head, r.hops) for r in graph.chain_heads(links).collect()} == {(i, 50, 50 - i) for i in range(50)}


def test_closure_of_many_levels(spark):
    chain = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(2)
    reach = graph.closure(chain)
    row = reach.agg(F.count("*"), F.max("depth"), F.count_if(F.col("dst") - F.col("src") != F.col("depth"))).first()
    assert tuple(row) == (1000 * 1001 // 2, 1000, 0)


def plain_components(edges):
    """Node to the set of nodes it shares cycles with, through plain reachability."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    reach = {}
    for start in ahead:
        seen, todo = set(), list(ahead[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead.get(x, ())
        reach[start] = seen
    return {a: frozenset(b for b in seen if a in reach.get(b, ())) for a, seen in reach.items() if a in seen}


@pytest.mark.parametrize("seed, nodes, count", [(2, 30, 70), (3, 200, 210)])
def test_strong_components(spark, seed, nodes, count):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)]
    ring = [(1000 + i, 1000 + (i + 1) % 17) for i in range(17)]
    edges += ring + [(5, 1003), (2000, 2001), (2001, 2000), (2001, 7)]
    df = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
    found = graph.strong_components(df)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.component, set()).add(r.node)
    want = plain_components(edges)
    assert {frozenset(g) for g in groups.values()} == set(want.values())
    assert {r.node for r in graph.on_cycles(found, df).collect()} == set(want)


def test_components_of_a_long_chain_and_a_hot_root(spark):
    chain = [(i, i + 1) for i in range(10_000)]
    star = [(20_000 + i, 0) for i in range(3000)] + [(10_000, 30_000 + i) for i in range(3000)]
    edges = spark.createDataFrame(chain + star + [(10_000, 9_990)], "src long, dst long").coalesce(1)
    found = graph.strong_components(edges)
    assert {r.node for r in found.collect()} == set(range(9_990, 10_001))
    assert found.select("component").distinct().count() == 1


def test_unique_slugs(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(9)], "id long, base string")
    got = [r.slug for r in graph.unique_slugs(df, "base", "id", width=2).orderBy("id").collect()]
    assert got == ["b", "a", "a-2", "b-2", "a-3", "a-4", "b-3", "a-5", "a-6"]


def test_lesson_replay_equals_a_loop(spark, small):
    t = Tables(spark, small)
    states = {}
    for r in lesson_events(t).orderBy("ts", "event_id").collect():
        s = states.setdefault((r.learner, r.lesson), dict(status="not_started", percent=0.0, seconds=0.0))
        kind = "complete" if r.kind == "update" and r.amount >= 100 else r.kind
        if kind == "reset":
            s.update(status="not_started", percent=0.0)
        elif kind == "time":
            s["seconds"] += r.amount
        elif kind == "complete":
            s.update(status="completed", percent=100.0)
        elif kind in ("start", "update") and s["status"] != "completed":
            s["status"] = "in_progress"
            if kind == "update":
                s["percent"] = r.amount
    got = {(r.learner, r.lesson): dict(status=r.status, percent=r.percent, seconds=r.seconds)
           for r in learning.lesson_progress(lesson_events(t)).collect()}
    assert got == states


def test_stream_leases_follow_the_batch_rule(spark):
    import pandas as pd

    from lorespark.streaming.streams import ended_leases

    rows = [(1, 0, 1, "reserved"), (1, 100, 2, "running"), (1, 900, 3, "succeeded"),
            (1, 1000, 4, "reserved"), (1, 1200, 5, "queued"), (2, 50, 6, "reserved"), (2, 4000, 7, "reserved")]
    df = pd.DataFrame(rows, columns=["job_id", "ts", "event_id", "status"])
    df["ts"] = pd.to_datetime(df.ts, unit="s")
    out = ended_leases(df, pd.Timestamp(3600, unit="s"), pd.Timedelta(seconds=300))
    assert [(r.job_id, r.reserved_event, r.previous) for r in out.itertuples()] == [(1, 1, "running"), (2, 6, "reserved")]


def test_job_states_over_several_batches_in_any_order(spark, small, tmp_path):
    from lorespark.streaming import streams

    t = Tables(spark, small)
    batch = views.job_events(t).withColumn("ts", F.col("ts").cast("timestamp")).drop("props")
    dealt = batch.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    for part in (0, 1, 2):
        piece = dealt.filter(F.col("part") == part).drop("part").coalesce(1)
        piece.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "s")
    streams.job_states(source, sink, str(tmp_path / "p"))
    got = {(r.job_id, r.status, r.events) for r in streams.latest_states(spark, sink).collect()}
    want = {(r.job_id, r.status, r.events) for r in history.current_states(batch.withColumn("e", F.lit("")), "e").collect()}
    assert got == want
    columns = ["job_id", "event_id", "previous_status", "status"]
    illegal = streams.illegal_transitions(spark, sink).select(*columns).collect()
    wanted = history.transitions(batch).filter("NOT legal").select(*columns).collect()
    assert sorted(illegal) == sorted(wanted)


def test_a_late_event_makes_its_neighbours_legal():
    import pandas as pd

    from lorespark.streaming.streams import judged_segments

    rows = [(1, 10, 1, "queued"), (1, 30, 3, "running"), (2, 5, 4, "queued")]
    make = lambda r: pd.DataFrame(r, columns=["job_id", "ts", "event_id", "status"])
    early = judged_segments(make(rows), 0, [1])
    assert early[["job_id", "events", "last_status"]].values.tolist() == [[1, 2, "running"]]
    assert [x["event_id"] for x in early.illegal[0]] == [3]
    late = judged_segments(make([*rows, (1, 20, 2, "reserved")]), 0, [1])
    assert late.events.tolist() == [3] and late.illegal.tolist() == [[]]


KNOWLEDGE = (
    "# Basics\nRisk management is a basic part of every trading plan. Stop loss orders are used for risk management.\n"
    "A moving average is an indicator in technical analysis. The RSI is an advanced indicator for technical analysis.\n"
    "Traders should use a stop-loss because drawdown leads to fear.\n"
)


def test_knowledge_with_default_rules(spark):
    docs = spark.createDataFrame([(1, KNOWLEDGE), (2, KNOWLEDGE)], "doc_id long, text string")
    found = knowledge.candidates(docs, "doc_id", "text")
    titles = {r.title for r in found.filter("doc_id = 1").collect()}
    assert {"Risk Management", "Stop Loss", "Moving Average", "RSI", "Technical Analysis", "Drawdown"} <= titles
    rows = knowledge.described(docs, found, "doc_id", "text")
    table = knowledge.registry(rows, "doc_id")
    assert table.filter("mentions <> 2").count() == 0
    rsi = table.filter("slug = 'rsi'").first()
    assert rsi.difficulty == "advanced" and rsi.category == "Technical Analysis"
    concepts = knowledge.document_concepts(rows, table, "doc_id")
    edges = {(r.source, r.relation, r.target) for r in knowledge.relations(concepts, "doc_id").collect()}
    assert ("RSI", "is_indicator", "Technical Analysis") in edges and ("Stop Loss", "used_for", "Risk Management") in edges
    made = knowledge.claims(docs, concepts, "doc_id", "text")
    kinds = {r.statement[:10]: (r.concept, r.claim_type, r.arrivals) for r in made.collect()}
    assert kinds["Risk manag"] == ("risk-management", "definition", 2)
    assert kinds["Traders sh"][1] == "causal"
    tagged = {(r.slug, r.tag) for r in knowledge.tags(docs, concepts, "doc_id", "text").collect()}
    assert ("rsi", "indicator") in tagged and ("drawdown", "advanced") in tagged and ("rsi", "risk") not in tagged


def test_scope_and_snapshots(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    assert quality.scoped(df, None, "c").count() == 2
    assert quality.scoped(df, df.filter("false"), "c").count() == 0
    before = spark.createDataFrame([(i, "succeeded", i) for i in range(4)], "id int, status string, x int")
    after = spark.createDataFrame([(0, "succeeded", 0), (1, "invalidated", 1), (2, "failed", 2)], "id int, status string, x int")
    found = {(r.id, r.problem) for r in quality.snapshot_changes(before, after, "id", ["x"], "status").collect()}
    assert found == {(2, "status changed"), (3, "row disappeared")}


def test_versions_rotate(spark):
    rows = [(1, 10, 1, True), (1, 11, 2, False), (1, 12, 3, True), (1, 13, 4, False), (2, 20, 1, False), (2, 21, 2, False)]
    df = spark.createDataFrame(rows, "document int, version int, seq int, make boolean")
    got = ch.rg.with_current_flag(df, "document", "version", ["seq"], "make").filter("is_current").collect()
    assert {(r.document, r.version) for r in got} == {(1, 12), (2, 20)}


def test_stream_dedup_over_batches(spark, tmp_path):
    from lorespark.streaming import streams

    schema = "doc_id long, text string"
    for run, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [(6, "a"), (7, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        # a lost progress folder replays everything; the sink still stays unique
        progress = tmp_path / ("p" if run < 2 else "p2")
        streams.dedup_ingest(source, "text", str(tmp_path / "out"), str(progress))
    stored = [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(stored) == ["a", "b", "c", "d"]


def test_leases_of_the_last_hours_are_flushed(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    statuses = ["queued", "reserved", "running", "succeeded", "reserved", "retrying", "running"]
    rows = [(rng.randrange(12), start + timedelta(seconds=rng.randrange(6 * 3600)), i, rng.choice(statuses)) for i in range(900)]
    rows += [(0, start + timedelta(hours=6), 900 + i, "reserved") for i in range(3)]
    df = spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, status string")
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(2).write.parquet(f"{folder}/events.parquet")
    streamed = streams.read_stream(spark, f"{folder}/events.parquet", "", df.schema)
    streams.lease_expiry(streamed, sink, str(tmp_path / "progress"), groups=2)
    read = lambda: streams.expired_leases(spark, sink)
    before = read().count()
    streams.flush_leases(df, sink, since=F.lit(start + timedelta(hours=2)))
    got = {tuple(r) for r in read().collect()}
    streams.flush_leases(df, sink)
    assert read().count() == len(got) > before > 0
    want = set()
    ttl = timedelta(seconds=300)
    for job, ts, event, status in rows:
        if status != "reserved":
            continue
        later = sorted((t, e, s) for j, t, e, s in rows if j == job and (t, e) > (ts, event))
        closed = next((t for t, _, s in later if s in ("queued", "reserved", "succeeded", "failed", "cancelled")), None)
        ran = next((t for t, _, s in later if s == "running"), None)
        if closed is None or closed > ts + ttl:
            live = ran is not None and ran <= ts + ttl
            want.add((job, event, ts + ttl, "running" if live else "reserved", "failed" if live else "released"))
    assert got == want
