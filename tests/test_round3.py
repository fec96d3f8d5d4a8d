"""Faults found on larger and odd tables."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.llm import op10_hmm
from lorespark.operators import knowledge, markdown, search
from lorespark.plans import flagship
from lorespark.plans.catalog import ORACLES, QUERIES
from lorespark.sources import corpus
from lorespark.streaming import streams
from tests.oracle import compare, connect


def test_a_stream_reads_a_table_that_is_a_folder_of_parts(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["l1_stream_dedup"](spark, str(tmp_path)).select("sha256", "copies").collect()
    assert len(got) == 7 and {r.copies for r in got} == {1}


def test_references_without_a_semicolon_agree_with_the_sql(spark, tmp_path):
    texts = ["a&amp&amp", "&copy 1", "&am", "&notit; &notin;", "&#150; &#39;x &#0;", "&ltb &amp;lt; &nbsp;z", "&;&#;&", "&NotEqualTilde;"]
    rows = [(i, f"u{i}", f"<html><head><title>{t}</title></head><body><h1>H{t}</h1><p>{t} end</p></body></html>") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/in")
    (part,) = (tmp_path / "in").glob("*.parquet")
    con = connect(str(tmp_path))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{part}'")
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables/pages.parquet").symlink_to(part)
    for name in ("c7_html_metadata", "c8_html_blocks", "c9_html_paths", "c13_html_offsets", "c14_page_statistics"):
        status, _, _, note = compare(spark, con, str(tmp_path / "tables"), name, QUERIES[name], ORACLES[name])
        assert status == "ok", (name, note)
    titles = {r.page_id: r.title for r in QUERIES["c7_html_metadata"](spark, str(tmp_path / "tables")).collect()}
    assert titles[0] == "a&&" and titles[2] == "&am"


def _old_clean(text: str) -> str:
    out = re.sub(r"\r\n?", "\n", text.replace("\x00", " "))
    out = re.sub(r" +\n *|\n +", "\n", re.sub(r"[ \t]{2,}|\t", " ", out))
    return re.sub(r"\n{3,}", "\n\n", out).strip(" \t\n\r\x0b\x0c")


def test_clean_text_on_random_white_space(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \t\n\r\x00") for _ in range(rng.randrange(30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.c == _old_clean(r.t) for r in df.select("t", tx.clean_text(F.col("t")).alias("c")).collect())


MINED = (
    "Stop-loss orders are what René O'Neil calls a Stop Loss rule here. The RSI rose and the RSI fell again today.\n"
    "A stop loss and the RSI belong together in every plan that he wrote. Moving Average lines follow the RSI slowly."
)


def test_documents_are_mined_in_their_own_row(spark):
    long = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} number follows here again and again." for i in range(3000))
    docs = spark.createDataFrame([(1, MINED), (2, long), (3, None), (4, "")], "doc_id long, text string")
    rows = knowledge.described(docs, None, "doc_id", "text")
    # a shuffle of words or word pairs grows far beyond the texts
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.title): r.summary for r in rows.collect()}
    split = knowledge.described(docs, knowledge.candidates(docs, "doc_id", "text"), "doc_id", "text")
    assert got == {(r.doc_id, r.title): r.summary for r in split.collect()}
    assert got[1, "Stop Loss"].startswith("Stop-loss orders") and got[1, "RSI"].startswith("The RSI rose")
    assert got[1, "Moving Average"].startswith("Moving Average lines") and {d for d, _ in got} == {1, 2}
    assert len(got) > 600


@pytest.mark.parametrize("name", ["d16_next_page", "d17_artifacts", "h8_changed_parts"])
def test_texts_are_cut_once(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # every part reads the rows of numbers


def test_inline_marks_are_removed_as_before(spark):
    rng = random.Random(9)
    bits = ["a", "b c", "*", "**", "_", "__", "`", "\\*", "\\", "![x](u)", "[t](v)", " ", "  ", "\t", "\n", "1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = F.col("t")
    for pattern, new in (
        (markdown._IMAGE, "$1"), (markdown._LINK, "$1"), (r"(?s)(?<!`)(`++)[ ]?(.+?)[ ]?\1(?!`)", "$2"),
        (r"\*\*(?=\S)([^*\n]++(?:\*(?!\*)[^*\n]++)*+)(?<=\S)\*\*", "$1"), (r"__(?=\S)([^_\n]++(?:_(?!_)[^_\n]++)*+)(?<=\S)__", "$1"),
        (r"(?<![*\p{L}\p{N}])\*(?=[^\s*])([^*\n]++)(?<=[^\s*])\*(?!\*)", "$1"),
        (r"(?<![_\p{L}\p{N}])_(?=[^\s_])([^_\n]++(?:(?<=[\p{L}\p{N}])_(?=[\p{L}\p{N}])[^_\n]++)*+)(?<=[^\s_])_(?![_\p{L}\p{N}])", "$1"),
        (r"\\([!-/:-@\[-`{-~])", "$1"), (r"[ \t]+", " "),
    ):
        out = F.regexp_replace(out, pattern, new)
    pairs = df.select("t", markdown.inline_text(F.col("t")).alias("new"), tx.strip(out).alias("old")).collect()
    assert all(r.new == r.old for r in pairs)


def _random_events(rng: random.Random, n: int, seconds: int) -> list[tuple]:
    statuses = ["queued", "reserved", "reserved", "running", "running", "succeeded", "retrying", "failed"]
    return [(rng.choice([0, 0, 1, 2, 3]), rng.randrange(seconds), i, rng.choice(statuses)) for i in range(n)]


def _held(spark, rows: list[tuple]):
    df = spark.createDataFrame(rows, "job_id long, s long, event_id long, status string")
    return df.select("job_id", F.timestamp_seconds("s").alias("ts"), "event_id", "status")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["job_id", "ts", "event_id", "status"])
    return df.assign(ts=pd.to_datetime(df.ts, unit="s"))


@pytest.mark.parametrize("n", [1, 5, 60, 400])
def test_an_array_of_events_gives_the_leases_of_the_rule(spark, n):
    rows = _random_events(random.Random(n), n, 3901)
    want = {tuple(r) for r in streams.ended_leases(_frame(rows), pd.Timestamp(3600, unit="s"), pd.Timedelta(seconds=300)).itertuples(index=False)}
    kept = _held(spark, [r for r in rows if r[3] != "retrying"])
    arrays = kept.agg(F.sort_array(F.collect_list(F.struct("job_id", "ts", "event_id", "status"))).alias("events"))
    found = arrays.select(F.explode(streams.leases_over(F.col("events"), F.timestamp_seconds(F.lit(3600)), 300)).alias("x")).select("x.*")
    got = {(r.job_id, r.reserved_event, pd.Timestamp(r.expired_at), r.previous, r.event_type) for r in found.collect()}
    assert got == want and (n < 60 or got)


def test_an_array_of_events_gives_the_segments_of_the_rule(spark):
    rows = _random_events(random.Random(8), 300, 3600)
    want = {r.job_id: r for r in streams.judged_segments(_frame(rows), 0, {r[0] for r in rows}).itertuples(index=False)}
    grouped = _held(spark, rows).groupBy("job_id", F.lit(0).cast("long").alias("hour"))
    held = grouped.agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "status"))).alias("events"))
    got = {r.job_id: r for r in streams.segments(held).collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 3}
    for job, r in got.items():
        assert tuple(r)[:8] == tuple(want[job])[:8]
        assert [x.asDict() for x in r.illegal] == want[job].illegal


def test_statistics_read_the_chunks_once(spark, small):
    plan = QUERIES["e3_corpus_statistics"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # all rows come from the kept counts


def test_a_filter_on_the_category_counts_keywords_once(spark):
    df = spark.range(1).selectExpr("'The end and the rest' AS t")
    rows = df.select(search.classify(F.col("t"), {"a": ["the"], "b": ["end"]}).alias("c")).filter("c = 'a'")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("replace(") <= 4
    texts = ["", "İthe end", "ended", "das über ü ü", "aaa"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.count_substring(F.col("t"), F.lit("ü")).alias("n"))
    assert {r.t: r.n for r in found.collect()} == {t: t.count("ü") for t in texts}


def test_each_word_of_a_block_is_searched_once(monkeypatch):
    tokens = ["aa", "an", "a-b", "ana", "--"]
    best = search.TopChunks([(0, token, 1) for token in tokens], 1, 3)
    searched = []
    plain = best._found
    monkeypatch.setattr(best, "_found", lambda runs: searched.extend(runs) or plain(runs))
    texts = ["aaaa banana an", "", "an aaa a-b'an é a an", "banana aaaaa x ---- - -", "ananas aa a aa"]
    row, cell = best.counts([*texts, None])
    for i, text in enumerate(texts):
        for k, token in enumerate(tokens):
            assert int(((row == i) & (cell == k)).sum()) == text.count(token)
    assert len(searched) == len(set(searched)) and "banana" in searched
    assert [len(x) for x in best.counts(["", None, "é"])] == [0, 0]


def test_symbols_of_texts_are_one_value_a_row():
    heavy, logs = {b"a": 0, b"b": 1}, np.log10(np.array([4.0, 3.0, 2.0, 1.0]))
    texts = ["a b", "", None, "B zz a zz"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "trains": [True] * 4, "number": [0, 1, 2, 3], "_t": texts})
    (out,) = op10_hmm._symbol_batches(SimpleNamespace(value=(heavy, logs)))(iter([batch]))
    assert out.column("symbols").type == pa.binary()  # arrays cost the passes a step for each token
    for lo, want in ((0, [[0, 1, 2], [2], [2], [1, 3, 0, 3, 2]]), (2, [[2], [1, 3, 0, 3, 2]]), (4, [])):
        symbols, bounds = op10_hmm._symbols_of(out.slice(lo).column("symbols"))
        assert [symbols[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert out.column("times").to_pylist()[3] == [2]


@pytest.mark.parametrize("name", ["d13_validation", "d13_structural_validation"])
def test_validated_chunks_are_cut_once(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and "Window" not in plan  # both uses read the kept rows


def test_texts_are_cleaned_once_and_copies_merged_in_one_exchange(spark):
    rows = [(1, "a  text that is long enough\r\n\n\n\nend "), (2, "short"), (3, None), (4, "a text that is long enough\n\nend"), (5, "another text, long enough")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = flagship.unique_texts(docs)
    assert sorted(map(tuple, found.collect())) == [(1, rows[3][1]), (5, rows[4][1])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.lower().count("trim(") == 1
    # nor does the filter go in front of a join, where it would clean every text
    wanted = docs.join(spark.createDataFrame([(5,)], "doc_id long"), "doc_id", "left_semi")
    plan = corpus.usable_text(wanted, "text").filter("usable")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("trim(") == 1 and plan.index("trim(") < plan.index("Join")


def test_runs_that_a_task_knows_are_not_searched_again(monkeypatch):
    monkeypatch.setattr(search, "KNOWN_RUNS", 4)
    tokens = ["aa", "an", "a-b", "ana", "--"]
    best = search.TopChunks([(0, token, 1) for token in tokens], 1, 3)
    searched = []
    plain = best._found
    monkeypatch.setattr(best, "_found", lambda runs: searched.extend(runs) or plain(runs))
    blocks = [["banana aaaa", "an", "ana"], ["banana an x-a-b", None, "ananas aa-aa"], ["anaé-- ---", "ananas ana", "aaaa", "x-a-b"]]
    for block in blocks:
        row, cell = best.counts(block)
        for i, text in enumerate(block):
            for k, token in enumerate(tokens):
                assert int(((row == i) & (cell == k)).sum()) == (text or "").count(token)
    assert len(best.known) == 4 and searched.count("banana") == searched.count("an") == 1


def test_large_weights_are_summed_exactly():
    best = search.TopChunks([(0, "aa", 1 << 24), (0, "bb", 1), (1, "bb", 3)], 2, 2)
    best.add(pa.array(["aa bb", "aa", "bb bb"]), pa.RecordBatch.from_pydict({"k": [1, 2, 3]}))
    got = [tuple(r.values()) for b in best.rows() for r in b.to_pylist()]
    assert got == [(0, 1, (1 << 24) + 1), (0, 2, 1 << 24), (1, 3, 6), (1, 1, 3)]
