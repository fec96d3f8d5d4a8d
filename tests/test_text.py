"""Text functions on small hand-made inputs and against Python on all texts."""

import re
import unicodedata

from pyspark.sql import functions as F

from lorespark.functions import hashing, text as tx
from lorespark.sources import corpus


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def test_clean_text(spark):
    assert one(spark, "A  \r\n\r\n\r\n\x00 B \n", tx.clean_text) == "A\n\nB"
    assert one(spark, "\t a\t\tb \n c", tx.clean_text) == "a b\nc"


def test_clean_text_equals_python(spark, small):
    def python(t):
        t = re.sub(r"\r\n?", "\n", t.replace("\x00", " "))
        t = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", t))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    noisy = docs.select("text", F.regexp_replace("text", "e", "\t \r\n ").alias("noisy"))
    rows = noisy.select("noisy", tx.clean_text(F.col("noisy")).alias("got")).collect()
    assert all(r.got == python(r.noisy) for r in rows)


def test_keys_slugs_and_aliases(spark):
    assert one(spark, " Caf\u00e9\u00a0 \uff21\uff22  Stra\u00dfe! ", tx.normalize_key) == "caf\u00e9 ab strasse"
    assert one(spark, "Caf\u00e9 & B\u00e4r", tx.slugify) == "cafe-bar"
    assert one(spark, "\u4e2d\u6587", tx.slugify) == "item"
    assert one(spark, " The\u3000Name ", tx.normalize_alias) == "the name"


def test_nfkc_only_changes_what_python_changes(spark):
    samples = ["plain", "\ufb01n", "\u2460", "e\u0301", "\u00e9", "\u00bd", "\u2019"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r.r for r in df.select(tx.nfkc(F.col("v")).alias("r")).collect()]
    # Latin-1 signs below the letters go through Python as well
    assert got == [unicodedata.normalize("NFKC", s) for s in samples]


def test_whole_terms(spark):
    hit = lambda v, t: one(spark, v, lambda c: tx.contains_term(c, t))
    assert hit("Use a STOP-LOSS now", "stop-loss")
    assert not hit("nonstop loss", "stop loss")
    assert not hit("the \u00e9the", "th")
    assert hit("(rsi)", "RSI")


def test_query_tokens_keep_repeats(spark):
    assert one(spark, "A bear-flag, BEAR-flag x it's", tx.query_tokens) == ["bear-flag", "bear-flag", "it's"]


def test_safe_messages(spark):
    assert one(spark, " bad\n file /srv/a/b.txt: x", tx.safe_message) == "bad file [internal path]: x"
    assert one(spark, "  ", tx.safe_message) == "Parsing failed"
    assert one(spark, "bad input!", tx.error_code) == "BAD_INPUT"


def test_canonical_json_matches_python(spark):
    import json

    value = 'q" \\ \n\t\b\f \x1f \x0b caf\u00e9 \u4e2d \U0001f600 \u2028'
    got = one(spark, value, lambda c: hashing.canonical_json(b=c, a=F.lit(None).cast("string")))
    assert got == json.dumps({"a": None, "b": value}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_file_names(spark):
    name = lambda v: one(spark, v, corpus.normalized_file_name)
    assert name("C:\\tmp\\My R\u00e9sum\u00e9 (1).PDF") == "My_Resume_1.pdf"
    assert name("con.txt") == "file_con.txt"
    assert name("..") is None
    assert name("a" * 400 + ".md") == "a" * 400 + ".md"  # kept whole; admission reports it


def test_format_routing(spark):
    rows = [(".md", "text/plain; charset=x"), (None, "text/plain"), (".txt", "application/octet-stream"),
            (".html", "application/pdf"), (None, None), ("dir/x.HTM", None)]
    df = corpus.route_formats(spark.createDataFrame(rows, "e string, m string"), F.col("e"), F.col("m"))
    assert [r.parser for r in df.collect()] == ["markdown", "txt", "txt", None, None, "html"]


def test_text_corpus_quarantine(spark):
    rows = [(1, b"\xef\xbb\xbfok\r\nx"), (2, b"\xff\xfe"), (3, b""), (4, b" \n")]
    df = corpus.text_corpus(spark.createDataFrame(rows, "id int, c binary"), "c")
    got = {r.id: (r.text, r.problem) for r in df.collect()}
    assert got[1] == ("ok\nx", None)
    assert got[2][1] == "not valid UTF-8" and got[3][1] == "empty document" and got[4][1] == "only white space"
