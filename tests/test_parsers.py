"""Hand-made documents with their expected blocks."""

import random

from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import html, markdown, sections

PLAIN = """INTRO NOTE

First line
second line

Setext title
============
Body one.

## Sub part ##
Body two.
---
Body three.
"""

MARKDOWN = """---
title: Tide tables
author: 'K. Moss'
keywords: [sea, moon]
---
Harbour notes
-------------

Low water comes *twice* a day, see `ebb(t)` or [the log](https://sea.example/log_(old) 'Log').

1. first tide
   * inner mark
2. second tide

>> deep quote
>> goes on

~~~sh
echo "a | b" ```
```python
## no heading
~~~

Port | Height
:--- | -----:
Quay | 3

[![gauge](g.png)](https://sea.example/g) and _one_snake_case_ word.

***

\tspring()

[log]: <https://sea.example/log> (The log)
"""

PAGE = """<!DOCTYPE html><HTML lang='pt'><head><title>Mar&eacute;s &amp; Lua</title>
<meta content="Lu&iacute;s d&#39;Orey" name=author><meta name='keywords' content='sea&#44;salt, moon;'>
<meta property="og:description" content="Tides"><script>if (a < b) { "<h1>no</h1>" }</script></head>
<body><p>Loose words<h2>Harbour</h2><!-- <li>gone -->
<p>Ebb with <b>bold</b> and
<a rel=nofollow href='/log'>the log</a>!
<ol><li>rope<ol><li>knot</ol><li><p>sail</p></ol>
<h3>Lights</h3><blockquote>red<blockquote>green</blockquote></blockquote>
<pre>on
 off</pre>
<table><caption>Heights</caption><tr><th>Port<th>m</tr><tr><td>Quay<td>3</tr></table>
<figure><img alt="gauge" src="g.png"><figcaption>Gauge</figcaption></figure>
<style>p { color: red }</style></body></HTML>"""


def frame(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id int, text string")


def test_plain_sections(spark):
    lines = sections.lines_of(frame(spark, PLAIN), "doc_id", "text")
    headed = sections.text_headings(lines, "doc_id")
    found = [(r.title, r.level) for r in headed.filter("level is not null").orderBy("pos").collect()]
    assert found == [("INTRO NOTE", 1), ("Setext title", 1), ("Sub part", 2), ("Body two.", 2)]
    out = sections.text_paragraphs(headed, "doc_id").orderBy("paragraph").collect()
    assert [(r.title, r.text) for r in out] == [
        ("INTRO NOTE", "First line second line"), ("Setext title", "Body one."), ("Body two.", "Body three.")]
    assert [r.section for r in out] == [0, 1, 2]


def test_underlines_are_eaten_in_pairs(spark):
    lines = sections.lines_of(frame(spark, "a\n---\n---\n---\nb"), "doc_id", "text")
    rows = sections.text_headings(lines, "doc_id").orderBy("pos").collect()
    assert [(r.title, r.dropped) for r in rows] == [
        ("a", False), (None, True), ("---", False), (None, True), (None, False)]


def test_fallback_title(spark):
    lines = sections.lines_of(frame(spark, "some text first\n\nHEAD\nbody"), "doc_id", "text")
    headed = sections.text_headings(lines, "doc_id")
    out = sections.text_paragraphs(headed, "doc_id", F.lit("file stem")).orderBy("pos").collect()
    assert [r.title for r in out] == ["file stem", "HEAD"]


def test_paged_sections(spark):
    text = "1.2 Scope\nBody text goes on here.\n\nOTHER HEAD\nmore words, and more\fplain start of page two.\nA Short Title\nend"
    out = sections.paged_paragraphs(frame(spark, text), "doc_id", "text").orderBy("pos").collect()
    assert [(r.page, r.title, r.level, r.text) for r in out] == [
        (1, "1.2 Scope", 2, "Body text goes on here."), (1, "OTHER HEAD", 1, "more words, and more"),
        (2, "Page 2", 1, "plain start of page two."), (2, "A Short Title", 2, "end")]


def test_section_paths_equal_a_stack(spark):
    rng = random.Random(3)
    rows, want, stack = [], [], []
    for pos in range(300):
        level = rng.choice([None, None, 1, 2, 3, 4, 5, 6])
        if level:
            stack = [s for s in stack if s[0] < level] + [(level, f"t{pos}")]
        rows.append((1, pos, level, f"t{pos}" if level else None))
        want.append([t for _, t in stack])
    df = spark.createDataFrame(rows, "doc_id int, pos int, level int, title string")
    got = sections.with_section_path(df, "doc_id").orderBy("pos").collect()
    assert [r.path for r in got] == want


def test_markdown(spark):
    front = markdown.front_matter(frame(spark, MARKDOWN), "doc_id", "text")
    meta = front.first()
    assert (meta.title, meta.author, meta.keywords) == ("Tide tables", "K. Moss", ["sea", "moon"])
    blocks = markdown.blocks(front, "doc_id", "body")
    rows = blocks.orderBy("pos").collect()
    assert [(r.block_type, r.text) for r in rows] == [
        ("heading", "Harbour notes"), ("paragraph", "Low water comes twice a day, see ebb(t) or the log."),
        ("list_item", "first tide"), ("list_item", "inner mark"), ("list_item", "second tide"),
        ("blockquote", "deep quote\ngoes on"), ("fenced_code", 'echo "a | b" ```\n```python\n## no heading'),
        ("table", "Port\tHeight\nQuay\t3"), ("paragraph", "gauge and one_snake_case word."),
        ("horizontal_rule", "[HORIZONTAL_RULE]"), ("code_block", "spring()"),
        ("definition", "[log]: <https://sea.example/log> (The log)")]
    items = [r for r in rows if r.block_type == "list_item"]
    assert [(r.list_level, r.ordered, r.list_start) for r in items] == [(0, True, 1), (1, False, None), (0, True, 2)]
    assert rows[6].language == "sh" and rows[7].cells == [["Port", "Height"], ["Quay", "3"]]
    links = {(r.kind, r.text, r.target, r.title) for r in markdown.inline_links(blocks, "doc_id").collect()}
    assert links == {("link", "the log", "https://sea.example/log_(old)", "Log"), ("link", "gauge", "https://sea.example/g", None),
                     ("image", "gauge", "g.png", None), ("code", "ebb(t)", None, None)}
    ref = markdown.reference_definitions(front, "doc_id", "body").first()
    assert (ref.label, ref.target, ref.title) == ("log", "https://sea.example/log", "The log")


def test_fences_close_with_their_own_sign(spark):
    cases = {
        "```\na\n~~~\nb\n```\nplain": ["a\n~~~\nb", "plain"],
        "```\na\n```python\nb\n```\n# head": ["a\n```python\nb", "head"],
        "````\n```\nx\n```\n````\nend": ["```\nx\n```", "end"],
        "~~~ a`b\nx\n~~~~\ny": ["x", "y"],
        "``` a`b\n\nplain": ["``` a`b", "plain"],
        "```\nnever closed\n\n# code": ["never closed\n\n# code"],
        "```\none\n```\n```\ntwo\n```": ["one", "two"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    found = {}
    for r in markdown.blocks(df, "doc_id", "text").orderBy("doc_id", "pos").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_long_lines_take_linear_time(spark):
    n = 1 << 18
    pieces = ["[", "![", "](", "[a](", "`", "` ``", "*", "**a ", "_a ", "> ", ">", "|", "-", "- ", "#", "# ", "~", "=", "/a", "/", "\\", "[x]", "<", "&"]
    texts = [(p * (n // len(p))) for p in pieces] + ["[" + "a" * n, "# " + " " * n + "x", "~" * n + "`", "[a]:" + " " * n + "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    blocks = markdown.blocks(df, "doc_id", "text")
    assert blocks.agg(F.count("*")).first()[0] > 0
    markdown.inline_links(blocks, "doc_id").count()
    markdown.reference_definitions(df, "doc_id", "text").count()
    markdown.front_matter(df, "doc_id", "text").agg(F.sum(F.length("body"))).first()
    df.select(tx.safe_message(F.col("text")), tx.error_code(F.col("text"))).agg(F.count("*")).first()


def test_html(spark):
    df = frame(spark, PAGE)
    found = html.blocks(df, "doc_id", "text")
    rows = found.orderBy("pos").collect()
    assert [(r.block_type, " ".join(r.text.split())) for r in rows] == [
        ("paragraph", "Loose words"), ("heading", "Harbour"), ("paragraph", "Ebb with bold and the log !"),
        ("list_item", "rope"), ("list_item", "knot"), ("list_item", "sail"), ("heading", "Lights"),
        ("blockquote", "red"), ("blockquote", "green"), ("preformatted", "on off")]
    titles = html.metadata(df, "doc_id", "text")
    meta = titles.first()
    assert (meta.title, meta.author, meta.subject, meta.language) == ("Marés & Lua", "Luís d'Orey", "Tides", "pt")
    assert meta.keywords == ["sea", "salt", "moon"]
    paths = [r.path for r in html.with_paths(found, titles.select("doc_id", "title"), "doc_id").orderBy("pos").collect()]
    assert paths[0] == ["Marés & Lua"] and paths[3] == ["Marés & Lua", "Harbour"] and paths[-1] == ["Marés & Lua", "Harbour", "Lights"]
    table = html.tables(df, "doc_id", "text").first()
    assert (table.caption, table.headers, table.rows) == ("Heights", ["Port", "m"], [["Quay", "3"]])
    link = html.links(df, "doc_id", "text").first()
    assert (link.text, link.target, link.rel) == ("the log", "/log", "nofollow")
    image = html.images(df, "doc_id", "text").first()
    assert (image.identifier, image.alt_text, image.caption) == ("g.png", "gauge", "Gauge")


def test_html_limits_and_broken_markup(spark):
    broken = html.blocks(frame(spark, "<html><body><h1>Title<p>Still content"), "doc_id", "text").orderBy("pos").collect()
    assert [r.text for r in broken] == ["Title", "Still content"]
    deep = html.complexity(frame(spark, "<div>" * 101 + "x"), "doc_id", "text").first()
    assert deep.depth == 101 and not deep.accepted
    unclosed = html.complexity(frame(spark, "<div>" + "<p>x" * 200), "doc_id", "text").first()
    assert unclosed.accepted
    rare = html.blocks(frame(spark, "<p>a&nbsp;&eacute;&#233; &amp;lt;</p>"), "doc_id", "text").first()
    assert rare.text.endswith("éé &lt;")
