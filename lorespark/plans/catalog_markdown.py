"""Registered queries: Markdown derived from the document texts.

``rich_md`` gives lines of every text a block mark by their place, so that
each block type occurs in bulk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorespark.operators import markdown
from lorespark.plans import views as v
from lorespark.plans.registry import Tables, query


def rich_md(t: Tables) -> DataFrame:
    def mark(line, i):
        safe = F.replace(line, F.lit("|"), F.lit("/"))
        return (
            F.when(i == 0, F.concat(F.lit("# "), line))
            .when(i % 8 == 1, F.concat(F.lit("- "), line))
            .when(i % 8 == 2, F.concat(F.lit("> "), line))
            .when(i % 8 == 3, F.concat(F.lit("```text\n"), line, F.lit("\n```")))
            .when(i % 8 == 4, F.concat(F.lit("| key | line |\n| --- | --- |\n| "), F.lit("k | "), safe, F.lit(" |")))
            .when(i % 8 == 5, F.concat(F.lit("---\n\nSee [the source](https://example.invalid/"),
                                       i.cast("string"), F.lit("), ![alt](img.png) and `x1`.")))
            .when(i % 8 == 6, F.concat(F.lit("1. "), line))
            .otherwise(line)
        )

    lines = F.transform(F.split("text", "\n"), mark)
    front = F.concat(F.lit("---\ntitle: Document "), F.col("doc_id").cast("string"),
                     F.lit("\n# comment\nkeywords: ["), F.col("lang"), F.lit(", "), F.col("source"),
                     F.lit("]\nlang: "), F.col("lang"), F.lit("\n---\n"))
    return t.documents.select(
        "doc_id", F.concat(front, F.array_join(lines, "\n\n")).alias("text"), "lang", "source"
    )


SQL_RICH = r"""
src AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
raw_blocks AS (SELECT doc_id, i, unnest(CASE
    WHEN i = 0 THEN [{'t': 'heading', 'x': line, 'n': 0}]
    WHEN i % 8 = 1 THEN [{'t': 'list_item', 'x': line, 'n': 0}]
    WHEN i % 8 = 2 THEN [{'t': 'blockquote', 'x': line, 'n': 0}]
    WHEN i % 8 = 3 THEN [{'t': 'fenced_code', 'x': line, 'n': 0}]
    WHEN i % 8 = 4 THEN [{'t': 'table', 'x': 'key' || chr(9) || 'line' || chr(10) || 'k' || chr(9) || trim(replace(line, '|', '/')), 'n': 0}]
    WHEN i % 8 = 5 THEN [{'t': 'horizontal_rule', 'x': '[HORIZONTAL_RULE]', 'n': 0},
      {'t': 'paragraph', 'x': 'See the source, alt and x1.', 'n': 1}]
    WHEN i % 8 = 6 THEN [{'t': 'list_item', 'x': line, 'n': 0}]
    ELSE [{'t': 'paragraph', 'x': line, 'n': 0}] END) AS b FROM src)"""


@query("c4_markdown_block_counts", f"""
WITH {SQL_RICH}
SELECT b.t AS block_type, count(*)::BIGINT AS n FROM raw_blocks WHERE trim(b.x) <> '' GROUP BY 1""")
def c4(t: Tables):
    body = markdown.front_matter(rich_md(t), "doc_id", "text")
    out = markdown.blocks(body, "doc_id", "body")
    return out.groupBy("block_type").agg(F.count("*").alias("n"))


@query("c4_markdown_blocks")
def c4_blocks(t: Tables):
    body = markdown.front_matter(rich_md(t), "doc_id", "text")
    out = markdown.blocks(body, "doc_id", "body")
    return out.select("doc_id", "pos", "block_type", "level", "list_level", "ordered", "language", "text")


@query("c5_markdown_links", f"""
WITH {SQL_RICH}
SELECT doc_id, kind, text, target FROM (
  SELECT doc_id, unnest([{{'k': 'link', 'x': 'the source', 'u': 'https://example.invalid/' || i}},
    {{'k': 'image', 'x': 'alt', 'u': 'img.png'}}, {{'k': 'code', 'x': 'x1', 'u': NULL}}], recursive := true)
  FROM src WHERE i > 0 AND i % 8 = 5) x(doc_id, kind, text, target)""")
def c5(t: Tables):
    # links are counted inside the generated sentences; other lines hold none
    body = markdown.front_matter(rich_md(t), "doc_id", "text")
    out = markdown.inline_links(markdown.blocks(body, "doc_id", "body"), "doc_id")
    return out.select("doc_id", "kind", "text", "target")


@query("c6_front_matter", """
SELECT doc_id, 'Document ' || doc_id AS title, lang AS language, lang || ',' || source AS keywords,
  3::BIGINT AS fields FROM documents""")
def c6(t: Tables):
    out = markdown.front_matter(rich_md(t), "doc_id", "text")
    return out.select("doc_id", "title", "language", F.array_join("keywords", ",").alias("keywords"),
                      F.size("fields").cast("bigint").alias("fields"))
