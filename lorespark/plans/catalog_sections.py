"""Registered queries: sections, paragraphs, offsets and statistics of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorespark.operators import sections
from lorespark.plans import views as v
from lorespark.plans.registry import Tables, query

#: classified lines of md_docs, spelled without look-around
SQL_HEADINGS = v.SQL_MD + r""",
ln0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM md_docs),
ln1 AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS bare,
  lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ln0),
ln AS (SELECT doc_id, pos, bare,
  CASE WHEN regexp_full_match(bare, '#{1,6}\s+(.+?)\s*#*') THEN length(regexp_extract(bare, '^(#{1,6})\s', 1))
    WHEN bare <> '' AND regexp_full_match(coalesce(nxt, ''), '\s*(=+|-+)\s*') AND length(trim(nxt)) >= 3
      THEN CASE WHEN trim(nxt) LIKE '=%' THEN 1 ELSE 2 END
    WHEN length(bare) <= 120 AND len(regexp_extract_all(bare, '\S+')) BETWEEN 1 AND 12
      AND regexp_matches(bare, '\p{L}') AND upper(bare) = bare THEN 1 END AS level,
  CASE WHEN regexp_full_match(bare, '#{1,6}\s+(.+?)\s*#*')
    THEN trim(regexp_extract(bare, '^#{1,6}\s+(.+?)\s*#*$', 1)) ELSE bare END AS title_text FROM ln1)"""

SQL_PARAGRAPHS = SQL_HEADINGS + r""",
g AS (SELECT *, sum((level IS NOT NULL)::INT) OVER w AS sec,
    sum((level IS NOT NULL OR bare = '')::INT) OVER w AS par
  FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
heads AS (SELECT doc_id, sec, title_text AS title, level FROM g WHERE level IS NOT NULL),
pg AS (SELECT doc_id, sec, par, min(pos) AS pos, string_agg(bare, ' ' ORDER BY pos) AS text
  FROM g WHERE level IS NULL AND bare <> '' GROUP BY ALL),
paragraphs AS (SELECT p.doc_id, dense_rank() OVER (PARTITION BY p.doc_id ORDER BY p.sec) - 1 AS section,
    title, coalesce(level, 1) AS level, row_number() OVER (PARTITION BY p.doc_id ORDER BY pos) - 1 AS paragraph,
    pos, text
  FROM pg p LEFT JOIN heads h ON p.doc_id = h.doc_id AND p.sec = h.sec)"""

#: rows that open or fill sections, for path and offset queries
SQL_BLOCKS = SQL_PARAGRAPHS + r""",
block_rows AS (
  SELECT doc_id, pos, level::INT AS level, title_text AS title, title_text AS text FROM ln WHERE level IS NOT NULL
  UNION ALL SELECT doc_id, pos, NULL, NULL, text FROM paragraphs)"""


def headings(t: Tables) -> DataFrame:
    lines = sections.lines_of(v.md_docs(t), "doc_id", "text")
    return sections.text_headings(lines, "doc_id")


def paragraphs(t: Tables) -> DataFrame:
    return sections.text_paragraphs(headings(t), "doc_id")


def block_rows(t: Tables) -> DataFrame:
    """Heading rows and paragraph rows of md_docs, by true line position."""
    headed = headings(t)
    heads = headed.filter("level IS NOT NULL").select(
        "doc_id", "pos", "level", "title", F.col("title").alias("text")
    )
    body = sections.text_paragraphs(headed, "doc_id").select(
        "doc_id", "pos", F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("title"), "text",
    )
    return heads.unionByName(body)


@query("c1_headings", f"""
WITH {SQL_HEADINGS} SELECT doc_id, pos::BIGINT AS pos, level::BIGINT AS level, title_text AS title
FROM ln WHERE level IS NOT NULL""")
def c1(t: Tables):
    return headings(t).filter("level IS NOT NULL").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        F.col("level").cast("bigint").alias("level"), "title",
    )


@query("c2_paragraphs", f"""
WITH {SQL_PARAGRAPHS} SELECT doc_id, section::BIGINT AS section, title, level::BIGINT AS level,
  paragraph::BIGINT AS paragraph, pos::BIGINT AS pos, text FROM paragraphs""")
def c2(t: Tables):
    out = paragraphs(t)
    return out.select("doc_id", "title", "text",
                      *[F.col(c).cast("bigint").alias(c) for c in ("section", "level", "paragraph", "pos")])


@query("c3_paged_sections", rf"""
WITH {v.SQL_PAGED},
pg0 AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page_text,
  generate_subscripts(string_split(text, chr(12)), 1) AS page FROM paged_docs),
l0 AS (SELECT doc_id, page, {v.sql_collapse("unnest(string_split(page_text, chr(10)))")} AS bare,
  generate_subscripts(string_split(page_text, chr(10)), 1) AS l FROM pg0),
l1 AS (SELECT *, CASE
  WHEN bare = '' OR length(bare) > 120 OR regexp_matches(bare, '[.;,]$') THEN NULL
  WHEN regexp_matches(bare, '^[0-9]+(\.[0-9]+)*[.)]?\s+.+$')
    THEN least(6, 1 + length(regexp_replace(regexp_extract(bare, '^([0-9]+(\.[0-9]+)*)', 1), '[^.]', '', 'g')))
  WHEN len(string_split(bare, ' ')) <= 12 AND regexp_matches(bare, '\p{{L}}') AND upper(bare) = bare THEN 1
  WHEN len(string_split(bare, ' ')) <= 8
    AND len(list_filter(string_split(bare, ' '), lambda w: regexp_matches(w, '^\p{{L}}') AND NOT regexp_matches(w, '^\p{{Lu}}'))) = 0
    THEN 2 END AS level FROM l0),
l2 AS (SELECT *, sum((level IS NOT NULL OR l = 1)::INT) OVER w AS sec,
  sum((level IS NOT NULL OR l = 1 OR bare = '')::INT) OVER w AS par
  FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY page, l)),
h AS (SELECT doc_id, sec, bare AS title, level FROM l2 WHERE level IS NOT NULL),
p AS (SELECT doc_id, sec, par, min(page) AS page, string_agg(bare, ' ' ORDER BY page, l) AS text
  FROM l2 WHERE level IS NULL AND bare <> '' GROUP BY ALL)
SELECT p.doc_id, page::BIGINT AS page, dense_rank() OVER (PARTITION BY p.doc_id ORDER BY p.sec)::BIGINT - 1 AS section,
  coalesce(title, 'Page ' || page) AS title, coalesce(level, 1)::BIGINT AS level,
  row_number() OVER (PARTITION BY p.doc_id ORDER BY par)::BIGINT - 1 AS paragraph, text
FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.sec = h.sec""")
def c3(t: Tables):
    out = sections.paged_paragraphs(v.paged_docs(t), "doc_id", "text")
    return out.select("doc_id", "title", "text",
                      *[F.col(c).cast("bigint").alias(c) for c in ("page", "section", "level", "paragraph")])


@query("c9_section_paths", f"""
WITH {SQL_BLOCKS},
lasts AS (SELECT doc_id, pos, text,
    max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2,
    max(CASE WHEN level = 3 THEN pos END) OVER w AS p3 FROM block_rows
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
named AS (SELECT l.doc_id, l.pos, l.text,
    h1.title AS t1, CASE WHEN p2 > coalesce(p1, -1) THEN h2.title END AS t2,
    CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN h3.title END AS t3
  FROM lasts l LEFT JOIN block_rows h1 ON h1.doc_id = l.doc_id AND h1.pos = l.p1
  LEFT JOIN block_rows h2 ON h2.doc_id = l.doc_id AND h2.pos = l.p2
  LEFT JOIN block_rows h3 ON h3.doc_id = l.doc_id AND h3.pos = l.p3)
SELECT doc_id, pos::BIGINT AS pos, concat_ws(' > ', t1, t2, t3) AS path, sha256(text) AS text_sha FROM named""")
def c9(t: Tables):
    out = sections.with_section_path(block_rows(t), "doc_id")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                      F.array_join("path", " > ").alias("path"), F.sha2("text", 256).alias("text_sha"))


@query("c13_char_offsets", f"""
WITH {SQL_BLOCKS},
o AS (SELECT doc_id, pos, length(text) AS n,
    coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM block_rows)
SELECT doc_id, pos::BIGINT AS pos, s::BIGINT AS char_start, (s + n)::BIGINT AS char_end FROM o""")
def c13(t: Tables):
    out = sections.with_offsets(block_rows(t), "doc_id")
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "char_start", "char_end")])


@query("c14_document_statistics", f"""
WITH {SQL_PARAGRAPHS},
pc AS (SELECT doc_id, count(*) AS n, count(DISTINCT section) AS s FROM paragraphs GROUP BY doc_id)
SELECT d.doc_id, {v.sql_words('text')}::BIGINT AS word_count, length(text)::BIGINT AS character_count,
  coalesce(n, 0)::BIGINT AS paragraph_count, coalesce(s, 0)::BIGINT AS section_count,
  {v.sql_strip('text')} <> '' AND coalesce(n, 0) > 0 AS valid
FROM md_docs d LEFT JOIN pc ON pc.doc_id = d.doc_id""")
def c14(t: Tables):
    paras = paragraphs(t)
    heads = paras.groupBy("doc_id", "section").agg(F.count("*").alias("n"))
    return sections.document_statistics(
        v.md_docs(t), "doc_id", "text", {"paragraph_count": paras, "section_count": heads}
    )
