"""Registered queries: HTML pages."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import DataFrame, functions as F

from lorespark.operators import html, sections
from lorespark.plans import views as v
from lorespark.plans.registry import Tables, query

_DECODE = ("replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
           "'&middot;', '·'), '&lt;', '<'), '&amp;', '&')")


def _sql_decode(x: str) -> str:
    return _DECODE.format(x=x)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# HTML's own names: the longest one that starts behind an ampersand counts, and
# some of them need no semicolon
_NAMES = sorted(html5, key=lambda n: (-len(n), n))
_NAMED = "MAP {" + ", ".join(f"'{n}': {_sql_text(html5[n])}" for n in _NAMES) + "}"
_C1 = "MAP {" + ", ".join(f"{n}: {_sql_text(unescape(f'&#{n};'))}" for n in range(0x80, 0xA0)) + "}"
_CHAR = (f"CASE WHEN n IS NULL OR n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN {_C1}[n] "
         "WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END")


def _sql_unescape(x: str) -> str:
    """Every reference of HTML in one pass, also one that lacks its semicolon."""
    number = ("[try_cast(CASE WHEN e[2] IN ('x', 'X') THEN '0x' || rtrim(e[3:], ';') ELSE rtrim(e[2:], ';') END AS BIGINT)]")
    one = (f"CASE WHEN e = '' THEN '&' WHEN e[1] = '#' THEN list_transform({number}, lambda n: {_CHAR})[1] ELSE {_NAMED}[e] END")
    found = rf"regexp_extract(p, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|{'|'.join(_NAMES)})')"
    part = f"list_transform([{found}], lambda e: {one} || p[len(e) + 1:])[1]"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {part} END), '')"


def _sql_tidy(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split(replace({x}, chr(13), chr(10)), chr(10)), "
            r"lambda z: regexp_replace(regexp_replace(z, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), "
            "lambda z: z <> ''), chr(10))")


SQL_TOKENS = r"""
vis AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<->', 'g'),
  '(?is)<script\b[^>]*>.*?</script\s*>', '<->', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '<->', 'g') AS h FROM pages),
tk0 AS (SELECT page_id, unnest(regexp_extract_all(h, '<[^>]*>|[^<]+|<')) AS token,
  generate_subscripts(regexp_extract_all(h, '<[^>]*>|[^<]+|<'), 1) - 1 AS pos FROM vis),
tk AS (SELECT *, CASE WHEN regexp_matches(token, '^<[/!?A-Za-z-]') THEN
    coalesce(nullif(lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), ''), '-') END AS name,
  token LIKE '</%' AS closes, regexp_matches(token, '^<[!?A-Za-z-]') AS opens FROM tk0)"""

_BLOCK_LIST = ", ".join(f"'{n}'" for n in html.BLOCK_TAGS)

SQL_HTML_BLOCKS = SQL_TOKENS + rf""",
ow AS (SELECT *, last_value(CASE WHEN name = 'p' AND opens THEN pos WHEN name IN ({_BLOCK_LIST}) THEN -1 END IGNORE NULLS) OVER w AS p_at,
  last_value(CASE WHEN name = 'h1' AND opens THEN pos WHEN name = 'h1' THEN -1 END IGNORE NULLS) OVER w AS h_at,
  last_value(CASE WHEN name = 'li' AND opens THEN pos WHEN name = 'li' OR name = 'ul' THEN -1 END IGNORE NULLS) OVER w AS li_at
  FROM tk WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
ob AS (SELECT page_id, CASE WHEN h_at >= 0 THEN h_at WHEN li_at >= 0 THEN li_at ELSE p_at END AS own,
  CASE WHEN h_at >= 0 THEN 'heading' WHEN li_at >= 0 THEN 'list_item' ELSE 'paragraph' END AS block_type, token, pos, name
  FROM ow WHERE h_at >= 0 OR li_at >= 0 OR p_at >= 0),
hb0 AS (SELECT page_id, own AS pos, block_type, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (name IS NULL), '') AS raw
  FROM ob GROUP BY page_id, own, block_type),
hb AS (SELECT page_id, pos, block_type, {_sql_tidy(_sql_decode('raw'))} AS text FROM hb0),
hblocks AS (SELECT * FROM hb WHERE text <> '')"""
# texts with every reference decoded; the counts of d3_content_types need none
SQL_TEXT_BLOCKS = SQL_HTML_BLOCKS.replace(_sql_decode("raw"), _sql_unescape("raw"))


def page_blocks(t: Tables) -> DataFrame:
    return html.blocks(t.pages, "page_id", "html")


def pages_with_metas(t: Tables) -> DataFrame:
    """Every page with four meta tags made of its own data, some with entities."""
    number = F.col("page_id").cast("string")
    metas = F.concat(
        F.lit('<meta name="author" content="Ren&eacute; O&#39;Neil '), number,
        F.lit('"><META content="k'), number, F.lit("&#44;x, &lt;b&gt; ; c\" name='Keywords'>"),
        F.lit('<meta property="og:description" content="About &amp;amp; page '), number,
        F.lit('"><meta name=robots content=none><meta name="empty" content="">'),
    )
    return t.pages.select("page_id", F.concat(metas, "html").alias("html"))


@query("c7_html_metadata", rf"""
WITH m AS (SELECT page_id, {_sql_tidy(_sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title,
  nullif(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1), '') AS language,
  list_filter(regexp_extract_all(html, '(?i)<meta [^>]*>'), lambda x: regexp_matches(x, '(?i)(name|property|http-equiv)=')) AS own
  FROM pages),
given AS (SELECT page_id, unnest([
    {{'k': 'author', 'v': 'René O''Neil ' || page_id}}, {{'k': 'keywords', 'v': 'k' || page_id || ',x, <b> ; c'}},
    {{'k': 'og:description', 'v': 'About &amp; page ' || page_id}}, {{'k': 'robots', 'v': 'none'}}], recursive := true) FROM pages),
pairs AS (SELECT page_id, k, v FROM given UNION ALL
  SELECT page_id, lower(regexp_extract(x, '(?i)(?:name|property|http-equiv)="([^"]*)"', 1)), regexp_extract(x, '(?i)content="([^"]*)"', 1)
  FROM (SELECT page_id, unnest(own) AS x FROM m))
SELECT page_id, nullif(title, '') AS title, 'René O''Neil ' || page_id AS author, language,
  'k' || page_id || '|x|<b>|c' AS keywords, 'About &amp; page ' || page_id AS subject,
  (SELECT string_agg(k || '=' || v, '; ' ORDER BY k, v) FROM pairs p WHERE p.page_id = m.page_id AND v <> '') AS metas FROM m""")
def c7(t: Tables):
    out = html.metadata(pages_with_metas(t), "page_id", "html")
    pairs = F.flatten(F.transform(F.map_entries("meta"), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("k"), v.alias("v")))))
    listed = F.transform(F.array_sort(pairs), lambda p: F.concat_ws("=", p["k"], p["v"]))
    return out.select("page_id", "title", "author", "language", F.array_join("keywords", "|").alias("keywords"),
                      "subject", F.array_join(listed, "; ").alias("metas"))


@query("c8_html_blocks", f"""
WITH {SQL_TEXT_BLOCKS} SELECT page_id, pos::BIGINT AS pos, block_type, text FROM hblocks""")
def c8(t: Tables):
    return page_blocks(t).select("page_id", F.col("pos").cast("bigint").alias("pos"), "block_type", "text")


@query("c9_html_paths", f"""
WITH {SQL_TEXT_BLOCKS},
ti AS (SELECT page_id, {_sql_tidy(_sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} AS title FROM pages),
hp AS (SELECT page_id, min(pos) AS hpos, arg_min(text, pos) AS htext FROM hblocks WHERE block_type = 'heading' GROUP BY page_id)
SELECT b.page_id, b.pos::BIGINT AS pos, CASE WHEN b.pos >= hpos THEN htext ELSE title END AS path
FROM hblocks b JOIN ti ON ti.page_id = b.page_id LEFT JOIN hp ON hp.page_id = b.page_id""")
def c9h(t: Tables):
    titles = html.metadata(t.pages, "page_id", "html").select("page_id", "title")
    out = html.with_paths(page_blocks(t), titles, "page_id")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"),
                      F.array_join("path", " > ").alias("path"))


#: navigation lists rewritten as tables, since the pages hold none
_AS_TABLE = [("<nav><ul>", "<table><caption>Links</caption><tr><th>A</th><th>B</th></tr><tr>"),
             ("</ul></nav>", "</tr></table>"), ("<li>", "<td>"), ("</li>", "</td>")]


@query("c10_html_tables", rf"""
WITH cells AS (SELECT page_id, list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1),
    '<li>(.*?)</li>', 1), lambda c: trim(regexp_replace({_sql_decode('c')}, '<[^>]*>', '', 'g'))) AS c FROM pages)
SELECT page_id, 0::BIGINT AS table_index, 'Links' AS caption, 1::BIGINT AS row_count,
  'Links' || chr(10) || 'A' || chr(9) || 'B' || chr(10) || array_to_string(c, chr(9)) AS rendered FROM cells""")
def c10(t: Tables):
    markup = F.col("html")
    for old, new in _AS_TABLE:
        markup = F.replace(markup, F.lit(old), F.lit(new))
    out = html.tables(t.pages.select("page_id", markup.alias("html")), "page_id", "html")
    return out.select(
        "page_id", F.col("table_index").cast("bigint").alias("table_index"), "caption",
        F.size("rows").cast("bigint").alias("row_count"),
        html.render_table(F.col("caption"), F.col("headers"), F.col("rows")).alias("rendered"),
    )


@query("c11_links", rf"""
WITH {SQL_TOKENS},
a AS (SELECT *, lead(token) OVER (PARTITION BY page_id ORDER BY pos) AS nxt FROM tk)
SELECT page_id, pos::BIGINT AS pos, trim({_sql_decode('nxt')}) AS text, regexp_extract(token, 'href="([^"]*)"', 1) AS target
FROM a WHERE name = 'a' AND opens""")
def c11(t: Tables):
    out = html.links(t.pages, "page_id", "html")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text", "target")


@query("c11_images", rf"""
WITH x AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g') AS h FROM pages),
y AS (SELECT page_id, unnest(regexp_extract_all(h, '<a href="([^"]*)"', 1)) AS source,
  unnest(regexp_extract_all(h, '<a href="[^"]*">([^<]*)<', 1)) AS alt FROM x)
SELECT page_id, source AS identifier, source, nullif({_sql_decode('alt')}, '') AS alt_text FROM y""")
def c11_images(t: Tables):
    markup = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', '<img src="$1" alt="$2">')
    out = html.images(t.pages.select("page_id", markup.alias("html")), "page_id", "html")
    return out.select("page_id", "identifier", "source", "alt_text")


_DEPTHLESS = ", ".join(
    f"'{n}'" for n in [*html.VOID_TAGS, *html.OPTIONAL_END_TAGS, *html.INLINE_TAGS, "-"]
)


@query("c12_complexity", f"""
WITH {SQL_TOKENS},
d AS (SELECT *, sum(CASE WHEN name IS NULL OR name IN ({_DEPTHLESS}) THEN 0
  ELSE opens::INT - closes::INT END) OVER (PARTITION BY page_id ORDER BY pos) AS dep FROM tk)
SELECT page_id, count(*) FILTER (name IS NULL OR (opens AND name <> '-'))::BIGINT AS nodes, max(dep)::BIGINT AS depth,
  count(*) FILTER (name IS NULL OR (opens AND name <> '-')) <= 200000 AND max(dep) <= 100 AS accepted
FROM d GROUP BY page_id""")
def c12(t: Tables):
    return html.complexity(t.pages, "page_id", "html")


@query("c13_html_offsets", f"""
WITH {SQL_TEXT_BLOCKS},
o AS (SELECT page_id, pos, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM hblocks)
SELECT page_id, pos::BIGINT AS pos, s::BIGINT AS char_start, (s + n)::BIGINT AS char_end FROM o""")
def c13h(t: Tables):
    out = sections.with_offsets(page_blocks(t), "page_id")
    return out.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "char_start", "char_end")])


def _more_markup(html_col: str = "html") -> F.Column:
    """Navigation lists as tables, and an image behind every link."""
    markup = F.col(html_col)
    for old, new in _AS_TABLE:
        markup = F.replace(markup, F.lit(old), F.lit(new))
    return F.regexp_replace(markup, r'(<a href="([^"]*)">([^<]*)</a>)', '$1<img src="$2" alt="$3">')


@query("c14_page_statistics", rf"""
WITH {SQL_TEXT_BLOCKS},
bt AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS content, count(*) FILTER (block_type = 'heading') AS s,
  count(*) FILTER (block_type <> 'heading') AS p FROM hblocks GROUP BY page_id),
ac AS (SELECT page_id, count(*) AS a FROM tk WHERE name = 'a' AND opens GROUP BY page_id),
xp AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>', '', 'g') AS h FROM pages),
c AS (SELECT q.page_id, coalesce(content, '') AS content, 1 AS page_count, coalesce(s, 0) AS section_count, coalesce(p, 0) AS paragraph_count,
  len(regexp_extract_all(h, '<nav>')) AS table_count, len(regexp_extract_all(h, '<a href="[^"]*">[^<]*</a>')) AS image_count,
  coalesce(a, 0) AS reference_count FROM pages q JOIN xp ON xp.page_id = q.page_id
  LEFT JOIN bt ON bt.page_id = q.page_id LEFT JOIN ac ON ac.page_id = q.page_id)
SELECT page_id, page_count::BIGINT AS page_count, section_count::BIGINT AS section_count, paragraph_count::BIGINT AS paragraph_count,
  table_count::BIGINT AS table_count, image_count::BIGINT AS image_count, reference_count::BIGINT AS reference_count,
  {v.sql_words('content')}::BIGINT AS word_count, length(content)::BIGINT AS character_count,
  {v.sql_strip('content')} <> '' AND paragraph_count > 0 AS valid FROM c""")
def c14_pages(t: Tables):
    """All counts of a page; its content is that of its blocks."""
    found = page_blocks(t)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    content = found.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("content"))
    docs = t.pages.select("page_id", F.lit(1).alias("pages")).join(content, "page_id", "left").withColumn(
        "content", F.coalesce("content", F.lit("")))
    rich = t.pages.select("page_id", _more_markup().alias("html"))
    return sections.document_statistics(docs, "page_id", "content", {
        "section_count": found.filter("block_type = 'heading'"), "paragraph_count": found.filter("block_type <> 'heading'"),
        "table_count": html.tables(rich, "page_id", "html"), "image_count": html.images(rich, "page_id", "html"),
        "reference_count": html.links(t.pages, "page_id", "html")}, pages="pages")
