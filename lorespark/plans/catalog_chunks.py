"""Registered queries: chunking, chunk tables, search and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorespark.functions import hashing, rules, text as tx
from lorespark.operators import chunk_tables as ct
from lorespark.operators import chunking as ck
from lorespark.operators import html, search, sections
from lorespark.plans import views as v
from lorespark.plans.catalog_html import SQL_HTML_BLOCKS, page_blocks
from lorespark.plans.catalog_sections import SQL_BLOCKS, block_rows
from lorespark.plans.registry import Tables, query
from lorespark.session import cut_lineage

FIXED = ck.ChunkConfig(strategy_name="fixed_window", boundary_preference=("character",))
BOUNDED = ck.ChunkConfig(strategy_name="fixed_window")
STRUCTURAL = ck.ChunkConfig()


def plain_chunks(t: Tables) -> DataFrame:
    """The cleaned documents as one block each, in fixed windows."""
    clean = t.documents.select("doc_id", "lang", tx.clean_text(F.col("text")).alias("clean"))
    usable = clean.filter(F.length("clean") >= 20)
    cut = ck.plain_windows(usable, "doc_id", "clean")
    out = cut.select("doc_id", "lang", "ordinal", "start", "end", "boundary", "overlap_chars",
                     F.col("chunk_text").alias("text"))
    none = F.array().cast("array<string>")
    return out.select(
        "*",
        F.length("text").cast("bigint").alias("character_count"),
        tx.word_count(F.col("text")).alias("word_count"),
        hashing.chunk_hash(F.col("text"), F.lit("paragraph"), none).alias("content_hash"),
    )


SQL_PLAIN = rf"""
cl AS (SELECT doc_id, lang, {v.sql_clean('text')} AS clean FROM documents),
ca AS (SELECT *, length(clean) AS n, CASE WHEN length(clean) <= 1800 THEN 1 ELSE ceil((length(clean) - 1800) / 1050.0)::BIGINT + 1 END AS k
  FROM cl WHERE length(clean) >= 20),
cb AS (SELECT *, unnest(generate_series(0, k - 1)) AS ordinal FROM ca),
chunks AS (SELECT doc_id, lang, ordinal, ordinal * 1050 AS start,
    CASE WHEN ordinal = k - 1 THEN n ELSE ordinal * 1050 + 1200 END AS "end",
    CASE WHEN ordinal = k - 1 THEN 'document' ELSE 'character' END AS boundary,
    CASE WHEN ordinal > 0 THEN 150 ELSE 0 END AS overlap_chars,
    substr(clean, ordinal * 1050 + 1, CASE WHEN ordinal = k - 1 THEN n - ordinal * 1050 ELSE 1200 END) AS text FROM cb),
hashed AS (SELECT *, length(text) AS character_count, {v.sql_words('text')} AS word_count,
  sha256('{{"content_type":"paragraph","heading_context":[],"text":' || to_json(text)::VARCHAR || '}}') AS content_hash FROM chunks)"""


def md_blocks(t: Tables) -> DataFrame:
    """Blocks of md_docs: headings and paragraphs with nested paths."""
    rows = sections.with_section_path(block_rows(t), "doc_id")
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    rows = rows.select("doc_id", "pos", kind.alias("block_type"), "text", "path")
    return ck.project_blocks(rows, "doc_id")


def html_blocks(t: Tables) -> DataFrame:
    titles = html.metadata(t.pages, "page_id", "html").select("page_id", "title")
    rows = html.with_paths(page_blocks(t), titles, "page_id")
    rows = rows.select("page_id", "pos", "block_type", "text", "path")
    return ck.project_blocks(rows, "page_id", titles=titles)


@query("d1_packed_paragraphs")
def d1(t: Tables):
    packed = v.md_docs(t).select("doc_id", F.posexplode(ck.pack_paragraphs(F.col("text"))).alias("ordinal", "text"))
    return packed.select("doc_id", "ordinal", "text", search.classify(F.col("text")).alias("category"))


@query("d2_blocks", f"""
WITH {SQL_BLOCKS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT - 1 AS source_order,
  CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS block_type,
  CASE WHEN level IS NULL THEN 'paragraph' ELSE 'section' END AS content_type, text FROM block_rows""")
def d2(t: Tables):
    return md_blocks(t).select("doc_id", F.col("source_order").cast("bigint").alias("source_order"),
                               "block_type", "content_type", "text")


@query("d3_content_types", f"""
WITH {SQL_HTML_BLOCKS}
SELECT CASE block_type WHEN 'list_item' THEN 'list' WHEN 'heading' THEN 'section' ELSE 'paragraph' END AS content_type,
  count(*)::BIGINT AS n FROM (SELECT block_type FROM hblocks
    UNION ALL SELECT 'heading' FROM pages WHERE regexp_matches(html, '(?is)<title[^>]*>\\s*[^<\\s]')) GROUP BY 1""")
def d3(t: Tables):
    return html_blocks(t).groupBy("content_type").agg(F.count("*").alias("n"))


@query("d4_fixed_windows", f"""
WITH {SQL_PLAIN} SELECT doc_id, ordinal::BIGINT AS ordinal, start::BIGINT AS start, "end"::BIGINT AS "end",
  boundary, text FROM chunks""")
def d4(t: Tables):
    return plain_chunks(t).select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "start", "end")], "boundary", "text")


@query("d4_boundary_windows")
def d4b(t: Tables):
    out = ck.boundary_windows(md_blocks(t), "doc_id", BOUNDED)
    return out.select("doc_id", "ordinal", "start", "end", "boundary", "content_type", "text", "content_hash")


@query("d5_structural_chunks")
def d5(t: Tables):
    out = ck.structural(md_blocks(t), "doc_id", STRUCTURAL)
    return out.select("doc_id", "ordinal", "content_type", "character_count", "text", "content_hash")


@query("d5_html_structural_chunks")
def d5h(t: Tables):
    out = ck.structural(html_blocks(t), "page_id", STRUCTURAL)
    return out.select("page_id", "ordinal", "content_type", "character_count", "text", "content_hash")


@query("d6_safe_split", r"""
WITH RECURSIVE s AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start, 0 AS fin FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, fin, CASE
    WHEN fin + 300 < n AND length(regexp_extract(substr(text, fin + 1, 300), '(?s)^(.*\s)', 1)) > 100
      THEN fin + length(regexp_extract(substr(text, fin + 1, 300), '(?s)^(.*\s)', 1))
    ELSE least(n, fin + 300) END FROM s WHERE fin < n)
SELECT doc_id, start::BIGINT AS start, fin::BIGINT AS "end" FROM s WHERE fin > 0""")
def d6(t: Tables):
    cut = t.documents.filter(F.length("text") > 0).select(
        "doc_id", F.explode(ck.safe_split(F.col("text"), 300)).alias("s"))
    return cut.select("doc_id", F.col("s.start").cast("bigint").alias("start"),
                      F.col("s.end").cast("bigint").alias("end"))


@query("d7_table_row_groups")
def d7(t: Tables):
    """Lines of each text as the rows of one captioned table."""
    tables = t.documents.select(
        "doc_id", F.col("source").alias("caption"), F.array("lang", F.lit("line")).alias("headers"),
        F.transform(F.split("text", "\n"), lambda x: F.array(F.lit("row"), x)).alias("rows"))
    groups = ck.split_table_rows(F.col("caption"), F.col("headers"), F.col("rows"), 600)
    return tables.select("doc_id", F.posexplode(groups).alias("part", "g")).select("doc_id", "part", "g.*")


@query("d8_span_map", f"""
WITH {SQL_BLOCKS},
b AS (SELECT doc_id, row_number() OVER w - 1 AS source_order, length(text) AS len,
    coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM block_rows WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT doc_id, max(s + len) AS n FROM b GROUP BY doc_id),
k AS (SELECT doc_id, n, unnest(generate_series(0, CASE WHEN n <= 1800 THEN 0 ELSE ceil((n - 1800) / 1050.0)::BIGINT END)) AS ordinal,
  CASE WHEN n <= 1800 THEN 0 ELSE ceil((n - 1800) / 1050.0)::BIGINT END AS lst FROM d),
w AS (SELECT doc_id, ordinal, ordinal * 1050 AS ws, CASE WHEN ordinal = lst THEN n ELSE ordinal * 1050 + 1200 END AS we,
  CASE WHEN ordinal = 0 THEN 0 ELSE ordinal * 1050 + 150 END AS prev FROM k),
p AS (SELECT w.doc_id, ordinal, source_order, greatest(ws, s) - s AS source_start, least(we, s + len) - s AS source_end,
  greatest(ws, s) < prev AS is_overlap FROM w JOIN b ON b.doc_id = w.doc_id AND s < we AND ws < s + len)
SELECT doc_id, ordinal::BIGINT AS ordinal, source_order::BIGINT AS source_order, source_start::BIGINT AS source_start,
  source_end::BIGINT AS source_end, is_overlap,
  coalesce(sum(source_end - source_start + 2) OVER (PARTITION BY doc_id, ordinal ORDER BY source_order
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_start FROM p""")
def d8(t: Tables):
    blocks = sections.with_offsets(md_blocks(t), "doc_id")
    content = blocks.groupBy("doc_id").agg(F.max("char_end").alias("n"))
    many = F.when(F.col("n") <= 1800, 0).otherwise(F.ceil((F.col("n") - 1800) / 1050)).cast("int")
    w = content.withColumn("k", many).withColumn("ordinal", F.explode(F.sequence(F.lit(0), "k")))
    w = w.select(
        "doc_id", "ordinal", (F.col("ordinal") * 1050).alias("start"),
        F.when(F.col("ordinal") == F.col("k"), F.col("n")).otherwise(F.col("ordinal") * 1050 + 1200).alias("end"),
        F.when(F.col("ordinal") == 0, 0).otherwise(F.col("ordinal") * 1050 + 150).alias("previous_end"))
    spans = blocks.select("doc_id", "source_order", "char_start", "char_end")
    out = ck.span_map(w, spans, "doc_id", 1800)
    return out.select("doc_id", "is_overlap", *[F.col(c).cast("bigint").alias(c) for c in (
        "ordinal", "source_order", "source_start", "source_end", "text_start")])


@query("d9_content_hashes", f"""
WITH {SQL_PLAIN} SELECT doc_id, ordinal::BIGINT AS ordinal, content_hash FROM hashed""")
def d9(t: Tables):
    return plain_chunks(t).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content_hash")


@query("d9_stable_keys")
def d9_keys(t: Tables):
    blocks = md_blocks(t)
    chunks = ck.structural(blocks, "doc_id", STRUCTURAL)
    out = ct.with_identity(chunks, ct.canonical_hashes(blocks, "doc_id"), "doc_id", STRUCTURAL)
    return out.select("doc_id", "ordinal", "chunk_set_key", "stable_key")


@query("d10_overlap_edges", f"""
WITH {SQL_PLAIN} SELECT doc_id, ordinal::BIGINT - 1 AS source_ordinal, ordinal::BIGINT AS target_ordinal,
  'overlaps' AS type, overlap_chars::BIGINT AS characters FROM chunks WHERE ordinal > 0""")
def d10(t: Tables):
    out = ct.edges(plain_chunks(t), "doc_id")
    return out.select("doc_id", "type", *[F.col(c).cast("bigint").alias(c) for c in (
        "source_ordinal", "target_ordinal", "characters")])


@query("d10_continuation_edges")
def d10_cont(t: Tables):
    return ct.edges(ck.structural(md_blocks(t), "doc_id", STRUCTURAL), "doc_id")


@query("d11_neighbours", f"""
WITH {SQL_PLAIN} SELECT doc_id, ordinal::BIGINT AS ordinal, lag(content_hash) OVER w AS previous_chunk,
  lead(content_hash) OVER w AS next_chunk FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
def d11(t: Tables):
    out = ct.neighbours(plain_chunks(t), "doc_id", "content_hash")
    return out.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "previous_chunk", "next_chunk")


@query("d12_chunk_set_rollup", f"""
WITH {SQL_PLAIN} SELECT doc_id, count(*)::BIGINT AS chunk_count, sum(character_count)::BIGINT AS total_characters,
  sum(word_count)::BIGINT AS total_words, min(character_count)::BIGINT AS smallest, max(character_count)::BIGINT AS largest,
  sum(overlap_chars)::BIGINT AS overlap_characters,
  sha256('[' || string_agg('"' || content_hash || '"', ',' ORDER BY ordinal) || ']') AS content_hash
FROM hashed GROUP BY doc_id""")
def d12(t: Tables):
    return ct.roll_up(plain_chunks(t), "doc_id")


@query("d12_manifests", f"""
WITH {SQL_PLAIN} SELECT doc_id, '[' || string_agg('{{"character_count":' || character_count || ',"content_hash":"' || content_hash
  || '","ordinal":' || ordinal || ',"word_count":' || word_count || '}}', ',' ORDER BY ordinal) || ']' AS manifest
FROM hashed GROUP BY doc_id""")
def d12_manifest(t: Tables):
    return ct.manifests(plain_chunks(t), "doc_id")


@query("d13_validation", f"""
WITH {SQL_PLAIN} SELECT doc_id, ordinal::BIGINT AS ordinal, array_to_string(list_filter([
  CASE WHEN character_count > 1400 THEN 'over the maximum size' END,
  CASE WHEN overlap_chars > 100 THEN 'overlap too large' END,
  CASE WHEN overlap_chars > 100 THEN 'overlap differs from previous tail' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM hashed""")
def d13(t: Tables):
    """Windows cut with wider settings than the ones they are checked against."""
    strict = ck.ChunkConfig(strategy_name="fixed_window", maximum_size=1400, overlap_size=100)
    start = F.col("start")
    span = F.struct(
        F.lit(0).alias("source_order"), F.lit("paragraph").alias("content_type"),
        F.array().cast("array<string>").alias("section_path"), start.alias("source_start"),
        F.col("end").alias("source_end"), (F.col("overlap_chars") > 0).alias("is_overlap"))
    chunks = plain_chunks(t).withColumn("spans", F.array(span))
    clean = t.documents.select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    blocks = clean.select("doc_id", F.lit(0).alias("source_order"), "text",
                          F.array().cast("array<string>").alias("heading_context"))
    out = ct.validate(chunks, blocks, "doc_id", strict)
    return out.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"),
                      F.array_join("reasons", "; ").alias("reasons"))


@query("d13_structural_validation")
def d13_structural(t: Tables):
    blocks = cut_lineage(md_blocks(t))  # cut into chunks, and the source they are checked against
    out = ct.validate(ck.structural(blocks, "doc_id", STRUCTURAL), blocks, "doc_id", STRUCTURAL)
    return out.select("doc_id", "ordinal", F.array_join("reasons", "; ").alias("reasons"))


@query("d14_chunk_estimates", f"""
WITH {SQL_BLOCKS} SELECT doc_id, greatest(1, ceil(sum(length(text) + 2) / 1200.0))::BIGINT AS structural,
  greatest(1, ceil(sum(length(text) + 2) / 1050.0))::BIGINT AS fixed FROM block_rows GROUP BY doc_id""")
def d14(t: Tables):
    return ct.estimate(md_blocks(t), "doc_id", STRUCTURAL)


@query("d16_chunk_listing", f"""
WITH {SQL_PLAIN}, f AS (SELECT * FROM hashed WHERE character_count >= 400 AND lang = 'en' AND contains(lower(text), 'the'))
SELECT doc_id, ordinal::BIGINT AS ordinal, character_count::BIGINT AS character_count,
  (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY character_count DESC, doc_id DESC, ordinal DESC LIMIT 50 OFFSET 20""")
def d16(t: Tables):
    chunks = plain_chunks(t).withColumnRenamed("lang", "language")
    found = ct.search_chunks(chunks, language="en", min_chars=400, contains="the")
    found = found.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "character_count")
    return ct.listing(found, "character_count", ["doc_id", "ordinal"], descending=True, offset=20, limit=50)


def _paged_chunks(t: Tables) -> DataFrame:
    """Chunks with a section and 3,000 characters to the page; a chunk may cross two pages."""
    path = F.array(F.concat(F.lit("Source "), F.coalesce("source", F.lit("none"))))
    pages = F.struct((F.floor(F.col("start") / 3000) + 1).cast("int").alias("page_start"),
                     (F.floor((F.col("end") - 1) / 3000) + 1).cast("int").alias("page_end"), path.alias("section_path"))
    chunks = plain_chunks(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return chunks.withColumns({"spans": F.array(pages), "content_type": F.lit("paragraph"), "chunk_set": F.col("doc_id")})


_SQL_FILTERED = f"""
WITH {SQL_PLAIN}, f AS (SELECT h.*, d.source, h.start // 3000 + 1 AS first_page, (h."end" - 1) // 3000 + 1 AS last_page
  FROM hashed h JOIN documents d USING (doc_id))
SELECT doc_id, ordinal::BIGINT AS ordinal, content_hash FROM f WHERE """
_FILTERED = ["doc_id", "ordinal", "content_hash"]


def _filtered(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content_hash")


@query("d16_chunks_of_page", f"{_SQL_FILTERED} first_page <= 2 AND last_page >= 2")
def d16_page(t: Tables):
    return _filtered(ct.search_chunks(_paged_chunks(t), page=2))


@query("d16_chunks_of_sets", f"{_SQL_FILTERED} doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def d16_sets(t: Tables):
    sets = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("chunk_set"))
    return _filtered(ct.search_chunks(_paged_chunks(t), chunk_sets=sets))


@query("d16_chunks_by_hash", f"""
WITH {SQL_PLAIN} SELECT doc_id, ordinal::BIGINT AS ordinal, content_hash FROM hashed WHERE content_hash = (
  SELECT content_hash FROM hashed WHERE doc_id = (SELECT min(doc_id) FROM hashed) AND ordinal = 0)""")
def d16_hash(t: Tables):
    chunks = _paged_chunks(t)
    wanted = chunks.filter("ordinal = 0").agg(F.min_by("content_hash", "doc_id")).first()[0]
    return _filtered(ct.search_chunks(chunks, content_hash=wanted.upper()))


@query("d16_chunks_of_section", f"{_SQL_FILTERED} contains(lower('Source ' || coalesce(source, 'none')), 'source src1') AND character_count <= 1000")
def d16_section(t: Tables):
    return _filtered(ct.search_chunks(_paged_chunks(t), section=" Source SRC1", max_chars=1000, content_type="paragraph"))


@query("d16_next_page", f"""
WITH {SQL_PLAIN}, f AS (SELECT doc_id, ordinal::BIGINT AS ordinal, character_count::BIGINT AS character_count FROM hashed)
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY character_count DESC, doc_id DESC, ordinal DESC LIMIT 500 OFFSET 300""")
def d16_next(t: Tables):
    """The second page by the key of the last row of the first one."""
    # both pages and their totals read them: cut once, without texts
    chunks = cut_lineage(plain_chunks(t).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "character_count"))
    first = ct.listing(chunks, "character_count", ["doc_id", "ordinal"], descending=True, limit=300)
    last = first.agg(F.min(F.struct("character_count", "doc_id", "ordinal"))).first()[0]
    return ct.listing(chunks, "character_count", ["doc_id", "ordinal"], descending=True, limit=500, after=list(last))


_CONFIG_JSON = FIXED.canonical_json().replace("'", "''")


@query("d17_artifacts", f"""
WITH {SQL_PLAIN},
st AS (SELECT doc_id, '{{"chunk_count":' || count(*) || ',"maximum_chunk_size":' || max(character_count) || ',"minimum_chunk_size":' ||
  min(character_count) || ',"overlap_character_count":' || sum(overlap_chars) || ',"total_character_count":' || sum(character_count) ||
  ',"total_word_count":' || sum(word_count) || '}}' AS content FROM hashed GROUP BY doc_id),
mf AS (SELECT doc_id, '[' || string_agg('{{"character_count":' || character_count || ',"content_hash":"' || content_hash
  || '","ordinal":' || ordinal || ',"word_count":' || word_count || '}}', ',' ORDER BY ordinal) || ']' AS content FROM hashed GROUP BY doc_id),
vr AS (SELECT doc_id, '{{"chunk_count":' || count(*) || ',"valid":' || (count(*) FILTER (character_count > 1400) = 0) || '}}' AS content
  FROM hashed GROUP BY doc_id),
wn AS (SELECT doc_id, 'over the maximum size: ' || count(*) AS content FROM hashed WHERE character_count > 1400 GROUP BY doc_id),
al AS (SELECT doc_id, 'configuration' AS type, '{_CONFIG_JSON}' AS content FROM st
  UNION ALL SELECT doc_id, 'statistics', content FROM st UNION ALL SELECT doc_id, 'manifest', content FROM mf
  UNION ALL SELECT doc_id, 'validation_report', content FROM vr UNION ALL SELECT doc_id, 'warning', content FROM wn)
SELECT doc_id, type, sha256(content) AS sha256 FROM al""")
def d17(t: Tables):
    # five parts read them: cut once, a row of numbers a chunk without its text
    chunks = cut_lineage(plain_chunks(t).select(
        "doc_id", "ordinal", "character_count", "word_count", "overlap_chars", "content_hash"))
    rule = F.when(F.col("character_count") > 1400, F.array(F.lit("over the maximum size")))
    checks = chunks.select("doc_id", "ordinal",
                           F.coalesce(rule, F.array().cast("array<string>")).alias("reasons"))
    return ct.artifacts(chunks, checks, "doc_id", FIXED).select("doc_id", "type", "sha256")


# --- classification and search -------------------------------------------------


def _sql_score(x: str, words) -> str:
    return " + ".join(
        f"(length(lower({x})) - length(replace(lower({x}), '{w}', ''))) // {len(w)}" for w in words
    )


def _sql_classified(source: str, cols: str, classes=v.CORPUS_CLASSES) -> str:
    scores = ", ".join(f"{_sql_score('text', words)} AS s{i}" for i, words in enumerate(classes.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(classes))) + ")"
    cases = " ".join(f"WHEN s{i} = {best} THEN '{n}'" for i, n in enumerate(classes))
    return (f"SELECT {cols}, CASE WHEN {best} = 0 THEN 'general' {cases} END AS category "
            f"FROM (SELECT *, {scores} FROM {source})")


@query("e1_classify_documents", f"{_sql_classified('documents', 'doc_id')}")
def e1(t: Tables):
    return t.documents.select("doc_id", search.classify(F.col("text"), v.CORPUS_CLASSES).alias("category"))


@query("e1_classify_default_rules", f"""
SELECT category, count(*)::BIGINT AS documents FROM ({_sql_classified('documents', 'doc_id', rules.CLASSIFIER_KEYWORDS)}) GROUP BY category""")
def e1_default(t: Tables):
    out = t.documents.select(search.classify(F.col("text")).alias("category"))
    return out.groupBy("category").agg(F.count("*").alias("documents"))


def _classified_chunks(t: Tables) -> DataFrame:
    return plain_chunks(t).withColumn("category", search.classify(F.col("text"), v.CORPUS_CLASSES))


@query("e2_keyword_search", rf"""
WITH {SQL_PLAIN},
tok AS (SELECT item_id, lower(u) AS token, count(*) AS weight FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_''-]+')) AS u FROM benchmark) WHERE length(u) >= 2 GROUP BY ALL),
lc AS (SELECT doc_id, ordinal, lower(text) AS t FROM chunks),
sc AS (SELECT item_id, doc_id, ordinal, sum(weight * (length(t) - length(replace(t, token, ''))) // length(token)) AS score
  FROM lc JOIN tok ON contains(t, token) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ordinal) AS position FROM sc)
SELECT item_id, doc_id, ordinal::BIGINT AS ordinal, score::BIGINT AS score, position::BIGINT AS position FROM rk WHERE position <= 10""")
def e2(t: Tables):
    hits = search.search(plain_chunks(t), t.benchmark, "item_id", "text", ["doc_id", "ordinal"], "text", 10)
    return hits.select("item_id", "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "score", "position")])


@query("e2_category_search", rf"""
WITH {SQL_PLAIN}, cc AS ({_sql_classified('chunks', 'doc_id, ordinal, text')}),
tok AS (SELECT item_id, lower(u) AS token, count(*) AS weight FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_''-]+')) AS u FROM benchmark) WHERE length(u) >= 2 GROUP BY ALL),
lc AS (SELECT doc_id, ordinal, lower(text) AS t FROM cc WHERE category = 'places'),
sc AS (SELECT item_id, doc_id, ordinal, sum(weight * (length(t) - length(replace(t, token, ''))) // length(token)) AS score
  FROM lc JOIN tok ON contains(t, token) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ordinal) AS position FROM sc)
SELECT item_id, doc_id, ordinal::BIGINT AS ordinal, score::BIGINT AS score, position::BIGINT AS position FROM rk WHERE position <= 10""")
def e2_category(t: Tables):
    hits = search.search(_classified_chunks(t), t.benchmark, "item_id", "text", ["doc_id", "ordinal"], "text", 10, "places")
    return hits.select("item_id", "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "score", "position")])


@query("e3_corpus_statistics", f"""
WITH {SQL_PLAIN}, cc AS ({_sql_classified('chunks', 'doc_id')})
SELECT 'documents' AS measure, NULL AS category, count(*)::BIGINT AS n FROM ca
UNION ALL SELECT 'chunks', NULL, count(*) FROM cc
UNION ALL SELECT 'category', category, count(*) FROM cc GROUP BY category""")
def e3(t: Tables):
    return search.corpus_statistics(_classified_chunks(t), "category", F.col("ordinal") == 0)


def _sql_rule_hit(name: str) -> str:
    rule = next(r for r in v.CORPUS_CATEGORIES if r.name == name)
    return v.sql_has_term("text", rule.keywords)


_ART, _LNK, _LIC, _PRO, _FIN = (_sql_rule_hit(n) for n in (
    "Articles", "Links", "Licensing", "Pronouns", "Financial Markets"))


@query("e4_detect_categories", f"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN {_FIN} OR {_ART} THEN 'Financial Markets' END, CASE WHEN {_ART} THEN 'Articles' END,
  CASE WHEN {_LNK} OR {_PRO} THEN 'Links' END, CASE WHEN {_LIC} THEN 'Licensing' END,
  CASE WHEN {_PRO} THEN 'Pronouns' END, 'General'], lambda x: x IS NOT NULL), ', ') AS categories FROM documents""")
def e4(t: Tables):
    out = search.detect_categories(F.col("text"), v.CORPUS_CATEGORIES)
    return t.documents.select("doc_id", F.array_join(out, ", ").alias("categories"))


@query("e5_primary_category", f"""
SELECT doc_id, CASE WHEN {_ART} THEN 'Articles' WHEN {_LNK} THEN 'Links' WHEN {_LIC} THEN 'Licensing'
  WHEN {_PRO} THEN 'Pronouns' WHEN {_FIN} THEN 'Financial Markets' ELSE 'General' END AS category FROM documents""")
def e5(t: Tables):
    return t.documents.select("doc_id", search.primary_category(F.col("text"), v.CORPUS_CATEGORIES).alias("category"))
