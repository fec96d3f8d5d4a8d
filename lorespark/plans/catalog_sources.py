"""Registered queries: scans, fingerprints, admission, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import rules, text as tx
from lorespark.plans import views as v
from lorespark.plans.registry import Tables, query
from lorespark.sources import corpus, sinks


@query("a1_text_scan", r"""
SELECT doc_id, sha256(t) AS text_sha, length(t)::BIGINT AS chars,
  CASE WHEN text = '' THEN 'empty document'
       WHEN regexp_replace(t, '^\s+|\s+$', '', 'g') = '' THEN 'only white space' END AS problem
FROM (SELECT doc_id, text, regexp_replace(ltrim(text, chr(65279)), '\r\n?', chr(10), 'g') AS t FROM documents)""")
def a1(t: Tables):
    out = corpus.text_corpus(t.documents, "text")
    return out.select(
        "doc_id", F.sha2("text", 256).alias("text_sha"),
        F.length("text").cast("bigint").alias("chars"), "problem",
    )


@query("a2_html_scan", r"""
SELECT page_id, strlen(html)::BIGINT AS size_bytes,
  CASE WHEN strlen(html) = 0 THEN 'empty document' WHEN strlen(html) > 10485760 THEN 'over the size limit'
       WHEN trim(html) = '' THEN 'only white space' END AS problem
FROM pages""")
def a2(t: Tables):
    return corpus.html_corpus(t.pages, "html").select("page_id", "size_bytes", "problem")


@query("a3_fingerprints", """
SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5,
  strlen(text)::BIGINT AS size_bytes FROM documents""")
def a3(t: Tables):
    return corpus.fingerprints(t.documents, "doc_id", "text")


_ALL_MIMES = ", ".join(f"'{m}'" for m in rules.ALLOWED_MIME_TYPES)
_ALL_EXTS = ", ".join(f"'{e}'" for e in rules.ALLOWED_EXTENSIONS)
_RESERVED = ", ".join(f"'{n}'" for n in rules.RESERVED_NAMES)
_PAIRS = " OR ".join(
    f"(extension = '{e}' AND mime_type NOT IN ({', '.join(repr(m) for m in ms)}))"
    for e, ms in rules.MIME_BY_EXTENSION.items()
)


@query("a4_upload_admission", rf"""
WITH {v.SQL_UPLOADS},
n1 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(strip_accents(name), '[^\x20-\x7E]', '', 'g'),
    '\s+', '_', 'g'), '[^A-Za-z0-9._+-]', '', 'g'), '_+', '_', 'g'), ' ._-') AS safe FROM uploads),
n2 AS (SELECT *, lower(regexp_extract(safe, '(\.[^.]*)$', 1)) AS dot_ext,
    coalesce(nullif(trim(regexp_replace(safe, '\.[^.]*$', ''), ' ._-'), ''), 'file') AS stem FROM n1),
n3 AS (SELECT *, CASE WHEN safe <> '' THEN CASE WHEN upper(stem) IN ({_RESERVED}) THEN 'file_' || stem
    ELSE stem END || dot_ext END AS file_name,
    replace(dot_ext, '.', '') AS extension, lower(trim(split_part(mime, ';', 1))) AS mime_type FROM n2)
SELECT page_id, file_name, extension, mime_type,
  array_to_string(list_filter([
    CASE WHEN file_name IS NULL THEN 'invalid file name' END,
    CASE WHEN length(file_name) > 255 THEN 'file name too long' END,
    CASE WHEN size <= 0 THEN 'zero bytes' END,
    CASE WHEN size > 52428800 THEN 'too large' END,
    CASE WHEN extension NOT IN ({_ALL_EXTS}) THEN 'extension not allowed' END,
    CASE WHEN mime_type NOT IN ({_ALL_MIMES}) THEN 'type not allowed' END,
    CASE WHEN {_PAIRS} THEN 'type does not match extension' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM n3""")
def a4(t: Tables):
    out = corpus.admit_uploads(v.uploads(t))
    return out.select("page_id", "file_name", "extension", "mime_type",
                      F.array_join("reasons", "; ").alias("reasons"))


@query("a5_format_routing", rf"""
WITH {v.SQL_UPLOADS},
u AS (SELECT page_id, nullif(lower(ext), '') AS e,
  nullif(nullif(lower(trim(split_part(mime, ';', 1))), ''), 'application/octet-stream') AS m FROM uploads),
caps(ord, parser, exts, mimes) AS (VALUES
  (1, 'pdf', ['.pdf'], ['application/pdf']), (2, 'txt', ['.txt'], ['text/plain']),
  (3, 'docx', ['.docx'], ['application/vnd.openxmlformats-officedocument.wordprocessingml.document']),
  (4, 'markdown', ['.md', '.markdown'], ['text/markdown', 'text/plain', 'text/x-markdown']),
  (5, 'html', ['.htm', '.html'], ['application/xhtml+xml', 'text/html']))
SELECT page_id, e AS extension, m AS mime_type,
  (SELECT arg_min(parser, ord) FROM caps WHERE (e IS NULL OR list_contains(exts, e))
     AND (m IS NULL OR list_contains(mimes, m)) AND (e IS NOT NULL OR m IS NOT NULL)) AS parser
FROM u""")
def a5(t: Tables):
    out = corpus.route_formats(v.uploads(t), F.col("ext"), F.col("mime"))
    mime = F.nullif(corpus.plain_mime(F.col("mime")), F.lit("application/octet-stream"))
    return out.select("page_id", F.nullif(F.lower("ext"), F.lit("")).alias("extension"),
                      mime.alias("mime_type"), "parser")


@query("a6_exact_dedup", """
SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS winner_id,
  doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents""")
def a6(t: Tables):
    return sinks.exact_duplicates(t.documents, "doc_id", "text")


@query("a6_kept_documents", """
SELECT doc_id, lang, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def a6_kept(t: Tables):
    return sinks.keep_first_copies(t.documents, "doc_id", "text").select("doc_id", "lang", "source")


@query("a7_idempotent_append", """
WITH ids AS (SELECT doc_id, source, sha256(text) AS content_hash, 'txt' AS parser_name FROM documents),
old AS (SELECT DISTINCT content_hash, parser_name FROM ids WHERE source = 'src0')
SELECT content_hash, parser_name,
  CASE WHEN (content_hash, parser_name) IN (SELECT (content_hash, parser_name) FROM old)
       THEN 'reused' ELSE 'created' END AS outcome
FROM (SELECT DISTINCT content_hash, parser_name FROM ids WHERE source <> 'src0')""")
def a7(t: Tables):
    identity = ["content_hash", "parser_name"]
    runs = t.documents.select(
        "source", F.sha2("text", 256).alias("content_hash"), F.lit("txt").alias("parser_name")
    )
    fresh, reused = sinks.split_new(
        runs.filter("source <> 'src0'"), runs.filter("source = 'src0'"), identity
    )
    created = fresh.select(*identity, F.lit("created").alias("outcome"))
    kept = reused.select(*identity).distinct().withColumn("outcome", F.lit("reused"))
    return created.unionByName(kept)


@query("a8_usable_text", f"""
SELECT doc_id, length(c)::BIGINT AS clean_chars, length(c) >= 20 AS usable
FROM (SELECT doc_id, {v.sql_clean('text')} AS c FROM documents)""")
def a8(t: Tables):
    out = corpus.usable_text(t.documents, "text")
    return out.select("doc_id", F.length("clean").cast("bigint").alias("clean_chars"), "usable")


@query("b1_clean_text", f"""
WITH {v.SQL_MD} SELECT doc_id, {v.sql_clean("'  ' || replace(text, ' ', chr(9) || ' ') || chr(13)")} AS clean FROM md_docs""")
def b1(t: Tables):
    noisy = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\t ")), F.lit("\r"))
    return v.md_docs(t).select("doc_id", tx.clean_text(noisy).alias("clean"))


@query("b2_normal_keys", f"""
SELECT doc_id, {v.sql_collapse('text')} AS collapsed, {v.sql_key('text')} AS key FROM documents""")
def b2(t: Tables):
    flat = t.documents.select("doc_id", tx.normalize_whitespace(F.col("text")).alias("collapsed"))
    return flat.withColumn("key", tx.key_of(F.col("collapsed")))


@query("b3_unique_slugs", f"""
SELECT p_partkey, base || CASE WHEN rn = 1 THEN '' ELSE '-' || rn END AS slug
FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS rn
  FROM (SELECT p_partkey, {v.sql_slug('p_name')} AS base FROM part))""")
def b3(t: Tables):
    from lorespark.operators.graph import unique_slugs

    slugs = t.part.select("p_partkey", tx.slugify(F.col("p_name")).alias("base"))
    return unique_slugs(slugs, "base", "p_partkey").select("p_partkey", "slug")


@query("b4_alias_keys", f"""
SELECT alias, count(*)::BIGINT AS uses, min(p_partkey) AS first_part FROM (
  SELECT p_partkey, {v.sql_casefold(v.sql_collapse("p_brand || '  ' || upper(p_name)"))} AS alias FROM part)
GROUP BY alias""")
def b4(t: Tables):
    name = F.concat("p_brand", F.lit("  "), F.upper("p_name"))
    keyed = t.part.select("p_partkey", tx.normalize_alias(name).alias("alias"))
    return keyed.groupBy("alias").agg(
        F.count("*").alias("uses"), F.min("p_partkey").alias("first_part")
    )


@query("b5_chunk_search_text", rf"""
WITH {v.SQL_MD}
SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)),
  '[ \t\r\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS search_text FROM md_docs""")
def b5(t: Tables):
    wide = F.replace("text", F.lit("\n"), F.lit("\r\n\n"))
    return v.md_docs(t).select("doc_id", tx.chunk_search_text(wide).alias("search_text"))


@query("b6_whole_terms", f"""
SELECT doc_id, {v.sql_has_term('text', ['the'])} AS has_the, {v.sql_has_term('text', ['là', 'où'])} AS has_accent,
  {v.sql_has_term('text', ['all rights reserved'])} AS has_phrase FROM documents""")
def b6(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id", tx.contains_term(text, "the").alias("has_the"),
        (tx.contains_term(text, "là") | tx.contains_term(text, "où")).alias("has_accent"),
        tx.contains_term(text, "all rights reserved").alias("has_phrase"),
    )


@query("b7_counts", f"""
SELECT doc_id, {v.sql_words('text')}::BIGINT AS words, length(text)::BIGINT AS chars FROM documents""")
def b7(t: Tables):
    return t.documents.select(
        "doc_id", tx.word_count(F.col("text")).alias("words"),
        F.length("text").cast("bigint").alias("chars"),
    )


@query("b8_query_tokens", r"""
SELECT item_id, array_to_string(list_transform(list_filter(
  regexp_extract_all(text, '[A-Za-z0-9_''-]+'), lambda x: length(x) >= 2), lambda x: lower(x)), ' ') AS tokens
FROM benchmark""")
def b8(t: Tables):
    return t.benchmark.select("item_id", F.array_join(tx.query_tokens(F.col("text")), " ").alias("tokens"))


@query("b9_safe_messages", rf"""
WITH m AS (SELECT page_id, url || '  failed at /srv/data/' || page_id || '/in.html: ' || left(url, 0) AS msg FROM pages)
SELECT page_id, regexp_replace({v.sql_collapse('msg')},
    '(?:[A-Za-z]:\\|/)[^ \t:][^ \t:/\\]*[/\\][^ \t:]+', '[internal path]', 'g') AS message,
  trim(regexp_replace(upper(trim(msg)), '[^A-Z0-9_]+', '_', 'g'), '_') AS code FROM m""")
def b9(t: Tables):
    raw = F.concat("url", F.lit("  failed at /srv/data/"), F.col("page_id").cast("string"),
                   F.lit("/in.html: "))
    return t.pages.select("page_id", tx.safe_message(raw).alias("message"),
                          tx.error_code(raw).alias("code"))
