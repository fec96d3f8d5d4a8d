"""Inputs derived from the given tables, as DataFrames and as oracle SQL.

The ``SQL_*`` strings are bodies for ``WITH`` clauses of the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorespark.functions import rules, text as tx
from lorespark.plans.registry import Tables

# --- SQL spellings of the text helpers --------------------------------------


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    out = rf"regexp_replace(replace({x}, chr(0), ' '), '\r\n?', chr(10), 'g')"
    out = rf"regexp_replace({out}, '[ \t]+', ' ', 'g')"
    out = rf"regexp_replace({out}, ' *\n *', chr(10), 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_strip(out)


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_key(x: str) -> str:
    return rf"trim(regexp_replace({sql_casefold(sql_collapse(x))}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def sql_slug(x: str, default: str = "item") -> str:
    ascii_only = rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"
    slug = f"trim(regexp_replace(lower({ascii_only}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif({slug}, ''), '{default}')"


def sql_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def sql_has_term(x: str, terms) -> str:
    body = "|".join(terms)
    return rf"regexp_matches({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])({body})([^\p{{L}}\p{{N}}_]|$)')"


# --- documents as Markdown and as pages --------------------------------------

def md_lines(docs: DataFrame) -> DataFrame:
    """Texts whose first line is a heading and every fourth a sub-heading."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(i == 0, F.concat(F.lit("# "), line))
        .when(i % 4 == 3, F.concat(F.lit("## "), line))
        .otherwise(line),
    )
    return docs.select("doc_id", "lang", lines.alias("lines"))


def md_docs(t: Tables) -> DataFrame:
    return md_lines(t.documents).select(
        "doc_id", "lang", F.array_join("lines", "\n\n").alias("text")
    )


SQL_MD = r"""
md_lines AS (
  SELECT doc_id, lang, list_transform(string_split(text, chr(10)), lambda line, i:
    CASE WHEN i = 1 THEN '# ' || line WHEN (i - 1) % 4 = 3 THEN '## ' || line ELSE line END) AS lines
  FROM documents),
md_docs AS (
  SELECT doc_id, lang, array_to_string(lines, chr(10) || chr(10)) AS text FROM md_lines)"""


def paged_docs(t: Tables) -> DataFrame:
    """The same lines, with a form feed after every tenth one."""
    marked = F.transform(
        "lines", lambda line, i: F.when(i % 10 == 9, F.concat(line, F.lit("\n\f"))).otherwise(line)
    )
    return md_lines(t.documents).select("doc_id", F.array_join(marked, "\n\n").alias("text"))


SQL_PAGED = SQL_MD + r""",
paged_docs AS (
  SELECT doc_id, array_to_string(list_transform(lines, lambda line, i:
    CASE WHEN (i - 1) % 10 = 9 THEN line || chr(10) || chr(12) ELSE line END),
    chr(10) || chr(10)) AS text FROM md_lines)"""

# --- rule tables over words that occur in the corpus --------------------------

CORPUS_CLASSES = {
    "articles": ["the", "une ", "des"],
    "links": ["and", " et ", "und"],
    "places": ["in ", "sur", "auf"],
    "terms": ["license", "trend"],
}

CORPUS_CATEGORIES = (
    rules.CategoryRule("Articles", ("the", "le", "la"), "Financial Markets"),
    rules.CategoryRule("Links", ("and", "et", "und")),
    rules.CategoryRule("Licensing", ("license", "copyright")),
    rules.CategoryRule("Pronouns", ("that", "which", "qui"), "Links"),
    rules.CategoryRule("Financial Markets", ("for", "of")),
    rules.CategoryRule("General", ()),
)

CORPUS_CONCEPTS = {
    "Article": ("the",),
    "License": ("license", "copyright"),
    "Conjunction": ("and", "et"),
    "Relative": ("that", "which", "qui"),
    "Preposition": ("of", "for", "de"),
}

# --- uploads -------------------------------------------------------------------

_EXTENSIONS = [".pdf", ".HTML", ".txt", ".md", ".exe", ""]
_MIMES = ["text/html", "text/plain; charset=utf-8", "application/pdf",
          "application/octet-stream", "image/png"]


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def uploads(t: Tables) -> DataFrame:
    segment = F.regexp_extract("url", r"([^/]*)$", 1)
    return t.pages.select(
        "page_id",
        F.concat(segment, _pick(F.col("page_id") % 6 + 1, _EXTENSIONS)).alias("name"),
        _pick(F.col("page_id") % 6 + 1, _EXTENSIONS).alias("ext"),
        _pick(F.col("page_id") % 5 + 1, _MIMES).alias("mime"),
        F.octet_length("html").cast("bigint").alias("size"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_UPLOADS = rf"""
uploads AS (
  SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || ({_sql_list(_EXTENSIONS)})[page_id % 6 + 1] AS name,
    ({_sql_list(_EXTENSIONS)})[page_id % 6 + 1] AS ext,
    ({_sql_list(_MIMES)})[page_id % 5 + 1] AS mime, strlen(html)::BIGINT AS size
  FROM pages)"""

# --- job events ------------------------------------------------------------------


def job_events(t: Tables) -> DataFrame:
    """events read as a status history: one job per user."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "view", "reserved")
        .when(F.col("event_type") == "click", "running")
        .when(F.col("event_type") == "purchase", "succeeded")
        .when(k % 2 == 0, "failed")
        .otherwise("retrying")
    )
    return t.events.select(
        F.col("user_id").alias("job_id"), "ts", "event_id", "event_type",
        status.alias("status"), "value", "props",
    )


SQL_JOBS = r"""
job_events AS (
  SELECT user_id AS job_id, ts, event_id, event_type, value, props,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'reserved'
      WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded'
      ELSE CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'failed' ELSE 'retrying' END END AS status
  FROM events)"""
