"""Headings, sections and paragraphs from plain and paged text.

Texts are exploded into lines behind ONE exchange on the document id; every
window and grouping below is keyed by that id and reuses the partitioning.
A group never holds more than the lines of one input record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorespark.functions import text as tx

LINE_BREAK = r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(docs: DataFrame, id_col: str, text: str, *keep: str) -> DataFrame:
    """(id, keep…, pos, line): one row per line of each document."""
    return docs.repartition(F.col(id_col)).select(
        id_col, *keep, F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "line")
    )


def _in_order(id_col: str):
    return Window.partitionBy(id_col).orderBy("pos")


def is_all_caps(line: Column) -> Column:
    return line.rlike(r"\p{L}") & (F.upper(line) == line)


def text_headings(lines: DataFrame, id_col: str) -> DataFrame:
    """Add ``bare``, ``title``, ``level`` and ``dropped`` (underline rows) to lines."""
    order = _in_order(id_col)
    hashes = r"(?U)^(#{1,6})\s+(.+?)\s*#*$"
    rows = lines.withColumn("bare", tx.strip(F.col("line")))
    rows = rows.withColumn("__next", F.lead("line").over(order))
    rows = rows.withColumn("__atx", F.col("bare").rlike(hashes)).withColumn(
        "__under",
        (F.col("bare") != "")
        & ~F.col("__atx")
        & F.coalesce(F.col("__next").rlike(r"(?U)^\s*(=+|-+)\s*$"), F.lit(False))
        & (F.length(tx.strip(F.col("__next"))) >= 3),
    )
    # In a run of candidates every second line is eaten as its predecessor's
    # underline, so only even places of the run are headings.
    last_other = F.max(F.when(~F.col("__under"), F.col("pos"))).over(order)
    place = F.col("pos") - F.coalesce(last_other, F.lit(-1)) - 1
    rows = rows.withColumn("__set", F.col("__under") & (place % 2 == 0))
    rows = rows.withColumn("dropped", F.coalesce(F.lag("__set").over(order), F.lit(False)))
    caps = (
        (F.length("bare") <= 120)
        & tx.word_count(F.col("bare")).between(1, 12)
        & is_all_caps(F.col("bare"))
    )
    level = (
        F.when(F.col("dropped"), None)
        .when(F.col("__atx"), F.length(F.regexp_extract("bare", hashes, 1)))
        .when(F.col("__set"), F.when(F.ltrim("__next").startswith("="), 1).otherwise(2))
        .when(caps, 1)
    )
    title = F.when(
        F.col("__atx"), tx.strip(F.regexp_extract("bare", hashes, 2))
    ).otherwise(F.col("bare"))
    rows = rows.withColumn("level", level.cast("int"))
    rows = rows.withColumn("title", F.when(F.col("level").isNotNull(), title))
    return rows.drop("__next", "__atx", "__under", "__set")


def text_paragraphs(
    headed: DataFrame, id_col: str, fallback_title: Column | None = None
) -> DataFrame:
    """Assemble lines into (id, section, title, level, paragraph, pos, text).

    A heading opens a section, a blank line ends a paragraph. Sections that
    hold no paragraph disappear. Text before the first heading belongs to the
    first heading when that is the first non-blank line, else to the fallback.
    """
    order = _in_order(id_col)
    heading = F.col("level").isNotNull()
    breaks = heading | (F.col("bare") == "") | F.col("dropped")
    rows = headed.withColumn("__sec", F.sum(heading.cast("int")).over(order))
    rows = rows.withColumn("__par", F.sum(breaks.cast("int")).over(order))
    by_section = Window.partitionBy(id_col, "__sec")
    rows = rows.withColumn("__title", F.max("title").over(by_section))
    rows = rows.withColumn("__level", F.coalesce(F.max("level").over(by_section), F.lit(1)))
    rows = rows.filter(~breaks)
    if fallback_title is not None:
        rows = rows.withColumn("__title", F.coalesce("__title", fallback_title))
    grouped = rows.groupBy(id_col, "__sec", "__par").agg(
        F.min("pos").alias("pos"),
        F.first("__title").alias("title"),
        F.first("__level").alias("level"),
        _joined_lines().alias("text"),
    )
    return _number(grouped, id_col)


def _joined_lines() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "bare")))
    return F.array_join(F.transform(ordered, lambda r: r["bare"]), " ")


def _number(grouped: DataFrame, id_col: str) -> DataFrame:
    order = _in_order(id_col)
    return grouped.select(
        id_col,
        (F.dense_rank().over(Window.partitionBy(id_col).orderBy("__sec")) - 1).alias("section"),
        "title",
        "level",
        (F.row_number().over(order) - 1).alias("paragraph"),
        "pos",
        "text",
        *([c for c in ("page",) if c in grouped.columns]),
    )


def paged_paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Sections and paragraphs of page-separated text (form feed between pages).

    Every page opens a section ``Page n``. Numbered, upper-case and short
    title-case lines are headings unless they end like a sentence.
    """
    pages = docs.repartition(F.col(id_col)).select(
        id_col, F.posexplode(F.split(text, "\f")).alias("__p", "__page_text")
    )
    lines = pages.select(
        id_col,
        (F.col("__p") + 1).alias("page"),
        F.posexplode(F.split("__page_text", LINE_BREAK)).alias("__l", "line"),
    ).withColumn("bare", tx.collapse_space(F.col("line")))
    bare = F.col("bare")
    closed = (bare == "") | (F.length(bare) > 120) | bare.rlike(r"[.;,]$")
    numbered = r"^(\p{Nd}+(?:\.\p{Nd}+)*)[.)]?\s+(.+)$"
    dots = F.length(F.regexp_replace(F.regexp_extract(bare, numbered, 1), r"[^.]", ""))
    level = (
        F.when(closed, None)
        .when(bare.rlike(numbered), F.least(dots + 1, F.lit(6)))
        .when((tx.word_count(bare) <= 12) & is_all_caps(bare), 1)
        # no word may start with a letter that is not upper case
        .when((tx.word_count(bare) <= 8) & ~bare.rlike(r"(^| )[\p{L}&&[^\p{Lu}]]"), 2)
    )
    rows = lines.withColumn("level", level.cast("int"))
    order = Window.partitionBy(id_col).orderBy("page", "__l")
    heading = F.col("level").isNotNull()
    opens = heading | (F.col("__l") == 0)
    breaks = heading | (bare == "")
    rows = (
        rows.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("__sec", F.sum(opens.cast("int")).over(order))
        .withColumn("__par", F.sum((opens | breaks).cast("int")).over(order))
    )
    by_section = Window.partitionBy(id_col, "__sec")
    rows = (
        rows.withColumn("__title", F.max(F.when(heading, bare)).over(by_section))
        .withColumn("__level", F.coalesce(F.max("level").over(by_section), F.lit(1)))
        .filter(~breaks)
    )
    page_title = F.concat(F.lit("Page "), F.col("page").cast("string"))
    grouped = rows.groupBy(id_col, "__sec", "__par").agg(
        F.min("pos").alias("pos"),
        F.min("page").alias("page"),
        F.first(F.coalesce("__title", page_title)).alias("title"),
        F.first("__level").alias("level"),
        _joined_lines().alias("text"),
    )
    return _number(grouped, id_col)


def with_section_path(rows: DataFrame, id_col: str, depth: int = 6) -> DataFrame:
    """Add ``path``: titles of the headings open at each row, outermost first.

    ``rows`` has pos, level (null when not a heading) and title. A heading of
    level k stays open until a heading of level ≤ k follows.
    """
    order = _in_order(id_col)
    out = rows
    for k in range(1, depth + 1):
        here = F.when(F.col("level") == k, F.struct("pos", "title"))
        out = out.withColumn(f"__h{k}", F.last(here, ignorenulls=True).over(order))
    entries, newest_outer = [], F.lit(-2)
    for k in range(1, depth + 1):
        at = F.col(f"__h{k}.pos")
        entries.append(F.when(at > newest_outer, F.col(f"__h{k}.title")))
        newest_outer = F.greatest(newest_outer, F.coalesce(at, F.lit(-2)))
    out = out.withColumn("path", F.array_compact(F.array(*entries)))
    return out.drop(*[f"__h{k}" for k in range(1, depth + 1)])


def with_offsets(blocks: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Add char_start/char_end of each block in the blank-line-joined content."""
    before = _in_order(id_col).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0))
    return blocks.withColumn("char_start", start).withColumn(
        "char_end", F.col("char_start") + F.length(text)
    )


def document_statistics(
    docs: DataFrame, id_col: str, text: str, children: dict[str, DataFrame],
    pages: str | None = None, stored: DataFrame | None = None,
) -> DataFrame:
    """Per document: page, word, char and child counts, and ``valid``.

    ``children`` maps count names (``section_count``, ``paragraph_count``,
    ``table_count``, ``image_count``, ``reference_count``) to tables keyed by
    the document id; each is pre-aggregated before the join. ``pages`` names
    the column with the number of pages. A document is valid if it has a page,
    a text and a paragraph, as far as these are given, and its counts equal
    those of ``stored`` where that table is given (no stored row: not valid).
    """
    out = docs.select(
        id_col,
        tx.word_count(F.col(text)).alias("word_count"),
        F.length(text).cast("bigint").alias("character_count"),
        (tx.strip(F.col(text)) != "").alias("__text"),
        *([F.col(pages).cast("bigint").alias("page_count")] if pages else []),
    )
    for name, child in children.items():
        counts = child.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, id_col, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    valid = F.col("__text")
    for name in ("page_count", "paragraph_count"):
        if name in out.columns:
            valid = valid & (F.coalesce(name, F.lit(0)) > 0)
    if stored is not None:
        counted = [c for c in out.columns if c not in (id_col, "__text")]
        kept = stored.select(id_col, F.struct(*counted).alias("__stored"))
        out = out.join(kept, id_col, "left")
        for name in counted:
            valid = valid & F.col(name).eqNullSafe(F.col(f"__stored.{name}"))
    return out.withColumn("valid", valid).drop("__text", "__stored")
