"""Blocks, metadata, tables, links and limits of HTML pages.

A page is cut into a tag/text token stream behind one exchange on its id.
Which element owns a text token follows from the last open/close event of
that kind at the token's nesting level, so no tree is built. Block tags end
an open paragraph, and a list item ends its open sibling, as browsers do.
"""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lorespark.functions import rules, text as tx
from lorespark.operators import sections

# fixed values: element classes
VOID_TAGS = ("area base br col embed hr img input link meta param source track wbr").split()
OPTIONAL_END_TAGS = ("p li dt dd option optgroup tr td th thead tbody tfoot colgroup").split()
BLOCK_TAGS = (
    "address article aside blockquote body center dd details dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul"
).split()
INLINE_TAGS = (
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var"
).split()
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

_TAG = r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_TOKENS = rf"({_TAG}|[^<]++|<)"
_IGNORED = rf"(?is)<({'|'.join(rules.IGNORED_HTML_TAGS)})\b[^>]*>.*?(?:</\1\s*>|\z)"
# entities decoded on the JVM; any other one is decoded in a Python worker
_COMMON = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html_lib.unescape, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_all(values: pd.Series) -> pd.Series:
    def decoded(items):
        return [None if x is None else html_lib.unescape(x) for x in items]

    return values.map(decoded, na_action="ignore")


def _has_rare(text: Column) -> Column:
    names = "|".join(e[1:-1] for e in _COMMON)
    return text.rlike(rf"&(?!(?:{names});)[#A-Za-z]")


def _decode_common(text: Column) -> Column:
    for entity, char in _COMMON.items():  # the ampersand itself comes last
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decode_entities(text: Column) -> Column:
    return F.coalesce(_unescape(F.when(_has_rare(text), text)), _decode_common(text))


def decode_all(texts: Column) -> Column:
    """Each text of an array decoded; only arrays with a rare entity reach Python."""
    rare = F.exists(texts, lambda x: F.coalesce(_has_rare(x), F.lit(False)))
    return F.coalesce(_unescape_all(F.when(rare, texts)), F.transform(texts, _decode_common))


def tidy_lines(text: Column) -> Column:
    """Per line: blanks collapsed and trimmed; empty lines removed."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("\n")), sections.LINE_BREAK)
    tidy = F.transform(lines, lambda x: tx.strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def visible_markup(html: Column) -> Column:
    """Markup without comments and ignored subtrees; each leaves a separator tag."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "<->")
    return F.regexp_replace(out, _IGNORED, "<->")


def attribute(tag: Column, name: str) -> Column:
    """Trimmed attribute value of a start tag, null when absent or empty."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.nullif(tx.strip(decode_entities(found)), F.lit(""))


def tokens(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, token, name, opens, closes): the visible token stream.

    ``pos`` counts tokens; a text token has a null name.
    """
    cut = pages.repartition(F.col(id_col)).select(
        id_col,
        F.posexplode(F.regexp_extract_all(visible_markup(F.col(html)), F.lit(_TOKENS), 1)).alias(
            "pos", "token"
        ),
    )
    name = F.nullif(F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))
    markup = F.col("token").rlike(r"^<[/!?A-Za-z-]")
    out = cut.withColumn("name", F.when(markup, F.coalesce(name, F.lit("-"))))
    out = out.withColumn("closes", F.coalesce(F.startswith("token", F.lit("</")), F.lit(False)) & markup)
    return out.withColumn("opens", F.col("name").isNotNull() & ~F.col("closes"))


def _last_event(event: Column, window) -> Column:
    """Position carried by the newest event; -1 marks a closing one."""
    last = F.last(event, ignorenulls=True).over(window)
    return F.when(last >= 0, last)


def _owners(stream: DataFrame, id_col: str) -> DataFrame:
    """Add the open position of the elements that own each token."""
    is_ = lambda *names: F.col("name").isin(*names)
    opens, closes, pos = F.col("opens"), F.col("closes"), F.col("pos")
    order = Window.partitionBy(id_col).orderBy("pos")

    def level(*names: str) -> Column:
        step = F.when(is_(*names), opens.cast("int") - closes.cast("int")).otherwise(0)
        return F.sum(step).over(order)

    rows = stream.select(
        "*",
        level("ul", "ol", "menu", "dir").alias("list_level"),
        level("table").alias("table_level"),
        level("blockquote").alias("quote_level"),
        _last_event(
            F.when(is_("p") & opens, pos).when(is_(*BLOCK_TAGS), F.lit(-1)), order
        ).alias("p_at"),
        _last_event(
            F.when(is_(*HEADING_TAGS) & opens, pos).when(is_(*BLOCK_TAGS), F.lit(-1)),
            order,
        ).alias("h_at"),
        _last_event(
            F.when(is_("pre") & opens, pos).when(is_("pre") & closes, F.lit(-1)), order
        ).alias("pre_at"),
        _last_event(
            F.when(is_("a") & opens, pos).when(is_("a") & closes, F.lit(-1)), order
        ).alias("a_at"),
    )
    by_list = Window.partitionBy(id_col, "list_level").orderBy("pos")
    rows = rows.withColumn(
        "li_at",
        _last_event(
            F.when(is_("li") & opens, pos).when(
                (is_("li") & closes) | (is_("ul", "ol", "menu", "dir") & opens), F.lit(-1)
            ),
            by_list,
        ),
    )
    by_quote = Window.partitionBy(id_col, "quote_level").orderBy("pos")
    return rows.withColumn(
        "quote_at",
        F.when(
            F.col("quote_level") > 0,
            _last_event(F.when(is_("blockquote") & opens, pos), by_quote),
        ),
    )


def blocks(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, block_type, level, list_level, quote_level, text) in page order.

    Headings, paragraphs, list items, block quotes and preformatted blocks.
    Bare text of other containers is not a block. Paragraphs in list items
    belong to the item; blocks inside tables are left to the table.
    """
    rows = _owners(tokens(pages, id_col, html), id_col)
    outside_list_item = F.col("li_at").isNull()
    free = F.col("table_level") == 0
    owner = (
        F.when(F.col("h_at").isNotNull(), F.struct(F.lit("heading").alias("t"), F.col("h_at").alias("at")))
        .when(free & F.col("pre_at").isNotNull(),
              F.struct(F.lit("preformatted").alias("t"), F.col("pre_at").alias("at")))
        .when((free | (F.col("list_level") > 1)) & F.col("li_at").isNotNull(),
              F.struct(F.lit("list_item").alias("t"), F.col("li_at").alias("at")))
        .when(free & outside_list_item & F.col("p_at").isNotNull(),
              F.struct(F.lit("paragraph").alias("t"), F.col("p_at").alias("at")))
        .when(free & F.col("quote_at").isNotNull(),
              F.struct(F.lit("quote").alias("t"), F.col("quote_at").alias("at")))
    )
    owned = rows.withColumn("__o", owner).filter("__o IS NOT NULL")
    grouped = owned.groupBy(id_col, F.col("__o.at").alias("pos")).agg(
        F.first("__o.t").alias("__t"),
        F.max("quote_level").alias("quote_level"),
        F.max("list_level").alias("__l"),
        F.max(F.when(F.col("pos") == F.col("__o.at"), F.col("name"))).alias("tag"),
        F.max(F.col("name") == "code").alias("__code"),
        F.array_sort(
            F.collect_list(F.when(F.col("name").isNull(), F.struct("pos", "token")))
        ).alias("__parts"),
    )
    parts = F.transform("__parts", lambda r: r["token"])
    joined = F.when(F.col("__t") == "preformatted", F.array_join(parts, "")).otherwise(
        F.array_join(parts, " ")
    )
    kind = (
        F.when(F.col("__t").isin("heading", "list_item"), F.col("__t"))
        .when((F.col("__t") == "quote") | (F.col("quote_level") > 0), "blockquote")
        .when((F.col("__t") == "preformatted") & F.col("__code"), "preformatted_code")
        .otherwise(F.col("__t"))
    )
    level = F.when(F.col("__t") == "heading", F.substring("tag", 2, 1).cast("int"))
    out = grouped.select(
        id_col, "pos", kind.alias("block_type"), level.alias("level"),
        F.when(F.col("__t") == "list_item", F.col("__l") - 1).alias("list_level"),
        F.col("quote_level").cast("int").alias("quote_level"),
        F.col("__t"),
        tidy_lines(decode_entities(joined)).alias("text"),
    )
    # a quote that holds p, li or pre is represented by them
    return _drop_filled_quotes(out.filter("text <> ''"), rows, id_col)


def _drop_filled_quotes(found: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    filled = (
        rows.filter(F.col("opens") & F.col("name").isin("p", "li", "pre") & F.col("quote_at").isNotNull())
        .select(id_col, F.col("quote_at").alias("pos"), F.lit("quote").alias("__t"))
        .distinct()
    )
    return found.join(filled, [id_col, "pos", "__t"], "left_anti").drop("__t")


def with_paths(found: DataFrame, titles: DataFrame, id_col: str) -> DataFrame:
    """Add ``path`` to blocks; text before the first heading sits under the title.

    ``titles`` is (id, title), one row per page.
    """
    by_page = Window.partitionBy(id_col).orderBy("pos")
    rows = found.withColumn("title", F.when(F.col("level").isNotNull(), F.col("text")))
    first = rows.withColumn("__rn", F.row_number().over(by_page)).filter(
        "__rn = 1 AND level IS NULL"
    )
    opening = first.join(titles.withColumnRenamed("title", "__title"), id_col, "left").select(
        id_col, F.lit(-1).alias("pos"), F.lit(1).alias("level"),
        F.coalesce("__title", F.lit("Document")).alias("title"),
    )
    named = rows.unionByName(opening, allowMissingColumns=True)
    return sections.with_section_path(named, id_col).filter("pos >= 0").drop("title")


def metadata(pages: DataFrame, id_col: str, html: str, stem: Column | None = None) -> DataFrame:
    """Title, author, subject, language, dates, keywords and all meta values."""
    source = F.col(html)
    raw_title = F.regexp_extract(source, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    tags = F.regexp_extract_all(source, F.lit(rf"(?is)(<meta\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)"), 1)
    key = lambda m: F.lower(F.coalesce(*[attribute_raw(m, n) for n in ("name", "property", "http-equiv")]))
    # values are decoded before anything splits them
    metas = F.transform(
        F.arrays_zip(
            decode_all(F.transform(tags, key)).alias("k"),
            decode_all(F.transform(tags, lambda m: attribute_raw(m, "content"))).alias("v"),
        ),
        lambda m: F.struct(
            F.nullif(tx.strip(m["k"]), F.lit("")).alias("k"), F.nullif(tx.strip(m["v"]), F.lit("")).alias("v")
        ),
    )
    rows = pages.select(
        id_col,
        tidy_lines(decode_entities(raw_title)).alias("__title"),
        attribute(F.regexp_extract(source, r"(?is)(<html\b[^>]*>)", 1), "lang").alias("__lang"),
        F.filter(metas, lambda m: m["k"].isNotNull() & m["v"].isNotNull()).alias("__metas"),
        (stem if stem is not None else F.lit(None).cast("string")).alias("__stem"),
    )

    def value(key: str) -> Column:
        return F.get(F.filter("__metas", lambda m: m["k"] == key), F.lit(0))["v"]

    keywords = F.filter(
        F.transform(F.split(F.coalesce(value("keywords"), F.lit("")), "[,;]"), tx.strip),
        lambda k: k != "",
    )
    keys = F.array_distinct(F.transform("__metas", lambda m: m["k"]))
    meta_map = F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.transform(F.filter("__metas", lambda m: m["k"] == k), lambda m: m["v"]),
        ),
    )
    return rows.select(
        id_col,
        F.coalesce(F.nullif("__title", F.lit("")), value("og:title"), "__stem").alias("title"),
        value("author").alias("author"),
        F.coalesce(value("description"), value("og:description")).alias("subject"),
        F.coalesce("__lang", value("content-language")).alias("language"),
        F.coalesce(value("article:published_time"), value("date")).alias("created_at"),
        value("article:modified_time").alias("modified_at"),
        keywords.alias("keywords"),
        meta_map.alias("meta"),
    )


def attribute_raw(tag: Column, name: str) -> Column:
    """Attribute value as written, null when absent or empty."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])
    return F.nullif(tx.strip(found), F.lit(""))


def tables(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, table_index, caption, headers, rows): cells of each table.

    A table nested in a cell counts as its own table. Everything grouped
    together comes from one page record.
    """
    stream = tokens(pages, id_col, html)
    order = Window.partitionBy(id_col).orderBy("pos")
    table = F.col("name") == "table"
    step = F.when(table, F.col("opens").cast("int") - F.col("closes").cast("int")).otherwise(0)
    rows = stream.withColumn("__lvl", F.sum(step).over(order)).filter("__lvl > 0")
    inside = Window.partitionBy(id_col, "__lvl").orderBy("pos")
    rows = rows.withColumn(
        "__t", F.last(F.when(table & F.col("opens"), F.col("pos")), True).over(inside)
    )
    per = Window.partitionBy(id_col, "__t").orderBy("pos")
    is_row, is_cell = F.col("name") == "tr", F.col("name").isin("td", "th")
    is_caption = F.col("name") == "caption"
    cell_event = (
        F.when(is_cell & F.col("opens"), F.lit("cell"))
        .when(is_caption & F.col("opens"), F.lit("caption"))
        .when(is_cell | is_row | is_caption, F.lit("none"))
    )
    rows = rows.select(
        "*",
        F.sum((is_row & F.col("opens")).cast("int")).over(per).alias("__r"),
        F.sum((is_cell & F.col("opens")).cast("int")).over(per).alias("__c"),
        F.last(cell_event, True).over(per).alias("__in"),
    )
    kept = rows.filter(F.col("__in").isin("cell", "caption"))
    cells = kept.groupBy(id_col, "__t", "__in", "__r", "__c").agg(
        F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("pos", "token")))).alias("__p")
    )
    joined = F.array_join(F.transform("__p", lambda p: tx.strip(p["token"])), " ")
    cells = cells.withColumn("text", tidy_lines(decode_entities(joined)))
    is_text = F.col("__in") == "cell"
    per_row = cells.groupBy(id_col, "__t", "__in", F.when(is_text, F.col("__r")).alias("__r")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__c", "text"))), lambda c: c["text"]
        ).alias("cells")
    )
    whole = per_row.groupBy(id_col, F.col("__t").alias("pos")).agg(
        F.max(F.when(F.col("__in") == "caption", F.col("cells")[0])).alias("caption"),
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("__in") == "cell", F.struct("__r", "cells")))
            ),
            lambda r: r["cells"],
        ).alias("__rows"),
    ).filter(F.size("__rows") > 0)
    return whole.select(
        id_col, "pos",
        (F.row_number().over(order) - 1).alias("table_index"),
        "caption",
        F.col("__rows")[0].alias("headers"),
        F.slice("__rows", F.lit(2), F.size("__rows")).alias("rows"),
    )


def render_table(caption: Column, headers: Column, rows: Column) -> Column:
    """Caption, header line and rows as tab-separated lines."""
    body = F.transform(F.concat(F.array(headers), rows), lambda r: F.array_join(r, "\t"))
    lines = F.concat(F.array_compact(F.array(F.nullif(caption, F.lit("")))), body)
    return F.array_join(lines, "\n")


def links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, text, target, title, rel): anchors that have a target."""
    rows = _owners(tokens(pages, id_col, html), id_col).filter("a_at IS NOT NULL")
    found = rows.groupBy(id_col, F.col("a_at").alias("pos")).agg(
        F.max(F.when(F.col("pos") == F.col("a_at"), F.col("token"))).alias("__tag"),
        F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("pos", "token")))).alias("__p"),
    )
    text = F.array_join(F.transform("__p", lambda p: tx.strip(p["token"])), " ")
    out = found.select(
        id_col, "pos",
        F.nullif(tidy_lines(decode_entities(text)), F.lit("")).alias("text"),
        attribute(F.col("__tag"), "href").alias("target"),
        attribute(F.col("__tag"), "title").alias("title"),
        attribute(F.col("__tag"), "rel").alias("rel"),
    ).filter("target IS NOT NULL")
    return out.withColumn("text", F.coalesce("text", "target"))


def images(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, identifier, source, alt_text, caption), de-duplicated."""
    stream = tokens(pages, id_col, html)
    order = Window.partitionBy(id_col).orderBy("pos")
    figure = F.col("name") == "figure"
    at = F.last(
        F.when(figure & F.col("opens"), F.col("pos")).when(figure, F.lit(-1)), True
    ).over(order)
    inside = F.last(
        F.when(F.col("name") == "figcaption", F.col("opens")), True
    ).over(order)
    rows = stream.select("*", at.alias("__f"), inside.alias("__cap"))
    captions = (
        rows.filter("__f >= 0 AND __cap AND name IS NULL")
        .groupBy(id_col, "__f")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("__p"))
        .select(
            id_col, "__f",
            tidy_lines(decode_entities(
                F.array_join(F.transform("__p", lambda p: tx.strip(p["token"])), " ")
            )).alias("caption"),
        )
    )
    found = rows.filter((F.col("name") == "img") & F.col("opens"))
    src = attribute(F.col("token"), "src")
    number = F.concat(F.lit("image-"), F.col("pos").cast("string"))
    return (
        found.join(captions, [id_col, "__f"], "left")
        .select(
            id_col, "pos",
            F.coalesce(attribute(F.col("token"), "id"), src, number).alias("identifier"),
            src.alias("source"),
            attribute(F.col("token"), "alt").alias("alt_text"),
            "caption",
        )
        .dropDuplicates([id_col, "identifier", "pos"])
    )


def complexity(
    pages: DataFrame,
    id_col: str,
    html: str,
    max_nodes: int = rules.MAX_HTML_NODES,
    max_depth: int = rules.MAX_HTML_DEPTH,
) -> DataFrame:
    """(id, nodes, depth, accepted): element and text nodes, container depth.

    Elements whose end tag may be missing do not add to the depth.
    """
    stream = tokens(pages, id_col, html)
    nests = ~F.col("name").isin(*VOID_TAGS, *OPTIONAL_END_TAGS, *INLINE_TAGS, "-")
    step = F.when(nests, F.col("opens").cast("int") - F.col("closes").cast("int")).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy(id_col).orderBy("pos"))
    per = stream.withColumn("__d", depth).groupBy(id_col).agg(
        F.count_if((F.col("opens") & (F.col("name") != "-")) | F.col("name").isNull()).alias("nodes"),
        F.max("__d").cast("bigint").alias("depth"),
    )
    ok = (F.col("nodes") <= max_nodes) & (F.col("depth") <= max_depth)
    return per.withColumn("accepted", ok)
