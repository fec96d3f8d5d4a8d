"""Stored form of chunks: identities, edges, roll-ups, checks and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorespark.functions import hashing, text as tx
from lorespark.operators.chunking import ChunkConfig
from lorespark.session import cut_lineage
from lorespark.sources.corpus import reasons



def canonical_hashes(blocks: DataFrame, id_col: str) -> DataFrame:
    """(id, canonical_hash): digest of the ordered blocks of each document."""
    item = F.struct("source_order", "content_type", "heading_context", "text")
    ordered = F.array_sort(F.collect_list(item))
    return blocks.groupBy(id_col).agg(F.sha2(F.to_json(ordered), 256).alias("canonical_hash"))


def chunk_set_key(id_value: Column, canonical_hash: Column, config: ChunkConfig) -> Column:
    return hashing.sha256_json(
        document=id_value.cast("string"),
        canonical_content_hash=canonical_hash,
        strategy_name=F.lit(config.strategy_name),
        strategy_version=F.lit(config.strategy_version),
        configuration_hash=F.lit(config.configuration_hash()),
    )


def with_identity(
    chunks: DataFrame, hashes: DataFrame, id_col: str, config: ChunkConfig
) -> DataFrame:
    """Add chunk_set_key, stable_key, normalized_text and language to chunks."""
    rows = chunks.join(hashes, id_col)
    stable = hashing.sha256_json(
        document=F.col(id_col).cast("string"),
        canonical_content_hash=F.col("canonical_hash"),
        strategy_name=F.lit(config.strategy_name),
        strategy_version=F.lit(config.strategy_version),
        configuration_hash=F.lit(config.configuration_hash()),
        ordinal=F.col("ordinal"),
        provenance=F.col("spans"),
        content_hash=F.col("content_hash"),
    )
    return rows.select(
        "*",
        chunk_set_key(F.col(id_col), F.col("canonical_hash"), config).alias("chunk_set_key"),
        stable.alias("stable_key"),
        tx.chunk_search_text(F.col("text")).alias("normalized_text"),
        F.lit(config.language).cast("string").alias("language"),
    )


def spans(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row per source span, with its offsets inside the chunk."""
    sized = F.transform(
        "spans",
        lambda s, i: s.withField(
            "text_start",
            F.aggregate(
                F.slice("spans", F.lit(1), i),
                F.lit(0),
                lambda acc, p: acc + (p["source_end"] - p["source_start"]).cast("int") + 2,
            ),
        ),
    )
    rows = chunks.select(*keys, F.posexplode(sized).alias("nth", "s")).select(*keys, "nth", "s.*")
    return rows.withColumn(
        "text_end", F.col("text_start") + F.col("source_end") - F.col("source_start")
    )


def edges(chunks: DataFrame, set_key: str) -> DataFrame:
    """(set, source_ordinal, target_ordinal, type, characters): earlier chunk first.

    Needs overlap_chars and/or continuation columns on the chunks.
    """
    has = set(chunks.columns)
    kinds = []
    if "overlap_chars" in has:
        kinds.append(F.when(
            (F.col("overlap_chars") > 0) & (F.col("ordinal") > 0),
            F.struct(F.lit("overlaps").alias("type"), F.col("overlap_chars").cast("bigint").alias("characters")),
        ))
    if "continuation" in has:
        kinds.append(F.when(
            F.col("continuation").isNotNull() & (F.col("ordinal") > 0),
            F.struct(F.lower("continuation").alias("type"), F.lit(None).cast("bigint").alias("characters")),
        ))
    rows = chunks.select(
        set_key, "ordinal", F.explode(F.array_compact(F.array(*kinds))).alias("e")
    )
    return rows.select(
        set_key,
        (F.col("ordinal") - 1).alias("source_ordinal"),
        F.col("ordinal").alias("target_ordinal"),
        F.col("e.type").alias("type"), F.col("e.characters").alias("characters"),
    ).dropDuplicates([set_key, "source_ordinal", "target_ordinal", "type"])


def neighbours(chunks: DataFrame, set_key: str, key: str) -> DataFrame:
    """Add previous_chunk and next_chunk keys inside each chunk set."""
    order = Window.partitionBy(set_key).orderBy("ordinal")
    return chunks.withColumn("previous_chunk", F.lag(key).over(order)).withColumn(
        "next_chunk", F.lead(key).over(order)
    )


def roll_up(chunks: DataFrame, set_key: str) -> DataFrame:
    """Counts, sizes and the content hash of each chunk set."""
    hashes = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "content_hash"))), lambda c: c["content_hash"]
    )
    overlap = F.sum("overlap_chars") if "overlap_chars" in chunks.columns else F.lit(0)
    return chunks.groupBy(set_key).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("character_count").alias("total_characters"),
        F.sum("word_count").alias("total_words"),
        F.min("character_count").alias("smallest"),
        F.max("character_count").alias("largest"),
        overlap.cast("bigint").alias("overlap_characters"),
        F.sha2(F.to_json(hashes), 256).alias("content_hash"),
    )


def manifests(chunks: DataFrame, set_key: str) -> DataFrame:
    """(set, manifest): the ordered chunk list of each set as canonical JSON."""
    item = F.struct("ordinal", "character_count", "content_hash", "word_count")
    body = F.transform(
        F.array_sort(F.collect_list(item)),
        lambda c: F.struct(
            c["character_count"].alias("character_count"), c["content_hash"].alias("content_hash"),
            c["ordinal"].alias("ordinal"), c["word_count"].alias("word_count"),
        ),
    )
    return chunks.groupBy(set_key).agg(F.to_json(body).alias("manifest"))


def validate(
    chunks: DataFrame, blocks: DataFrame, id_col: str, config: ChunkConfig
) -> DataFrame:
    """(id, ordinal, reasons): rules each chunk breaks; an empty array is valid.

    ``chunks`` carries spans and, when windows overlap, overlap_chars. They are
    cut once and kept; what needs no source is judged before the join, so that
    no text goes through it. Runs a job.
    """
    order = Window.partitionBy(id_col).orderBy("ordinal")
    overlap = F.col("overlap_chars") if "overlap_chars" in chunks.columns else F.lit(0)
    rows = chunks.select(
        id_col, "ordinal", "text", "character_count", "spans", overlap.alias("__o"),
        (F.row_number().over(order) - 1).alias("__rank"),
        F.lag(F.right("text", F.lit(config.overlap_size))).over(order).alias("__tail"),
    )
    head_ok = F.when(
        F.length("__tail") >= F.col("__o"),
        F.substring(F.col("text"), F.lit(1), F.col("__o")) == F.right("__tail", F.col("__o")),
    ).otherwise(False)
    orders = F.transform("spans", lambda s: s["source_order"])
    own = {
        "__gap": F.col("ordinal") != F.col("__rank"), "__size": F.length("text"),
        "__unsorted": orders != F.array_sort(orders), "__head": head_ok,
    }
    rows = cut_lineage(rows.withColumns(own).drop("__rank", "__tail"))
    # a span takes its own piece of the text along, not the whole chunk
    piece = F.substring(F.col("text"), F.col("text_start") + 1, F.col("text_end") - F.col("text_start"))
    per_span = spans(rows, id_col, "ordinal", "text").withColumns({"__piece": piece, "__n": F.length("text")}).drop("text")
    source = blocks.select(
        id_col, "source_order", F.col("text").alias("__source"), F.col("heading_context").alias("__path")
    )
    checked = per_span.join(source, [id_col, "source_order"], "left")
    origin = F.substring(
        F.col("__source"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start")
    )
    # table groups repeat their header, so only their presence is checked
    from_rows = F.col("table_row_start").isNotNull() if "table_row_start" in checked.columns else F.lit(False)
    span_flags = checked.groupBy(id_col, "ordinal").agg(
        F.max(F.col("__source").isNull()).alias("__lost"),
        F.max(F.coalesce(~from_rows & (F.col("__piece") != origin), F.lit(False))).alias("__text"),
        F.max((F.col("text_end") <= F.col("text_start")) | (F.col("text_end") > F.col("__n"))).alias("__bad"),
        F.max(F.coalesce(F.col("__path") != F.col("section_path"), F.lit(False))).alias("__moved"),
        F.max("is_overlap").alias("__marked"),
    )
    judged = rows.select(
        id_col, "ordinal", "character_count", "__o", "__gap", "__size", "__unsorted", "__head", F.size("spans").alias("__spans")
    )
    out = judged.join(span_flags, [id_col, "ordinal"], "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    return out.select(
        id_col, "ordinal",
        reasons(
            (F.col("__gap"), "ordinals not contiguous"),
            (F.col("__size") == 0, "empty chunk"),
            (F.col("__size") != F.col("character_count"), "wrong character count"),
            (F.col("character_count") > config.maximum_size, "over the maximum size"),
            (F.col("__spans") == 0, "no source span"),
            (F.col("__unsorted"), "spans out of order"),
            (flag("__bad"), "span offsets invalid"),
            (flag("__text"), "span differs from chunk text"),
            (flag("__lost"), "source block missing"),
            (flag("__moved"), "section path not inherited"),
            (F.col("__o") > config.overlap_size, "overlap too large"),
            ((F.col("__o") > 0) & ~flag("__head"), "overlap differs from previous tail"),
            ((F.col("__o") > 0) & ~flag("__marked"), "overlap not marked"),
        ).alias("reasons"),
    )


def estimate(blocks: DataFrame, id_col: str, config: ChunkConfig) -> DataFrame:
    """(id, structural, fixed): expected chunk counts from block lengths."""
    total = F.sum(F.length("text") + 2)
    step = max(1, config.target_size - config.overlap_size)
    at_least_one = lambda k: F.greatest(F.lit(1), F.ceil(total / k)).cast("bigint")
    return blocks.groupBy(id_col).agg(
        at_least_one(config.target_size).alias("structural"), at_least_one(step).alias("fixed")
    )


def current_results(
    runs: DataFrame, parent: str, finished: str, run_id: str, *carry: str
) -> DataFrame:
    """Latest succeeded run per parent; a plain aggregate, so safe for hot parents."""
    done = runs.filter("status = 'succeeded'")
    newest = F.max_by(F.struct(finished, run_id, *carry), F.struct(finished, run_id))
    return done.groupBy(parent).agg(newest.alias("__r")).select(parent, "__r.*")


def listing(
    df: DataFrame,
    sort_by: str,
    tie: str | Sequence[str],
    descending: bool = False,
    offset: int = 0,
    limit: int = 50,
    allowed: Sequence[str] | None = None,
    after: Sequence[object] | None = None,
    tie_descending: bool | None = None,
) -> DataFrame:
    """One page of ``df`` plus the ``total`` before paging.

    Ties run like the sort column unless ``tie_descending`` says otherwise.

    The page is a top-k (no full sort); the total is a second, pruned pass.
    ``after`` holds the sort value and ties of the last row of the page before:
    the next page then starts behind that row, by a filter that reaches the
    scan, and costs the same at any depth. ``offset`` counts rows instead and
    has to order all rows in front of the page. Rows without a sort value come
    last.
    """
    if offset < 0 or limit < 1:
        raise ValueError("need offset >= 0 and limit >= 1")
    if allowed is not None and sort_by not in allowed:
        raise ValueError(f"cannot sort by {sort_by}")
    names = [sort_by, *([tie] if isinstance(tie, str) else tie)]
    falls = [descending] + [descending if tie_descending is None else tie_descending] * (len(names) - 1)
    keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in zip(names, falls)]
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df if after is None else df.filter(behind(names, after, falls))
    page = rows.orderBy(*keys).offset(offset).limit(limit)
    return page.withColumn("total", total.scalar())


def behind(names: Sequence[str], last: Sequence[object], descending: bool | Sequence[bool] = False) -> Column:
    """Rows that come after the key ``last`` in the order of ``names``, nulls last.

    ``descending`` holds for all columns or lists one direction for each.
    """
    if len(names) != len(last):
        raise ValueError("need one value for each sort column")
    falls = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    out = F.lit(False)
    for name, value, down in reversed(list(zip(names, last, falls))):
        column = F.col(name)
        if value is None:
            out = column.isNull() & out
            continue
        beyond = column < F.lit(value) if down else column > F.lit(value)
        out = beyond | column.isNull() | ((column == F.lit(value)) & out)
    return out


def search_chunks(
    chunks: DataFrame,
    content_type: str | None = None,
    language: str | None = None,
    min_chars: int | None = None,
    max_chars: int | None = None,
    section: str | None = None,
    contains: str | None = None,
    page: int | None = None,
    content_hash: str | None = None,
    chunk_sets: DataFrame | None = None,
    set_key: str = "chunk_set",
) -> DataFrame:
    """Filtered chunks; section and page tests look at the spans in place.

    ``page`` keeps chunks with a span whose pages hold it, ``content_hash``
    those with that hash in any case, and ``chunk_sets`` those whose
    ``set_key`` is in that table, by a semi-join.
    """
    out = chunks
    if content_type is not None:
        out = out.filter(F.col("content_type") == content_type)
    if language is not None:
        out = out.filter(F.col("language") == language)
    if min_chars is not None:
        out = out.filter(F.col("character_count") >= min_chars)
    if max_chars is not None:
        out = out.filter(F.col("character_count") <= max_chars)
    if content_hash is not None:
        out = out.filter(F.col("content_hash") == content_hash.strip().lower())
    if page is not None:
        out = out.filter(F.exists("spans", lambda s: (s["page_start"] <= page) & (F.coalesce(s["page_end"], s["page_start"]) >= page)))
    if section:
        needle = section.strip().casefold()
        out = out.filter(
            F.exists("spans", lambda s: F.contains(F.lower(F.to_json(s["section_path"])), F.lit(needle)))
        )
    if contains and contains.strip():
        out = out.filter(F.contains(F.lower("text"), F.lit(contains.strip().casefold())))
    if chunk_sets is not None:
        out = out.join(chunk_sets.select(set_key).distinct(), set_key, "left_semi")
    return out


def artifacts(
    chunks: DataFrame, checks: DataFrame, id_col: str, config: ChunkConfig
) -> DataFrame:
    """(id, type, name, content, sha256): what is stored beside a chunk set."""

    def rows(df: DataFrame, kind: str, name: Column, content: Column) -> DataFrame:
        return df.select(
            id_col, F.lit(kind).alias("type"), name.alias("name"), content.alias("content"),
            F.sha2(content, 256).alias("sha256"),
        )

    sets = roll_up(chunks, id_col)
    statistics = hashing.canonical_json(
        chunk_count=F.col("chunk_count"), total_character_count=F.col("total_characters"),
        total_word_count=F.col("total_words"), minimum_chunk_size=F.col("smallest"),
        maximum_chunk_size=F.col("largest"), overlap_character_count=F.col("overlap_characters"),
    )
    report = checks.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") > 0).alias("bad")
    )
    verdict = hashing.canonical_json(chunk_count=F.col("n"), valid=F.col("bad") == 0)
    # one row per broken rule, counted, so a bad document stays small
    warned = (
        checks.select(id_col, F.explode("reasons").alias("reason"))
        .groupBy(id_col, "reason").agg(F.count(F.lit(1)).alias("n"))
    )
    note = F.concat(F.col("reason"), F.lit(": "), F.col("n").cast("string"))
    parts = [
        rows(sets, "configuration", F.lit("chunk-configuration"), F.lit(config.canonical_json())),
        rows(sets, "statistics", F.lit("chunk-statistics"), statistics),
        rows(manifests(chunks, id_col), "manifest", F.lit("chunk-manifest"), F.col("manifest")),
        rows(report, "validation_report", F.lit("provenance-validation"), verdict),
        rows(warned, "warning", F.concat(F.lit("chunk-warning-"), F.col("reason")), note),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
