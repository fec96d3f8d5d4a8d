"""Registry queries: searches, versions, readiness and stored-object checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespark.functions import hashing
from lorespark.operators.chunk_tables import listing
from lorespark.sources.corpus import reasons
from lorespark.session import cut_lineage


def matches_any(columns: Sequence[str], query: str) -> Column:
    """Case-insensitive substring test over several columns."""
    needle = F.lit(query.strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False))
    return hit


def identity_is(id_col: str, names: Sequence[str], value: int | str) -> Column:
    """Filter by numeric id, or by slug/name when the value is not a number."""
    text = str(value).strip()
    if text.isdigit():
        return F.col(id_col) == int(text)
    hit = F.lit(False)
    for name in names:
        hit = hit | (F.lower(name) == text.lower())
    return hit


def having(rows: DataFrame, key: str, related: DataFrame, test: Column) -> DataFrame:
    """Rows with at least one related row that passes ``test``: a semi-join on ``key``."""
    return rows.join(related.filter(test).select(key).distinct(), key, "left_semi")


def search_registry(
    rows: DataFrame,
    key: str,
    q: str | None = None,
    columns: Sequence[str] = (),
    related: Sequence[tuple[DataFrame, Sequence[str]]] = (),
    contains: Sequence[tuple[Sequence[str], str]] = (),
    equals: Mapping[str, str | int | bool] | None = None,
    identities: Sequence[tuple[str, Sequence[str], int | str]] = (),
    tag: int | str | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Rows of a registry of sources or documents that pass all given filters.

    ``q`` must be part of one of ``columns``, or of a column of a ``related``
    table (aliases, identifiers), whose rows belong to a row by ``key``.
    ``contains`` asks for a text in one of some columns (own author or that of
    the source), ``equals`` for values, texts in any case, ``identities`` for
    an id or a name, and ``tag`` for a row of ``tags`` (key, tag, slug, name)
    by id, slug or name. Related rows are reduced to distinct keys before they
    are joined, so many aliases of one row do not multiply it. A blank ``q``
    filters nothing; null columns hold nothing.
    """
    out = rows
    for name, value in (equals or {}).items():
        column = F.lower(name) == value.casefold() if isinstance(value, str) else F.col(name) == F.lit(value)
        out = out.filter(column)
    for names, text in contains:
        out = out.filter(matches_any(names, text))
    for id_col, names, value in identities:
        out = out.filter(identity_is(id_col, names, value))
    if tag is not None and tags is not None:
        out = having(out, key, tags, identity_is("tag", ["slug", "name"], tag))
    if q and q.strip():
        hit = matches_any(columns, q)
        for i, (table, names) in enumerate(related):
            found = table.filter(matches_any(names, q)).select(key).distinct()
            out = out.join(found.withColumn(f"__hit{i}", F.lit(True)), key, "left")
            hit = hit | F.col(f"__hit{i}").isNotNull()
        out = out.filter(hit).drop(*[f"__hit{i}" for i in range(len(related))])
    return out


def current_versions(versions: DataFrame, document: str, version: str, order: Sequence[str], flag: str) -> DataFrame:
    """(document, current_version, versions): replayed as one aggregate.

    Registering makes a version current when asked to or when there is none,
    so the current one is the last flagged version, else the first of all.
    """
    at = F.struct(*order)
    return versions.groupBy(document).agg(
        F.coalesce(
            F.max_by(version, F.when(F.col(flag), at)), F.min_by(version, at)
        ).alias("current_version"),
        F.count(F.lit(1)).alias("versions"),
    )


def with_current_flag(versions: DataFrame, document: str, version: str, order: Sequence[str], flag: str) -> DataFrame:
    """Versions with ``is_current``: exactly one per document.

    The join is on the unique version id, so a document with very many
    versions does not form one hot partition.
    """
    current = current_versions(versions, document, version, order, flag)
    marked = current.select(F.col("current_version").alias(version), F.lit(True).alias("__c"))
    return versions.join(marked, version, "left").withColumn(
        "is_current", F.coalesce("__c", F.lit(False))
    ).drop("__c")


def eligibility(
    documents: DataFrame, sources: DataFrame, versions: DataFrame, files: DataFrame,
    document: str, source: str, version: str,
) -> DataFrame:
    """(document, eligible, reasons): may the document be ingested?

    documents: document, source, active, archived; sources: source,
    source_active, source_archived, allows_ingestion; versions: document,
    version, is_current, checksum; files: version (one row per stored file).
    """
    stored = files.select(version).distinct().withColumn("__file", F.lit(True))
    flagged = versions.filter("is_current").join(stored, version, "left")
    per_doc = flagged.groupBy(document).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(F.trim("checksum") == "").alias("__no_sum"),
        F.max(F.col("__file").isNull()).alias("__no_file"),
    )
    rows = documents.join(sources, source, "left").join(per_doc, document, "left")
    n = F.coalesce("__n", F.lit(0))
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        document,
        reasons(
            (~ok("source_active") | ok("source_archived"), "source is not active"),
            (~ok("allows_ingestion"), "source license does not allow ingestion"),
            (~ok("active"), "document is not active"),
            (ok("archived"), "document is archived"),
            (n == 0, "current version does not exist"),
            (n > 1, "document has multiple current versions"),
            ((n == 1) & ok("__no_sum"), "current version checksum does not exist"),
            ((n == 1) & ok("__no_file"), "current version has no file metadata"),
        ).alias("reasons"),
    ).withColumn("eligible", F.size("reasons") == 0)


def readiness(df: DataFrame, key: str, checks: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """(key, one boolean per facet, ready, reasons): facets with their failure text."""
    facets = [F.coalesce(cond, F.lit(False)).alias(name) for name, cond, _ in checks]
    out = df.select(key, *facets)
    why = F.array_distinct(reasons(*[(~F.col(name), text) for name, _, text in checks]))
    return out.withColumn("reasons", why).withColumn("ready", F.size("reasons") == 0)


def verify_inventory(expected: DataFrame, actual: DataFrame, key: str, max_bytes: int) -> DataFrame:
    """(key, finding) comparing (key, sha256, size_bytes) of registry and store."""
    e = expected.select(key, F.col("sha256").alias("__es"), F.col("size_bytes").alias("__eb"))
    a = actual.select(key, F.col("sha256").alias("__as"), F.col("size_bytes").alias("__ab"))
    finding = (
        F.when(F.col("__ab").isNull(), "object missing")
        .when(F.col("__eb").isNull(), "not registered")
        .when(F.col("__ab") > max_bytes, "over the size limit")
        .when(F.col("__ab") != F.col("__eb"), "size differs")
        .when(F.lower("__as") != F.lower("__es"), "hash differs")
        .otherwise("ok")
    )
    return e.join(a, key, "full_outer").select(key, finding.alias("finding"))


def determinism(first: DataFrame, second: DataFrame, identity: Sequence[str], digest: str) -> DataFrame:
    """(identity…, same): do two runs of one identity agree on the digest?"""
    again = second.select(*identity, F.col(digest).alias("__again"))
    return first.join(again, list(identity)).select(
        *identity, (F.col(digest) == F.col("__again")).alias("same")
    )


#: Parts that are folded in one array: a part of any size is a tree of this fan-out.
FOLD = 1024


def _fold(rows: DataFrame, keys: Sequence[str], position: str, digest: str) -> DataFrame:
    """One digest per key over the digests of its rows in order of position.

    Rows are folded in stretches of ``FOLD`` positions first, so that a key
    with very many rows gathers one digest per stretch only.
    """

    def joined(at: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(at, digest)))
        return F.sha2(F.array_join(F.transform(ordered, lambda x: x[digest]), ""), 256).alias(digest)

    stretches = rows.withColumn("__s", F.floor(F.col(position) / FOLD)).groupBy(*keys, "__s").agg(joined(position))
    return stretches.groupBy(*keys).agg(joined("__s"))


def hash_tree(
    blocks: DataFrame, id_col: str, section: str, position: str, fields: Sequence[str], staged: bool = False
) -> dict[str, DataFrame]:
    """Canonical hashes of a document's blocks, sections and whole: three tables.

    A block is hashed as canonical JSON of its position and ``fields``; a
    section over its blocks and a document over its sections, both in order.
    Equal trees have equal documents. ``section`` and ``position`` are whole
    numbers, and a position comes once in a section. ``staged`` writes the
    hashes of blocks once (a job), for callers that read more than one table.
    """
    values = {name: F.col(name) for name in fields}
    leaves = blocks.select(
        id_col, section, position, hashing.sha256_json(position=F.col(position), **values).alias("sha256")
    )
    leaves = cut_lineage(leaves) if staged else leaves
    sections = _fold(leaves, [id_col, section], position, "sha256")
    return {"block": leaves, "section": sections, "document": _fold(sections, [id_col], section, "sha256")}


def changed_parts(
    stored: dict[str, DataFrame], again: dict[str, DataFrame], id_col: str, section: str, position: str
) -> DataFrame:
    """(id, level, section, position, finding): where two hash trees part.

    Findings are ``changed``, ``missing`` (only stored) and ``added`` (only
    recomputed). Sections are compared in changed documents only, and blocks
    in changed sections only; what is missing or added as a whole is one row.
    """
    keys = [id_col, section, position]
    parent: DataFrame | None = None
    out: DataFrame | None = None
    for depth, level in enumerate(("document", "section", "block"), 1):
        old, new = stored[level], again[level]
        if parent is not None:
            old, new = (x.join(parent, keys[: depth - 1], "left_semi") for x in (old, new))
        both = old.withColumnRenamed("sha256", "__old").join(
            new.withColumnRenamed("sha256", "__new"), keys[:depth], "full_outer"
        )
        finding = F.when(F.col("__new").isNull(), "missing").when(F.col("__old").isNull(), "added").otherwise("changed")
        found = both.filter(~F.col("__old").eqNullSafe(F.col("__new"))).withColumn("finding", finding)
        parent = found.filter("finding = 'changed'").select(*keys[:depth])
        rows = found.select(
            id_col, F.lit(level).alias("level"),
            *[(F.col(k) if i < depth else F.lit(None)).cast("bigint").alias(k) for i, k in enumerate(keys[1:], 1)],
            "finding",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def completed_runs(runs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, reasons, accepted): may a parse run be completed with this output?

    runs: key, status, parser_name, parser_version, content_hash (null until
    it succeeds); outputs: key, parser_name, parser_version, content_hash as
    recomputed. A run that has succeeded is never changed: its output must
    have the stored hash again. Whatever cannot be shown is refused, so a run
    without output is, too.
    """
    new = outputs.select(
        key, F.col("parser_name").alias("__name"), F.col("parser_version").alias("__version"),
        F.col("content_hash").alias("__hash"),
    )
    done = F.col("status") == "succeeded"
    same_parser = F.col("parser_name").eqNullSafe(F.col("__name")) & F.col("parser_version").eqNullSafe(F.col("__version"))
    why = reasons(
        (~F.coalesce(F.col("status").isin("parsing", "succeeded"), F.lit(False)), "run is not being parsed"),
        (F.col("__hash").isNull(), "no output"),
        (F.col("__hash").isNotNull() & ~same_parser, "output of another parser"),
        (F.coalesce(done, F.lit(False)) & F.col("__hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("__hash")),
         "output differs from the stored result"),
    )
    return runs.join(new, key, "left").select(key, why.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def run_listing(
    runs: DataFrame,
    tie: str,
    created: str = "created_at",
    equals: dict[str, object] | None = None,
    hashes: dict[str, str] | None = None,
    status: str | None = None,
    created_from: object = None,
    created_to: object = None,
    sort_by: str | None = None,
    sortable: Sequence[str] | None = None,
    **page,
) -> DataFrame:
    """One page of runs (parse results, chunk sets, import batches), newest first.

    ``equals`` are exact values (texts trimmed), ``hashes`` SHA-256 values in
    any case, ``status`` is compared without case, and both ends of the time
    range belong to it. ``page`` goes to ``listing``. A hash that is none
    raises ValueError, as does a sort column outside ``sortable``.
    """
    out = runs
    for name, value in (equals or {}).items():
        out = out.filter(F.col(name) == (value.strip() if isinstance(value, str) else value))
    for name, value in (hashes or {}).items():
        digest = value.strip().lower()
        if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
            raise ValueError(f"{name} needs a SHA-256 value")
        out = out.filter(F.col(name) == digest)
    if status is not None:
        out = out.filter(F.lower("status") == status.strip().casefold())
    if created_from is not None:
        out = out.filter(F.col(created) >= F.lit(created_from))
    if created_to is not None:
        out = out.filter(F.col(created) <= F.lit(created_to))
    page.setdefault("descending", True)
    return listing(out, sort_by or created, tie, allowed=sortable, **page)
