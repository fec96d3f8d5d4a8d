"""Knowledge-graph and tree queries."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespark.functions.ordered import with_running
from lorespark.session import cut_lineage


def unique_slugs(df: DataFrame, base: str, order: str, width: int = 100_000) -> DataFrame:
    """Add ``slug``: repeats of a base get -2, -3, … in arrival order."""
    segment = F.floor(F.col(order) / width)
    numbered = with_running(df, base, [order], segment, {"__n": F.lit(1)})
    suffix = F.when(F.col("__n") == 1, "").otherwise(F.concat(F.lit("-"), F.col("__n").cast("string")))
    return numbered.withColumn("slug", F.concat(base, suffix)).drop("__n")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): everything reachable from src, by shortest distance.

    Distances double per round: a shortest path of more than ``d`` steps has a
    node at exactly ``d``, so the pairs at that distance are joined with all
    pairs known. A thousand levels take ten rounds; cycles end by themselves,
    as their pairs are known by shorter paths. Rounds are checkpointed so that
    lost executors do not replay the loop. Paths beyond ``max_depth``, if a
    caller gives one, are an error, not a silent cut. Runs jobs.
    """
    known = edges.select("src", "dst").distinct().withColumn("depth", F.lit(1))
    known = cut_lineage(known)
    for power in itertools.count():
        far = 1 << power
        edge = known.filter(F.col("depth") == far).select("src", F.col("dst").alias("__mid"))
        ahead = known.select(F.col("src").alias("__mid"), "dst", (F.col("depth") + far).alias("depth"))
        grown = edge.join(ahead, "__mid").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        fresh = cut_lineage(grown.join(known, ["src", "dst"], "left_anti"))
        deepest = fresh.agg(F.max("depth")).first()[0]
        if deepest is None:
            return known
        if max_depth is not None and deepest > max_depth:
            raise ValueError(f"paths longer than {max_depth}")
        known = known.unionByName(fresh)
        if power % 8 == 7:  # else plan and partitions grow with every round
            known = cut_lineage(known.coalesce(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes that lie on cycles of ``edges(src, dst)``.

    Nodes without an edge in or out are peeled off, and nodes with one of each
    are taken out of their path, both many at a time, so that chains and trees
    go in logarithmically many rounds. What is left is coloured forward by the
    greatest node that reaches it; nodes of a colour that reach its name are
    one component. Path nodes then come back, in the component of their
    neighbours if both share one. No pairs of nodes are built. A component is
    named by one of its nodes. Runs jobs.
    """
    clean = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = clean.filter("src = dst").select(F.col("src").alias("node"))
    live = cut_lineage(clean.filter("src <> dst"))
    taken: list[DataFrame] = []
    found = cut_lineage(loops.select("node", F.col("node").alias("component")))
    while not live.isEmpty():
        live, picked, progress = _contracted(live, len(taken))
        if picked is not None:
            taken.append(picked)
        if not progress:
            part = _coloured(live)
            inside = part.select("node")
            live = cut_lineage(
                live.join(inside.withColumnRenamed("node", "src"), "src", "left_anti")
                .join(inside.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            )
            found = found.unionByName(part)
    named = lambda df: df.groupBy("node").agg(F.max_by("component", F.col("node") != F.col("component")).alias("component"))
    found = named(found)
    for turn, picked in enumerate(reversed(taken)):
        near = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))  # noqa: E731, B023
        back = picked.join(near("before"), "before", "left").join(near("after"), "after", "left")
        component = F.coalesce("__before", "before")
        same = back.filter(component == F.coalesce("__after", "after")).select("node", component.alias("component"))
        # the neighbour itself may not have been known to lie on a cycle
        joined = same.select(F.col("component").alias("node"), "component")
        found = named(found.unionByName(same).unionByName(joined))
        if turn % 4 == 3:
            found = cut_lineage(found)
    return found


def _contracted(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame | None, bool]:
    """One round of peeling and path shortening: (edges left, path nodes taken out, any change)."""
    into = live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("before"))
    out = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("after"))
    nodes = into.join(out, "node", "full")
    dice = lambda c: F.xxhash64(c, F.lit(turn))
    # no two neighbours go in one round
    lowest = (dice("node") < dice("before")) & (dice("node") < dice("after"))
    end = F.col("ins").isNull() | F.col("outs").isNull()
    gone = cut_lineage(nodes.filter(end | ((F.col("ins") == 1) & (F.col("outs") == 1) & lowest)).select("node", "before", "after"))
    if gone.isEmpty():
        return live, None, False
    picked = gone.filter("before IS NOT NULL AND after IS NOT NULL")
    left = live.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    left = left.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    bridges = picked.filter("before <> after").select(F.col("before").alias("src"), F.col("after").alias("dst"))
    return cut_lineage(left.unionByName(bridges).distinct()), picked, True


def _coloured(live: DataFrame) -> DataFrame:
    """(node, component) of at least one strong component of ``live``; runs jobs."""
    nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour = cut_lineage(nodes.withColumn("colour", F.col("node")))
    while True:
        sent = live.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
        grown = colour.withColumn("old", F.col("colour")).unionByName(sent.withColumn("old", F.lit(None).cast(colour.schema["node"].dataType)))
        grown = cut_lineage(grown.groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old")))
        colour = grown.select("node", "colour")
        if grown.filter("colour <> old").isEmpty():
            break
    reached = colour.filter("node = colour")
    inner = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("__s")), "src")
    inner = inner.join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("__d")), "dst")
    inner = cut_lineage(inner.filter("__s = __d").select("src", "dst", F.col("__s").alias("colour")))
    fresh = reached
    while True:
        grown = inner.join(fresh.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
        fresh = cut_lineage(grown.join(reached.select("node"), "node", "left_anti"))
        if fresh.isEmpty():
            return reached.withColumnRenamed("colour", "component")
        reached = cut_lineage(reached.unionByName(fresh))


def on_cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: in a component with others, or with a loop."""
    alone = components.groupBy("component").agg(F.count("*").alias("n")).filter("n = 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    single = components.join(alone, "component", "left_semi").select("node").join(loops, "node", "left_semi")
    return components.join(alone, "component", "left_anti").select("node").unionByName(single)


def edge_problems(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, copies, problem): self loops, repeats and edges inside cycles."""
    grouped = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))
    joined = grouped.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    problem = (
        F.when(F.col("src") == F.col("dst"), "self loop")
        .when(F.col("__src") == F.col("__dst"), "cycle")
        .when(F.col("copies") > 1, "duplicate")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("src", "dst", "copies", "problem")


def chain_heads(links: DataFrame) -> DataFrame:
    """(node, head, hops) following ``node -> next`` to the last one.

    Pointer jumping: the distance covered doubles per round, so a chain of a
    million links needs twenty joins. Finished pointers leave the join, which
    keeps the popular last nodes out of it. Links must not form cycles.
    """
    base = links.select("node", F.col("next").alias("head"))
    ends = base.select(F.col("node").alias("head"), F.lit(True).alias("__goes_on"))
    state = base.join(ends, "head", "left").select(
        "node", "head", F.lit(1).cast("bigint").alias("hops"), F.col("__goes_on").isNull().alias("done")
    )
    state = cut_lineage(state)
    for _ in range(64):
        moving = state.filter("NOT done")
        if moving.isEmpty():
            return state.drop("done")
        ahead = state.select(
            F.col("node").alias("head"), F.col("head").alias("__h"),
            F.col("hops").alias("__n"), F.col("done").alias("__d"),
        )
        jumped = moving.join(ahead, "head").select(
            "node", F.col("__h").alias("head"), (F.col("hops") + F.col("__n")).alias("hops"),
            F.col("__d").alias("done"),
        )
        state = cut_lineage(state.filter("done").unionByName(jumped))
    raise ValueError("links form a cycle")


def neighbourhood(edges: DataFrame, nodes: DataFrame, key: str, title: str) -> DataFrame:
    """(node, direction, type, other, other_title): both directions of each edge.

    A union of two projections, not a join with OR.
    """
    out = edges.select(
        F.col("src").alias("node"), F.lit("outgoing").alias("direction"), "type", F.col("dst").alias("other")
    )
    into = edges.select(
        F.col("dst").alias("node"), F.lit("incoming").alias("direction"), "type", F.col("src").alias("other")
    )
    names = nodes.select(F.col(key).alias("other"), F.col(title).alias("other_title"))
    return out.unionByName(into).join(names, "other").select(
        "node", "direction", "type", "other", "other_title"
    )


def conflict_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Unordered, unique pairs without self pairs, with their number of reports."""
    clean = pairs.filter(F.col(left) != F.col(right)).select(
        F.least(left, right).alias("first"), F.greatest(left, right).alias("second")
    )
    return clean.groupBy("first", "second").agg(F.count(F.lit(1)).alias("reports"))


def latest_per_entity(
    rows: DataFrame, entity: Sequence[str], version: str, carry: Sequence[str], tie: str
) -> DataFrame:
    """Newest version per entity plus how many rows share a version number."""
    per_version = rows.groupBy(*entity, version).agg(
        F.max_by(F.struct(*carry), F.col(tie)).alias("__c"), F.count(F.lit(1)).alias("__n")
    )
    return per_version.groupBy(*entity).agg(
        F.max(version).alias(version),
        F.max_by("__c", version).alias("__c"),
        F.count_if(F.col("__n") > 1).alias("repeated_versions"),
    ).select(*entity, version, "__c.*", "repeated_versions")


def entity_type_key(name: Column) -> Column:
    """Normalised entity type: snake case, singular."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"[- ]", "_")
    return F.when(key.rlike("ies$"), F.regexp_replace(key, "ies$", "y")).otherwise(
        F.regexp_replace(key, "s$", "")
    )


def reference_audit(refs: DataFrame, entities: DataFrame, types: Sequence[str]) -> DataFrame:
    """(…, entity_type, problem) of references with an unknown type or a missing target.

    ``entities`` is the union of (entity_type, entity_id) over all tables.
    """
    rows = refs.withColumn("entity_type", entity_type_key(F.col("entity_type")))
    unknown = rows.filter(~F.col("entity_type").isin(list(types))).withColumn(
        "problem", F.lit("unknown type")
    )
    lost = rows.filter(F.col("entity_type").isin(list(types))).join(
        entities, ["entity_type", "entity_id"], "left_anti"
    ).withColumn("problem", F.lit("missing entity"))
    return unknown.unionByName(lost)


def latest_assessments(
    rows: DataFrame, source: str, scores: Sequence[str], at: str, tie: str
) -> DataFrame:
    """Newest assessment per source and whether all its scores lie in [0, 1]."""
    newest = rows.groupBy(source).agg(
        F.max_by(F.struct(at, *scores), F.struct(at, tie)).alias("__a")
    ).select(source, "__a.*")
    valid = F.lit(True)
    for s in scores:
        valid = valid & F.coalesce(F.col(s).between(0.0, 1.0), F.lit(True))
    return newest.withColumn("valid", valid)


def outline(
    levels: Sequence[tuple[DataFrame, str, str | None, str]], order_width: int = 100_000
) -> DataFrame:
    """One row per node of a fixed hierarchy: (level, id, parent, title, position, siblings).

    ``levels`` lists (table, id column, parent column, title column) from the
    root down. Positions count inside the parent in id order. Rows stay flat:
    a parent with millions of children would not fit in one array, and a
    reader takes one subtree with a filter.
    """
    out = None
    for depth, (table, key, parent, title) in enumerate(levels):
        rows = table.select(
            F.lit(depth).alias("level"), F.col(key).cast("bigint").alias("id"),
            (F.col(parent) if parent else F.lit(None)).cast("bigint").alias("parent"),
            F.col(title).alias("title"),
        ).withColumn("__p", F.coalesce("parent", F.lit(-1).cast("bigint")))
        placed = with_running(
            rows, "__p", ["id"], F.floor(F.col("id") / order_width), {"__n": F.lit(1)}
        )
        if parent is None:  # one group: its size is a scalar, not a join on a constant
            placed = placed.withColumn("siblings", rows.select(F.count(F.lit(1))).scalar())
        else:
            count = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("siblings"))
            placed = placed.join(count, "__p")
        placed = placed.select(
            "level", "id", "parent", "title", (F.col("__n") - 1).alias("position"), "siblings"
        )
        out = placed if out is None else out.unionByName(placed)
    return out


def repeated_positions(children: DataFrame, parent: str, position: str) -> DataFrame:
    """(parent, position, n) used more than once under one parent."""
    return children.groupBy(parent, position).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def resolve_aliases(phrases: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Join phrases to concepts by alias key: preferred alias first, then lowest id.

    ``aliases`` has the key, alias_id, concept and preferred.
    """
    best = aliases.groupBy(key).agg(
        F.min_by("concept", F.struct((~F.col("preferred")).alias("p"), "alias_id")).alias("concept")
    )
    return phrases.join(best, key, "left")


def matching_claims(
    claims: DataFrame,
    concept: object = None,
    claim_type: str | None = None,
    status: str | None = None,
    min_confidence: float | None = None,
    q: str | None = None,
) -> DataFrame:
    """Claims (concept, claim_type, status, confidence, statement) by exact values,
    a least confidence and a pattern in the statement (``%`` and ``_`` are wild)."""
    out = claims
    for name, value in (("concept", concept), ("claim_type", claim_type or None), ("status", status or None)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    return out.filter(F.col("statement").ilike(f"%{q}%")) if q else out


def matching_evidence(
    evidence: DataFrame,
    claim: object = None,
    source: object = None,
    evidence_type: str | None = None,
    strength: float | None = None,
) -> DataFrame:
    """Evidence (claim, source, evidence_type, strength) by exact values."""
    out = evidence
    for name, value in (("claim", claim), ("source", source), ("evidence_type", evidence_type or None), ("strength", strength)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def evidence_chain(
    concepts: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame
) -> DataFrame:
    """concept → claim → evidence → source, one row per piece of evidence.

    Concepts have ``concept`` and any further columns, claims ``claim`` and
    ``concept``, evidence ``claim`` and ``source``, sources ``source``.
    Evidence without a known source stays, with nulls for its columns. Each
    join is on the unique key of one side. Tables that are filtered before
    shrink the chain from either end; evidence is reduced to its claims first.
    """
    chain = claims.join(concepts, "concept")
    return evidence.join(chain, "claim").join(sources, "source", "left")


def nested(
    parents: DataFrame,
    key: str,
    children: dict[str, tuple[DataFrame, str, str, Sequence[str]]],
    most: int = 10_000,
) -> DataFrame:
    """Parents with their children inside, in position order.

    ``children`` maps a name to (table, parent column, position column, further
    columns). Each name becomes an array of structs, with ``<name>_count`` and
    ``<name>_repeated``, the positions that come more than once (ascending).
    Equal positions are ordered by the further columns; without children the
    arrays are empty. Deeper trees are built from the leaves up, as a table may
    be the result of another call.

    A parent with over ``most`` children keeps its count, and its arrays are
    null: they would not fit a row, and ``outline`` lists them as rows. Such
    children leave before anything is collected.
    """
    out = parents
    for name, (table, parent, position, fields) in children.items():
        rows = table.filter(F.col(parent).isNotNull())
        count = rows.groupBy(parent).agg(F.count(F.lit(1)).alias("__n"))
        crowded = count.filter(F.col("__n") > most).select(parent)
        packed = rows.join(crowded, parent, "left_anti").groupBy(parent).agg(
            F.array_sort(F.collect_list(F.struct(position, *fields))).alias("__c")
        )
        at = F.transform("__c", lambda x: x[position])
        again = F.array_distinct(F.filter(at, lambda x, i: (i > 0) & x.eqNullSafe(F.get(at, i - 1))))
        found = count.join(packed, parent, "left").select(
            F.col(parent).alias("__k"), F.col("__n"), F.col("__c"), again.alias("__r")
        )
        joined = out.join(found, F.col(key) == F.col("__k"), "left")
        kinds = found.schema
        none = F.col("__n").isNull()
        out = joined.select(
            *out.columns,
            F.when(none, F.array().cast(kinds["__c"].dataType)).otherwise(F.col("__c")).alias(name),
            F.coalesce("__n", F.lit(0)).alias(f"{name}_count"),
            F.when(none, F.array().cast(kinds["__r"].dataType)).otherwise(F.col("__r")).alias(f"{name}_repeated"),
        )
    return out
