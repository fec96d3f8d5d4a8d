"""Registered queries: graphs, governance and table audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorespark.functions import text as tx
from lorespark.operators import chunk_tables as ct
from lorespark.operators import graph as gr
from lorespark.operators import quality as qa
from lorespark.operators import registry as rg
from lorespark.plans import views as v
from lorespark.plans.registry import Tables, query


def part_tree(t: Tables) -> DataFrame:
    """Every part under the part with half its key, as a category tree."""
    return t.part.filter("p_partkey > 0").select(
        F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))


SQL_TREE = "tree AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0)"


def tangled(t: Tables) -> DataFrame:
    """The part tree with self loops, repeats and short cycles added."""
    tree = part_tree(t)
    loops = tree.filter("src % 500 = 0").select("src", F.col("src").alias("dst"))
    again = tree.filter("src % 300 = 0")
    back = tree.filter("src % 400 = 7").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return tree.unionByName(loops).unionByName(again).unionByName(back)


SQL_TANGLED = SQL_TREE + """,
tangled AS (SELECT * FROM tree UNION ALL SELECT src, src FROM tree WHERE src % 500 = 0
  UNION ALL SELECT * FROM tree WHERE src % 300 = 0 UNION ALL SELECT dst, src FROM tree WHERE src % 400 = 7),
reach AS (SELECT DISTINCT src, dst FROM tangled UNION SELECT r.src, e.dst FROM reach r JOIN tangled e ON e.src = r.dst)"""


@query("g1_category_ancestry", f"""
WITH RECURSIVE {SQL_TREE}, up AS (SELECT src, dst, 1 AS depth FROM tree
  UNION ALL SELECT u.src, e.dst, depth + 1 FROM up u JOIN tree e ON e.src = u.dst)
SELECT src, dst, depth::BIGINT AS depth FROM up""")
def g1(t: Tables):
    return gr.closure(part_tree(t)).select("src", "dst", F.col("depth").cast("bigint").alias("depth"))


@query("g2_concept_listing", """
WITH f AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 40
  AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'brand#1'))
  AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45))
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY p_name, p_partkey LIMIT 100""")
def g2(t: Tables):
    tagged = t.lineitem.filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    found = t.part.filter("p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 40")
    found = found.filter(F.contains(F.lower("p_name"), F.lit("red")) | F.contains(F.lower("p_brand"), F.lit("brand#1")))
    found = found.join(tagged, "p_partkey", "left_semi").select("p_partkey", "p_name", "p_brand", "p_type")
    return ct.listing(found, "p_name", "p_partkey", limit=100)


@query("g3_neighbourhood", f"""
WITH {SQL_TREE}, b AS (SELECT src AS node, 'outgoing' AS direction, dst AS other FROM tree
  UNION ALL SELECT dst, 'incoming', src FROM tree)
SELECT node, direction, 'part_of' AS type, other, p_name AS other_title FROM b JOIN part ON p_partkey = other""")
def g3(t: Tables):
    edges = part_tree(t).withColumn("type", F.lit("part_of"))
    return gr.neighbourhood(edges, t.part, "p_partkey", "p_name")


@query("g4_evidence_chain", """
SELECT p_name AS concept, l_orderkey AS claim, l_extendedprice AS strength, s_name AS source
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND l_returnflag <> 'R'
WHERE l_discount >= 0.05 AND l_quantity > 40 AND contains(lower(p_name), 'blue')""")
def g4(t: Tables):
    concepts = t.part.filter(F.contains(F.lower("p_name"), F.lit("blue"))).select(
        F.col("p_partkey").alias("concept"), F.col("p_name").alias("title"))
    # each line is one claim on its part with one piece of evidence
    line = F.struct("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("row"))
    lines = t.lineitem.filter("l_discount >= 0.05 AND l_quantity > 40").select(
        line.alias("claim"), F.col("l_partkey").alias("concept"), F.col("l_extendedprice").alias("strength"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("source"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("name"))
    chain = gr.evidence_chain(concepts, lines.select("claim", "concept"), lines.select("claim", "source", "strength"), sources)
    return chain.select(F.col("title").alias("concept"), F.col("claim.l_orderkey").alias("claim"), "strength", F.col("name").alias("source"))


@query("g4_claims", """
SELECT o_orderkey AS claim, o_custkey AS concept FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_totalprice >= 150000 AND o_orderpriority = '2-HIGH'
  AND c_name || ': ' || o_orderpriority ILIKE '%customer_0%high%'""")
def g4_claims(t: Tables):
    """Orders read as claims on their customer."""
    named = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    claims = named.select(
        F.col("o_orderkey").alias("claim"), F.col("o_custkey").alias("concept"), F.col("o_orderpriority").alias("claim_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("confidence"),
        F.concat("c_name", F.lit(": "), "o_orderpriority").alias("statement"))
    out = gr.matching_claims(claims, claim_type="2-HIGH", status="F", min_confidence=150000.0, q="customer_0%high")
    return out.select("claim", "concept")


@query("g4_evidence", """
SELECT l_orderkey AS claim, l_suppkey AS source, l_returnflag AS evidence_type, l_discount AS strength, o_orderstatus, s_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
WHERE l_returnflag = 'A' AND l_discount = 0.05""")
def g4_evidence(t: Tables):
    """Evidence by type and strength; sources without credit are unknown but keep their evidence."""
    evidence = t.lineitem.select(
        F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("source"),
        F.col("l_returnflag").alias("evidence_type"), F.col("l_discount").alias("strength"))
    claims = t.orders.select(F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("concept"))
    concepts = claims.select("concept").distinct().withColumn("o_orderstatus", F.col("concept"))
    sources = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("source"), "s_name")
    chain = gr.evidence_chain(concepts, claims, gr.matching_evidence(evidence, evidence_type="A", strength=0.05), sources)
    return chain.select("claim", "source", "evidence_type", "strength", "o_orderstatus", "s_name")


@query("g5_conflict_pairs", """
SELECT least(l_partkey, l_suppkey) AS first, greatest(l_partkey, l_suppkey) AS second, count(*)::BIGINT AS reports
FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2""")
def g5(t: Tables):
    return gr.conflict_pairs(t.lineitem, "l_partkey", "l_suppkey")


@query("g6_latest_revision", """
WITH r AS (SELECT o_custkey, year(o_orderdate) * 100 + month(o_orderdate) AS version, count(*) AS n,
  arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL)
SELECT o_custkey, max(version)::BIGINT AS version, arg_max(price, version) AS price,
  count(*) FILTER (n > 1)::BIGINT AS repeated_versions FROM r GROUP BY o_custkey""")
def g6(t: Tables):
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("version"))
    return gr.latest_per_entity(rows, ["o_custkey"], "version", ["price"], "o_orderkey")


@query("g7_reference_audit", """
WITH refs AS (SELECT l_orderkey AS ref, 'Parts' AS kind, l_partkey + 1900 AS id FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'customer', l_suppkey * 20 FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT l_orderkey, 'Widget-Box', l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT CASE kind WHEN 'Parts' THEN 'part' WHEN 'Widget-Box' THEN 'widget_box' ELSE kind END AS entity_type,
  CASE WHEN kind = 'Widget-Box' THEN 'unknown type' ELSE 'missing entity' END AS problem, count(*)::BIGINT AS n FROM refs
WHERE kind = 'Widget-Box' OR (kind = 'Parts' AND id NOT IN (SELECT p_partkey FROM part))
  OR (kind = 'customer' AND id NOT IN (SELECT c_custkey FROM customer)) GROUP BY ALL""")
def g7(t: Tables):
    kind = F.when(F.col("l_returnflag") == "A", "Parts").when(F.col("l_returnflag") == "N", "customer").otherwise("Widget-Box")
    target = F.when(F.col("l_returnflag") == "A", F.col("l_partkey") + 1900).when(
        F.col("l_returnflag") == "N", F.col("l_suppkey") * 20).otherwise(F.col("l_suppkey"))
    refs = t.lineitem.select(F.col("l_orderkey").alias("ref"), kind.alias("entity_type"), target.alias("entity_id"))
    entities = t.part.select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id")).unionByName(
        t.customer.select(F.lit("customer").alias("entity_type"), F.col("c_custkey").alias("entity_id")))
    out = gr.reference_audit(refs, entities, ["part", "customer", "supplier"])
    return out.groupBy("entity_type", "problem").agg(F.count("*").alias("n"))


@query("g8_source_assessments", """
WITH a AS (SELECT l_suppkey, l_discount * 10 AS authority, l_tax * 14 AS accuracy, l_shipdate, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem)
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS assessed, round(authority, 4) AS authority, round(accuracy, 4) AS accuracy,
  authority BETWEEN 0 AND 1 AND accuracy BETWEEN 0 AND 1 AS valid FROM a WHERE rn = 1""")
def g8(t: Tables):
    rows = t.lineitem.select(
        "l_suppkey", "l_shipdate", (F.col("l_discount") * 10).alias("authority"), (F.col("l_tax") * 14).alias("accuracy"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("tie"))
    out = gr.latest_assessments(rows, "l_suppkey", ["authority", "accuracy"], "l_shipdate", "tie")
    return out.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("assessed"),
                      F.round("authority", 4).alias("authority"), F.round("accuracy", 4).alias("accuracy"), "valid")


@query("g9_outline", """
WITH o AS (SELECT 0 AS level, r_regionkey::BIGINT AS id, NULL::BIGINT AS parent, r_name AS title FROM region
  UNION ALL SELECT 1, n_nationkey, n_regionkey, n_name FROM nation UNION ALL SELECT 2, c_custkey, c_nationkey, c_name FROM customer
  UNION ALL SELECT 3, o_orderkey, o_custkey, o_orderstatus FROM orders)
SELECT level::BIGINT AS level, id, parent, title, row_number() OVER (PARTITION BY level, parent ORDER BY id)::BIGINT - 1 AS position,
  count(*) OVER (PARTITION BY level, parent)::BIGINT AS siblings FROM o""")
def g9(t: Tables):
    out = gr.outline([
        (t.region, "r_regionkey", None, "r_name"), (t.nation, "n_nationkey", "n_regionkey", "n_name"),
        (t.customer, "c_custkey", "c_nationkey", "c_name"), (t.orders, "o_orderkey", "o_custkey", "o_orderstatus")])
    return out.select("id", "parent", "title", *[F.col(c).cast("bigint").alias(c) for c in ("level", "position", "siblings")])


@query("g9_repeated_positions", """
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def g9_positions(t: Tables):
    return gr.repeated_positions(t.lineitem, "l_orderkey", "l_linenumber")


@query("g10_alias_resolution", f"""
WITH a AS (SELECT {v.sql_casefold(v.sql_collapse('p_name'))} AS k, p_partkey AS alias_id, p_brand AS concept, p_size > 40 AS preferred FROM part),
b AS (SELECT k, arg_min(concept, (NOT preferred, alias_id)) AS concept FROM a GROUP BY k)
SELECT p_partkey, b.concept FROM part LEFT JOIN b ON b.k = {v.sql_casefold(v.sql_collapse("CASE WHEN p_partkey % 3 = 0 THEN p_name || ' x' ELSE upper(p_name) || '  ' END"))}""")
def g10(t: Tables):
    aliases = t.part.select(
        tx.normalize_alias(F.col("p_name")).alias("k"), F.col("p_partkey").alias("alias_id"),
        F.col("p_brand").alias("concept"), (F.col("p_size") > 40).alias("preferred"))
    asked = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" x"))).otherwise(
        F.concat(F.upper("p_name"), F.lit("  ")))
    phrases = t.part.select("p_partkey", tx.normalize_alias(asked).alias("k"))
    return gr.resolve_aliases(phrases, aliases, "k").select("p_partkey", "concept")


@query("h6_supersedes_chains", """
WITH s AS (SELECT o_orderkey AS node, lead(o_orderkey) OVER w AS nxt,
    last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head,
    count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w AS hops
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT node, head, hops::BIGINT AS hops FROM s WHERE nxt IS NOT NULL""")
def h6(t: Tables):
    from lorespark.functions.ordered import with_neighbour

    links = with_neighbour(
        t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"],
        F.date_trunc("month", "o_orderdate"), {"next": "o_orderkey"}, forward=True)
    links = links.filter("next IS NOT NULL").select(F.col("o_orderkey").alias("node"), "next")
    return gr.chain_heads(links)


@query("h6_relation_listing", """
WITH e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst, o_orderstatus AS type FROM orders WHERE o_orderkey <> o_custkey)
SELECT node, direction, type, other FROM (SELECT src AS node, 'outgoing' AS direction, type, dst AS other FROM e
  UNION ALL SELECT dst, 'incoming', type, src FROM e)""")
def h6_relations(t: Tables):
    edges = t.orders.filter("o_orderkey <> o_custkey").select(
        F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_orderstatus").alias("type")).distinct()
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    out = gr.neighbourhood(edges, ids.withColumn("title", F.lit("")), "id", "title")
    return out.select("node", "direction", "type", "other")


@query("j13_prerequisite_problems", f"""
WITH RECURSIVE {SQL_TANGLED}, g AS (SELECT src, dst, count(*) AS copies FROM tangled GROUP BY ALL)
SELECT src, dst, copies::BIGINT AS copies, CASE WHEN src = dst THEN 'self loop'
  WHEN (dst, src) IN (SELECT (src, dst) FROM reach) THEN 'cycle' WHEN copies > 1 THEN 'duplicate' END AS problem FROM g
WHERE src = dst OR copies > 1 OR (dst, src) IN (SELECT (src, dst) FROM reach)""")
def j13(t: Tables):
    edges = tangled(t)
    return gr.edge_problems(edges, gr.strong_components(edges))


@query("j13_cyclic_nodes", f"""
WITH RECURSIVE {SQL_TANGLED} SELECT DISTINCT src AS node FROM reach WHERE src = dst""")
def j13_cycles(t: Tables):
    edges = tangled(t)
    return gr.on_cycles(gr.strong_components(edges), edges)


# --- audits -----------------------------------------------------------------------


@query("k1_repeated_keys", """
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def k1(t: Tables):
    return qa.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("k1_repeated_names", """
SELECT lower(p_name) AS p_name, lower(p_brand) AS p_brand, count(*)::BIGINT AS copies FROM part GROUP BY ALL HAVING count(*) > 1""")
def k1_names(t: Tables):
    names = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), "p_brand")
    return qa.repeated_keys(names, ["p_name", "p_brand"], ignore_case=True)


@query("k2_row_checks", """
SELECT l_orderkey, l_partkey, l_linenumber, array_to_string(list_filter([
  CASE WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'discount out of range' END,
  CASE WHEN NOT l_quantity <= 45 THEN 'quantity too large' END,
  CASE WHEN NOT l_extendedprice >= l_quantity * 100 THEN 'price below minimum' END], lambda x: x IS NOT NULL), '; ') AS problems
FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.08 OR NOT l_quantity <= 45 OR NOT l_extendedprice >= l_quantity * 100""")
def k2(t: Tables):
    out = qa.row_checks(t.lineitem, ["l_orderkey", "l_partkey", "l_linenumber"], {
        "discount out of range": F.col("l_discount").between(0, 0.08),
        "quantity too large": F.col("l_quantity") <= 45,
        "price below minimum": F.col("l_extendedprice") >= F.col("l_quantity") * 100})
    return out.withColumn("problems", F.array_join("problems", "; "))


@query("k3_enum_domain", """
SELECT o_orderpriority AS value, count(*)::BIGINT AS n FROM orders
WHERE o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority < '4') GROUP BY 1""")
def k3(t: Tables):
    allowed = t.orders.filter("o_orderkey % 2 = 0 AND o_orderpriority < '4'").select(
        F.col("o_orderpriority").alias("value")).distinct()
    return qa.outside_domain(t.orders, "o_orderpriority", allowed)


@query("k4_several_true", """
SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS n FROM orders GROUP BY 1
HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 1""")
def k4(t: Tables):
    return qa.several_true(t.orders, "o_custkey", F.col("o_orderpriority") == "1-URGENT")


@query("k5_orphans", """
SELECT l_orderkey AS missing_key, count(*)::BIGINT AS "rows", 'delete rows' AS action FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def k5(t: Tables):
    return qa.orphans(t.lineitem, t.orders.filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey", "cascade")


@query("k6_cascade", """
WITH c AS (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2)
SELECT 'region' AS "table", r_regionkey::BIGINT AS id FROM region WHERE r_regionkey = 2
UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'customer', c_custkey FROM c UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)""")
def k6(t: Tables):
    return qa.cascade([
        ("region", t.region, "r_regionkey", None), ("nation", t.nation, "n_nationkey", "n_regionkey"),
        ("customer", t.customer, "c_custkey", "c_nationkey"), ("orders", t.orders, "o_orderkey", "o_custkey"),
    ], t.region.filter("r_regionkey = 2").select("r_regionkey"))


def _edited(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 100 == 1, "invalidated").when(k % 100 == 2, "failed").otherwise("succeeded")
    return t.orders.filter(k % 100 != 3).select(
        "o_orderkey", "o_custkey", status.alias("status"),
        F.when(k % 100 == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))


def _snapshot(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded")
    return t.orders.select("o_orderkey", "o_custkey", status.alias("status"), "o_totalprice")


@query("k7_snapshot_changes", """
SELECT o_orderkey, CASE o_orderkey % 100 WHEN 3 THEN 'row disappeared' WHEN 4 THEN 'frozen column changed' ELSE 'status changed' END AS problem
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 100 IN (2, 3, 4)""")
def k7(t: Tables):
    return qa.snapshot_changes(_snapshot(t), _edited(t), "o_orderkey", ["o_custkey", "o_totalprice"], "status")


@query("k7_append_only", """
SELECT o_orderkey, CASE o_orderkey % 100 WHEN 3 THEN 'row disappeared' ELSE 'row changed' END AS problem FROM orders WHERE o_orderkey % 100 IN (3, 4)""")
def k7_history(t: Tables):
    return qa.append_only(_snapshot(t), _edited(t), "o_orderkey", ["o_custkey", "o_totalprice"])


@query("k0_scope_and_redaction", """
SELECT o_orderkey, o_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN o_totalprice END AS o_totalprice
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def k0(t: Tables):
    scope = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    people = qa.scoped(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), scope, "c_nationkey")
    rows = t.orders.select("o_orderkey", F.col("o_custkey"), "o_totalprice").join(
        people.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    out = qa.redacted(rows, F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], ["o_totalprice"])
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query("g9_nested_articles", """
WITH sc AS (SELECT l_orderkey, to_json(list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}
    ORDER BY l_linenumber, l_partkey, l_suppkey))::VARCHAR AS sections, count(*) AS n FROM lineitem GROUP BY ALL),
sr AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS again FROM
    (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
fq AS (SELECT l_orderkey, to_json(list({'l_linenumber': l_linenumber, 'l_returnflag': l_returnflag, 'l_partkey': l_partkey}
    ORDER BY l_linenumber, l_returnflag, l_partkey))::VARCHAR AS faqs FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT o_orderkey, o_orderpriority, coalesce(sections, '[]') AS sections, coalesce(n, 0)::BIGINT AS sections_count,
  coalesce(array_to_string(again, ','), '') AS sections_repeated, coalesce(faqs, '[]') AS faqs
FROM orders LEFT JOIN sc ON sc.l_orderkey = o_orderkey LEFT JOIN sr ON sr.l_orderkey = o_orderkey LEFT JOIN fq ON fq.l_orderkey = o_orderkey""")
def g9_articles(t: Tables):
    """Orders as articles: their lines are sections, returned and accepted lines also questions."""
    out = gr.nested(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", {
        "sections": (t.lineitem, "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"]),
        "faqs": (t.lineitem.filter("l_returnflag <> 'N'"), "l_orderkey", "l_linenumber", ["l_returnflag", "l_partkey"])})
    return out.select("o_orderkey", "o_orderpriority", F.to_json("sections").alias("sections"), "sections_count",
                      F.array_join("sections_repeated", ",").alias("sections_repeated"), F.to_json("faqs").alias("faqs"))


@query("g9_nested_courses", """
WITH le AS (SELECT l_orderkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey} ORDER BY l_linenumber, l_partkey) AS lessons
  FROM lineitem GROUP BY ALL),
mo AS (SELECT o_custkey, to_json(list({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'lessons': coalesce(lessons, [])}
    ORDER BY o_orderkey))::VARCHAR AS modules, count(*) AS n FROM orders LEFT JOIN le ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c_custkey, c_name, coalesce(modules, '[]') AS modules, coalesce(n, 0)::BIGINT AS modules_count FROM customer LEFT JOIN mo ON o_custkey = c_custkey""")
def g9_courses(t: Tables):
    """Customers as courses, their orders as modules, the lines of these as lessons."""
    modules = gr.nested(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_orderkey",
                        {"lessons": (t.lineitem, "l_orderkey", "l_linenumber", ["l_partkey"])})
    out = gr.nested(t.customer.select("c_custkey", "c_name"), "c_custkey",
                    {"modules": (modules, "o_custkey", "o_orderkey", ["o_orderpriority", "lessons"])})
    return out.select("c_custkey", "c_name", F.to_json("modules").alias("modules"), "modules_count")
