"""Registered queries: execution histories and registries."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lorespark.functions import hashing, rules
from lorespark.operators import chunk_tables as ct
from lorespark.operators import history as hi
from lorespark.operators import registry as rg
from lorespark.plans import views as v
from lorespark.plans.catalog_sections import SQL_PARAGRAPHS, paragraphs
from lorespark.plans.registry import Tables, query
from lorespark.sources import corpus

_LEGAL = ", ".join(f"'{a}>{b}'" for a, bs in rules.JOB_TRANSITIONS.items() for b in bs)
_AS_OF = "2024-01-20 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


def _text(ts: str) -> F.Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _sql_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def parse_runs(t: Tables) -> DataFrame:
    """Each event as one finished or failed execution of its user's object."""
    status = F.when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "signup", "invalidated").otherwise("succeeded")
    return t.events.select(
        F.col("user_id").alias("parent"), F.col("event_id").alias("run_id"), F.col("ts").alias("completed_at"),
        status.alias("status"), F.sha2("props", 256).alias("content_hash"))


SQL_RUNS = """
runs AS (SELECT user_id AS parent, event_id AS run_id, ts AS completed_at, sha256(props) AS content_hash,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'invalidated' ELSE 'succeeded' END AS status FROM events)"""


@query("d15_current_result", f"""
WITH {SQL_RUNS} SELECT parent, {_sql_text('completed_at')} AS completed_at, run_id, content_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY parent ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs WHERE status = 'succeeded')
WHERE rn = 1""")
def d15(t: Tables):
    out = ct.current_results(parse_runs(t), "parent", "completed_at", "run_id", "content_hash")
    return out.withColumn("completed_at", _text("completed_at"))


@query("i1_transition_legality", f"""
WITH {v.SQL_JOBS}, p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id), 'new') AS previous_status FROM job_events)
SELECT job_id, event_id, previous_status, status, previous_status || '>' || status IN ({_LEGAL}) AS legal FROM p""")
def i1(t: Tables):
    return hi.transitions(v.job_events(t)).select("job_id", "event_id", "previous_status", "status", "legal")


@query("i2_current_states", f"""
WITH {v.SQL_JOBS}, a AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS since, count(*) AS events,
  max((ts, event_id)) FILTER (status = 'failed') AS f, max((ts, event_id)) FILTER (status = 'running') AS s,
  arg_max(props, (ts, event_id)) FILTER (status = 'failed') AS e FROM job_events GROUP BY job_id)
SELECT job_id, status, CASE WHEN status IN ('succeeded', 'failed', 'cancelled') THEN {_sql_text('since')} END AS completed_at,
  CASE WHEN f IS NOT NULL AND (s IS NULL OR f > s) THEN e END AS last_error, events::BIGINT AS events FROM a""")
def i2(t: Tables):
    out = hi.current_states(v.job_events(t), "props")
    return out.select("job_id", "status", _text("completed_at").alias("completed_at"), "last_error", "events")


@query("i3_attempts", f"""
WITH {v.SQL_JOBS}, m AS (SELECT *, lead(status) OVER w AS ns, lead(ts) OVER w AS nt FROM job_events
  WHERE status IN ('running', 'succeeded', 'failed', 'cancelled') WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id)::BIGINT AS attempt_number, {_sql_text('ts')} AS started_at,
  CASE WHEN ns = 'succeeded' THEN 'succeeded' WHEN ns IN ('failed', 'cancelled') THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN ns <> 'running' THEN greatest(0, (epoch_us(nt) - epoch_us(ts)) // 1000)::BIGINT END AS duration_ms FROM m WHERE status = 'running'""")
def i3(t: Tables):
    out = hi.attempts(v.job_events(t))
    return out.select("job_id", F.col("attempt_number").cast("bigint").alias("attempt_number"),
                      _text("started_at").alias("started_at"), "status",
                      F.col("duration_ms").cast("bigint").alias("duration_ms"))


@query("i4_retry_budget", f"""
WITH {v.SQL_JOBS} SELECT job_id, count(*) FILTER (status = 'retrying')::BIGINT AS retries_used,
  greatest(0, 3 - count(*) FILTER (status = 'retrying'))::BIGINT AS retries_left,
  count(*) FILTER (status = 'retrying') > 3 AS over_limit FROM job_events GROUP BY job_id""")
def i4(t: Tables):
    return hi.retry_budget(v.job_events(t))


@query("i5_expired_leases", f"""
WITH {v.SQL_JOBS}, j AS (SELECT job_id, arg_max(status, (ts, event_id)) AS previous,
    max((ts, event_id)) FILTER (status = 'reserved') AS r, max(ts) FILTER (status = 'reserved') AS rts,
    max((ts, event_id)) FILTER (status IN ('queued', 'succeeded', 'failed', 'cancelled')) AS fin
  FROM job_events WHERE ts <= TIMESTAMP '{_AS_OF}' GROUP BY job_id)
SELECT job_id, previous, CASE previous WHEN 'reserved' THEN 'queued' WHEN 'running' THEN 'failed' ELSE previous END AS "new",
  CASE previous WHEN 'running' THEN 'failed' ELSE 'released' END AS event_type,
  {_sql_text("rts + INTERVAL 300 SECOND")} AS expired_at
FROM j WHERE r IS NOT NULL AND (fin IS NULL OR r > fin) AND rts + INTERVAL 300 SECOND <= TIMESTAMP '{_AS_OF}'""")
def i5(t: Tables):
    out = hi.expire_leases(v.job_events(t), _as_of())
    return out.withColumn("expired_at", _text("expired_at"))


@query("i6_one_active_job", f"""
WITH {v.SQL_JOBS}, a AS (SELECT job_id AS document, event_id AS job, ts FROM job_events WHERE status NOT IN ('succeeded', 'cancelled'))
SELECT document, job, first_value(job) OVER (PARTITION BY document ORDER BY ts, job) AS returned_job,
  job = first_value(job) OVER (PARTITION BY document ORDER BY ts, job) AS created FROM a""")
def i6(t: Tables):
    jobs = v.job_events(t).select(F.col("job_id").alias("document"), F.col("event_id").alias("job"), "ts", "status")
    return hi.one_active_job(jobs, "document", "job", "ts")


@query("i7_job_search", f"""
WITH {v.SQL_JOBS}, j AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS events FROM job_events GROUP BY job_id),
f AS (SELECT job_id, status, events::BIGINT AS events, c_name FROM j JOIN customer ON c_custkey = job_id
  WHERE (contains(lower(c_name), '0001') OR contains(job_id::VARCHAR, '0001')) AND status <> 'queued')
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY events DESC, job_id DESC LIMIT 20""")
def i7(t: Tables):
    jobs = hi.current_states(v.job_events(t), "props").select("job_id", "status", "events")
    named = jobs.join(t.customer.select(F.col("c_custkey").alias("job_id"), "c_name"), "job_id")
    found = named.filter(rg.matches_any(["c_name", "job_id"], "0001") & (F.col("status") != "queued"))
    return ct.listing(found, "events", "job_id", descending=True, limit=20)


@query("i8_node_registry", f"""
WITH b AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'Node-' ELSE 'NODE-' END || user_id % 20 AS name, ts, event_id, value FROM events)
SELECT lower(name) AS node_key, arg_max(name, (ts, event_id)) AS name, {_sql_text('max(ts)')} AS ts,
  arg_max(value, (ts, event_id)) AS value, count(*)::BIGINT AS beats FROM b GROUP BY 1""")
def i8(t: Tables):
    prefix = F.when(F.col("event_id") % 2 == 0, "Node-").otherwise("NODE-")
    beats = t.events.select(F.concat(prefix, (F.col("user_id") % 20).cast("string")).alias("name"), "ts", "event_id", "value")
    return hi.latest_heartbeats(beats, "name", "ts", "event_id", "value").withColumn("ts", _text("ts"))


_UPLOAD_STATES = {"signup": "created", "view": "receiving", "click": "validating", "purchase": "completed", "error": "failed"}


@query("i9_upload_outcomes", f"""
WITH u AS (SELECT user_id * 100 + day(ts) AS session, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'receiving' WHEN 'click' THEN 'validating'
      WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events),
p AS (SELECT session, min(ts) AS created_at, arg_min(state, (ts, event_id)) FILTER (state IN ('completed', 'failed')) AS fin,
  min(ts) FILTER (state IN ('completed', 'failed')) AS done, arg_max(state, (ts, event_id)) AS lst FROM u GROUP BY session)
SELECT session, {_sql_text('created_at')} AS created_at, CASE WHEN fin IS NOT NULL AND done <= created_at + INTERVAL 3600 SECOND THEN fin
  WHEN created_at + INTERVAL 3600 SECOND <= TIMESTAMP '{_AS_OF}' THEN 'expired' ELSE lst END AS outcome FROM p""")
def i9(t: Tables):
    table = F.create_map(*[F.lit(x) for p in _UPLOAD_STATES.items() for x in p])
    events = t.events.select((F.col("user_id") * 100 + F.day("ts")).alias("session"), "ts", "event_id",
                             table[F.col("event_type")].alias("state"))
    return hi.upload_outcomes(events, _as_of()).withColumn("created_at", _text("created_at"))


# --- registries ------------------------------------------------------------------


@query("h1_source_search", """
WITH f AS (SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey
  WHERE (contains(lower(s_name), '00') OR contains(lower(n_name), '00')) AND s_acctbal >= 0 AND n_regionkey IN (1, 2, 3))
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 30""")
def h1(t: Tables):
    rows = t.supplier.join(t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    found = rows.filter(rg.matches_any(["s_name", "n_name"], "00") & (F.col("s_acctbal") >= 0)
                        & F.col("n_regionkey").isin(1, 2, 3))
    found = found.select("s_suppkey", "s_name", "n_name", "s_acctbal")
    return ct.listing(found, "s_acctbal", "s_suppkey", descending=True, limit=30)


@query("h1_source_search_by_organization", """
SELECT s_suppkey, s_name, s_nationkey::BIGINT AS organization FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
  WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3)""")
def h1_org(t: Tables):
    rows = t.supplier.join(t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    wanted = t.nation.filter("n_nationkey = 3").select(F.lower("n_name").alias("k"))
    by_name = rows.join(wanted, F.lower("n_name") == F.col("k"), "left_semi")
    by_id = rows.filter(rg.identity_is("s_nationkey", ["n_name"], "7"))
    cols = ["s_suppkey", "s_name", F.col("s_nationkey").cast("bigint").alias("organization")]
    return by_id.select(*cols).unionByName(by_name.select(*cols))


@query("h2_document_search", """
WITH f AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'Own ' || o_orderkey END, c_name) AS author,
    o_totalprice, year(o_orderdate)::BIGINT AS publication_year FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE year(o_orderdate) = 1997 AND o_orderstatus = 'F')
SELECT *, (SELECT count(*) FROM f WHERE contains(lower(author), '1'))::BIGINT AS total FROM f WHERE contains(lower(author), '1')
ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 10""")
def h2(t: Tables):
    own = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Own "), F.col("o_orderkey").cast("string")))
    rows = t.orders.filter("year(o_orderdate) = 1997 AND o_orderstatus = 'F'").join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    rows = rows.select("o_orderkey", F.coalesce(own, F.col("c_name")).alias("author"), "o_totalprice",
                       F.year("o_orderdate").cast("bigint").alias("publication_year"))
    return ct.listing(rows.filter(rg.matches_any(["author"], "1")), "o_totalprice", "o_orderkey", offset=10, limit=50)


def _source_rows(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    return rows.select("s_suppkey", "s_name", "s_nationkey", "n_name", "s_acctbal", (F.col("s_acctbal") > 0).alias("active"))


@query("h1_source_search_by_alias", """
SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE contains(lower(s_name), '#2 small ring') OR contains(lower(n_name), '#2 small ring') OR EXISTS (
  SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND contains(lower(p_brand || ' ' || p_name), '#2 small ring'))""")
def h1_alias(t: Tables):
    """Names of delivered parts serve as aliases of a source."""
    delivered = t.lineitem.filter("l_quantity = 50").join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    aliases = delivered.select(F.col("l_suppkey").alias("s_suppkey"), F.concat_ws(" ", "p_brand", "p_name").alias("alias"))
    out = rg.search_registry(_source_rows(t), "s_suppkey", q=" #2 SMALL ring ", columns=["s_name", "n_name"], related=[(aliases, ["alias"])])
    return out.select("s_suppkey", "s_name")


@query("h1_source_search_by_tag", """
SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND lower(p_type) = 'economy' AND p_size = 11)""")
def h1_tag(t: Tables):
    """Kinds of delivered parts serve as tags; only active sources."""
    delivered = t.lineitem.filter("l_quantity = 50").join(t.part, F.col("p_partkey") == F.col("l_partkey")).filter("p_size = 11")
    tags = delivered.select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_size").alias("tag"), F.col("p_type").alias("slug"), F.col("p_brand").alias("name"))
    out = rg.search_registry(_source_rows(t), "s_suppkey", equals={"active": True}, tag=" Economy ", tags=tags)
    return out.select("s_suppkey", "s_name")


@query("h2_document_search_by_identifier", """
SELECT o_orderkey, c_name AS author FROM orders JOIN customer ON c_custkey = o_custkey
WHERE lower(o_orderstatus) = 'f' AND year(o_orderdate) = 1997 AND contains(lower(c_name), '1')
  AND (contains(lower(o_orderpriority), 'brand#17') OR EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_orderkey = o_orderkey AND (contains(lower(p_brand), 'brand#17') OR contains(lower(p_name), 'brand#17'))))""")
def h2_identifier(t: Tables):
    """Brand and name of the parts of an order serve as its identifiers."""
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author")), "o_custkey")
    rows = rows.withColumn("publication_year", F.year("o_orderdate"))
    parts = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    identifiers = parts.select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("identifier_type"), F.col("p_name").alias("identifier_value"))
    out = rg.search_registry(
        rows, "o_orderkey", q="Brand#17", columns=["o_orderpriority"], related=[(identifiers, ["identifier_type", "identifier_value"])],
        contains=[(["author"], "1")], equals={"o_orderstatus": "f", "publication_year": 1997})
    return out.select("o_orderkey", "author")


def versions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), "o_orderdate",
        (F.col("o_orderpriority") != "5-LOW").alias("make_current"))


SQL_VERSIONS = """
ver AS (SELECT o_custkey AS document, o_orderkey AS version, o_orderdate, o_orderpriority <> '5-LOW' AS make_current FROM orders),
cur AS (SELECT document, coalesce(arg_max(version, (o_orderdate, version)) FILTER (make_current), arg_min(version, (o_orderdate, version))) AS current_version,
  count(*) AS versions FROM ver GROUP BY document)"""


@query("h3_current_versions", f"""
WITH {SQL_VERSIONS} SELECT document, current_version, versions::BIGINT AS versions FROM cur""")
def h3(t: Tables):
    return rg.current_versions(versions(t), "document", "version", ["o_orderdate", "version"], "make_current")


@query("h3_version_flags", f"""
WITH {SQL_VERSIONS} SELECT v.document, version, version = current_version AS is_current FROM ver v JOIN cur c ON c.document = v.document""")
def h3_flags(t: Tables):
    out = rg.with_current_flag(versions(t), "document", "version", ["o_orderdate", "version"], "make_current")
    return out.select("document", "version", "is_current")


@query("h4_ingestion_eligibility", f"""
WITH {SQL_VERSIONS},
fl AS (SELECT DISTINCT l_orderkey AS version FROM lineitem WHERE l_returnflag = 'A'),
pd AS (SELECT document, CASE WHEN o.o_orderstatus = 'P' THEN '' ELSE 'x' END AS checksum, fl.version IS NOT NULL AS has_file
  FROM cur JOIN orders o ON o.o_orderkey = current_version LEFT JOIN fl ON fl.version = current_version)
SELECT c_custkey AS document, array_to_string(list_filter([
  CASE WHEN NOT (n_regionkey <> 0) OR n_nationkey % 6 = 1 THEN 'source is not active' END,
  CASE WHEN n_nationkey % 4 = 0 THEN 'source license does not allow ingestion' END,
  CASE WHEN NOT c_acctbal > 0 THEN 'document is not active' END,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'document is archived' END,
  CASE WHEN pd.document IS NULL THEN 'current version does not exist' END,
  CASE WHEN checksum = '' THEN 'current version checksum does not exist' END,
  CASE WHEN NOT has_file THEN 'current version has no file metadata' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN pd ON pd.document = c_custkey""")
def h4(t: Tables):
    documents = t.customer.select(
        F.col("c_custkey").alias("document"), F.col("c_nationkey").alias("source"),
        (F.col("c_acctbal") > 0).alias("active"), (F.col("c_mktsegment") == "MACHINERY").alias("archived"))
    sources = t.nation.select(
        F.col("n_nationkey").alias("source"), (F.col("n_regionkey") != 0).alias("source_active"),
        (F.col("n_nationkey") % 6 == 1).alias("source_archived"), (F.col("n_nationkey") % 4 != 0).alias("allows_ingestion"))
    flagged = rg.with_current_flag(versions(t), "document", "version", ["o_orderdate", "version"], "make_current")
    checks = t.orders.select(F.col("o_orderkey").alias("version"),
                             F.when(F.col("o_orderstatus") == "P", "").otherwise("x").alias("checksum"))
    files = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("version"))
    out = rg.eligibility(documents, sources, flagged.join(checks, "version"), files, "document", "source", "version")
    return out.select("document", F.array_join("reasons", "; ").alias("reasons"))


@query("h5_readiness", """
SELECT doc_id, text_usable, labelled, quality_ok, array_to_string(list_filter([
    CASE WHEN NOT text_usable THEN 'text is too short' END,
    CASE WHEN NOT labelled OR NOT quality_ok THEN 'no parse result' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM (SELECT d.doc_id, length(text) >= 200 AS text_usable, l.doc_id IS NOT NULL AS labelled, coalesce(quality = 1, false) AS quality_ok
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def h5(t: Tables):
    rows = t.documents.select("doc_id", "text").join(
        t.labels.select("doc_id", "quality", F.lit(True).alias("has")), "doc_id", "left")
    out = rg.readiness(rows, "doc_id", [
        ("text_usable", F.length("text") >= 200, "text is too short"),
        ("labelled", F.col("has"), "no parse result"),
        ("quality_ok", F.col("quality") == 1, "no parse result")])
    return out.select("doc_id", "text_usable", "labelled", "quality_ok", F.array_join("reasons", "; ").alias("reasons"))


@query("h7_inventory_check", """
WITH e AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || 'x' ELSE text END) AS s,
    strlen(CASE WHEN doc_id % 10 = 3 THEN text || 'x' ELSE text END) AS b FROM documents WHERE doc_id % 10 <> 1),
a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 5 THEN replace(text, 'e', 'E') ELSE text END) AS s,
  strlen(CASE WHEN doc_id % 10 = 5 THEN replace(text, 'e', 'E') ELSE text END) AS b FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(e.doc_id, a.doc_id) AS doc_id, CASE WHEN a.b IS NULL THEN 'object missing' WHEN e.b IS NULL THEN 'not registered'
  WHEN a.b > 100000 THEN 'over the size limit' WHEN a.b <> e.b THEN 'size differs' WHEN a.s <> e.s THEN 'hash differs' ELSE 'ok' END AS finding
FROM e FULL JOIN a ON a.doc_id = e.doc_id""")
def h7(t: Tables):
    k = F.col("doc_id") % 10
    kept = t.documents.select("doc_id", F.when(k == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    stored = t.documents.select("doc_id", F.when(k == 5, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text")).alias("text"))
    expected = corpus.fingerprints(kept.filter(k != 1), "doc_id", "text")
    actual = corpus.fingerprints(stored.filter(k != 2), "doc_id", "text")
    return rg.verify_inventory(expected, actual, "doc_id", 100_000)


@query("h8_determinism", f"""
SELECT doc_id, {v.sql_clean('text')} = text AS same FROM documents""")
def h8(t: Tables):
    """Two runs of one parser identity: raw text against cleaned text."""
    from lorespark.functions import text as tx

    first = t.documents.select("doc_id", hashing.sha256_json(text=F.col("text")).alias("digest"))
    second = t.documents.select("doc_id", hashing.sha256_json(text=tx.clean_text(F.col("text"))).alias("digest"))
    return rg.determinism(first, second, ["doc_id"], "digest")


@query("h9_run_listing", f"""
WITH {SQL_RUNS}, f AS (SELECT run_id, parent, status, {_sql_text('completed_at')} AS completed_at FROM runs WHERE status = 'succeeded'
  AND completed_at >= TIMESTAMP '2024-01-05' AND completed_at < TIMESTAMP '2024-01-25')
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY completed_at DESC, run_id DESC LIMIT 200 OFFSET 100""")
def h9(t: Tables):
    runs = parse_runs(t).filter(
        "status = 'succeeded' AND completed_at >= TIMESTAMP_NTZ '2024-01-05' AND completed_at < TIMESTAMP_NTZ '2024-01-25'")
    out = ct.listing(runs.select("run_id", "parent", "status", "completed_at"), "completed_at", "run_id",
                     descending=True, offset=100, limit=200)
    return out.withColumn("completed_at", _text("completed_at"))


#: the second parser version spells a word otherwise and leaves out single signs
_SQL_TREES = f"""
{SQL_PARAGRAPHS},
runs2 AS MATERIALIZED (SELECT 'old' AS run, doc_id, section, paragraph, text FROM paragraphs
  UNION ALL SELECT 'new', doc_id, section, paragraph, replace(text, 'license', 'licence') FROM paragraphs WHERE length(text) > 3),
bl AS (SELECT run, doc_id, section, paragraph, sha256('{{"position":' || paragraph || ',"text":' || to_json(text)::VARCHAR || '}}') AS h FROM runs2),
s1 AS (SELECT run, doc_id, section, paragraph // 1024 AS st, sha256(string_agg(h, '' ORDER BY paragraph)) AS h FROM bl GROUP BY ALL),
se AS (SELECT run, doc_id, section, sha256(string_agg(h, '' ORDER BY st)) AS h FROM s1 GROUP BY ALL),
d1 AS (SELECT run, doc_id, section // 1024 AS st, sha256(string_agg(h, '' ORDER BY section)) AS h FROM se GROUP BY ALL),
dc AS (SELECT run, doc_id, sha256(string_agg(h, '' ORDER BY st)) AS h FROM d1 GROUP BY ALL)"""


def _trees(t: Tables, staged: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    rows = paragraphs(t).select("doc_id", "section", "paragraph", "text")
    again = rows.filter(F.length("text") > 3).withColumn("text", F.replace("text", F.lit("license"), F.lit("licence")))
    return tuple(rg.hash_tree(x, "doc_id", "section", "paragraph", ["text"], staged=staged) for x in (rows, again))


def _sql_parts(table: str, keys: str, level: str, columns: str, inside: str) -> str:
    return f"""SELECT doc_id, '{level}' AS level, {columns}, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'added' ELSE 'changed' END AS finding
FROM (SELECT * FROM {table} WHERE run = 'old') a FULL JOIN (SELECT * FROM {table} WHERE run = 'new') b USING ({keys})
WHERE a.h IS DISTINCT FROM b.h {inside}"""


_IN_BOTH = "SELECT DISTINCT {k} FROM {t} WHERE run = 'old' INTERSECT SELECT {k} FROM {t} WHERE run = 'new'"


@query("h8_changed_parts", f"""
WITH {_SQL_TREES}
{_sql_parts('dc', 'doc_id', 'document', 'NULL::BIGINT AS section, NULL::BIGINT AS paragraph', '')}
UNION ALL {_sql_parts('se', 'doc_id, section', 'section', 'section::BIGINT, NULL::BIGINT',
                      "AND doc_id IN (" + _IN_BOTH.format(k='doc_id', t='dc') + ")")}
UNION ALL {_sql_parts('bl', 'doc_id, section, paragraph', 'block', 'section::BIGINT, paragraph::BIGINT',
                      "AND (doc_id, section) IN (" + _IN_BOTH.format(k='(doc_id, section)', t='se') + ")")}""")
def h8_parts(t: Tables):
    old, new = _trees(t, staged=True)
    return rg.changed_parts(old, new, "doc_id", "section", "paragraph")


@query("h8_completed_runs", f"""
WITH {_SQL_TREES},
r AS (SELECT d.doc_id, CASE lang WHEN 'en' THEN 'succeeded' WHEN 'fr' THEN 'parsing' WHEN 'de' THEN 'succeeded' ELSE 'failed' END AS status,
    CASE WHEN lang = 'de' THEN '1' ELSE '2' END AS version, o.h AS old, n.h AS new FROM documents d
  LEFT JOIN (SELECT * FROM dc WHERE run = 'old') o ON o.doc_id = d.doc_id LEFT JOIN (SELECT * FROM dc WHERE run = 'new') n ON n.doc_id = d.doc_id)
SELECT doc_id, array_to_string(list_filter([
    CASE WHEN status = 'failed' THEN 'run is not being parsed' END, CASE WHEN new IS NULL THEN 'no output' END,
    CASE WHEN new IS NOT NULL AND version <> '2' THEN 'output of another parser' END,
    CASE WHEN status = 'succeeded' AND new IS NOT NULL AND old IS DISTINCT FROM new THEN 'output differs from the stored result' END],
  lambda x: x IS NOT NULL), '; ') AS reasons,
  status <> 'failed' AND new IS NOT NULL AND version = '2' AND (status <> 'succeeded' OR old IS NOT DISTINCT FROM new) AS accepted FROM r""")
def h8_runs(t: Tables):
    old, new = _trees(t)
    status = F.when(F.col("lang").isin("en", "de"), "succeeded").when(F.col("lang") == "fr", "parsing").otherwise("failed")
    version = F.when(F.col("lang") == "de", "1").otherwise("2")
    runs = t.documents.select("doc_id", status.alias("status"), F.lit("text").alias("parser_name"), version.alias("parser_version"))
    runs = runs.join(old["document"].withColumnRenamed("sha256", "content_hash"), "doc_id", "left")
    outputs = new["document"].select("doc_id", F.lit("text").alias("parser_name"), F.lit("2").alias("parser_version"),
                                     F.col("sha256").alias("content_hash"))
    out = rg.completed_runs(runs, outputs, "doc_id")
    return out.select("doc_id", F.array_join("reasons", "; ").alias("reasons"), "accepted")


@query("h9_parse_results", f"""
WITH {SQL_RUNS}, f AS (SELECT run_id, parent, content_hash, {_sql_text('completed_at')} AS completed_at FROM runs WHERE status = 'succeeded'
  AND content_hash = sha256('{{"k": 39}}') AND completed_at >= TIMESTAMP '2024-01-03')
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY completed_at DESC, run_id DESC LIMIT 200""")
def h9_results(t: Tables):
    """Successful results with one output hash, given in capitals."""
    digest = "\t" + hashlib.sha256(b'{"k": 39}').hexdigest().upper() + " "
    out = rg.run_listing(
        parse_runs(t).select("run_id", "parent", "content_hash", "completed_at", "status"), "run_id", created="completed_at",
        hashes={"content_hash": digest}, status=" Succeeded", created_from=datetime(2024, 1, 3),
        sortable=("completed_at", "run_id", "status"), limit=200)
    return out.withColumn("completed_at", _text("completed_at")).drop("status")


@query("h9_chunk_sets", f"""
WITH f AS (SELECT o_orderkey, o_custkey, sha256(o_orderpriority) AS configuration_hash, o_orderstatus AS status, {_sql_text('o_orderdate')} AS created_at
  FROM orders WHERE sha256(o_orderpriority) = sha256('2-HIGH') AND o_orderstatus = 'F'
  AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-06-30')
SELECT *, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY o_custkey, o_orderkey LIMIT 200 OFFSET 20""")
def h9_sets(t: Tables):
    """Orders read as chunk sets of their customers; the priority is the configuration."""
    sets = t.orders.select("o_orderkey", "o_custkey", F.sha2("o_orderpriority", 256).alias("configuration_hash"),
                           F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    out = rg.run_listing(
        sets, "o_orderkey", equals={"status": "F "}, hashes={"configuration_hash": hashlib.sha256(b"2-HIGH").hexdigest()},
        created_from=datetime(1995, 1, 1), created_to=datetime(1998, 6, 30), sort_by="o_custkey",
        sortable=("created_at", "o_custkey"), descending=False, offset=20, limit=200)
    return out.withColumn("created_at", _text("created_at"))


@query("h9_import_batches", f"""
WITH f AS (SELECT o_orderkey, o_orderstatus AS status, o_orderdate FROM orders WHERE lower(o_orderstatus) = 'o')
SELECT o_orderkey, status, {_sql_text('o_orderdate')} AS created_at, (SELECT count(*) FROM f)::BIGINT AS total
FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def h9_batches(t: Tables):
    """Newest batches first, equal times by ascending id."""
    batches = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    out = rg.run_listing(batches, "o_orderkey", status="o", tie_descending=False, limit=200)
    return out.withColumn("created_at", _text("created_at"))
