"""Registered queries: the streaming operators run over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import rules
from lorespark.plans import views as v
from lorespark.plans.registry import Tables, query
from lorespark.session import new_run_folder
from lorespark.streaming import streams

_LEGAL = ", ".join(f"'{a}>{b}'" for a, bs in rules.JOB_TRANSITIONS.items() for b in bs)


def _table_stream(t: Tables, name: str):
    return streams.read_stream(t.spark, t.folder, name, getattr(t, name).schema)


def _job_stream(t: Tables):
    class Streamed(Tables):
        def __getattr__(self, name):
            return _table_stream(t, name)

    events = v.job_events(Streamed(t.spark, t.folder))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("l1_stream_dedup", """
SELECT DISTINCT sha256(text) AS sha256, 1::BIGINT AS copies FROM documents""")
def l1(t: Tables):
    folder = new_run_folder(t.spark, "l1")
    docs = _table_stream(t, "documents")
    streams.dedup_ingest(docs, "text", f"{folder}/docs", f"{folder}/progress")
    return t.spark.read.parquet(f"{folder}/docs").groupBy("sha256").agg(F.count("*").alias("copies"))


@query("l2_stream_lease_expiry", f"""
WITH {v.SQL_JOBS},
e AS (SELECT *, min(CASE WHEN status IN ('queued', 'reserved', 'succeeded', 'failed', 'cancelled') THEN ts END) OVER w AS closed,
    min(CASE WHEN status = 'running' THEN ts END) OVER w AS ran FROM job_events
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT job_id, event_id AS reserved_event, strftime(ts + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS expired_at,
  CASE WHEN ran <= ts + INTERVAL 300 SECOND THEN 'running' ELSE 'reserved' END AS previous,
  CASE WHEN ran <= ts + INTERVAL 300 SECOND THEN 'failed' ELSE 'released' END AS event_type
FROM e WHERE status = 'reserved' AND (closed IS NULL OR closed > ts + INTERVAL 300 SECOND)""")
def l2(t: Tables):
    folder = new_run_folder(t.spark, "l2")
    streams.lease_expiry(_job_stream(t), f"{folder}/expired", f"{folder}/progress")
    events = v.job_events(t)
    # the stream has written all that is older than its watermark, an hour's events and a lease
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    streams.flush_leases(events, f"{folder}/expired", since=F.lit(last) - F.expr("INTERVAL 4 HOURS"))
    out = streams.expired_leases(t.spark, f"{folder}/expired")
    return out.withColumn("expired_at", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _segments(t: Tables) -> str:
    folder = new_run_folder(t.spark, "l3")
    streams.job_states(_job_stream(t), f"{folder}/segments", f"{folder}/progress")
    return f"{folder}/segments"


@query("l3_stream_job_states", f"""
WITH {v.SQL_JOBS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*)::BIGINT AS events,
  count(*) FILTER (status = 'running')::BIGINT AS attempts, count(*) FILTER (status = 'retrying')::BIGINT AS retries
FROM job_events GROUP BY job_id""")
def l3(t: Tables):
    return streams.latest_states(t.spark, _segments(t))


@query("l3_stream_violations", f"""
WITH {v.SQL_JOBS}, p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id), 'new') AS previous_status FROM job_events)
SELECT job_id, event_id, previous_status, status FROM p WHERE previous_status || '>' || status NOT IN ({_LEGAL})""")
def l3_violations(t: Tables):
    return streams.illegal_transitions(t.spark, _segments(t))
