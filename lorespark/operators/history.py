"""State-machine analytics over append-only event tables.

Per-job facts are aggregates, which shrink hot jobs map-side. Facts about
neighbouring events use segmented windows, so a job that owns a large share
of all events is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespark.functions import rules
from lorespark.functions.ordered import first_arrivals, with_neighbour, with_running

TERMINAL = ("succeeded", "failed", "cancelled")


def hour_of(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def is_legal(
    previous: Column, new: Column,
    transitions: Mapping[str, Sequence[str]] = rules.JOB_TRANSITIONS,
) -> Column:
    legal = [f"{a}>{b}" for a, follows in transitions.items() for b in follows]
    return F.concat(previous, F.lit(">"), new).isin(legal)


def transitions(
    events: DataFrame, segment: Column | None = None, initial: str = "new",
    table: Mapping[str, Sequence[str]] = rules.JOB_TRANSITIONS,
) -> DataFrame:
    """Add ``previous_status`` and ``legal`` to (job_id, ts, event_id, status)."""
    seg = hour_of() if segment is None else segment
    out = with_neighbour(events, "job_id", ["ts", "event_id"], seg, {"previous_status": "status"})
    out = out.withColumn("previous_status", F.coalesce("previous_status", F.lit(initial)))
    return out.withColumn("legal", is_legal(F.col("previous_status"), F.col("status"), table))


def current_states(events: DataFrame, error: str) -> DataFrame:
    """(job_id, status, since, completed_at, last_error, events) per job.

    A new start clears the last error.
    """
    at = F.struct("ts", "event_id")
    failed = F.when(F.col("status") == "failed", at)
    started = F.when(F.col("status") == "running", at)
    out = events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.max("ts").alias("since"),
        F.max_by(error, failed).alias("__e"),
        F.max(failed).alias("__f"),
        F.max(started).alias("__s"),
        F.count(F.lit(1)).alias("events"),
    )
    keeps = F.col("__f").isNotNull() & (F.col("__s").isNull() | (F.col("__f") > F.col("__s")))
    return out.select(
        "job_id", "status", "since",
        F.when(F.col("status").isin(*rules.COMPLETED_JOB_STATUSES), F.col("since")).alias("completed_at"),
        F.when(keeps, F.col("__e")).alias("last_error"),
        "events",
    )


def attempts(events: DataFrame, segment: Column | None = None) -> DataFrame:
    """(job_id, attempt_number, started_at, finished_at, status, duration_ms).

    A start is finished by the next terminal event unless another start
    comes first.
    """
    seg = hour_of() if segment is None else segment
    marks = events.filter(F.col("status").isin("running", *TERMINAL)).select(
        "job_id", "ts", "event_id", "status"
    )
    order = ["ts", "event_id"]
    paired = with_neighbour(
        marks, "job_id", order, seg, {"next_status": "status", "next_ts": "ts"}, forward=True
    ).filter("status = 'running'")
    numbered = with_running(paired, "job_id", order, seg, {"attempt_number": F.lit(1)})
    done = F.col("next_status").isin(*TERMINAL)
    millis = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000
    return numbered.select(
        "job_id", "attempt_number", F.col("ts").alias("started_at"),
        F.when(done, F.col("next_ts")).alias("finished_at"),
        F.when(done, F.when(F.col("next_status") == "succeeded", "succeeded").otherwise("failed"))
        .otherwise("running").alias("status"),
        F.when(done, F.greatest(F.lit(0), F.floor(millis))).alias("duration_ms"),
    )


def retry_budget(events: DataFrame, limit: int = rules.RETRY_LIMIT) -> DataFrame:
    used = F.count_if(F.col("status") == "retrying")
    return events.groupBy("job_id").agg(used.alias("retries_used")).select(
        "job_id", "retries_used",
        F.greatest(F.lit(0), F.lit(limit) - F.col("retries_used")).alias("retries_left"),
        (F.col("retries_used") > limit).alias("over_limit"),
    )


def expire_leases(events: DataFrame, as_of: Column, ttl_seconds: int = rules.LEASE_TTL_SECONDS) -> DataFrame:
    """Events to emit for leases that ended by ``as_of``: (job_id, previous, new, event_type).

    The lease starts at the job's latest reservation. A reserved job returns
    to the queue, a running one fails, any other only loses its lease.
    """
    at = F.struct("ts", "event_id")
    past = events.filter(F.col("ts") <= as_of)
    jobs = past.groupBy("job_id").agg(
        F.max_by("status", at).alias("previous"),
        F.max(F.when(F.col("status") == "reserved", at)).alias("__r"),
        F.max(F.when(F.col("status").isin("queued", *TERMINAL), at)).alias("__end"),
    )
    open_lease = F.col("__r").isNotNull() & (F.col("__end").isNull() | (F.col("__r") > F.col("__end")))
    expires = F.col("__r.ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    ended = jobs.filter(open_lease & (expires <= as_of))
    new = (
        F.when(F.col("previous") == "reserved", "queued")
        .when(F.col("previous") == "running", "failed").otherwise(F.col("previous"))
    )
    kind = F.when(F.col("previous") == "running", "failed").otherwise("released")
    return ended.select("job_id", "previous", new.alias("new"), kind.alias("event_type"), expires.alias("expired_at"))


def one_active_job(jobs: DataFrame, document: str, job: str, order: str) -> DataFrame:
    """(document, job, returned_job, created): a request returns the active job.

    Only active jobs take part; the earliest per document is the one created.
    """
    active = jobs.filter(F.col("status").isin(*rules.ACTIVE_JOB_STATUSES)).select(document, job, order)
    firsts = first_arrivals(active, document, [order, job], [job]).select(
        document, F.col(job).alias("returned_job")
    )
    return active.join(firsts, document).select(
        document, job, "returned_job", (F.col(job) == F.col("returned_job")).alias("created")
    )


def latest_heartbeats(beats: DataFrame, name: str, ts: str, tie: str, *carry: str) -> DataFrame:
    """Newest row per case-insensitive node name."""
    newest = F.max_by(F.struct(name, ts, *carry), F.struct(ts, tie))
    grouped = beats.groupBy(F.lower(name).alias("node_key")).agg(
        newest.alias("__n"), F.count(F.lit(1)).alias("beats")
    )
    return grouped.select("node_key", "__n.*", "beats")


def upload_outcomes(events: DataFrame, as_of: Column, ttl_seconds: int = rules.UPLOAD_TTL_SECONDS) -> DataFrame:
    """(session, created_at, outcome): last state, or expired after the TTL.

    ``events`` has session, ts, event_id, state; states completed, failed and
    cancelled are final from their first occurrence on.
    """
    final = F.col("state").isin("completed", "failed", "cancelled")
    at = F.struct("ts", "event_id")
    per = events.groupBy("session").agg(
        F.min("ts").alias("created_at"),
        F.min_by("state", F.when(final, at)).alias("__final"),
        F.min(F.when(final, F.col("ts"))).alias("__done"),
        F.max_by("state", at).alias("__last"),
    )
    limit = F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    outcome = (
        F.when(F.col("__final").isNotNull() & (F.col("__done") <= limit), F.col("__final"))
        .when(limit <= as_of, "expired").otherwise(F.col("__last"))
    )
    return per.select("session", "created_at", outcome.alias("outcome"))
