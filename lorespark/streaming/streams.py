"""Three batch behaviours as streams: de-dup, lease expiry and job states.

All sources are file streams; sinks are parquet folders. Functions that start
a query return after the available input is processed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from lorespark.functions import rules
from lorespark.functions.ordered import with_neighbour
from lorespark.operators.chunking import let
from lorespark.operators.history import TERMINAL, hour_of, is_legal
from lorespark.session import cut_lineage
from lorespark.sources.sinks import append_new

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType,
                files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of one table as a stream; a table may be a file, files or a folder of parts."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder.rstrip('/')}/{name}*.parquet")
    )


def _run(writer, progress: str) -> None:
    query: StreamingQuery = (
        writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()


@contextmanager
def _keyed(spark: SparkSession) -> Iterator[None]:
    """Only the query started inside gets the state store that keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# --- first arrival per content -------------------------------------------------------


def dedup_ingest(docs: DataFrame, content: str, sink: str, progress: str, delay: str = "1 day") -> None:
    """Append first arrivals per content hash to ``sink``.

    The watermark runs on arrival time, so no document counts as late and
    none is lost. Repeats within ``delay`` of the first arrival are dropped by
    the stream's state; later ones meet the stored hashes in an anti join.
    """
    keyed = docs.withColumn("sha256", F.sha2(F.col(content), 256)).withColumn(
        "arrived_at", F.current_timestamp()
    )
    fresh = keyed.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["sha256"])

    def store(batch: DataFrame, _: int) -> None:
        append_new(batch, sink, ["sha256"])

    _run(fresh.writeStream.foreachBatch(store), progress)


# --- lease expiry ----------------------------------------------------------------------

EXPIRY_SCHEMA = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("reserved_event", T.LongType()),
    T.StructField("expired_at", T.TimestampType()),
    T.StructField("previous", T.StringType()),
    T.StructField("event_type", T.StringType()),
])
_ENDS_LEASE = ("queued", "reserved", *TERMINAL)


def ended_leases(events: pd.DataFrame, until: pd.Timestamp, ttl: pd.Timedelta) -> pd.DataFrame:
    """Leases reserved before ``until`` that met no closing event within the TTL."""
    rows = events.sort_values(["job_id", "ts", "event_id"]).reset_index(drop=True)

    def next_time(marked: pd.Series) -> pd.Series:
        later = rows.ts.where(marked).groupby(rows.job_id).shift(-1)
        return later.groupby(rows.job_id).bfill()

    following = next_time(rows.status.isin(_ENDS_LEASE))
    runs = next_time(rows.status.eq("running"))
    deadline = rows.ts + ttl
    out = rows[rows.status.eq("reserved") & (rows.ts < until) & ~(following <= deadline)]
    running = runs[out.index] <= deadline[out.index]
    return pd.DataFrame({
        "job_id": out.job_id, "reserved_event": out.event_id, "expired_at": deadline[out.index],
        "previous": running.map({True: "running", False: "reserved"}),
        "event_type": running.map({True: "failed", False: "released"}),
    })


def leases_over(events: Column, until: Column, ttl_seconds: int) -> Column:
    """``ended_leases`` of sorted (job_id, ts, event_id, status) events, in one pass over the array."""

    def judged(x: Column) -> Column:
        def judge(e: Column, i: Column) -> Column:
            deadline = e["ts"] + F.make_dt_interval(secs=F.lit(ttl_seconds))
            following, second = (F.when(o["job_id"] == e["job_id"], o) for o in (F.get(x, i + 1), F.get(x, i + 2)))
            # runs in a row are one event here, so what follows one is closing
            runs = F.coalesce(following["status"] == "running", F.lit(False))
            closed = F.when(runs, second["ts"]).otherwise(following["ts"])
            running = runs & (following["ts"] <= deadline)
            over = (e["status"] == "reserved") & (e["ts"] < until) & (closed.isNull() | (closed > deadline))
            return F.when(over, F.struct(
                e["job_id"].alias("job_id"), e["event_id"].alias("reserved_event"), deadline.alias("expired_at"),
                F.when(running, "running").otherwise("reserved").alias("previous"),
                F.when(running, "failed").otherwise("released").alias("event_type"),
            ))

        return F.array_compact(F.transform(x, judge))

    def first_runs(x: Column) -> Column:
        def again(e: Column, before: Column) -> Column:
            return (e["status"] == "running") & (before["status"] == "running") & (e["job_id"] == before["job_id"])

        return F.filter(x, lambda e, i: ~F.coalesce(again(e, F.get(x, i - 1)), F.lit(False)))

    return let(let(events, first_runs), judged)


def lease_expiry(
    events: DataFrame, sink: str, progress: str, ttl_seconds: int = rules.LEASE_TTL_SECONDS,
    delay: str = "1 hour", groups: int | None = None,
) -> None:
    """Write one row per lease that ran out: (job_id, reserved_event, expired_at, …).

    The state holds the events of one (job group, hour) as an array until the
    watermark has passed the hour and a lease. An event close to the start of
    its hour is also in the window of the hour before, where it can still
    close a lease. Leases are far shorter than an hour, so a busy job is
    spread over its hours. ``groups`` is the number of job groups per hour, by
    default one per shuffle partition. Hours that the watermark has not passed
    when the input ends are left to ``flush_leases``.
    """
    spark = events.sparkSession
    parts = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = F.col("status").isin("running", *_ENDS_LEASE)
    rows = (
        events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
        .withWatermark("ts", delay)
        .withColumn("job_group", F.pmod(F.xxhash64("job_id"), F.lit(parts)))
    )
    hours = F.window("ts", f"{3600 + ttl_seconds + 1} seconds", "3600 seconds")
    # all events move the watermark; the state needs those that open, run or close a lease
    kept = F.collect_list(F.when(counts, F.struct("job_id", "ts", "event_id", "status")))
    held = rows.groupBy("job_group", hours.alias("hour")).agg(F.sort_array(kept).alias("events"))
    until = F.col("hour.start") + F.expr("INTERVAL 1 HOUR")
    found = held.select(F.explode(leases_over(F.col("events"), until, ttl_seconds)).alias("x")).select("x.*")
    with _keyed(spark):
        _run(found.writeStream.format("parquet").option("path", sink).outputMode("append"), progress)


def flush_leases(
    events: DataFrame, sink: str, ttl_seconds: int = rules.LEASE_TTL_SECONDS, since: Column | None = None
) -> None:
    """Append the leases that ``lease_expiry`` left open when its input ended.

    ``events`` is the whole input as a batch. No event follows any more, so a
    lease without a closing event within its time has run out, also where the
    watermark never passed its hour. Leases that the sink has are not written
    again, so a repeated flush adds nothing. ``since`` may leave out
    reservations that are known to be written. Runs a job.
    """
    order, seg = ["ts", "event_id"], hour_of()
    rows = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    ends = rows.filter(F.col("status").isin(*_ENDS_LEASE))
    closed = with_neighbour(ends, "job_id", order, seg, {"__closed": "ts"}, forward=True).filter("status = 'reserved'")
    # a run that follows another reservation comes after the lease was closed
    runs = rows.filter(F.col("status").isin("reserved", "running"))
    ran = with_neighbour(runs, "job_id", order, seg, {"__next": "status", "__ran": "ts"}, forward=True)
    ran = ran.filter("status = 'reserved'").select("event_id", F.when(F.col("__next") == "running", F.col("__ran")).alias("__ran"))
    deadline = F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    over = closed.filter(F.col("__closed").isNull() | (F.col("__closed") > deadline)).join(ran, "event_id")
    running = F.coalesce(F.col("__ran") <= deadline, F.lit(False))
    out = over.select(
        "job_id", F.col("event_id").alias("reserved_event"), deadline.alias("expired_at"),
        F.when(running, "running").otherwise("reserved").alias("previous"),
        F.when(running, "failed").otherwise("released").alias("event_type"),
    )
    written = expired_leases(events.sparkSession, sink).select("reserved_event")
    fresh = cut_lineage(out.join(written, "reserved_event", "left_anti").select(*EXPIRY_SCHEMA.names))
    fresh.write.mode("append").parquet(_flushed(sink))


def _flushed(sink: str) -> str:
    # readers of a stream's own folder see only what the stream committed
    return f"{sink.rstrip('/')}-flushed"


def expired_leases(spark: SparkSession, sink: str) -> DataFrame:
    """All leases written by ``lease_expiry`` and ``flush_leases``."""
    read = spark.read.schema(EXPIRY_SCHEMA)
    found = read.parquet(sink)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_flushed(sink))
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        found = found.unionByName(read.parquet(_flushed(sink)))
    return found


# --- job states ----------------------------------------------------------------------------


_LONG, _STRING = T.LongType(), T.StringType()
_STEP = T.StructType([T.StructField("event_id", _LONG), T.StructField("previous_status", _STRING), T.StructField("status", _STRING)])
SEGMENT_SCHEMA = T.StructType([
    *[T.StructField(name, _LONG) for name in ("job_id", "hour", "events", "attempts", "retries", "first_event")],
    T.StructField("first_status", _STRING), T.StructField("last_status", _STRING), T.StructField("illegal", T.ArrayType(_STEP)),
])
_LEGAL_STEPS = {(a, b) for a, follows in rules.JOB_TRANSITIONS.items() for b in follows}


def judged_segments(events: pd.DataFrame, hour: int, jobs: Iterable[int]) -> pd.DataFrame:
    """One row for each of ``jobs``: what its events of one hour amount to.

    Every event but the first is judged against the one before it in event
    time; the first one is judged by ``illegal_transitions``, which knows the
    hour before.
    """
    rows = events[events.job_id.isin(set(jobs))].sort_values(["job_id", "ts", "event_id"])
    before = rows.groupby("job_id").status.shift(1)
    legal = [(a, b) in _LEGAL_STEPS for a, b in zip(before, rows.status)]
    wrong = rows.assign(previous=before)[before.notna() & ~pd.Series(legal, rows.index, dtype=bool)]
    steps = {
        job: [{"event_id": e, "previous_status": a, "status": b} for e, a, b in zip(part.event_id, part.previous, part.status)]
        for job, part in wrong.groupby("job_id")
    }
    grouped = rows.groupby("job_id")
    return pd.DataFrame({
        "events": grouped.size(),
        "attempts": rows.status.eq("running").groupby(rows.job_id).sum(),
        "retries": rows.status.eq("retrying").groupby(rows.job_id).sum(),
        "first_event": grouped.event_id.first(), "first_status": grouped.status.first(),
        "last_status": grouped.status.last(),
    }).reset_index().assign(hour=hour, illegal=lambda x: [steps.get(job, []) for job in x.job_id])[SEGMENT_SCHEMA.names]


def segments(held: DataFrame) -> DataFrame:
    """``judged_segments`` of rows (job_id, hour, sorted (ts, event_id, status) events)."""
    x = F.col("events")

    def count(status: str) -> Column:
        return F.size(F.filter(x, lambda e: e["status"] == status)).cast("long")

    # each event with the one before it; the first has none and is not judged here
    pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x)).alias("b"))
    wrong = F.filter(pairs, lambda p: ~is_legal(p["a"]["status"], p["b"]["status"]))
    illegal = F.transform(wrong, lambda p: F.struct(
        p["b"]["event_id"].alias("event_id"), p["a"]["status"].alias("previous_status"), p["b"]["status"].alias("status")))
    return held.select(
        "job_id", "hour", F.size(x).cast("long").alias("events"), count("running").alias("attempts"), count("retrying").alias("retries"),
        x[0]["event_id"].alias("first_event"), x[0]["status"].alias("first_status"),
        F.element_at(x, -1)["status"].alias("last_status"), illegal.alias("illegal"),
    )


def job_states(events: DataFrame, sink: str, progress: str) -> None:
    """Keep status, counters and illegal transitions per job, in hourly segments.

    The state holds the events of one (job, hour) as an array. A batch appends
    one revised row for each (job, hour) that it touches, so nothing else is
    written again, and a busy job is spread over its hours. An event that
    comes late, in whatever batch, is put in its place in event time, and the
    events beside it are judged again; none is dropped. A batch that is
    repeated replaces its rows. Read the result by ``latest_states`` and
    ``illegal_transitions``.
    """
    hour = F.floor(F.unix_timestamp("ts") / 3600) * 3600
    rows = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    held = rows.groupBy("job_id", hour.alias("hour")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "status"))).alias("events"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    with _keyed(events.sparkSession):
        _run(segments(held).writeStream.foreachBatch(store).outputMode("update"), progress)


def _segments(spark: SparkSession, sink: str) -> DataFrame:
    # events are only added, so the newest revision has most of them
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(sink)
    newest = rows.groupBy("job_id", "hour").agg(F.max_by(F.struct(*SEGMENT_SCHEMA.names), "events").alias("x"))
    return newest.select("x.*")


def latest_states(spark: SparkSession, sink: str) -> DataFrame:
    """(job_id, status, events, attempts, retries) from the rows of ``job_states``."""
    return _segments(spark, sink).groupBy("job_id").agg(
        F.max_by("last_status", "hour").alias("status"),
        *[F.sum(c).alias(c) for c in ("events", "attempts", "retries")],
    )


def illegal_transitions(spark: SparkSession, sink: str, initial: str = "new") -> DataFrame:
    """(job_id, event_id, previous_status, status): inside hours, and from one hour to the next."""
    segments = _segments(spark, sink)
    inside = segments.select("job_id", F.explode("illegal").alias("x")).select("job_id", "x.*")
    before = F.lag("last_status").over(Window.partitionBy("job_id").orderBy("hour"))
    edges = segments.select(
        "job_id", F.col("first_event").alias("event_id"), F.coalesce(before, F.lit(initial)).alias("previous_status"),
        F.col("first_status").alias("status"),
    )
    return inside.unionByName(edges.filter(~is_legal(F.col("previous_status"), F.col("status"))))
