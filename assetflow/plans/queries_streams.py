"""Queries on streams of arriving rows (extensions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.plans.catalog import query
from assetflow.sources import views
from assetflow.streaming import jobs


@query(
    "stream_inventory",
    "select ext, count(*) as num_files, cast(sum(size_bytes) as bigint) as total_bytes from files "
    "where ext is not null group by ext",
    ("files",),
)
def stream_inventory(spark, sf):
    arriving = views.view(spark, sf, views.ASSETS, read=jobs.table_arrivals)
    return jobs.run_available(arriving, jobs.arrival_counts())


@query(
    "stream_error_rate",
    """select strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start, file_type, count(*) as batches,
              count(*) filter (failed) as failed_batches,
              round(count(*) filter (failed) / count(*), 6) as err_rate
       from timings group by date_trunc('day', ts), file_type""",
    ("timings",),
)
def stream_error_rate(spark, sf):
    timings = views.view(spark, sf, views.TIMINGS, read=jobs.table_arrivals)
    rows = jobs.run_available(timings, jobs.error_rate_by_window())
    day = F.substring(F.col("window_start").cast("string"), 1, 10)
    return rows.withColumns({"window_start": day, "err_rate": F.round("err_rate", 6)})


@query(
    "stream_sessions",
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start,
              strftime(max(ts) + interval 2 hour, '%Y-%m-%d %H:%M:%S') as session_end, count(*) as num_events
       from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from
               (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hour
                               then 0 else 1 end as fresh from events))
       group by user_id, session""",
)
def stream_sessions(spark, sf):
    events = jobs.table_arrivals(spark, sf, "events").select("ts", "user_id")
    kind = events.schema["user_id"].dataType.simpleString()
    rows = jobs.run_available(events, jobs.sessions("user_id", key_type=kind))
    # To the second, whatever the session's time zone.
    return rows.withColumns(
        {c: F.substring(F.col(c).cast("string"), 1, 19) for c in ("session_start", "session_end")}
    )


@query(
    "stream_dedup",
    "select distinct concat('/in/u', user_id, '/', event_type, '.json') as path from events",
)
def stream_dedup(spark, sf):
    # An event stands for the delivery of a user's file of that type.
    events = jobs.table_arrivals(spark, sf, "events")
    path = F.concat(F.lit("/in/u"), "user_id", F.lit("/"), "event_type", F.lit(".json"))
    deliveries = events.select("ts", path.alias("path"))
    return jobs.run_available(deliveries, jobs.first_deliveries(["path"])).select("path")
