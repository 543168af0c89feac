"""Timestamps, streams and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timestamps import normalise_timestamps, utc_text
from ..session import table
from ..streaming import streams
from .base import query


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    moments = normalise_timestamps(table(spark, d, "corpus_records"), table(spark, d, "feed_sources"))
    return moments.select("record_id", utc_text(F.col("epoch_s")).alias("published_utc"))


@query("""
    with h as (select time_bucket(interval '1 hour', ts) as w, event_type, count(*) as n from events group by 1, 2)
    select cast(w as timestamp) as window_start, event_type, n, cast(sum(n) over (partition by event_type order by w range between interval '23 hours' preceding and current row) as bigint) as last_day from h""")
def velocity_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, with the sum of the last 24 hours as a range of time."""
    hours = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    seconds = F.unix_timestamp(F.col("window_start").cast("timestamp"))
    last = Window.partitionBy("event_type").orderBy("_s").rangeBetween(-23 * 3600, 0)
    out = hours.withColumn("_s", seconds).withColumn("last_day", F.sum("n").over(last)).drop("_s")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "last_day")


@query("""
    with w as (select time_bucket(interval '1 day', ts) as b, event_type, count(*) as n, (select max(ts) from events) as m from events group by 1, 2)
    select cast(b as timestamp) as window_start, event_type, n from w where b + interval '1 day' <= m - interval '1 hour'""")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a day that the watermark has closed."""
    rows = streams.read_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = streams.run_once(streams.window_counts(rows, "ts", ["event_type"], size="1 day"), "stream-windows")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type; the delay spans the table, so each pair comes once."""
    rows = streams.read_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    out = streams.run_once(streams.dedup_stream(rows, ["user_id", "event_type"], "ts", delay="60 days"), "stream-dedup")
    return out.select("user_id", "event_type")


@query("""
    with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events where user_id is not null),
         s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, cast(min(ts) as timestamp) as window_start, count(*) as n from s group by user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, apart by six hours or more, over the whole table."""
    rows = table(spark, d, "events").where(F.col("user_id").isNotNull()).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = rows.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""
    select event_type, cast(time_bucket(interval '12 hours', ts) as timestamp) as window_start, count(*) as n, round(sum(value), 2) as total
    from (select event_type, ts, value from events union all select event_type, ts + interval '12 hours', value from events) group by all""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 24 hours that start every 12; the label is the start of the window's last half."""
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    g = rows.groupBy(F.window("ts", "24 hours", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", (F.col("w.start") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz").alias("window_start"), "n", "total")
