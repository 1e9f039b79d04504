"""Streaming jobs driven over the given event log and conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions.num import half_up
from shelfsight.plans import intent_queries as iq
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r
from shelfsight.streaming import jobs

WM = "(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE"


def _windows(width: str, by: str) -> str:
    return (f"SELECT epoch(w)::BIGINT AS start_s, {by}, count(*) AS calls, {r('sum(value)')} AS revenue FROM (SELECT time_bucket(INTERVAL {width}, ts) AS w, "
            f"event_type AS tool_name, 'agent'||user_id AS agent_id, * FROM events) WHERE w+INTERVAL {width}<={WM} GROUP BY ALL")


def _windowed(spark, d, width, by, name):
    x = jobs.run_to_files(spark, jobs.windowed_calls(jobs.event_stream(spark, d), width, by), name)
    return x.select(F.unix_timestamp("window.start").alias("start_s"), by, "calls", half_up("revenue", 6).alias("revenue"))


@query("s1_windowed_calls", _windows("1 HOUR", "tool_name"))
def s1(spark, d):
    return _windowed(spark, d, "1 hour", "tool_name", "s1")


@query("s1_minute_calls_by_tool", _windows("1 MINUTE", "tool_name"))
def s1_minute(spark, d):
    return _windowed(spark, d, "1 minute", "tool_name", "s1m")


@query("s1_hour_calls_by_agent", _windows("1 HOUR", "agent_id"))
def s1_hour_agent(spark, d):
    return _windowed(spark, d, "1 hour", "agent_id", "s1ha")


@query("s1_day_calls_by_agent", _windows("1 DAY", "agent_id"))
def s1_day(spark, d):
    return _windowed(spark, d, "1 day", "agent_id", "s1da")


def _breaches(width: str, slide: str, slides: int, limit: int) -> str:
    return (f"SELECT epoch(s)::BIGINT AS start_s, agent_id, count(*) AS calls FROM (SELECT 'agent'||user_id AS agent_id, "
            f"unnest([time_bucket(INTERVAL {slide}, ts)-INTERVAL {slide}*i FOR i IN range(0,{slides})]) AS s FROM events) "
            f"WHERE s+INTERVAL {width}<={WM} GROUP BY ALL HAVING count(*)>={limit}")


def _breached(spark, d, width, slide, limit, name):
    steps, until = jobs.run_to_watermark(spark, jobs.slide_calls(jobs.event_stream(spark, d), slide), name)
    x = jobs.limit_breaches(steps, width, slide, limit, until)
    return x.select(F.unix_timestamp("window.start").alias("start_s"), "agent_id", "calls")


@query("s2_limit_breaches", _breaches("1 HOUR", "10 MINUTE", 6, 3))
def s2(spark, d):
    return _breached(spark, d, "1 hour", "10 minutes", 3, "s2")


@query("s2_minute_limit_breaches", _breaches("1 MINUTE", "10 SECOND", 6, 2))
def s2_minute(spark, d):
    return _breached(spark, d, "1 minute", "10 seconds", 2, "s2m")


@query("s2_day_limit_breaches", _breaches("1 DAY", "1 HOUR", 24, 5))
def s2_day(spark, d):
    return _breached(spark, d, "1 day", "1 hour", 5, "s2d")


@query("s3_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
 i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT 'agent'||user_id AS agent_id, epoch_us(min(ts)) AS start_us, count(*) AS calls, {r('sum(value)')} AS revenue, count_if(event_type='error')::BIGINT AS errors, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools
FROM i GROUP BY user_id, sid HAVING max(ts)+INTERVAL 30 MINUTE<={WM}""")
def s3(spark, d):
    x = jobs.run_to_files(spark, jobs.sessions(jobs.event_stream(spark, d)), "s3")
    return x.select("agent_id", F.unix_micros("session_window.start").alias("start_us"), "calls", half_up("revenue", 6).alias("revenue"),
                    "errors", F.array_join("tools", ",").alias("tools"))


@query("s4_free_tier_admission", """SELECT event_id, 'agent'||user_id AS agent_id, strftime(ts,'%Y-%m-%d') AS day, n<=2 AS granted, greatest(2-n,0) AS remaining FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, strftime(ts,'%Y-%m-%d') ORDER BY ts, event_id) AS n FROM events)""")
def s4(spark, d):
    return jobs.run_to_files(spark, jobs.free_tier_admission(jobs.event_stream(spark, d), 2), "s4")


@query("s4_token_bucket")
def s4t(spark, d):
    return jobs.run_to_files(spark, jobs.token_bucket_admission(jobs.event_stream(spark, d), 1.0 / 600), "s4t")


@query("s4_budget_admission")
def s4b(spark, d):
    budget = {"per_request": 0.01, "daily": 0.08, "monthly": 1.5, "alert": 0.8}
    calls = jobs.event_stream(spark, d).select("event_id", F.col("tool_name").alias("service"), "ts", (F.col("k") / 8000.0).alias("cost"))
    return jobs.run_to_files(spark, jobs.budget_admission(calls, budget), "s4b")


@query("s5_ingest_once", f"SELECT event_type AS tool_name, count(*) AS events, {r('sum(value)')} AS amount FROM events GROUP BY event_type")
def s5(spark, d):
    e = jobs.event_stream(spark, d)
    doubled = e.union(e.where(F.col("k") % 2 == 0))
    x = jobs.run_to_files(spark, jobs.ingest_once(doubled), "s5")
    return x.groupBy("tool_name").agg(F.count("*").alias("events"), half_up(F.sum("amount_usd"), 6).alias("amount"))


@query("s6_running_intents", iq.BASE[:-1] + f", {iq.DIST} SELECT video_id, intent, n, {r('total')} AS total_score, {r('commercial')} AS commercial FROM dist")
def s6(spark, d):
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/conversation[s].parquet")
    segs = raw.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_no"), "text")
    x = jobs.run_foreach(spark, segs, m.intents(spark, d), "s6")
    return x.select("video_id", "intent", "n", half_up("total_score", 6).alias("total_score"), half_up("commercial", 6).alias("commercial"))
