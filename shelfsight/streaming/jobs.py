"""Structured Streaming jobs over the usage log and arriving segments.

Each builder takes a streaming (or batch) DataFrame and returns one; `run_to_files` and
`run_foreach` drive a job to the end of its input with a checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions.num import local_day
from shelfsight.operators import intent
from shelfsight.operators.usage import refusal
from shelfsight.session import checkpoint_dir

SLICE = 10_000  # rows that a stateful function hands back at a time
NO_DAY = -(1 << 31)  # the day of an event without a time


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("agent"), F.col("user_id")).alias("agent_id"),
        F.col("event_type").alias("tool_name"), F.col("value").alias("amount_usd"),
        (F.col("event_type") != "error").alias("success"), k.alias("k"))


def _seconds(ts: str) -> Column:
    return F.floor(F.unix_micros(ts) / 1000000)


def windowed_calls(events: DataFrame, width: str = "1 hour", by: str = "tool_name", late: str = "10 minutes") -> DataFrame:
    """Calls and revenue per window (minute, hour or day), by tool or by agent."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(
        F.count("*").alias("calls"), F.sum("amount_usd").alias("revenue"))


def slide_calls(events: DataFrame, slide: str, late: str = "10 minutes") -> DataFrame:
    """Calls of an agent in each step of a sliding window, the only state kept: one row for a call at most.

    A call that comes after its step has closed is dropped.
    """
    return windowed_calls(events, slide, "agent_id", late).select(F.col("window.start").alias("start"), "agent_id", "calls")


def limit_breaches(steps: DataFrame, width: str, slide: str, limit: int, until: pd.Timedelta | None) -> DataFrame:
    """Sliding windows in which an agent reached the limit, over the closed steps that `slide_calls` put out.

    Only windows that end by `until`, the watermark, have all their steps. A step adds its calls where the first
    window that holds it begins and takes them back behind the last one, so the count of a window is a running
    sum: two rows a step, and window by window only where the limit is reached. `width` is a multiple of `slide`.
    """
    wide, step = (pd.Timedelta(x) // pd.Timedelta(1, "us") for x in (width, slide))
    if wide % step:
        raise ValueError("the width of a window must be a multiple of its slide")
    at, calls = F.unix_micros("start"), F.col("calls")
    change = steps.select("agent_id", F.explode(F.array(
        F.struct((at - wide + step).alias("at"), calls.alias("more")), F.struct((at + step).alias("at"), (-calls).alias("more")))).alias("x"))
    by_time = W.partitionBy("agent_id").orderBy("x.at")
    counts = change.select(
        "agent_id", F.col("x.at").alias("at"), F.lead("x.at").over(by_time).alias("next"),
        F.sum("x.more").over(by_time.rangeBetween(W.unboundedPreceding, W.currentRow)).alias("calls"))
    last = F.lit(None if until is None else until // pd.Timedelta(1, "us") - wide).cast("long")
    some = counts.where((F.col("calls") >= max(limit, 1)) & (F.col("next") > F.col("at")) & (F.col("at") <= last))
    first = F.explode(F.sequence("at", F.least(F.col("next") - step, last), F.lit(step).cast("long")))
    return some.select("agent_id", "calls", first.alias("at")).select(
        F.struct(F.timestamp_micros("at").alias("start"), F.timestamp_micros(F.col("at") + wide).alias("end")).alias("window"), "agent_id", "calls")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """S3: activity sessions per agent."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "agent_id").agg(
        F.count("*").alias("calls"), F.sum("amount_usd").alias("revenue"), F.count_if(~F.col("success")).alias("errors"),
        F.array_sort(F.collect_set("tool_name")).alias("tools"))


def free_tier_admission(events: DataFrame, limit: int = 5, late: str = "10 minutes", zone: str = "UTC", slots: int = 64) -> DataFrame:
    """Admission per (agent, day of the zone) with state; a day's state expires after the watermark passes it.

    The agents of a day are dealt over `slots` groups, so that Python is called once for many
    agents with few calls each; the state of a group is the count of every agent it has seen.
    """
    out = "event_id long, agent_id string, day string, granted boolean, remaining long"
    state = "agents array<string>, used array<long>"

    def admit(key, batches, st):
        day = key[0]
        if st.hasTimedOut:
            st.remove()
            return
        before = pd.Series(*reversed(st.get), dtype="int64") if st.exists else pd.Series(dtype="int64")
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        agent = rows["agent_id"]
        # A null agent is one agent too, with a name of its own in the state.
        name = ("a" + agent).fillna("")
        n = rows.groupby(name).cumcount() + 1 + name.map(before).fillna(0).astype("int64")
        after = before.add(name.value_counts(), fill_value=0).astype("int64")
        st.update((after.index.tolist(), after.tolist()))
        # A day may be reopened only until the watermark is past its end.
        end_ms = int((pd.Timestamp(day, tz=zone) + pd.Timedelta(days=1)).timestamp() * 1000)
        st.setTimeoutTimestamp(max(end_ms, st.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "agent_id": agent, "day": day,
                            "granted": n <= limit, "remaining": (limit - n).clip(lower=0)})

    e = events.withWatermark("ts", late).withColumn("day", local_day(_seconds("ts"), zone)).withColumn(
        "slot", F.pmod(F.xxhash64("agent_id"), F.lit(slots)))
    return e.groupBy("day", "slot").applyInPandasWithState(admit, out, state, "append", "EventTimeTimeout")


def token_bucket_admission(events: DataFrame, rate: float, late: str = "10 minutes") -> DataFrame:
    """Token bucket per service; the state is two numbers (tokens, last_ms)."""
    out = "event_id long, service string, allowed boolean"

    def admit(key, batches, st):
        tokens, last = st.get if st.exists else (rate, -1)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
        ok = []
        for ms in rows["at_ms"]:
            last = ms if last < 0 else last
            tokens = min(rate, tokens + max(0, ms - last) * rate / 1000.0)
            last = max(last, ms)
            ok.append(tokens >= 1)
            tokens -= 1 if ok[-1] else 0
        st.update((float(tokens), int(last)))
        yield pd.DataFrame({"event_id": rows["event_id"], "service": key[0], "allowed": ok})

    e = events.select("event_id", F.col("tool_name").alias("service"), F.floor(F.unix_micros("ts") / 1000).alias("at_ms"))
    return e.groupBy("service").applyInPandasWithState(admit, out, "tokens double, last_ms long", "append", "NoTimeout")


def budget_admission(calls: DataFrame, budget: dict, zone: str = "UTC") -> DataFrame:
    """Budget admission per (service, month); the state is the day and two running costs.

    calls(event_id, service, ts, cost). Rows of one batch are taken in event-time order.
    """
    out = "event_id long, service string, refused_by string"

    def admit(key, batches, st):
        day, day_cost, month_cost = st.get if st.exists else ("", 0.0, 0.0)
        # A batch of a group is kept as four numbers a row; names stand in the key only.
        kept = [[b[x].to_numpy() for x in ("at", "event_id", "date", "cost")] for b in batches]
        at, ids, dates, costs = (np.concatenate(x) for x in zip(*kept))
        del kept
        order = np.lexsort((ids, at))
        del at
        name, now = None, None
        for lo in range(0, len(order), SLICE):
            part = order[lo : lo + SLICE]
            why = []
            for d, cost in zip(dates[part].tolist(), costs[part].tolist()):
                if d != now:
                    now, name = d, str(np.datetime64(d, "D")) if d != NO_DAY else None
                if name != day:
                    day, day_cost = name, 0.0
                w = refusal(day_cost, month_cost, cost, budget)
                if w is None:
                    day_cost, month_cost = day_cost + cost, month_cost + cost
                why.append(w)
            yield pd.DataFrame({"event_id": ids[part], "service": key[0], "refused_by": why})
        st.update((day, float(day_cost), float(month_cost)))

    day_ = local_day(_seconds("ts"), zone)
    c = calls.select("event_id", "service", "cost", F.substring(day_, 1, 7).alias("month"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"),
                     F.coalesce(F.unix_date(day_.cast("date")), F.lit(NO_DAY)).alias("date"))
    return c.groupBy("service", "month").applyInPandasWithState(
        admit, out, "day string, day_cost double, month_cost double", "append", "NoTimeout")


def ingest_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per event id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def intent_updates(segments: DataFrame, phrases: DataFrame, path: str):
    """A foreachBatch writer that appends each batch's per-video intent totals."""
    def write(batch: DataFrame, batch_id: int) -> None:
        d = intent.intent_distribution(intent.score_segments(batch, phrases))
        d.select("video_id", "intent", "n", "total_score", "commercial").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return segments, write


def running_intents(spark: SparkSession, path: str) -> DataFrame:
    """Running summary: sums over the batches written so far (a rewritten batch replaces itself)."""
    d = spark.read.parquet(path).groupBy("video_id", "intent").agg(
        F.sum("n").alias("n"), F.sum("total_score").alias("total_score"), F.sum("commercial").alias("commercial"))
    return d


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/shelfsight/{name}-{uuid.uuid4().hex}"


def run_to_files(spark: SparkSession, job: DataFrame, name: str) -> DataFrame:
    """Drive an append-mode job over the available input and read its sink back."""
    return run_to_watermark(spark, job, name)[0]


def run_to_watermark(spark: SparkSession, job: DataFrame, name: str) -> tuple[DataFrame, pd.Timedelta | None]:
    """The same, with the watermark that the job has reached as the time since the epoch; none without an event."""
    base = _folder(spark, name)
    q = job.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/ckpt").option(
        "path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    reached = [pd.Timestamp(p["eventTime"]["watermark"]) - pd.Timestamp(0, tz="UTC") for p in q.recentProgress if "watermark" in p["eventTime"]]
    return spark.read.schema(job.schema).parquet(f"{base}/out"), max(reached, default=None)


def run_foreach(spark: SparkSession, segments: DataFrame, phrases: DataFrame, name: str) -> DataFrame:
    base = _folder(spark, name)
    stream, write = intent_updates(segments, phrases, f"{base}/out")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return running_intents(spark, f"{base}/out")
