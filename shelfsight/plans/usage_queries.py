"""G: metering, billing and budgets over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions.num import half_up
from shelfsight.operators import usage as u
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r

BASE = m.with_(m.USAGE)
AS_OF = 1706745600  # 2024-02-01 00:00:00 UTC, the end of the log


def _money(df, *cols):
    for x in cols:
        df = df.withColumn(x, half_up(x, 6))
    return df


@query("g1_rate_limit_offered", BASE + """, n AS (SELECT event_id, agent_id, epoch,
 count(*) OVER w60 - row_number() OVER s AS n_per_minute, count(*) OVER w3600 - row_number() OVER s AS n_per_hour,
 count(*) OVER w86400 - row_number() OVER s AS n_per_day FROM us
 WINDOW w60 AS (PARTITION BY agent_id ORDER BY epoch RANGE BETWEEN 59 PRECEDING AND CURRENT ROW),
 w3600 AS (PARTITION BY agent_id ORDER BY epoch RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW),
 w86400 AS (PARTITION BY agent_id ORDER BY epoch RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW),
 s AS (PARTITION BY agent_id, epoch ORDER BY event_id DESC))
SELECT event_id, agent_id, n_per_minute, n_per_hour, n_per_day, greatest(2-n_per_minute,0) AS left_per_minute,
 greatest(3-n_per_hour,0) AS left_per_hour, greatest(4-n_per_day,0) AS left_per_day,
 NOT (n_per_minute>=2 OR n_per_hour>=3 OR n_per_day>=4) AS allowed,
 CASE WHEN n_per_minute>=2 THEN 'per_minute' WHEN n_per_hour>=3 THEN 'per_hour' WHEN n_per_day>=4 THEN 'per_day' END AS limit_exceeded,
 CAST(CASE WHEN n_per_minute>=2 THEN 60 WHEN n_per_hour>=3 THEN 3600 WHEN n_per_day>=4 THEN 86400 END AS BIGINT) AS retry_after_s FROM n""")
def g1(spark, d):
    limits = [("per_minute", 60, 2), ("per_hour", 3600, 3), ("per_day", 86400, 4)]
    return u.offered_rate_limits(m.usage(spark, d), limits).drop("epoch")


@query("g1_rate_limit_admitted")
def g1a(spark, d):
    limits = [("per_minute", 60, 2), ("per_hour", 3600, 2), ("per_day", 86400, 3)]
    return u.admitted_rate_limits(m.usage(spark, d), limits)


@query("g2_agent_stats", BASE + f"""SELECT agent_id, count(*) AS calls, {r('sum(amount_usd)')} AS revenue,
 CAST(floor(avg(ms)+0.5e0) AS BIGINT) AS avg_ms, {r('avg(CASE WHEN success THEN 0e0 ELSE 1e0 END)')} AS error_rate,
 (SELECT string_agg(tool_name||'='||n, ',' ORDER BY tool_name) FROM (SELECT tool_name, count(*) AS n FROM us y
   WHERE y.agent_id=x.agent_id AND y.epoch>{AS_OF}-2592000 AND y.epoch<={AS_OF} GROUP BY tool_name)) AS by_tool
FROM us x WHERE epoch>{AS_OF}-2592000 AND epoch<={AS_OF} GROUP BY agent_id""")
def g2(spark, d):
    s = u.agent_stats(u.since(m.usage(spark, d), AS_OF, 2592000))
    pairs = F.transform(F.map_entries("calls_by_tool"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _money(s, "revenue", "error_rate").withColumn("by_tool", F.array_join(pairs, ",")).drop("calls_by_tool")


@query("g3_tool_stats", BASE + f"""SELECT tool_name, count(*) AS calls, {r('sum(amount_usd)')} AS revenue,
 CAST(floor(avg(ms)+0.5e0) AS BIGINT) AS avg_ms, {r('avg(CASE WHEN success THEN 0e0 ELSE 1e0 END)')} AS error_rate,
 count(DISTINCT agent_id) AS agents FROM us WHERE epoch>{AS_OF}-604800 AND epoch<={AS_OF} GROUP BY tool_name""")
def g3(spark, d):
    return _money(u.tool_stats(u.since(m.usage(spark, d), AS_OF, 604800)), "revenue", "error_rate")


@query("g4_overview", BASE + f"""SELECT tool_name, payment_method, CAST(grouping(tool_name,payment_method) AS BIGINT) AS gid, count(*) AS calls,
 {r('sum(amount_usd)')} AS revenue, CAST(floor(avg(ms)+0.5e0) AS BIGINT) AS avg_ms,
 {r('avg(CASE WHEN success THEN 0e0 ELSE 1e0 END)')} AS error_rate, count(DISTINCT agent_id) AS agents
FROM us GROUP BY GROUPING SETS ((),(tool_name),(payment_method))""")
def g4(spark, d):
    return _money(u.overview(m.usage(spark, d)), "revenue", "error_rate")


@query("g5_revenue", BASE + f"""SELECT tool_name, payment_method, day, CAST(grouping(tool_name,payment_method,day) AS BIGINT) AS gid,
 {r('sum(amount_usd)')} AS revenue, count(*) AS calls FROM (SELECT *, strftime(ts,'%Y-%m-%d') AS day FROM us)
GROUP BY GROUPING SETS ((),(tool_name),(payment_method),(day))""")
def g5(spark, d):
    return _money(u.revenue(m.usage(spark, d)), "revenue")


@query("g6_retention", BASE + f"""SELECT tool_name, count(*) AS kept, min(epoch) AS oldest FROM us
WHERE epoch >= {AS_OF}-20*86400 GROUP BY tool_name""")
def g6(spark, d):
    return u.retained(m.usage(spark, d), AS_OF, 20).groupBy("tool_name").agg(
        F.count("*").alias("kept"), F.min("epoch").alias("oldest"))


@query("g7_free_tier", BASE + """SELECT event_id, agent_id, day, call_no, call_no<=2 AS granted, greatest(2-call_no,0) AS remaining FROM (
 SELECT event_id, agent_id, strftime(ts,'%Y-%m-%d') AS day,
 row_number() OVER (PARTITION BY agent_id, strftime(ts,'%Y-%m-%d') ORDER BY epoch, event_id) AS call_no FROM us)""")
def g7(spark, d):
    return u.free_tier(m.usage(spark, d), 2).select("event_id", "agent_id", "day", "call_no", "granted", "remaining")


TOOLS = {"view": "analyze_video", "click": "batch_analyze", "signup": "get_seasonal_calendar",
         "purchase": "discover_opportunities", "error": "unknown_tool"}
CALLS = ("calls AS (SELECT *, CASE tool_name WHEN 'view' THEN 'analyze_video' WHEN 'click' THEN 'batch_analyze' "
         "WHEN 'signup' THEN 'get_seasonal_calendar' WHEN 'purchase' THEN 'discover_opportunities' ELSE 'unknown_tool' END AS tool, "
         "CASE WHEN k%2=0 THEN 'deep' ELSE 'standard' END AS depth, k%4+1 AS n_urls FROM us)")


def calls(spark, d):
    names = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    e = m.usage(spark, d).withColumn("tool_name", names[F.col("tool_name")])
    return e.withColumn("depth", F.when(F.col("k") % 2 == 0, "deep").otherwise("standard")).withColumn(
        "urls", F.array_repeat(F.lit("u"), (F.col("k") % 4 + 1).cast("int")))


@query("g8_charges", BASE[:-1] + ", " + m.with_(CALLS)[5:] + f"""SELECT pricing_key, sum(units)::BIGINT AS units, {r('sum(price*units)')} AS charge, count(*) AS calls FROM (
 SELECT CASE WHEN tool='analyze_video' AND depth='deep' THEN 'analyze_video:deep' ELSE tool END AS pricing_key,
 CASE WHEN tool='batch_analyze' THEN n_urls ELSE 1 END AS units,
 CASE WHEN tool='analyze_video' AND depth='deep' THEN 0.05e0 WHEN tool='analyze_video' THEN 0.02e0 WHEN tool='batch_analyze' THEN 0.015e0
 WHEN tool='get_seasonal_calendar' THEN 0.005e0 WHEN tool='discover_opportunities' THEN 0.02e0 ELSE 0e0 END AS price FROM calls) GROUP BY pricing_key""")
def g8(spark, d):
    return u.charges(calls(spark, d)).groupBy("pricing_key").agg(
        F.sum("units").alias("units"), half_up(F.sum("charge"), 6).alias("charge"), F.count("*").alias("calls"))


AUTH = ("au AS (SELECT event_id, agent_id, epoch, strftime(ts,'%Y-%m-%d') AS day, tool_name, amount_usd, "
        "CASE WHEN k%7=0 AND ('key'||(k%3)) IN ('key0','key1') THEN 'api_key' WHEN k%5=0 THEN 'x402' END AS early FROM us), "
        "auth AS (SELECT event_id, agent_id, epoch, tool_name, amount_usd, coalesce(early, CASE WHEN sum(CASE WHEN early IS NULL THEN 1 ELSE 0 END) "
        "OVER (PARTITION BY agent_id, day ORDER BY epoch, event_id ROWS UNBOUNDED PRECEDING) <= 1 THEN 'free_tier' ELSE 'denied' END) AS method FROM au)")


def authorised(spark, d):
    e = m.usage(spark, d).withColumn(
        "api_key", F.when(F.col("k") % 7 == 0, F.concat(F.lit("key"), F.col("k") % 3))).withColumn(
        "has_payment", F.col("k") % 5 == 0)
    keys = m.usage(spark, d).where("k < 2").select(F.concat(F.lit("key"), F.col("k")).alias("api_key"))
    return u.authorise(e, keys, limit=1)


@query("g9_authorisation", m.with_(m.USAGE, AUTH) + "SELECT event_id, agent_id, method FROM auth")
def g9(spark, d):
    return authorised(spark, d).select("event_id", "agent_id", "method")


@query("g10_receipt_rollup", m.with_(m.USAGE, AUTH) + f"""SELECT payment_method, tool_name, agent_id,
 CAST(grouping(payment_method,tool_name,agent_id) AS BIGINT) AS gid, count(*) AS receipts, {r('sum(amount_usd)')} AS amount FROM (
 SELECT method AS payment_method, tool_name, agent_id, amount_usd FROM auth WHERE method<>'denied' ORDER BY epoch DESC, event_id DESC LIMIT 10000)
GROUP BY GROUPING SETS ((),(payment_method),(tool_name),(agent_id))""")
def g10(spark, d):
    rec = authorised(spark, d).where("method <> 'denied'").withColumn("payment_method", F.col("method"))
    return _money(u.receipt_rollup(u.last_receipts(rec)), "amount")


def api_calls(spark, d):
    return m.usage(spark, d).select(
        "event_id", F.col("tool_name").alias("service"), "epoch", (F.col("k") / 8000.0).alias("cost"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))


@query("g11_budget_ledger", BASE + f""", x AS (SELECT event_id, tool_name AS service, epoch, k/8000e0 AS cost, strftime(ts,'%Y-%m-%d') AS day, strftime(ts,'%Y-%m') AS month FROM us),
y AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY service, day ORDER BY epoch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0e0) AS day_before,
 coalesce(sum(cost) OVER (PARTITION BY service, month ORDER BY epoch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0e0) AS month_before FROM x)
SELECT event_id, service, day, {r('day_before')} AS day_before, {r('month_before')} AS month_before,
 CASE WHEN cost>0.01e0 THEN 'per_request' WHEN floor((day_before+cost)*1e9+0.5e0)/1e9>0.11e0 THEN 'daily' WHEN floor((month_before+cost)*1e9+0.5e0)/1e9>2e0 THEN 'monthly' END AS refused_by FROM y""")
def g11(spark, d):
    budget = {"per_request": 0.01, "daily": 0.11 + 1e-9, "monthly": 2.0 + 1e-9, "alert": 0.8}
    led = u.budget_ledger(api_calls(spark, d), budget=budget)
    return _money(led.select("event_id", "service", "day", "day_before", "month_before", "refused_by"),
                  "day_before", "month_before")


@query("g11_budget_admitted")
def g11a(spark, d):
    budget = {"per_request": 0.01, "daily": 0.08, "monthly": 1.5, "alert": 0.8}
    return u.budget_admitted(api_calls(spark, d), budget)


@query("g12_token_bucket")
def g12(spark, d):
    return u.token_bucket(api_calls(spark, d), rate=1.0 / 600, daily_quota=40)


@query("g13_extraction_cost", f"""SELECT lang, count(*) AS docs, sum(CAST(ceil(length(text)/4e0) AS BIGINT))::BIGINT AS input_tokens,
 {r('sum(ceil(length(text)/4e0)*0.15e-6+150*0.6e-6)', 8)} AS cost FROM documents GROUP BY lang""")
def g13(spark, d):
    return u.extraction_cost(m.transcripts(spark, d)).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("input_tokens").alias("input_tokens"), half_up(F.sum("cost"), 8).alias("cost"))


@query("g14_savings", BASE + f""", c AS (SELECT k*100+50 AS tokens, k/100000e0 AS cost,
 (CASE WHEN k%2=0 THEN 1 ELSE 0 END)+1+(CASE WHEN k%3=0 THEN 3 ELSE 0 END)+(CASE WHEN k%5=0 THEN 1 ELSE 0 END)+(CASE WHEN k%7=0 THEN 1 ELSE 0 END)+0 AS single FROM us),
 s AS (SELECT count(*) AS total_calls, sum(tokens)::BIGINT AS total_tokens, sum(cost) AS tc, sum(greatest(single-1,0))::BIGINT AS calls_saved,
 sum(tokens/0.6e0-tokens) AS ts, sum((tokens/0.6e0-tokens)/1000000*0.15e0) AS cs FROM c)
SELECT total_calls, total_tokens, {r('tc')} AS total_cost, calls_saved, {r('ts',3)} AS tokens_saved, {r('cs')} AS cost_saved,
 CAST(floor(total_tokens/total_calls+0.5e0) AS BIGINT) AS avg_tokens_per_call, {r('cs/(tc+cs)*100')} AS savings_pct FROM s""")
def g14(spark, d):
    k = F.col("k")
    c = m.usage(spark, d).select(
        (k * 100 + 50).alias("tokens"), (k / 100000.0).alias("cost"), (k % 2 == 0).alias("language"),
        F.lit(True).alias("entities"), (k % 3 == 0).alias("disambiguation"), (k % 5 == 0).alias("intent"),
        (k % 7 == 0).alias("items"), F.lit(False).alias("actions"))
    s = u.savings(c)
    return _money(s.withColumn("tokens_saved", half_up("tokens_saved", 3)), "total_cost", "cost_saved", "savings_pct")
