"""Usage metering, billing and budgets over an append-only event log.

usage events: event_id, agent_id, tool_name, epoch (seconds), payment_method, amount_usd,
ms, success. `as_of` is always a parameter, in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions.num import cascade, half_up, local_day
from shelfsight.operators.joins import trailing_blocks

DAY = 86400


def record_defaults(events: DataFrame) -> DataFrame:
    """Defaults of the sink: amount 0, ms null, success unless explicitly false."""
    return events.select(
        "event_id", "agent_id", "tool_name", "epoch", "payment_method",
        F.coalesce("amount_usd", F.lit(0.0)).alias("amount_usd"),
        F.col("ms").cast("long").alias("ms"),
        F.coalesce("success", F.lit(True)).alias("success"))


def offered_rate_limits(events: DataFrame, limits=None) -> DataFrame:
    """For every event, the earlier events of its agent in each trailing window.

    Rows are copied into their own and the next block of the longest window, so that a hot
    agent is split by time and no task holds an agent's whole history.
    """
    limits = limits or fixed.RATE_LIMITS
    block = max(w for _, w, _ in limits)
    e = trailing_blocks(events.select("event_id", "agent_id", "epoch"), "epoch", block)
    part = ["agent_id", "_blk"]
    later = F.row_number().over(W.partitionBy(*part, "epoch").orderBy(F.desc("event_id")))
    e = e.withColumn("_same", later)
    for name, width, _ in limits:
        frame = W.partitionBy(*part).orderBy("epoch").rangeBetween(-(width - 1), 0)
        e = e.withColumn(f"n_{name}", F.count("*").over(frame) - F.col("_same"))
    e = e.where("_own")
    exceeded = cascade([(F.col(f"n_{n}") >= cap, n) for n, _, cap in limits])
    wait = cascade([(F.col(f"n_{n}") >= cap, w) for n, w, cap in limits])
    return e.select(
        "event_id", "agent_id", "epoch", *[f"n_{n}" for n, _, _ in limits],
        *[F.greatest(F.lit(cap) - F.col(f"n_{n}"), F.lit(0)).alias(f"left_{n}") for n, _, cap in limits],
        exceeded.isNull().alias("allowed"), exceeded.alias("limit_exceeded"),
        wait.cast("long").alias("retry_after_s"))


def admitted_rate_limits(events: DataFrame, limits=None) -> DataFrame:
    """Limits where refused calls do not count: an ordered fold per agent.

    The state is the admitted times of the longest window, never more than its limit, so
    memory stays bounded however many calls an agent makes.
    """
    from bisect import bisect_right

    import pandas as pd
    limits = list(limits or fixed.RATE_LIMITS)
    longest = max(w for _, w, _ in limits)
    e = (events.select("event_id", "agent_id", "epoch").repartition("agent_id")
         .sortWithinPartitions("agent_id", "epoch", "event_id"))

    def fold(batches):
        agent, times = None, []
        for b in batches:
            hit = []
            for a, t in zip(b["agent_id"], b["epoch"]):
                if a != agent:
                    agent, times = a, []
                del times[:bisect_right(times, t - longest)]
                why = next((n for n, w, cap in limits if len(times) - bisect_right(times, t - w) >= cap), None)
                if why is None:
                    times.append(t)
                hit.append(why)
            yield pd.DataFrame({"event_id": b["event_id"], "agent_id": b["agent_id"], "limit_exceeded": hit})

    return e.mapInPandas(fold, "event_id long, agent_id string, limit_exceeded string")


def since(events: DataFrame, as_of: int, seconds: int) -> DataFrame:
    return events.where((F.col("epoch") > as_of - seconds) & (F.col("epoch") <= as_of))


def _base_stats() -> list[Column]:
    return [
        F.count("*").alias("calls"), F.sum("amount_usd").alias("revenue"),
        half_up(F.avg("ms")).cast("long").alias("avg_ms"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate")]


def agent_stats(events: DataFrame) -> DataFrame:
    """Two-level aggregation: per (agent, tool) first, so the tool map needs no second scan."""
    per_tool = events.groupBy("agent_id", "tool_name").agg(
        F.count("*").alias("n"), F.sum("amount_usd").alias("rev"), F.sum("ms").alias("ms"),
        F.count("ms").alias("n_ms"), F.count_if(~F.col("success")).alias("bad"))
    return per_tool.groupBy("agent_id").agg(
        F.sum("n").alias("calls"), F.sum("rev").alias("revenue"),
        half_up(F.sum("ms") / F.sum("n_ms")).cast("long").alias("avg_ms"),
        (F.sum("bad") / F.sum("n")).alias("error_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("calls_by_tool"))


def tool_stats(events: DataFrame, approximate: bool = False) -> DataFrame:
    agents = F.approx_count_distinct("agent_id") if approximate else F.countDistinct("agent_id")
    return events.groupBy("tool_name").agg(*_base_stats(), agents.alias("agents"))


def overview(events: DataFrame) -> DataFrame:
    """Totals, per tool and per method in one pass over the rows."""
    g = events.groupingSets([[], ["tool_name"], ["payment_method"]], "tool_name", "payment_method")
    return g.agg(F.grouping_id().alias("gid"), *_base_stats(), F.countDistinct("agent_id").alias("agents"))


def revenue(events: DataFrame) -> DataFrame:
    e = events.withColumn("day", local_day(F.col("epoch")))
    g = e.groupingSets([[], ["tool_name"], ["payment_method"], ["day"]], "tool_name", "payment_method", "day")
    return g.agg(F.grouping_id().alias("gid"), F.sum("amount_usd").alias("revenue"), F.count("*").alias("calls"))


def retained(events: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    return events.where(F.col("epoch") >= as_of - days * DAY)


def free_tier(events: DataFrame, limit: int = fixed.FREE_CALLS_PER_DAY) -> DataFrame:
    """Nth call of the agent's UTC day; calls beyond the limit are denied."""
    e = events.withColumn("day", local_day(F.col("epoch")))
    n = F.row_number().over(W.partitionBy("agent_id", "day").orderBy("epoch", "event_id")).cast("long")
    return e.withColumn("call_no", n).withColumn("granted", F.col("call_no") <= limit).withColumn(
        "remaining", F.greatest(F.lit(limit) - F.col("call_no"), F.lit(0)))


def pricing_key(tool: Column, depth: Column) -> Column:
    return F.when((tool == "analyze_video") & (depth == "deep"), F.lit("analyze_video:deep")).otherwise(tool)


def price_map(prices: dict | None = None) -> Column:
    prices = prices or fixed.TOOL_PRICES
    return F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])


def charges(calls: DataFrame, prices: dict | None = None) -> DataFrame:
    """calls(tool_name, depth, urls): price of the call, batch calls per url."""
    key = pricing_key(F.col("tool_name"), F.col("depth"))
    units = F.when(F.col("tool_name") == "batch_analyze", F.coalesce(F.size("urls"), F.lit(1))).otherwise(F.lit(1))
    base = F.coalesce(F.try_element_at(price_map(prices), key), F.lit(0.0))
    return calls.withColumn("pricing_key", key).withColumn("units", units.cast("long")).withColumn(
        "charge", base * units)


def authorise(calls: DataFrame, api_keys: DataFrame, enabled: bool = True,
              limit: int = fixed.FREE_CALLS_PER_DAY) -> DataFrame:
    """Method of each call in order: disabled, api key, payment, free tier, denied.

    Only calls that reach the free tier consume it, so the per-day counter runs over the
    calls that no earlier rule took.
    """
    keys = api_keys.select("api_key").distinct().withColumn("_known", F.lit(True))
    c = calls.join(keys, "api_key", "left")
    early = cascade([
        (F.lit(not enabled), "disabled"),
        (F.col("_known"), "api_key"),
        (F.col("has_payment"), "x402"),
    ])
    c = c.withColumn("_early", early).withColumn(
        "day", local_day(F.col("epoch")))
    n = F.sum(F.when(F.col("_early").isNull(), 1).otherwise(0)).over(
        W.partitionBy("agent_id", "day").orderBy("epoch", "event_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow))
    return c.withColumn("_n", n).withColumn(
        "method", F.coalesce("_early", F.when(F.col("_n") <= limit, "free_tier").otherwise("denied"))
    ).drop("_early", "_n", "_known", "day")


def last_receipts(receipts: DataFrame, keep: int = 10_000) -> DataFrame:
    return receipts.orderBy(F.desc("epoch"), F.desc("event_id")).limit(keep)


def receipt_rollup(receipts: DataFrame) -> DataFrame:
    g = receipts.groupingSets(
        [[], ["payment_method"], ["tool_name"], ["agent_id"]], "payment_method", "tool_name", "agent_id")
    return g.agg(F.grouping_id().alias("gid"), F.count("*").alias("receipts"), F.sum("amount_usd").alias("amount"))


def _budget_reason(cost, day_before, month_before, budget):
    return cascade([
        (cost > budget["per_request"], "per_request"),
        (day_before + cost > budget["daily"], "daily"),
        (month_before + cost > budget["monthly"], "monthly"),
    ])


def budget_ledger(calls: DataFrame, zone: str = "UTC", budget: dict | None = None) -> DataFrame:
    """Every call counted: running cost of its day and month, limits, alert and stop flags.

    A month's running sum is the sum of earlier days plus the running sum inside the day,
    so the long frame is (service, day), never a whole month of one service in one task.
    """
    budget = budget or fixed.BUDGET
    c = calls.withColumn("day", local_day(F.col("epoch"), zone)).withColumn("month", F.substring("day", 1, 7))
    days = c.groupBy("service", "month", "day").agg(F.sum("cost").alias("_day_total"), F.count("*").alias("_day_n"))
    prior = W.partitionBy("service", "month").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("_prior", F.coalesce(F.sum("_day_total").over(prior), F.lit(0.0)))
    in_day = W.partitionBy("service", "day").orderBy("epoch", "event_id").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("day_before", F.coalesce(F.sum("cost").over(in_day), F.lit(0.0))).withColumn(
        "requests_before", F.count("*").over(in_day))
    c = c.join(days.select("service", "day", "_prior"), ["service", "day"])
    c = c.withColumn("month_before", F.col("_prior") + F.col("day_before")).drop("_prior")
    reason = _budget_reason(F.col("cost"), F.col("day_before"), F.col("month_before"), budget)
    return (
        c.withColumn("refused_by", reason)
        .withColumn("alert", (F.col("day_before") + F.col("cost")) / budget["daily"] >= budget["alert"])
        .withColumn("stop", (F.col("day_before") >= budget["daily"]) | (F.col("month_before") >= budget["monthly"])))


def refusal(day_cost: float, month_cost: float, cost: float, budget: dict):
    """The first budget rule a call breaks, or None."""
    if cost > budget["per_request"]:
        return "per_request"
    if day_cost + cost > budget["daily"]:
        return "daily"
    if month_cost + cost > budget["monthly"]:
        return "monthly"
    return None


def budget_admitted(calls: DataFrame, budget: dict | None = None, zone: str = "UTC") -> DataFrame:
    """Admission where refused calls add no cost: an ordered fold per (service, month).

    The fold walks its group as a stream of Arrow batches and keeps two running sums, so
    memory does not grow with the group.
    """
    import pandas as pd
    budget = dict(budget or fixed.BUDGET)
    day_ = local_day(F.col("epoch"), zone)
    c = (calls.select("event_id", "service", "epoch", "cost", F.substring(day_, 1, 7).alias("month"), day_.alias("day"))
         .repartition("service", "month").sortWithinPartitions("service", "month", "epoch", "event_id"))

    def fold(batches):
        key = day = None
        day_cost = month_cost = 0.0
        for b in batches:
            why, spent = [], []
            for svc, mon, dy, cost in zip(b["service"], b["month"], b["day"], b["cost"]):
                if (svc, mon) != key:
                    key, day, day_cost, month_cost = (svc, mon), None, 0.0, 0.0
                if dy != day:
                    day, day_cost = dy, 0.0
                w = refusal(day_cost, month_cost, cost, budget)
                if w is None:
                    day_cost += cost
                    month_cost += cost
                why.append(w)
                spent.append(day_cost)
            yield pd.DataFrame({"event_id": b["event_id"], "service": b["service"], "day": b["day"],
                                "cost": b["cost"], "refused_by": why, "day_spent": spent})

    return c.mapInPandas(fold, "event_id long, service string, day string, cost double, refused_by string, day_spent double")


def token_bucket(calls: DataFrame, rate: float = 5.0, daily_quota: int = 10_000) -> DataFrame:
    """Token bucket per service (capacity = rate per second) with a daily quota.

    calls(event_id, service, at_ms). An allowed call takes one token; a denied one does not.
    Same streaming fold as `budget_admitted`: two numbers of state per service.
    """
    import math

    import pandas as pd
    c = (calls.select("event_id", "service", "at_ms")
         .repartition("service").sortWithinPartitions("service", "at_ms", "event_id"))

    def fold(batches):
        svc, tokens, last, day, used = None, rate, 0, None, 0
        for b in batches:
            ok, wait = [], []
            for s, ms in zip(b["service"], b["at_ms"]):
                if s != svc:
                    svc, tokens, last, day, used = s, rate, ms, None, 0
                if ms // 86_400_000 != day:
                    day, used = ms // 86_400_000, 0
                tokens = min(rate, tokens + (ms - last) * rate / 1000.0)
                last = ms
                if tokens < 1:
                    ok.append(False)
                    wait.append(math.ceil((1 - tokens) / (rate / 1000.0)))
                    continue
                allowed = used < daily_quota
                if allowed:
                    tokens -= 1
                    used += 1
                ok.append(allowed)
                wait.append(0)
            yield pd.DataFrame({"event_id": b["event_id"], "service": b["service"], "allowed": ok, "wait_ms": wait})

    return c.mapInPandas(fold, "event_id long, service string, allowed boolean, wait_ms long")


def extraction_cost(docs: DataFrame, text: str = "text") -> DataFrame:
    k = fixed.TOKEN_COST
    tokens = F.ceil(F.length(text) / 4.0)
    return docs.withColumn("input_tokens", tokens).withColumn(
        "cost", tokens * k["input"] + F.lit(k["output_tokens"] * k["output"]))


SAVING_FLAGS = {"language": 1, "entities": 1, "disambiguation": 3, "intent": 1, "items": 1, "actions": 1}


def savings(calls: DataFrame) -> DataFrame:
    """calls(tokens, cost, one boolean per SAVING_FLAGS key): ledger of saved calls and cost."""
    parts = [F.when(F.col(k), n).otherwise(0) for k, n in SAVING_FLAGS.items()]
    single = sum(parts[1:], parts[0])
    saved_tokens = F.col("tokens") / 0.6 - F.col("tokens")
    return calls.agg(
        F.count("*").alias("total_calls"), F.sum("tokens").alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.sum(F.greatest(single - 1, F.lit(0))).alias("calls_saved"),
        F.sum(saved_tokens).alias("tokens_saved"),
        F.sum(saved_tokens / 1000000 * 0.15).alias("cost_saved"),
    ).withColumn("avg_tokens_per_call", half_up(F.col("total_tokens") / F.col("total_calls")).cast("long")
    ).withColumn("savings_pct", F.when(
        F.col("total_cost") > 0, F.col("cost_saved") / (F.col("total_cost") + F.col("cost_saved")) * 100).otherwise(0.0))
