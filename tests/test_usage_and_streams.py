"""Metering against brute force, ordered folds, store, sources and streaming edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import content as ct
from shelfsight.operators import market as mk
from shelfsight.operators import usage as u
from shelfsight.sources import captions, feeds, store
from shelfsight.streaming import jobs


def log(spark, n=300, agents=("hot", "hot", "hot", "b")):
    rng = random.Random(1)
    rows = [(i, rng.choice(agents), rng.choice("xyz"), rng.randint(0, 200_000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, agent_id string, tool_name string, epoch long")


def test_rate_limits_against_brute_force(spark):
    rows, df = log(spark)
    got = {r.event_id: (r.n_per_minute, r.n_per_hour, r.n_per_day) for r in u.offered_rate_limits(df).collect()}
    for i, a, _, t in rows:
        prior = [(t2, i2) for i2, a2, _, t2 in rows if a2 == a and (t2, i2) < (t, i)]
        assert got[i] == tuple(sum(t2 > t - w for t2, _ in prior) for w in (60, 3600, 86400))


def test_admitted_limits_by_hand(spark):
    rows, df = log(spark)
    limits = [("m", 60, 1), ("h", 3600, 2), ("d", 86400, 9)]
    got = {r.event_id: r.limit_exceeded for r in u.admitted_rate_limits(df, limits).collect()}
    taken = {}
    for i, a, _, t in sorted(rows, key=lambda x: (x[3], x[0])):
        past = taken.setdefault(a, [])
        why = next((n for n, w, cap in limits if sum(x > t - w for x in past) >= cap), None)
        if why is None:
            past.append(t)
        assert got[i] == why


def test_streaming_budget_equals_batch(spark):
    from shelfsight.plans import catalog
    sf = "/root/testdata/sf0.01"
    a = {(r.event_id, r.refused_by) for r in catalog.QUERIES["s4_budget_admission"](spark, sf).collect()}
    b = {(r.event_id, r.refused_by) for r in catalog.QUERIES["g11_budget_admitted"](spark, sf).collect()}
    assert a == b and any(x[1] == "daily" for x in a)


def test_budget_admission_by_hand(spark):
    rng = random.Random(2)
    rows = [(i, "s", 1_704_067_200 + rng.randint(0, 400_000), rng.choice([0.001, 0.004, 0.02])) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, service string, epoch long, cost double")
    b = {"per_request": 0.01, "daily": 0.05, "monthly": 0.12, "alert": 0.8}
    got = {r.event_id: r.refused_by for r in u.budget_admitted(df, b).collect()}
    day, month = {}, 0.0
    for i, _, t, c in sorted(rows, key=lambda x: (x[2], x[0])):
        d = t // 86400
        why = "per_request" if c > 0.01 else "daily" if day.get(d, 0.0) + c > 0.05 else "monthly" if month + c > 0.12 else None
        if why is None:
            day[d] = day.get(d, 0.0) + c
            month += c
        assert got[i] == why


def test_token_bucket_by_hand(spark):
    rng = random.Random(4)
    rows = sorted((i, "svc", rng.randint(0, 20_000)) for i in range(150))
    got = {r.event_id: r.allowed for r in u.token_bucket(spark.createDataFrame(rows, "event_id long, service string, at_ms long"), 5.0, 60).collect()}
    tokens, last, used = 5.0, None, 0
    for i, _, ms in sorted(rows, key=lambda x: (x[2], x[0])):
        last = ms if last is None else last
        tokens, last = min(5.0, tokens + (ms - last) * 0.005), ms
        ok = tokens >= 1 and used < 60
        if ok:
            tokens, used = tokens - 1, used + 1
        assert got[i] == ok


def test_feedback_walk_slices(spark):
    rng = random.Random(6)
    rows = [("v", i * 400, i, rng.choice([1, 4, 9]), 0.7, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vertical string, ord long, video_id long, entity_count long, avg_confidence double, item_count long")
    level = 0.5
    for r in rows:
        level = min(0.8, level + 0.05) if r[3] > 5 else max(0.05, level - 0.05) if r[3] < 3 else level
    assert abs(ct.fold_feedback(df).head().aggressiveness - level) < 1e-9


def test_trend_edges(spark):
    rows = [(c, i, float(v)) for c, vals in {"six": [1] * 6, "seven": [5] * 7, "up": [10] * 7 + [20] * 7, "down": [20] * 7 + [10] * 7}.items() for i, v in enumerate(vals)]
    t = {r.category: r for r in mk.trend(spark.createDataFrame(rows, "category string, observed_at int, score double")).collect()}
    assert t["six"].trend == "stable" and t["seven"].velocity == 0.0
    assert t["up"].trend == "emerging" and t["down"].trend == "dying"


def test_promotion_gate_malformed_json(spark):
    c = spark.createDataFrame([("a", 60.0, 200, 20, "{bad", 0.9), ("b", 60.0, 200, 20, json.dumps({"primary": ["k"] * 10}), 0.9), ("c", 10.0, 0, 0, None, None)],
                              "category string, convergence double, products long, videos long, learned_keywords string, keyword_confidence double")
    assert {r.category: r.reason for r in mk.promotion(c).collect()} == {"a": "keywords_unparseable", "b": "promoted", "c": "convergence"}


def test_video_ids(spark):
    cases = {"https://www.youtube.com/watch?v=dQw4w9WgXcQ": "dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ": "dQw4w9WgXcQ",
             "https://youtube.com/embed/dQw4w9WgXcQ": "dQw4w9WgXcQ", "dQw4w9WgXcQ": "dQw4w9WgXcQ", "https://vimeo.com/1": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", feeds.video_id("url").alias("v"))
    assert {r.url: r.v for r in df.collect()} == cases


def test_caption_files(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps({"events": [{"tStartMs": 0, "dDurationMs": 900, "segs": [{"utf8": "one "}, {"utf8": "two"}]}, {"tStartMs": 5}]}))
    (tmp_path / "v2.json").write_text("{broken")
    rows = captions.parse_json3(captions.whole_files(spark, str(tmp_path / "*.json"))).collect()
    assert [(r.video_id, r.text, r.start_ms) for r in rows] == [("v1", "one two", 0)]
    (tmp_path / "v3.xml").write_text('<t><text start="1.5" dur="2">a &amp; b</text><text start="4" dur="1">it&apos;s</text></t>')
    x = captions.parse_xml(captions.whole_files(spark, str(tmp_path / "*.xml"))).orderBy("pos").collect()
    assert [r.text for r in x] == ["a & b", "it&apos;s"] and x[0].start_ms == 1500


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    r = lambda v, j: spark.createDataFrame([(v, "standard", j)], "video_id string, depth string, analysis_json string")
    store.put(r("a", "old"), path, 1000)
    store.put(r("a", "new"), path, 2000)
    store.put(r("b", "x"), path, 10)
    rows = spark.read.parquet(path)
    live = {x.video_id: x.analysis_json for x in store.read(rows, 10 + store.TTL_S + 5).collect()}
    assert live == {"a": "new"}
    assert store.read(store.invalidate(rows, "a"), 2000).count() == 1
    store.purge(spark, path, str(tmp_path / "live"), 10 + store.TTL_S + 5)
    assert spark.read.parquet(str(tmp_path / "live")).count() == 1


def test_late_events_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    mk_df = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, tool_name string, amount_usd double").withColumn("ts", F.col("ts").cast("timestamp"))
    mk_df([(1, "2024-01-01 00:05:00", "x", 1.0), (2, "2024-01-01 05:00:00", "x", 1.0)]).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(mk_df([]).schema).option("maxFilesPerTrigger", 1).parquet(src)
    base = str(tmp_path)

    def run():
        q = jobs.windowed_calls(stream()).writeStream.format("parquet").option("checkpointLocation", base + "/c").option("path", base + "/o").trigger(availableNow=True).start()
        q.awaitTermination()
    run()
    mk_df([(3, "2024-01-01 00:10:00", "x", 1.0), (4, "2024-01-01 09:00:00", "x", 1.0)]).coalesce(1).write.mode("append").parquet(src)
    run()
    out = {r.window.start.hour: r.calls for r in spark.read.parquet(base + "/o").collect()}
    assert out == {0: 1, 5: 1}


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_do_not_follow_the_session_zone(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        e = spark.createDataFrame([(1, "a", 86400 - 60), (2, "a", 86400 + 60), (3, "a", 86400 + 120)], "event_id long, agent_id string, epoch long")
        got = {r.event_id: (r.day, r.call_no) for r in u.free_tier(e, 2).collect()}
        assert got == {1: ("1970-01-01", 1), 2: ("1970-01-02", 1), 3: ("1970-01-02", 2)}
        c = e.select("event_id", F.lit("s").alias("service"), "epoch", F.lit(1.0).alias("cost"))
        days = {r.event_id: r.day for r in u.budget_ledger(c, "America/New_York").collect()}
        assert days == {1: "1970-01-01", 2: "1970-01-01", 3: "1970-01-01"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_free_tier_state_is_kept_by_slots_of_a_day(spark, tmp_path):
    """Two batches of one day: counts go on from the first, and agents share a few states."""
    def part(k):
        rows = [(100 * k + i, f"2024-03-01 0{k}:{i // 60:02d}:{i % 60:02d}", None if i % 31 == 0 else f"a{i % 31}") for i in range(62)]
        spark.createDataFrame(rows, "event_id long, ts string, agent_id string").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    part(1)
    part(2)
    raw = spark.readStream.schema("event_id long, ts timestamp, agent_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.free_tier_admission(raw, 3, late="1 day", slots=4).writeStream.format("memory").queryName("free_tier_slots").outputMode(
        "append").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: (r.agent_id, r.granted, r.remaining) for r in spark.table("free_tier_slots").collect()}
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 4
    want, seen = {}, {}
    for k in (1, 2):
        for i in range(62):
            a = None if i % 31 == 0 else f"a{i % 31}"
            seen[a] = seen.get(a, 0) + 1
            want[100 * k + i] = (a, seen[a] <= 3, max(3 - seen[a], 0))
    assert got == want


def test_sliding_limits_keep_one_state_a_call(spark, tmp_path):
    """Windows over several batches equal a count of every window that the watermark has passed; null agents are one agent."""
    rng = random.Random(5)
    at = sorted(rng.randrange(40 * 60) for _ in range(300))
    rows = [(i, f"2024-03-01 {m // 60:02d}:{m % 60:02d}:30" if m < 1440 else f"2024-03-02 {m // 60 - 24:02d}:{m % 60:02d}:30", rng.choice(["a", "b", None])) for i, m in enumerate(at)]
    for part in (rows[:200], rows[200:], [(999, None, "a")]):
        spark.createDataFrame(part, "event_id long, ts string, agent_id string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
            "amount_usd", F.lit(1.0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, agent_id string, amount_usd double"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    steps, until = jobs.run_to_watermark(spark, jobs.slide_calls(raw, "1 hour"), "slides")
    end = at[-1] + 0.5 - 10
    assert until.total_seconds() - 1709251200 == end * 60
    assert steps.count() == len({(r[2], m // 60) for r, m in zip(rows, at) if (m // 60 + 1) * 60 <= end})
    want = {}
    for (_, _, agent), m in zip(rows, at):
        for k in range(24):
            want[m // 60 - k, agent] = want.get((m // 60 - k, agent), 0) + 1
    for limit in (1, 5, 60):
        got = jobs.limit_breaches(steps, "1 day", "1 hour", limit, until).select(((F.unix_timestamp("window.start") - 1709251200) / 3600).cast("int"), "agent_id", "calls").collect()
        full = {k: n for k, n in want.items() if n >= limit and (k[0] + 24) * 60 <= end}
        assert len(got) == len(full) and {(s, g): n for s, g, n in got} == full
    assert jobs.limit_breaches(steps, "1 day", "1 hour", 1, None).count() == 0
    with pytest.raises(ValueError):
        jobs.limit_breaches(steps, "1 day", "7 hours", 1, until)


def test_evaluation_joins_no_names(spark):
    """Expected and found entities meet in one grouping by case; only the cases are joined. A null name meets none."""
    from shelfsight.operators import quality as ql
    cases = spark.createDataFrame([(c, 50, 0, 100, 1, 1, 1.0, 1.0) for c in (1, 2, 3)], "case_id int, score int, score_lo int, score_hi int, stages_done int, stages int, cost double, cost_cap double")
    want = spark.createDataFrame([(1, "A"), (1, "a"), (1, "b"), (1, None), (2, "x")], "case_id int, entity string")
    got = spark.createDataFrame([(1, "a", True), (1, "c", False), (1, None, True), (3, "q", None), (3, "r", True)], "case_id int, entity string, has_species boolean")
    e = ql.evaluate(want, got, cases)
    found = {r.case_id: (round(r.recall, 6), round(r.specificity, 6)) for r in e.collect()}
    assert found == {1: (33.333333, 66.666667), 2: (0.0, 0.0), 3: (0.0, 50.0)}
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_analysis_response_searches_mentions_once(spark):
    from shelfsight.plans import catalog
    from shelfsight.plans import entity_queries as eq
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    d = "/root/testdata/sf0.001"
    assert joins(catalog.QUERIES["a16_analysis_response"](spark, d)) == joins(eq.mentions(spark, d))
