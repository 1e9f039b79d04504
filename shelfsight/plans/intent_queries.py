"""D and A14: audience intent over conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions.num import half_up
from shelfsight.operators import intent
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r, table

DET = (
    "det AS (SELECT video_id, seg_no, intent, intent_pos, weight, emotion, cta, matches, score, weight*score AS commercial_value FROM ("
    "SELECT *, least(matches*0.3e0 + least(matches/(words/100e0),1e0)*0.4e0 + weight*0.3e0, 1e0) AS score FROM ("
    "SELECT video_id, seg_no, len(regexp_split_to_array(text,'\\s+')) AS words, intent, intent_pos, weight, emotion, cta, count(*) AS matches "
    "FROM seg JOIN intents ON contains(lower(text), phrase) GROUP BY ALL)))")
BASE = m.with_(m.SEG, m.VOCAB, m.INTENT, DET)
RANK = "floor(commercial_value*1e9+0.5e0)"
DIST = (
    "dist AS (SELECT video_id, intent, count(*) AS n, sum(score) AS total, avg(score) AS avg_score, sum(commercial_value) AS commercial, "
    "min({'s':seg_no,'v':-commercial_value,'p':intent_pos}) AS fs FROM det GROUP BY ALL)")


def detections(spark, d):
    return intent.score_segments(m.segments(spark, d), m.intents(spark, d))


@query("d1_segment_intent", BASE + f"""
SELECT video_id, seg_no, intent, matches, emotion, cta, {r('score')} AS score, {r('commercial_value')} AS commercial_value FROM det""")
def d1(spark, d):
    return detections(spark, d).select(
        "video_id", "seg_no", "intent", "matches", "emotion", "cta",
        half_up("score", 6).alias("score"), half_up("commercial_value", 6).alias("commercial_value"))


@query("d2_intent_summary", BASE[:-1] + f", {DIST} " + f"""
SELECT video_id, CAST(sum(n) AS BIGINT) AS detections, count(*) AS intents,
 arg_max(intent, {{'a':floor(total*1e9+0.5e0),'b':-fs.s,'c':-fs.v,'d':-fs.p}}) AS top_intent,
 {r('sum(commercial)')} AS total_commercial_value, {r('sum(commercial)/sum(n)')} AS avg_commercial_value
FROM dist GROUP BY video_id""")
def d2(spark, d):
    return intent.summarise(detections(spark, d)).select(
        "video_id", "detections", "intents", "top_intent",
        half_up("total_commercial_value", 6).alias("total_commercial_value"),
        half_up("avg_commercial_value", 6).alias("avg_commercial_value"))


@query("d2_emotion_distribution", BASE + "SELECT video_id, emotion, count(*) AS n FROM det GROUP BY ALL")
def d2e(spark, d):
    return intent.emotion_counts(detections(spark, d))


@query("d3_high_value_segments", BASE + f"""
SELECT video_id, seg_no, intent, {r('commercial_value')} AS commercial_value,
 row_number() OVER (PARTITION BY video_id ORDER BY {RANK} DESC, seg_no, intent_pos) AS rank FROM det QUALIFY rank<=5""")
def d3(spark, d):
    return intent.high_value(detections(spark, d)).select(
        "video_id", "seg_no", "intent", half_up("commercial_value", 6).alias("commercial_value"),
        F.col("rank").cast("long").alias("rank"))


@query("d4_taxonomy_routing", """
SELECT source, lang, CASE WHEN lower(lang) IN ('gardening','garden') THEN 'gardening'
 WHEN lower(alias) IN ('startup','startups','technology','tech','ai','saas','crypto','cryptocurrency','software','developer','coding','fintech','blockchain') THEN 'startup'
 WHEN alias='garden' THEN 'gardening' ELSE 'generic' END AS taxonomy_id, count(*) AS videos
FROM (SELECT source, lang, CASE lang WHEN 'en' THEN 'Garden' WHEN 'fr' THEN 'TECH' WHEN 'de' THEN 'ai' ELSE lang END AS a0, lower(a0) AS alias FROM documents) GROUP BY ALL""")
def d4(spark, d):
    v = F.expr("CASE lang WHEN 'en' THEN 'Garden' WHEN 'fr' THEN 'TECH' WHEN 'de' THEN 'ai' ELSE lang END")
    docs = table(spark, d, "documents").select("source", "lang", v.alias("vertical_id"))
    return intent.taxonomy_of(docs).groupBy("source", "lang", "taxonomy_id").agg(F.count("*").alias("videos"))


@query("d5_best_per_intent", BASE + f"""
SELECT video_id, intent, arg_max(seg_no, {{'a':{RANK},'b':-seg_no}}) AS seg_no, {r('max(commercial_value)')} AS commercial_value
FROM det GROUP BY ALL""")
def d5(spark, d):
    return intent.best_per_intent(detections(spark, d)).select(
        "video_id", "intent", "seg_no", half_up("commercial_value", 6).alias("commercial_value"))


@query("d6_first_detections", BASE + f"""
SELECT video_id, count(*) AS n, string_agg(seg_no||':'||intent, ',' ORDER BY rank) AS listed FROM (
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_no, {RANK} DESC, intent_pos) AS rank FROM det QUALIFY rank<=20) GROUP BY video_id""")
def d6(spark, d):
    f = intent.first_detections(detections(spark, d))
    item = F.struct("rank", F.concat_ws(":", "seg_no", "intent").alias("x"))
    return f.groupBy("video_id").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda y: y["x"]), ",").alias("listed"))


@query("a14_intent_export", BASE[:-1] + f""", {DIST},
 sm AS (SELECT video_id, arg_max(intent, {{'a':floor(total*1e9+0.5e0),'b':-fs.s,'c':-fs.v,'d':-fs.p}}) AS top_intent, {r('sum(commercial)')} AS total FROM dist GROUP BY video_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {RANK} DESC, seg_no, intent_pos) AS rank FROM det)
SELECT video_id, any_value(top_intent) AS top_intent, any_value(sm.total) AS total, string_agg(seg_no||':'||intent, ',' ORDER BY seg_no, intent_pos) AS listed,
 string_agg(CASE WHEN rank<=10 THEN seg_no||':'||intent END, ',' ORDER BY rank) AS top FROM rk JOIN sm USING (video_id) GROUP BY video_id""")
def a14(spark, d):
    e = intent.export_json(detections(spark, d))
    item = "array<struct<seg_no:long,intent:string>>"
    j = F.from_json("json", f"summary struct<top_intent:string,total_commercial_value:double>, high_value_segments {item}, all_detections {item}")
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["seg_no"], x["intent"])), ",")
    return e.select("video_id", j.alias("j")).select(
        "video_id", "j.summary.top_intent", half_up("j.summary.total_commercial_value", 6).alias("total"),
        line("j.all_detections").alias("listed"), line("j.high_value_segments").alias("top"))
