"""Audience intent: segment scoring, per-video summary, rankings and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions.num import cap
from shelfsight.operators.joins import containment_join

INTENT_COLUMNS = ["intent", "intent_pos", "weight", "emotion", "cta"]


def score_segments(segments: DataFrame, phrases: DataFrame) -> DataFrame:
    """One row per (segment, intent) with at least one phrase in the text.

    segments(video_id, seg_no, text, ...); phrases(intent, intent_pos, phrase, weight,
    emotion, cta). Phrases are found through the substring index, any number of them.
    """
    seg = segments.withColumn("_lower", F.lower("text")).withColumn(
        "_words", F.size(F.split("text", r"\s+")))
    hits = containment_join(
        seg, phrases.withColumn("phrase", F.lower("phrase")), "_lower", "phrase",
        keep=["video_id", "seg_no", "_words"])
    m = F.col("matches")
    density = cap(m / (F.col("_words") / 100.0), 1.0)
    return (
        hits.groupBy("video_id", "seg_no", "_words", *INTENT_COLUMNS)
        .agg(F.count("*").alias("matches"), F.array_sort(F.collect_list("phrase")).alias("phrases"))
        .withColumn("score", cap(m * 0.3 + density * 0.4 + F.col("weight") * 0.3, 1.0))
        .withColumn("commercial_value", F.col("weight") * F.col("score"))
        .drop("_words")
    )


def intent_distribution(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id", "intent").agg(
        F.count("*").alias("n"), F.sum("score").alias("total_score"),
        F.avg("score").alias("avg_score"), F.sum("commercial_value").alias("commercial"),
        F.min(F.struct("seg_no", (-F.col("commercial_value")).alias("v"), "intent_pos")).alias("first_seen"),
        F.first("emotion").alias("emotion"))


def summarise(detections: DataFrame) -> DataFrame:
    """Per video: top intent (largest total score, first seen wins), totals and counts."""
    d = intent_distribution(detections)
    return d.groupBy("video_id").agg(
        F.sum("n").alias("detections"), F.count("*").alias("intents"),
        F.max_by("intent", F.struct(
            F.floor(F.col("total_score") * 1e9 + 0.5),
            -F.col("first_seen.seg_no"), -F.col("first_seen.v"), -F.col("first_seen.intent_pos"))).alias("top_intent"),
        F.sum("commercial").alias("total_commercial_value"),
        (F.sum("commercial") / F.sum("n")).alias("avg_commercial_value"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("intent", "avg_score")))).alias("intent_distribution"))


def emotion_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id", "emotion").agg(F.count("*").alias("n"))


def _ranked(detections: DataFrame):
    return W.partitionBy("video_id").orderBy(
        F.desc(F.floor(F.col("commercial_value") * 1e9 + 0.5)), "seg_no", "intent_pos")


def high_value(detections: DataFrame, k: int = 5) -> DataFrame:
    return (detections.withColumn("rank", F.row_number().over(_ranked(detections)))
            .where(F.col("rank") <= k))


def best_per_intent(detections: DataFrame) -> DataFrame:
    best = detections.groupBy("video_id", "intent").agg(F.max_by(
        F.struct("seg_no", "score", "commercial_value", "emotion", "cta", "intent_pos"),
        F.struct(F.floor(F.col("commercial_value") * 1e9 + 0.5), -F.col("seg_no"))).alias("b"))
    return best.select("video_id", "intent", "b.*")


def first_detections(detections: DataFrame, k: int = 20) -> DataFrame:
    w = W.partitionBy("video_id").orderBy(
        "seg_no", F.desc(F.floor(F.col("commercial_value") * 1e9 + 0.5)), "intent_pos")
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def taxonomy_of(verticals: DataFrame, col: str = "vertical_id", aliases: dict | None = None) -> DataFrame:
    """Route a vertical id to the taxonomy that serves it; unknown ids get `generic`."""
    aliases = aliases or fixed.TAXONOMY_ALIASES
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return verticals.withColumn(
        "taxonomy_id", F.coalesce(F.try_element_at(pairs, F.lower(col)), F.lit("generic")))


def export_json(detections: DataFrame, k: int = 10) -> DataFrame:
    """One JSON document per video: summary, top-k segments and all detections."""
    item = F.struct("seg_no", "intent", "score", "commercial_value", "phrases")
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "intent_pos", item.alias("d"))))
    every = detections.groupBy("video_id").agg(F.transform(ordered, lambda x: x["d"]).alias("all"))
    top = high_value(detections, k).groupBy("video_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("d")))), lambda x: x["d"]).alias("top"))
    body = F.to_json(F.struct(
        "video_id",
        F.struct("top_intent", "total_commercial_value", "avg_commercial_value", "intent_distribution").alias("summary"),
        F.col("top").alias("high_value_segments"), F.col("all").alias("all_detections")))
    return summarise(detections).join(top, "video_id").join(every, "video_id").select(
        "video_id", body.alias("json"), F.size("all").alias("n_detections"), F.size("top").alias("n_top"))
