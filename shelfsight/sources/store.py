"""Analysis-result store on append-only parquet, and response assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.functions.num import half_up
from shelfsight.operators.content import clip

KEY = ["video_id", "depth"]
TTL_S = 604_800


def put(results: DataFrame, path: str, now: int, ttl: int = TTL_S) -> None:
    """Append results(video_id, depth, analysis_json); the latest row of a key is its value."""
    results.withColumn("created_at", F.lit(now)).withColumn("expires_at", F.lit(now + ttl)).write.mode("append").partitionBy("depth").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """Latest row per key by one aggregation; no sort of a key's history."""
    rest = [x for x in rows.columns if x not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("created_at", "analysis_json")).alias("v")).select(*KEY, "v.*")


def read(rows: DataFrame, now: int) -> DataFrame:
    return latest(rows).where(F.col("expires_at") > now)


def missing(requests: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """Requests without a live entry: what still has to be analysed."""
    return requests.join(read(rows, now).select(*KEY), KEY, "left_anti")


def invalidate(rows: DataFrame, video_id: str, depth: str | None = None) -> DataFrame:
    gone = F.col("video_id") == video_id
    return rows.where(~(gone & (F.col("depth") == depth)) if depth else ~gone)


def purge(spark: SparkSession, path: str, out: str, now: int) -> None:
    """Write the live latest rows to a new folder; the caller swaps the folders."""
    read(spark.read.parquet(path), now).write.mode("errorifexists").partitionBy("depth").parquet(out)


def stats(rows: DataFrame, lookups: DataFrame, now: int) -> DataFrame:
    """Totals of the latest rows and the hit rate of a lookup log (hit boolean)."""
    s = latest(rows).agg(
        F.count("*").alias("total"), F.count_if(F.col("expires_at") <= now).alias("expired"),
        F.coalesce(F.sum(F.length("analysis_json")), F.lit(0)).alias("bytes"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    h = lookups.agg(F.count_if("hit").alias("hits"), F.count("*").alias("lookups"))
    return s.crossJoin(F.broadcast(h)).withColumn(
        "hit_rate", F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(0.0)).drop("lookups", "hits")


def keep_focus(focus: Column, dimension: str, value: Column) -> Column:
    """A dimension of the response, null when a focus list is given that leaves it out."""
    return F.when(focus.isNull() | (F.size(focus) == 0) | F.array_contains(focus, dimension), value)


def entity_lists(entities: DataFrame) -> DataFrame:
    """entities(video_id, entity, category, confidence, context): (video_id, _e), one list for each video."""
    return entities.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("entity").alias("name"), F.lower("category").alias("category"), half_up("confidence", 2).alias("confidence"),
        clip(F.col("context"), 150).alias("context")))).alias("_e"))


def response_of(listed: DataFrame) -> DataFrame:
    """One nested document for each row of videos that carries its entity list `_e`."""
    f = F.col("focus")
    return listed.select(
        "video_id", keep_focus(f, "entities", F.coalesce("_e", F.array().cast("array<struct<name:string,category:string,confidence:double,context:string>>"))).alias("entities"),
        keep_focus(f, "audience", F.struct("top_intent", half_up("commercial_value", 2).alias("commercial_value"))).alias("audience"),
        keep_focus(f, "quality", F.struct("overall", "tier")).alias("quality"))


def analysis_response(videos: DataFrame, entities: DataFrame) -> DataFrame:
    """videos(video_id, focus[], overall, tier, top_intent, commercial_value); entities(video_id, entity,
    category, confidence, context): one nested document per video."""
    return response_of(videos.join(entity_lists(entities), "video_id", "left"))
