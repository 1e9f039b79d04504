"""URL, video, caption-track, program-feed and extraction-result normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions.num import c

ID = r"[A-Za-z0-9_-]{11}"
URL_PATTERNS = [
    rf"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/|youtube\.com/v/)({ID})",
    rf"youtube\.com/watch\?.*v=({ID})",
    rf"^({ID})$",
]


def video_id(url) -> Column:
    """Id of a watch, short, embed or v link or a bare id; null when there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c(url), p, 1), F.lit("")) for p in URL_PATTERNS])


def valid_videos(urls: DataFrame) -> DataFrame:
    """urls(ord, url): one row per video id, the first link kept."""
    u = urls.withColumn("video_id", video_id("url")).where("video_id IS NOT NULL")
    return u.groupBy("video_id").agg(F.min_by("url", "ord").alias("url"), F.count("*").alias("links"))


def iso_seconds(duration) -> Column:
    n = lambda u: F.coalesce(F.nullif(F.regexp_extract(c(duration), rf"(\d+){u}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.when(c(duration).rlike(r"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?"), n("H") * 3600 + n("M") * 60 + n("S")).otherwise(F.lit(0))


VIDEO = ("id string, title string, duration string, viewCount string, tags array<string>, "
         "thumbnails struct<maxres string, high string, medium string, `default` string>")


def video_metadata(dump: DataFrame) -> DataFrame:
    """dump(body JSON): duration in seconds, views default 0, best thumbnail, nullable tags."""
    v = dump.select(F.from_json("body", VIDEO).alias("v"))
    th = [F.col(f"v.thumbnails.{k}") for k in ("maxres", "high", "medium", "default")]
    return v.where("v.id IS NOT NULL").select(
        F.col("v.id").alias("video_id"), F.col("v.title").alias("title"), iso_seconds(F.col("v.duration")).alias("duration_s"),
        F.coalesce(F.col("v.viewCount").try_cast("long"), F.lit(0)).alias("views"), F.coalesce(*th).alias("thumbnail"), F.col("v.tags").alias("tags"))


def caption_tracks(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """tracks(video_id, pos, lang, kind): English only, manual before asr, first wins."""
    en = tracks.where((F.lower("lang") == "en") | F.lower("lang").startswith("en-"))
    best = en.groupBy("video_id").agg(F.min(F.struct((F.col("kind") == "asr").alias("asr"), "pos")).alias("b"))
    return videos.select("video_id").join(best, "video_id", "left").select(
        "video_id", F.col("b.pos").alias("pos"),
        F.when(F.col("b").isNull(), "none").when(F.col("b.asr"), "auto").otherwise("manual").alias("caption_type"))


PROGRAM = ("advertiserId bigint, advertiserName string, primaryRegion struct<name string>, programTerms string, "
           "commissionGroups array<struct<groupName string, minCommission double, maxCommission double>>, cookiePeriod int")


def program_feed(feed: DataFrame) -> DataFrame:
    p = feed.select(F.from_json("body", PROGRAM).alias("p")).where("p.advertiserId IS NOT NULL")
    groups = F.transform(F.coalesce("p.commissionGroups", F.array().cast("array<struct<groupName:string,minCommission:double,maxCommission:double>>")),
                         lambda g: F.struct(F.coalesce(g["minCommission"], F.lit(0.0)).alias("min"), F.coalesce(g["maxCommission"], F.lit(0.0)).alias("max")))
    return p.select(F.col("p.advertiserId").alias("program_id"), F.col("p.advertiserName").alias("name"),
                    F.coalesce("p.primaryRegion.name", F.lit("Unknown")).alias("region"), F.col("p.programTerms").alias("terms"),
                    groups.alias("commission_groups"), F.coalesce("p.cookiePeriod", F.lit(30)).cast("long").alias("cookie_days"))


EXTRACTION = ("entities array<struct<name string, category string, confidence double>>, "
              "commerceItems array<struct<name string, category string, confidence double>>, "
              "actions array<struct<keyword string, category string>>, language string, commercialIntent struct<score double>")


def extraction_results(raw: DataFrame) -> DataFrame:
    """raw(video_id, body): code fences stripped, JSON parsed; `ok` is false for rejects, whose `body` stays."""
    body = F.trim(F.regexp_replace("body", r"```(?:json)?\s*", ""))
    r = raw.select("video_id", body.alias("_b")).withColumn("r", F.from_json("_b", EXTRACTION))
    ok = F.try_parse_json("_b").isNotNull()
    return r.select("video_id", "r", ok.alias("ok"), F.when(~ok, F.col("_b")).alias("body"))


def extracted_entities(results: DataFrame) -> DataFrame:
    """Confidence from 0-100 (default 50) to 0-1."""
    e = results.where("ok").select("video_id", F.posexplode("r.entities").alias("pos", "e"))
    return e.select("video_id", "pos", F.col("e.name").alias("entity"), F.upper("e.category").alias("category"),
                    (F.coalesce("e.confidence", F.lit(50.0)) / 100).alias("confidence"))


def extracted_items(results: DataFrame) -> DataFrame:
    """(video_id, pos, item, category, confidence): commerce items, confidence as for entities."""
    e = results.where("ok").select("video_id", F.posexplode("r.commerceItems").alias("pos", "e"))
    return e.select("video_id", "pos", F.col("e.name").alias("item"), F.upper("e.category").alias("category"),
                    (F.coalesce("e.confidence", F.lit(50.0)) / 100).alias("confidence"))


def extracted_actions(results: DataFrame) -> DataFrame:
    """(video_id, pos, keyword, category) of the actions named."""
    e = results.where("ok").select("video_id", F.posexplode("r.actions").alias("pos", "e"))
    return e.select("video_id", "pos", "e.keyword", "e.category")


def extracted_summary(results: DataFrame) -> DataFrame:
    """(video_id, language, intent_score): one row for each answer that parses."""
    return results.where("ok").select("video_id", F.col("r.language").alias("language"), F.col("r.commercialIntent.score").alias("intent_score"))


def rejected(results: DataFrame) -> DataFrame:
    """(video_id, body) of the answers that are no JSON."""
    return results.where("NOT ok").select("video_id", "body")


DICTIONARY_ENTRY = (
    "latinName string, commonNames array<string>, synonyms array<string>, genus string, species string, variety string, "
    "tradeNames array<string>, taxonomyLevel string, usageCount bigint, ambiguityScore double, _corrupt string")


def dictionary_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, body, entry, ok): the elements of every dictionary file below a folder.

    A file is one JSON array of entries and is parsed whole in one row. An element is ok when it is an
    object of the expected types with a Latin name. A file that is no array gives one row that is not
    ok, without a place; an empty array gives none.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"), F.from_json("value", "array<string>").alias("_items"))
    kinds = {"columnNameOfCorruptRecord": "_corrupt"}
    each = raw.where("_items IS NOT NULL").select("file", F.posexplode("_items").alias("place", "body")).withColumn(
        "entry", F.from_json("body", DICTIONARY_ENTRY, kinds))
    ok = F.col("entry").isNotNull() & F.col("entry._corrupt").isNull() & (F.length(F.trim("entry.latinName")) > 0)
    each = each.withColumn("ok", F.coalesce(ok, F.lit(False)))
    broken = raw.where("_items IS NULL").select(
        "file", F.lit(None).cast("int").alias("place"), "body", F.lit(None).cast(each.schema["entry"].dataType).alias("entry"), F.lit(False).alias("ok"))
    return each.unionByName(broken)


def dictionary_entries(elements: DataFrame) -> DataFrame:
    """The entries of `dictionary_files` as a dictionary, numbered from 1 in file order.

    Files are ordered by path. The number is the place among the good entries of the file plus the
    sizes of the files before, so only one row for each file is ordered as a whole.
    """
    good = elements.where("ok")
    own = F.row_number().over(W.partitionBy("file").orderBy("place"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    sizes = good.groupBy("file").agg(F.count("*").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    empty = F.array().cast("array<string>")
    return good.withColumn("_own", own).join(sizes, "file").select(
        (F.col("_own") + F.col("_off")).cast("long").alias("entry_pos"), F.col("entry.latinName").alias("latin"), "entry.genus", "entry.species",
        "entry.variety", F.coalesce("entry.commonNames", empty).alias("common"), F.coalesce("entry.synonyms", empty).alias("synonyms"),
        F.coalesce("entry.tradeNames", empty).alias("trade"), F.coalesce("entry.usageCount", F.lit(0)).alias("usage_count"),
        F.coalesce("entry.ambiguityScore", F.lit(0.0)).alias("ambiguity"), F.col("entry.taxonomyLevel").alias("level"))


def dictionary_rejects(elements: DataFrame) -> DataFrame:
    """(file, place, body) of what is no entry; a null place marks a whole file."""
    return elements.where("NOT ok").select("file", "place", "body")
