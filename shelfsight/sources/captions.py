"""Caption scans: JSON3 and XML bodies to one row per segment; bad bodies give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.functions import text as tx

JSON3 = "events array<struct<tStartMs bigint, dDurationMs bigint, segs array<struct<utf8 string>>>>"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, body): one row per caption file, the id taken from the file name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)*$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("video_id"), F.col("value").alias("body"))


def parse_json3(bodies: DataFrame) -> DataFrame:
    e = bodies.select("video_id", F.posexplode(F.from_json("body", JSON3)["events"]).alias("pos", "e"))
    text = tx.strip_ws(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    return e.select("video_id", "pos", F.coalesce("e.tStartMs", F.lit(0)).alias("start_ms"),
                    F.coalesce("e.dDurationMs", F.lit(0)).alias("duration_ms"), text.alias("text")).where("length(text) > 0")


def parse_xml(bodies: DataFrame) -> DataFrame:
    pat = r'<text start="([^"]*)" dur="([^"]*)"[^>]*>([\s\S]*?)</text>'
    part = lambda i: F.regexp_extract_all("body", F.lit(pat), F.lit(i))
    z = F.arrays_zip(part(1).alias("s"), part(2).alias("d"), part(3).alias("t"))
    e = bodies.select("video_id", F.posexplode(z).alias("pos", "z"))
    text = F.col("z.t")
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    ms = lambda x: F.floor(F.col(x).cast("double") * 1000 + 0.5)
    return e.select("video_id", "pos", ms("z.s").alias("start_ms"), ms("z.d").alias("duration_ms"), tx.strip_ws(text).alias("text")).where(
        "length(text) > 0")


def normalise(raw: DataFrame) -> DataFrame:
    """raw(video_id, pos, start_ms, duration_ms, text): bracketed notes out, seconds and clock in."""
    t = tx.strip_ws(F.regexp_replace("text", r"\[.*?\]", ""))
    start = F.col("start_ms") / 1000.0
    return raw.select("video_id", "pos", start.alias("start_s"), (F.col("duration_ms") / 1000.0).alias("duration_s"),
                      tx.clock(start).alias("ts"), t.alias("text")).where("length(text) > 0")


def full_text(segments: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("start_s", "pos", "text")))
    return segments.groupBy("video_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("full_text"))
