"""The analytic model derived from the given tables, in Spark and as SQL text.

Transcripts are `documents`; timed segments are conversation turns; the keyword, intent and
entity dictionaries are derived from the passages of `benchmark`, so that they occur in the
text. Dictionaries hold every term that the passages give; they grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.operators.joins import containment_join, ranked, spread
from shelfsight.plans.registry import table

N_CATEGORIES = 5
EMOTIONS = ["motivation", "curiosity", "confidence"]


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(
        F.col("doc_id").alias("video_id"), "text", "lang", F.col("source").alias("channel")))


DOC = "doc AS (SELECT doc_id AS video_id, text, lang, source AS channel FROM documents)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_no"),
        (F.col("turn") * 30.0).alias("start_s"), "role", "text"))


SEG = ("seg AS (SELECT conv_id AS video_id, turn AS seg_no, turn*30e0 AS start_s, role, text "
       "FROM conversations)")


def vocab(spark: SparkSession, d: str, min_len: int = 6) -> DataFrame:
    """The words of the benchmark passages with their count and rank."""
    words = (
        table(spark, d, "benchmark")
        .select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
        .where(F.length("term") >= min_len)
        .groupBy("term").agg(F.count("*").alias("n"))
    )
    return ranked(words, -F.col("n"), F.col("term"), [F.desc("n"), F.col("term")])


def vocab_sql(min_len: int = 6, name: str = "vocab") -> str:
    return (
        f"{name} AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rk FROM ("
        "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text),'[^a-z]+')) AS term "
        f"FROM benchmark) WHERE length(term)>={min_len} GROUP BY term))")


VOCAB = vocab_sql()


def keywords(spark: SparkSession, d: str) -> list[str]:
    """Domain keywords of the preprocessing jobs, a list in the plan: every fifth vocabulary word."""
    v = vocab(spark, d).where(F.col("rk") % N_CATEGORIES == 0).orderBy("rk")
    return [x.term for x in v.collect()]


KW = f"kw AS (SELECT term, rk FROM vocab WHERE rk%{N_CATEGORIES}=0 ORDER BY rk)"


def intents(spark: SparkSession, d: str) -> DataFrame:
    """Intent phrases: (intent, intent_pos, phrase, weight, emotion, cta), one for each word."""
    pos = F.col("rk") % 6
    return vocab(spark, d).select(
        F.concat(F.lit("intent_"), pos).alias("intent"), pos.alias("intent_pos"),
        F.col("term").alias("phrase"), (F.lit(0.4) + pos * 0.1).alias("weight"),
        F.element_at(F.lit(EMOTIONS), (pos % 3 + 1).cast("int")).alias("emotion"),
        F.concat(F.lit("cta "), pos).alias("cta"))


INTENT = (
    "intents AS (SELECT 'intent_'||(rk%6) AS intent, rk%6 AS intent_pos, term AS phrase, "
    "0.4e0+(rk%6)*0.1e0 AS weight, "
    f"(['{EMOTIONS[0]}','{EMOTIONS[1]}','{EMOTIONS[2]}'])[(rk%6)%3+1] AS emotion, 'cta '||(rk%6) AS cta FROM vocab)")


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Two-word names from the benchmark passages with aliases."""
    toks = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 5)
    pairs = (
        table(spark, d, "benchmark").select(toks.alias("t"))
        .select(F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))),
            lambda i: F.struct(F.try_element_at("t", i).alias("g"), F.try_element_at("t", i + 1).alias("s")))).alias("p"))
        .where("p.s IS NOT NULL")
        .groupBy("p").agg(F.count("*").alias("n"))
    )
    pairs = ranked(pairs, -F.col("n"), F.col("p.g"), [F.desc("n"), F.col("p.g"), F.col("p.s")], name="pos")
    pos = F.col("pos")
    return pairs.select(
        pos.alias("entry_pos"),
        F.concat_ws(" ", "p.g", "p.s").alias("latin"),
        F.col("p.g").alias("genus"), F.col("p.s").alias("species"),
        F.when(pos % 3 == 0, F.concat(F.col("p.s"), F.lit(" gold"))).alias("variety"),
        F.array(F.col("p.s")).alias("common"),
        F.array(F.concat(F.substring("p.g", 1, 5), F.substring("p.s", 1, 4))).alias("synonyms"),
        F.when(pos % 4 == 0, F.array(F.concat_ws(" ", "p.s", "p.g"))).otherwise(F.array().cast("array<string>")).alias("trade"),
        (pos * 7 % 20).alias("usage_count"),
        ((pos * 3 % 10) / 10.0).alias("ambiguity"))


DICT = (
    "bt AS (SELECT list_filter(regexp_split_to_array(lower(text),'[^a-z]+'), lambda x: length(x)>=5) AS t FROM benchmark), "
    "bp AS (SELECT t[i] AS g, t[i+1] AS s FROM (SELECT t, unnest(range(1,len(t))) AS i FROM bt)), "
    f"bn AS (SELECT g, s, row_number() OVER (ORDER BY count(*) DESC, g, s) AS pos FROM bp GROUP BY g, s), "
    "dict AS (SELECT pos AS entry_pos, g||' '||s AS latin, g AS genus, s AS species, "
    "CASE WHEN pos%3=0 THEN s||' gold' END AS variety, [s] AS common, [g[1:5]||s[1:4]] AS synonyms, "
    "CASE WHEN pos%4=0 THEN [s||' '||g] ELSE [] END AS trade, pos*7%20 AS usage_count, (pos*3%10)/10e0 AS ambiguity FROM bn)")


def mentions(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """Timed entity mentions: vocabulary words found in conversation turns.

    `most` cuts the context that is carried along, not the text that is searched, to its first characters.
    """
    segs = segments(spark, d).withColumn("_lower", F.lower("text"))
    if most is not None:
        segs = segs.withColumn("text", F.substring("text", 1, most))
    ents = vocab(spark, d).select("term", "rk")
    hit = containment_join(segs, ents, "_lower", "term",
                           keep=["video_id", "seg_no", "start_s"], carry=["text"])
    return hit.select(
        "video_id", "seg_no", F.col("start_s").alias("t"), F.col("term").alias("entity"), "rk",
        F.when(F.col("rk") % 2 == 0, F.concat(F.col("term"), F.lit(" vera"))).alias("latin"),
        ((F.col("rk") * 37 + F.col("seg_no") * 11) % 100 / 100.0).alias("confidence"),
        (F.col("rk") % 3 != 0).alias("in_dictionary"),
        F.element_at(F.lit(["PLANT", "TOOL", "BOOK", "OTHER"]), (F.col("rk") % 4 + 1).cast("int")).alias("category"),
        (F.col("rk") % 5 < 3).alias("shoppable"),
        F.col("text").alias("context"))


MENTION = (
    "mention AS (SELECT video_id, seg_no, start_s AS t, term AS entity, rk, "
    "CASE WHEN rk%2=0 THEN term||' vera' END AS latin, ((rk*37+seg_no*11)%100)/100e0 AS confidence, "
    "rk%3<>0 AS in_dictionary, (['PLANT','TOOL','BOOK','OTHER'])[rk%4+1] AS category, rk%5<3 AS shoppable, "
    "text AS context FROM seg JOIN vocab ON contains(lower(text), term))")


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage events: agent, tool, method, amount, ms (null for k % 10 = 0), success."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.concat(F.lit("agent"), F.col("user_id")).alias("agent_id"),
        F.col("event_type").alias("tool_name"), "ts",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("epoch"),
        F.element_at(F.lit(["free_tier", "api_key", "x402"]), (k % 3 + 1).cast("int")).alias("payment_method"),
        F.col("value").alias("amount_usd"),
        F.when(k % 10 != 0, k).alias("ms"),
        (F.col("event_type") != "error").alias("success"), k.alias("k"))


USAGE = (
    "us0 AS (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events), "
    "us AS (SELECT event_id, 'agent'||user_id AS agent_id, event_type AS tool_name, ts, "
    "CAST(floor(epoch_us(ts)/1000000) AS BIGINT) AS epoch, (['free_tier','api_key','x402'])[k%3+1] AS payment_method, "
    "value AS amount_usd, CASE WHEN k%10<>0 THEN k END AS ms, event_type<>'error' AS success, k FROM us0)")


def products(spark: SparkSession, d: str) -> DataFrame:
    """Product mentions: line items with their part; the order is the video."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("creator_id"), "l_linenumber", "l_quantity", "l_extendedprice",
        F.col("l_discount").alias("discount"), F.col("l_shipdate").alias("seen_at"))
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return li.join(p, "product_id")


PROD = (
    "prod AS (SELECT l_orderkey AS video_id, l_partkey AS product_id, l_suppkey AS creator_id, l_linenumber, l_quantity, "
    "l_extendedprice, l_discount AS discount, l_shipdate AS seen_at, p_name AS name, p_type AS category, "
    "p_brand AS brand, p_retailprice AS price, p_size AS size FROM lineitem JOIN part ON l_partkey=p_partkey)")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
