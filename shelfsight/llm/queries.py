"""Registered queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import audit, bpe, collocations, debruijn, decontam, licences, maxent, neardup, quality, rules, secrets, sharding, toolcalls
from shelfsight.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op2_quadratic_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op3_secret_ownership")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op4_ngram_likelihood_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return rules.apply_rules(table(spark, sf_dir, "documents"), trusted)


@query("op5_kd_tree_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


@query("op6_maxent_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


@query("op7_licence_digests", licences.oracle_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


#: Tools of the chat query: (name, key, type, required).
SCHEMAS = [("lookup", "query", "STRING", True), ("lookup", "limit", "BIGINT", True),
           ("search", "query", "STRING", True), ("search", "limit", "BIGINT", False), ("search", "page", "BIGINT", True)]
OP8_SQL = """
WITH u AS (SELECT *, length(text) AS n FROM conversations),
calls AS (SELECT conv_id, turn, 'c' || turn AS call_id, text,
    CASE WHEN n < 150 THEN 'lookup' WHEN n < 400 THEN 'search' ELSE 'archive' END AS name,
    CASE WHEN contains(text, chr(10)) THEN NULL ELSE n END AS lim FROM u WHERE role = 'user'),
results AS (SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text FROM u WHERE role = 'assistant'),
c AS (SELECT calls.*, r.conv_id IS NOT NULL AS answered, p.conv_id IS NOT NULL AS waits, pc.conv_id IS NOT NULL AS chained
    FROM calls LEFT JOIN results r USING (conv_id, call_id)
    LEFT JOIN results p ON p.conv_id = calls.conv_id AND calls.turn % 4 IN (2, 3) AND p.call_id = 'c' || (calls.turn - 2)
    LEFT JOIN calls pc ON pc.conv_id = calls.conv_id AND pc.call_id = p.call_id),
lv AS (SELECT *, CASE WHEN NOT waits THEN 0 WHEN chained THEN 2 ELSE 1 END AS level FROM c),
rows_ AS (
    SELECT conv_id, turn, level, 'call' AS kind, call_id, name,
        CASE WHEN name = 'archive' THEN 'unknown tool' WHEN name = 'lookup' AND lim IS NULL THEN 'missing limit'
            WHEN name = 'search' THEN 'missing page' WHEN answered THEN 'ok' ELSE 'pending' END AS status,
        CASE WHEN lim IS NULL THEN '{"query":' || to_json(text) || '}'
            ELSE '{"limit":' || lim || ',"query":' || to_json(text) || '}' END AS body FROM lv
    UNION ALL
    SELECT r.conv_id, r.turn, coalesce(lv.level + 1, 0), 'result', r.call_id, lv.name,
        CASE WHEN lv.conv_id IS NULL THEN 'orphan' ELSE 'ok' END, '{"content":' || to_json(r.text) || '}'
    FROM results r LEFT JOIN lv USING (conv_id, call_id)),
m AS (SELECT *, '{"body":' || body || ',"call_id":"' || call_id || '","kind":"' || kind || '"'
    || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || '}' AS message FROM rows_)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, kind, call_id) - 1 AS position,
    kind, call_id, name, status, message FROM m"""


@query("op8_tool_call_linking", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls, the assistant turns that follow as their results."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n = F.length("text").cast("long")
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", F.concat(F.lit("c"), "turn").alias("call_id"),
        F.when(n < 150, "lookup").when(n < 400, "search").otherwise("archive").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), F.when(~F.col("text").contains("\n"), n).alias("limit"))).alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    needs = calls.where("turn % 4 IN (2, 3)").select("conv_id", "call_id", F.concat(F.lit("c"), F.col("turn") - 2).alias("needs"))
    schemas = spark.createDataFrame(SCHEMAS, "name string, key string, type string, required boolean")
    return toolcalls.link(calls, results, schemas, needs)


@query("op9_positional_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, percent=5)


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op11_debruijn_substrings")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"), size=13)


@query("op12_setm_collocations", collocations.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, percent=50, top=2000)


@query("op13_removal_ranks", audit.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
