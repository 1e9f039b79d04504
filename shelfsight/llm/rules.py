"""Quality rules and the hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every document's word unigrams and bigrams are hashed into buckets. Two multinomials are counted
over the whole corpus, one of trusted documents and one of all; a document's score is the mean
over its n-grams of log(p_trusted / p_all), compared with a fixed threshold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import WORD, own_columns

BUCKETS = 1 << 16
WINDOW = 8
BROADCAST_ROWS = 2_000_000  # trusted ids up to this count travel as a broadcast, more by a shuffle


def _pairs(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long: each entry joined with the one `step` further on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def with_grams(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, w (words), h1 and h2 (hashes of words and of word pairs)."""
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select(*keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
        .select(*keep, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
        .select(*keep, "w", "h1", _pairs(F.col("h1"), 1).alias("h2")))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame, smooth: float = 20.0) -> list[float]:
    """log(p_trusted / p_all) of each bucket; BUCKETS rows at most reach the driver.

    A bucket's trusted share is smoothed towards its share of all documents, as if `smooth` more
    n-grams had followed it: buckets seen a few times say next to nothing.
    """
    ids = own_columns(trusted, ["doc_id"]).where("doc_id IS NOT NULL").distinct().withColumn("t", F.lit(1))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    grams = with_grams(docs.join(ids, "doc_id", "left").select("text", F.coalesce("t", F.lit(0)).alias("t")), "t")
    rows = (
        grams.select("t", F.explode(F.concat("h1", "h2")).alias("h"))
        .groupBy(_bucket(F.col("h")).alias("b")).agg(F.count("*").alias("r"), F.sum("t").alias("t"))).collect()
    total, own = sum(x["r"] for x in rows), sum(x["t"] for x in rows)
    out = [0.0] * BUCKETS
    for x in rows:
        if not own:
            break
        expected = x["r"] * own / max(total, 1)
        out[x["b"]] = round(math.log((x["t"] + smooth) / (expected + smooth)), 9)
    return out


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more, given the hash of each window."""
    def sweep(s: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))
        twice = F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    total = F.get(F.transform(F.transform(F.array(placed), sweep), covered), 0)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total).cast("long")


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = -0.12) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    docs has (doc_id, text), trusted the doc_id of trusted documents (repeats and unknown ids have no
    effect). A document fails the base rules with fewer than 20 words or with more than 30 in 100 words
    inside repeated windows of 8 words; else it is kept if its score is `threshold` or more. A text
    without words, or null, scores 0. Without trusted documents every ratio is 0. An
    empty table gives no rows; repeated rows come back as often as they stand. Other columns are not
    read.
    """
    docs = own_columns(docs, ["doc_id", "text"])
    ratio = F.from_json(F.lit(json.dumps(ratios(docs, trusted))), "array<double>")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    base = docs.select(
        "doc_id", "text", F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"))
    base = base.select("doc_id", "text", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    grams = with_grams(base, "doc_id", "n_symbols", "n_dup_lines")
    part = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.get(ratio, _bucket(x)))
    scored = grams.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", _pairs(F.col("h2"), 2).alias("h4"),
        ((part(F.col("h1")) + part(F.col("h2"))) / F.greatest(F.size("h1") + F.size("h2"), F.lit(1))).alias("score"))
    scored = scored.withColumn("h8", _pairs(F.col("h4"), 4)).withColumn("n_repeat_words", repeated_words(F.col("h8")))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
