"""Quality measurement: extraction variants, traffic split, evaluation scores, stage rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions.num import cascade, half_up, ratio


def variant_stats(daily: DataFrame) -> DataFrame:
    """daily(version, day, entities, genus_only, corrections, avg_confidence)."""
    a = daily.groupBy("version").agg(
        F.count("*").alias("days"), F.sum("entities").alias("entities"), F.sum("genus_only").alias("_g"),
        F.sum("corrections").alias("_c"), F.avg(F.coalesce("avg_confidence", F.lit(0.0))).alias("avg_confidence"))
    a = a.withColumn("genus_rate", ratio("_g", "entities")).withColumn("correction_rate", ratio("_c", "entities")).drop("_g", "_c")
    q = (F.greatest(F.lit(0.0), F.lit(100.0) - F.col("genus_rate") * 500) * 0.4
         + F.greatest(F.lit(0.0), F.lit(100.0) - F.col("correction_rate") * 1000) * 0.4 + F.col("avg_confidence") * 100 * 0.2)
    return a.withColumn("quality", q)


def performance(daily: DataFrame, min_days: int = 5) -> DataFrame:
    def mark(col, hi, hi_label, lo, lo_label, low_is_bad=False):
        x = F.col(col)
        return (F.when(x < hi, hi_label) if low_is_bad else F.when(x > hi, hi_label),
                F.when(x > lo, lo_label) if low_is_bad else F.when(x < lo, lo_label))
    m = [mark("genus_rate", 0.15, "high_genus_only_rate", 0.05, "low_genus_only_rate"),
         mark("correction_rate", 0.1, "high_correction_rate", 0.03, "low_correction_rate"),
         mark("avg_confidence", 0.7, "low_confidence", 0.85, "high_confidence", True)]
    pick = lambda i: F.filter(F.array(*[x[i] for x in m]), lambda v: v.isNotNull())
    return variant_stats(daily).where(F.col("days") >= min_days).withColumn("weaknesses", pick(0)).withColumn("strengths", pick(1))


def compare(daily: DataFrame) -> DataFrame:
    """Every pair of versions (a < b): winner and improvement of the better one."""
    s = variant_stats(daily).select("version", "quality")
    a, b = s.select(F.col("version").alias("a"), F.col("quality").alias("qa")), s.select(F.col("version").alias("b"), F.col("quality").alias("qb"))
    p = a.join(b, F.col("a") < F.col("b"))
    d = F.col("qa") - F.col("qb")
    lose = F.least("qa", "qb")
    return p.withColumn("winner", cascade([(F.abs(d) < 5, "tie"), (d > 0, "A")], "B")).withColumn(
        "improvement_pct", F.when((F.col("winner") != "tie") & (lose > 0), half_up(F.abs(d) / lose * 100, 1)))


def traffic_split(versions: DataFrame) -> DataFrame:
    """versions(version, active, share): cumulative share ranges; the leftover goes to the first."""
    w = W.orderBy(F.desc("share"), "version")
    v = versions.where("active AND share > 0").withColumn("hi", F.sum("share").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "lo", F.col("hi") - F.col("share")).withColumn("first", F.row_number().over(w) == 1)
    return v


def assign(items: DataFrame, versions: DataFrame, bucket) -> DataFrame:
    """Deterministic assignment: bucket 0-99 of the key falls into a version's share range.

    Ranges are unrolled to their hundred buckets, so the range join is an equi-join.
    """
    split = traffic_split(versions)
    slots = split.select("version", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("_b")).join(
        split.select("version", "lo", "hi", "first"), "version")
    hit = (F.col("_b") >= F.col("lo")) & (F.col("_b") < F.col("hi"))
    owner = slots.groupBy("_b").agg(F.coalesce(F.max(F.when(hit, F.col("version"))), F.max(F.when(F.col("first"), F.col("version")))).alias("version"))
    return items.withColumn("_b", bucket).join(F.broadcast(owner), "_b", "left").drop("_b")


CASES = 100_000  # cases to a task
EVAL_WEIGHTS = {"recall": 0.3, "specificity": 0.15, "monetisation": 0.2, "stages": 0.2, "cost": 0.15}


def evaluate(expected: DataFrame, actual: DataFrame, cases: DataFrame) -> DataFrame:
    """expected(case_id, entity); actual(case_id, entity, has_species);
    cases(case_id, score, score_lo, score_hi, stages_done, stages, cost, cost_cap): per-case scores and total."""
    # Both sides in one relation, dealt by case once: an entity of a case is one row, without a join of names.
    named = F.lower("entity").alias("entity")
    each = expected.select("case_id", named, F.lit(True).alias("want"), F.lit(None).cast("boolean").alias("sp"), F.lit(False).alias("got")).unionByName(
        actual.select("case_id", named, F.lit(False).alias("want"), F.col("has_species").alias("sp"), F.lit(True).alias("got")))
    # More tasks for more cases, so that what one task holds does not grow with the table.
    least = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = each.repartition(max(least, -(-cases.count() // CASES)), "case_id").groupBy("case_id", "entity").agg(F.bool_or("want").alias("want"), F.bool_or("sp").alias("sp"), F.bool_or("got").alias("got"))
    # A null name meets no name, as in a join.
    met = F.col("want") & F.col("sp").isNotNull() & F.col("entity").isNotNull()
    rates = each.groupBy("case_id").agg(
        F.when(F.bool_or("want"), F.count_if(met) / F.count_if("want") * 100).alias("recall"),
        F.when(F.bool_or("got"), F.count_if(F.col("got") & F.col("sp")) / F.count_if("got") * 100).alias("specificity"))
    d = cases.join(rates, "case_id", "left").fillna(0.0, ["recall", "specificity"])
    d = d.withColumn("monetisation", F.when(F.col("score").between(F.col("score_lo"), F.col("score_hi")), 100.0).otherwise(0.0)).withColumn(
        "stages", ratio("stages_done", "stages") * 100).withColumn(
        "cost", F.when(F.col("cost") <= F.col("cost_cap"), 100.0).otherwise(ratio("cost_cap", "cost") * 100))
    total = sum([F.col(k) * w for k, w in EVAL_WEIGHTS.items()], F.lit(0.0))
    return d.withColumn("overall", total / sum(EVAL_WEIGHTS.values())).withColumn("passed", F.col("overall") >= 80)


def stage_rates(runs: DataFrame) -> DataFrame:
    """runs(run_id, completed[], failed[]): rates per stage."""
    tagged = F.concat(F.transform("completed", lambda s: F.struct(s.alias("stage"), F.lit(1).alias("ok"))),
                      F.transform("failed", lambda s: F.struct(s.alias("stage"), F.lit(0).alias("ok"))))
    return runs.select(F.inline(tagged)).groupBy("stage").agg(
        F.sum("ok").alias("completed"), (F.count("*") - F.sum("ok")).alias("failed"), F.avg(F.col("ok").cast("double")).alias("completion_rate"))
