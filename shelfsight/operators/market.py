"""Market layer: convergence, internal signals, affinity, lifecycle, channels, programs, clusters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions.num import c, cap, cascade, clamp, half_up, ladder, ratio
from shelfsight.operators.joins import any_contained

# --- convergence -----------------------------------------------------------------------


def convergence(demand="demand", commission="commission", authority="authority", competition="competition") -> Column:
    return clamp(c(demand) * c(commission) * c(authority) / 10000.0 - c(competition) / 2.0, 0, 100)


def competition(categories: DataFrame) -> DataFrame:
    """categories(competitors, volume, quality): competition, barrier and data quality."""
    comp = cap(F.col("competitors") / 50.0 * 100, 100) * 0.6 + cap(F.col("volume") / 500.0 * 100, 100) * 0.4
    return categories.withColumn("competition", comp).withColumn(
        "barrier", F.col("competition") * 0.5 + F.col("quality") * 0.5).withColumn(
        "competition_quality", F.when(F.col("volume") > 10, 1.0).otherwise(F.col("volume") / 10.0))


TREND_BANDS = [(20.0, "emerging"), (5.0, "rising"), (-5.0, "stable"), (-20.0, "declining")]


def trend(history: DataFrame, key: str = "category") -> DataFrame:
    """history(category, observed_at, score), one row per period: latest 7 against the 7 before."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc("observed_at")))
    n = F.count("*").over(W.partitionBy(key))
    h = history.withColumn("_r", rn).withColumn("_n", n).where("_r <= 14")
    a = h.groupBy(key).agg(
        F.max("_n").alias("samples"), F.avg(F.when(F.col("_r") <= 7, F.col("score"))).alias("recent"),
        F.avg(F.when(F.col("_r") > 7, F.col("score"))).alias("previous"))
    prev = F.coalesce("previous", "recent")
    v = F.when((F.col("samples") >= 7) & (prev > 0), (F.col("recent") - prev) / prev * 100).otherwise(0.0)
    a = a.withColumn("velocity", v)
    band = cascade([(F.col("velocity") > b, t) for b, t in TREND_BANDS], "dying")
    return a.withColumn("trend", F.when(F.col("samples") < 7, "stable").otherwise(band)).drop("recent", "previous")


def opportunity(d: DataFrame) -> DataFrame:
    """Adds opportunity, priority and recommendation to scored categories."""
    bonus = cascade([(F.col("trend") == "emerging", 20.0), (F.col("trend") == "rising", 10.0)], 0.0)
    d = d.withColumn("opportunity", cap(F.col("convergence") * 0.5 + bonus + (F.lit(100.0) - F.col("competition")) * 0.2, 100))
    conv = F.col("convergence")
    return d.withColumn("priority", ladder("opportunity", [(35, "critical"), (30, "high"), (25, "medium"), (20, "low")], "avoid")).withColumn(
        "recommendation", cascade([
            ((conv >= 25) & (F.col("trend") == "emerging"), "invest_now"),
            ((conv >= 20) & (F.col("authority") < 50), "partner_first"),
            (conv >= 15, "test_small"), (conv >= 10, "watch_closely")], "skip"))


def financials(d: DataFrame) -> DataFrame:
    comp = F.col("competition")
    rev = half_up(F.col("demand") * F.col("commission") / 100 * ((F.lit(100.0) - comp) / 100) * 15)
    cost = half_up((comp / 100 + 1.0) * 300)
    return d.withColumn("revenue", rev).withColumn("cost", cost).withColumn(
        "roi", F.when(F.col("cost") > 0, half_up(F.col("revenue") / F.col("cost"), 1)).otherwise(0.0)).withColumn(
        "weeks_to_revenue", cascade([(comp > 70, 8), (comp > 50, 5)], 3))


def confidence_and_reasoning(d: DataFrame) -> DataFrame:
    """Needs trend_quality, competition_quality, samples; adds confidence and a sentence."""
    conf = (F.col("trend_quality") + F.col("competition_quality")) / 2 * cap(F.col("samples") / 7.0, 1)
    whole = lambda x: half_up(x).cast("long").cast("string")
    words = F.filter(F.array(
        F.concat(ladder("demand", [(75, "Strong consumer demand ("), (60, "Moderate demand (")], "Low demand ("), whole("demand"), F.lit("/100)")),
        ladder("commission", [(70, "excellent profit margins"), (50, "decent profit margins")], "low profit margins"),
        ladder("authority", [(70, "authoritative creators present"), (50, "some authority established")], "authority gap - partnership opportunity"),
        cascade([(F.col("competition") < 40, "low competition"), (F.col("competition") < 70, "moderate competition")], "high competition"),
        cascade([(F.col("trend") == "emerging", "rapid growth"), (F.col("trend") == "rising", "steady growth"), (F.col("trend") == "declining", "declining trend")])),
        lambda x: x.isNotNull())
    label = F.upper(F.replace("recommendation", F.lit("_"), F.lit(" ")))
    label = F.when(F.col("recommendation") == "invest_now", "GREEN LIGHT").otherwise(label)
    return d.withColumn("confidence", conf).withColumn("reasoning", F.concat(label, F.lit(": "), F.array_join(words, ", "), F.lit(".")))


def detect(categories: DataFrame, history: DataFrame) -> DataFrame:
    d = competition(categories).withColumn("convergence", convergence()).join(trend(history), "category", "left")
    d = d.fillna({"samples": 0, "velocity": 0.0, "trend": "stable"})
    return confidence_and_reasoning(financials(opportunity(d)))


def opportunities(detected: DataFrame, min_score: float = 0.0) -> DataFrame:
    return detected.where(F.col("opportunity") >= min_score * 100).orderBy(F.desc("opportunity"), "category")


# --- internal signals from facts ---------------------------------------------------------


def category_video_facts(mentions: DataFrame) -> DataFrame:
    """First level of every internal signal: one row per (category, video)."""
    return mentions.groupBy("category", "video_id").agg(
        F.count("*").alias("matches"), F.sum("weight").alias("weight"), F.count_if("is_item").alias("items"))


def internal_demand(facts: DataFrame, videos: DataFrame, cut) -> DataFrame:
    """facts from category_video_facts; videos(video_id, views, published). Recency splits at `cut`."""
    recent = F.col("published") >= F.lit(cut)
    a = facts.join(videos, "video_id").groupBy("category").agg(
        F.sum("matches").alias("matches"), (F.sum("weight") / F.sum("matches")).alias("avg_weight"),
        F.count("*").alias("videos"), F.sum("items").alias("items"), F.sum("views").alias("views"),
        F.avg("views").alias("avg_views"), F.coalesce(F.avg(F.when(recent, F.col("views"))), F.lit(0.0)).alias("recent_views"),
        F.coalesce(F.avg(F.when(~recent, F.col("views"))), F.lit(0.0)).alias("older_views"))
    total = videos.agg(F.count("*").alias("_tv"))
    a = a.crossJoin(F.broadcast(total)).withColumn("_ti", F.sum("items").over(W.partitionBy()))
    score = (cap(F.col("matches") * F.col("avg_weight") * 2, 100) * 0.35 + cap(ratio("videos", "_tv") * 100, 100) * 0.25
             + cap(ratio("items", "_ti") * 100, 100) * 0.25 + cap(F.col("avg_views") / 100, 100) * 0.15)
    t = cascade([(F.col("recent_views") > F.col("older_views") * 1.2, "rising"),
                 (F.col("recent_views") < F.col("older_views") * 0.8, "declining")], "stable")
    a = a.withColumn("recent_trend", t)
    mult = cascade([(F.col("recent_trend") == "rising", 1.2), (F.col("recent_trend") == "declining", 0.8)], 1.0)
    points = sum([F.when(F.col(x) > 0, 1).otherwise(0) for x in ["videos", "items", "views"]], F.when(F.col("matches") > 0, 1).otherwise(0))
    return a.withColumn("demand", clamp(half_up(score * mult), 0, 100)).withColumn(
        "demand_confidence", points * 25.0).drop("_tv", "_ti")


def internal_commission(categories: DataFrame) -> DataFrame:
    """categories(category, available, products, rate, linked, links, programs)."""
    s = (cap(ratio("available", "products") * 500, 100) * 0.4 + F.col("rate") * 6 * 0.35
         + cap(ratio("linked", "links") * 300, 100) * 0.25)
    return categories.withColumn("commission", clamp(half_up(s), 0, 100)).withColumn(
        "commission_confidence", F.greatest(F.lit(50.0), cap(F.col("programs") / 3.0 * 100, 100)))


def internal_authority(creators: DataFrame, total_channels: DataFrame) -> DataFrame:
    """creators(category, creator_id, videos, avg_entities, avg_items); top 10 by quality count."""
    q = half_up(cap(F.col("avg_entities") / 15 * 50 + F.col("avg_items") / 8 * 50, 100))
    w = W.partitionBy("category").orderBy(F.desc("_q"), "creator_id")
    r = creators.withColumn("_q", q).withColumn("_r", F.row_number().over(w))
    a = r.groupBy("category").agg(
        F.count("*").alias("creators"), F.sum("videos").alias("creator_videos"),
        F.avg(F.when(F.col("_r") <= 10, F.col("_q"))).alias("avg_quality"))
    a = a.crossJoin(F.broadcast(total_channels.select(F.col("channels").alias("_c"))))
    s = (cap(ratio("creators", "_c") * 300, 100) * 0.3 + F.col("avg_quality") * 0.4
         + cap(ratio("creator_videos", "creators") * 20, 100) * 0.3)
    return a.withColumn("authority", clamp(half_up(s), 0, 100)).withColumn(
        "authority_confidence", F.greatest(F.lit(30.0), cap(F.col("creator_videos") / 10.0 * 100, 100))).drop("_c")


def internal_convergence(demand: DataFrame, commission: DataFrame, authority: DataFrame) -> DataFrame:
    d = demand.join(commission, "category").join(authority, "category")
    t = cascade([(F.col("recent_trend") == "rising", "emerging"), (F.col("recent_trend") == "declining", "declining")], "stable")
    return d.withColumn("convergence", half_up(F.col("demand") * F.col("commission") * F.col("authority") / 10000)).withColumn(
        "confidence", (F.col("demand_confidence") + F.col("commission_confidence") + F.col("authority_confidence")) / 3).withColumn(
        "trend_direction", t)


# --- affinity ----------------------------------------------------------------------------


def co_category_counts(members: DataFrame) -> DataFrame:
    """members(category, member): per unordered pair, members in both and members in either.

    Members with the same set of categories are counted together first, so the pairs that
    are emitted grow with the distinct sets, not with the members.
    """
    sets = members.distinct().groupBy("member").agg(F.array_sort(F.collect_set("category")).alias("s"))
    sets = sets.groupBy("s").agg(F.count("*").alias("n"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = sets.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("both"))
    size = sets.select("n", F.explode("s").alias("category")).groupBy("category").agg(F.sum("n").alias("size"))
    sa, sb = size.select(F.col("category").alias("a"), F.col("size").alias("na")), size.select(F.col("category").alias("b"), F.col("size").alias("nb"))
    return both.join(sa, "a").join(sb, "b").select("a", "b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either"))


def overlap(members: DataFrame, name: str) -> DataFrame:
    return co_category_counts(members).select("a", "b", (F.col("both") / F.col("either") * 100).alias(name))


def keyword_overlap(keywords: DataFrame) -> DataFrame:
    """keywords(category, keyword): Jaccard * 100 over an inverted index."""
    return overlap(keywords.select("category", F.lower("keyword").alias("member")), "keyword")


AFFINITY_WEIGHTS = {"video": 0.3, "keyword": 0.25, "audience": 0.2, "commerce": 0.15, "creator": 0.1}


def affinity(categories: DataFrame, **overlaps: DataFrame) -> DataFrame:
    """categories(category, parent). Every unordered pair of the category dimension."""
    a = categories.select(F.col("category").alias("a"), F.col("parent").alias("pa"))
    b = categories.select(F.col("category").alias("b"), F.col("parent").alias("pb"))
    d = a.join(b, F.col("a") < F.col("b"))
    for name, o in overlaps.items():
        d = d.join(o, ["a", "b"], "left")
    score = F.lit(0.0)
    for name, wt in AFFINITY_WEIGHTS.items():
        if name in overlaps:
            score = score + F.coalesce(F.col(name), F.lit(0.0)) * wt
    # The sample is the sum of the three overlaps that come from facts; 100 and more is full confidence.
    sample = F.lit(0.0)
    for name in ("video", "commerce", "creator"):
        if name in overlaps:
            sample = sample + F.coalesce(F.col(name), F.lit(0.0))
    d = d.withColumn("score", score).withColumn("sample_size", half_up(sample).cast("long")).withColumn(
        "confidence", cap(sample / 100, 1.0))
    relation = cascade([
        ((F.col("pa") == F.col("b")) | (F.col("pb") == F.col("a")), "parent_child"),
        (F.col("pa") == F.col("pb"), "sibling"), (F.col("score") >= 50, "adjacent")], "unrelated")
    return d.withColumn("relation", relation)


def find_categories(wanted: DataFrame, categories: DataFrame) -> DataFrame:
    """wanted(wanted) with the category meant, or null: categories(category, key, name).

    A category is found by its key (the text in lower case, blanks as hyphens), by its name in any
    case or by its id as written; the first by id where several match. One equi-join.
    """
    def forms(**columns):
        return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("form")) for k, c in columns.items()])).alias("_f")
    w = F.col("wanted")
    asked = wanted.select("wanted").distinct().select("wanted", forms(
        key=F.regexp_replace(F.lower(w), r"\s+", "-"), name=F.lower(w), id=w)).select("wanted", "_f.*")
    known = categories.select("category", forms(key=F.col("key"), name=F.lower("name"), id=F.col("category"))).select("category", "_f.*")
    return asked.join(known, ["kind", "form"], "left").groupBy("wanted").agg(F.min("category").alias("category"))


def category_affinity(wanted: DataFrame, categories: DataFrame, edges: DataFrame) -> DataFrame:
    """edges(source, target, score, relation) of the categories wanted; a row without target where
    the category is unknown or has no relationship."""
    found = find_categories(wanted, categories).withColumnRenamed("category", "source")
    return found.join(edges, "source", "left").select("wanted", "source", "target", "score", "relation")


def estimated_overlaps(pairs: DataFrame) -> DataFrame:
    """Fallback without facts: pairs(keyword, related) -> overlaps from keyword similarity."""
    bonus = F.when(F.col("related"), 25.0).otherwise(0.0)
    k = F.coalesce("keyword", F.lit(0.0))
    return pairs.withColumn("video", cap(k * 0.8 + bonus, 100)).withColumn("commerce", cap(k * 0.6 + bonus, 100)).withColumn(
        "creator", cap(k * 0.5 + bonus * 0.5, 100)).withColumn("audience", cap(k * 0.7 + bonus, 100))


def oriented(pairs: DataFrame, *extra: str) -> DataFrame:
    """Both directions of each pair: (source, target, score, relation)."""
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("target"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("_w"), "score", "relation", *extra).select(
        "_w.*", "score", "relation", *extra)


def expansion_paths(edges: DataFrame, depth: int = 2, first: float = 20, later: float = 15, keep: int = 5) -> DataFrame:
    """edges(source, target, score): the `keep` best neighbours, each followed by best further hops."""
    w = W.partitionBy("source").orderBy(F.desc(F.floor(F.col("score") * 1e9 + 0.5)), "target")
    p = edges.where(F.col("score") >= first).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select(
        "source", "rank", "score", F.array("source", "target").alias("path"), F.col("target").alias("_end"))
    for _ in range(1, min(depth, 5)):
        hop = edges.where(F.col("score") >= later).select(F.col("source").alias("_end"), F.col("target").alias("_next"), F.col("score").alias("_s"))
        j = p.join(hop, "_end", "left").where(F.col("_next").isNull() | ~F.array_contains("path", F.col("_next")))
        order = W.partitionBy("source", "rank").orderBy(F.desc(F.floor(F.col("_s") * 1e9 + 0.5)), "_next")
        best = j.withColumn("_o", F.row_number().over(order)).where("_o = 1").select("source", "rank", F.col("_next").alias("_n"))
        p = p.join(best, ["source", "rank"], "left").select(
            "source", "rank", "score", F.when(F.col("_n").isNotNull(), F.array_append("path", F.col("_n"))).otherwise(F.col("path")).alias("path"),
            F.coalesce("_n", "_end").alias("_end"))
    rec = ladder("score", [(50, "Strong cross-sell opportunity -- audiences highly overlap"),
                           (30, "Moderate affinity -- test with related content")],
                 "Weak connection -- monitor for emerging crossover")
    return p.drop("_end").withColumn("recommendation", rec)


def presented(pairs: DataFrame) -> DataFrame:
    """Pairs with a relation, with cross-sell potential."""
    z = lambda x: F.coalesce(F.col(x), F.lit(0.0)) / 100
    cross = z("commerce") * 0.4 + z("audience") * 0.35 + (F.lit(1.0) - F.abs(F.coalesce("keyword", F.lit(0.0)) - 50) / 50) * 0.25
    label = cascade([(F.col("relation") == "parent_child", "parent"), (F.col("relation") == "sibling", "sibling")], "complementary")
    return pairs.where("relation <> 'unrelated'").withColumn("shown_relation", label).withColumn("cross_sell", cap(cross, 1))


# --- lifecycle ---------------------------------------------------------------------------

GATES = {"convergence": 50.0, "products": 100, "videos": 10, "keyword_confidence": 0.5, "keywords": 10}
RETIRE = {"points": 8, "mean": 20.0}


def promotion(cands: DataFrame, g: dict = GATES) -> DataFrame:
    """cands(convergence, products, videos, learned_keywords JSON, keyword_confidence): first failing gate."""
    d = cands.withColumn("_k", F.from_json("learned_keywords", "primary array<string>, secondary array<string>"))
    n = F.greatest(F.coalesce(F.size("_k.primary"), F.lit(0)), F.lit(0))
    learned = F.col("learned_keywords").isNotNull() & (F.coalesce("keyword_confidence", F.lit(0.0)) >= g["keyword_confidence"])
    parsed = F.try_parse_json("learned_keywords").isNotNull()
    reason = cascade([
        (F.col("convergence") < g["convergence"], "convergence"), (F.col("products") < g["products"], "product_mentions"),
        (F.col("videos") < g["videos"], "video_mentions"), (~learned, "keywords_not_learned"),
        (~parsed, "keywords_unparseable"), (n < g["keywords"], "too_few_keywords")], "promoted")
    return d.withColumn("reason", reason).withColumn("promoted", F.col("reason") == "promoted").drop("_k")


def retirement(history: DataFrame, g: dict = RETIRE) -> DataFrame:
    return history.groupBy("category").agg(F.count("*").alias("points"), F.avg("score").alias("mean")).where(
        (F.col("points") >= g["points"]) & (F.col("mean") < g["mean"]))


def next_stage(d: DataFrame, g: dict = GATES, manual: bool = False) -> DataFrame:
    """Needs stage, convergence, learned_keywords, keyword_confidence, promoted."""
    learned = F.col("learned_keywords").isNotNull() & (F.coalesce("keyword_confidence", F.lit(0.0)) >= g["keyword_confidence"])
    s = F.col("stage")
    return d.withColumn("next_stage", cascade([
        ((s == "detected") & (F.col("convergence") >= g["convergence"] / 2), "trend_validated"),
        ((s == "trend_validated") & learned, "keywords_learned"),
        ((s == "keywords_learned") & F.col("promoted"), "ready_for_promotion" if manual else "promoted")], s))


def lifecycle_signals(d: DataFrame, history: DataFrame) -> DataFrame:
    """Long signals (category, signal, value, direction)."""
    rn = F.row_number().over(W.partitionBy("category").orderBy(F.desc("observed_at")))
    h = history.withColumn("_r", rn).where("_r <= 8").groupBy("category").agg(
        F.count("*").alias("_n"), F.avg(F.when(F.col("_r") <= 4, F.col("score"))).alias("_a"),
        F.avg(F.when(F.col("_r") > 4, F.col("score"))).alias("_b"))
    change = F.when(F.col("_b").isNotNull(), (F.col("_a") - F.col("_b")) / F.greatest(F.col("_b"), F.lit(1.0)) * 100)
    d = d.join(h.select("category", change.alias("_chg")), "category", "left")
    pos = lambda cond: F.when(cond, "positive").otherwise("neutral")
    sig = lambda name, v, dirn: F.struct(F.lit(name).alias("signal"), v.cast("double").alias("value"), dirn.alias("direction"))
    rows = F.array(
        sig("Demand score", F.col("demand"), ladder("demand", [(75, "positive"), (50, "neutral")], "negative")),
        F.when(F.col("_chg").isNotNull(), sig("Convergence trend (4-week)", F.col("_chg"),
               cascade([(F.col("_chg") > 5, "positive"), (F.col("_chg") < -5, "negative")], "neutral"))),
        sig("Product mentions", F.col("products"), pos(F.col("products") >= 100)),
        sig("Video mentions", F.col("videos"), pos(F.col("videos") >= 10)),
        sig("Keyword confidence", F.col("keyword_confidence") * 100, pos(F.col("keyword_confidence") >= 0.75)),
        sig("Competition", F.col("competitors"), cascade([(F.col("competitors") < 15, "positive"), (F.col("competitors") > 30, "negative")], "neutral")))
    return d.select("category", F.inline(F.filter(rows, lambda x: x.isNotNull())))


STATES = {"detected": "emerging", "trend_validated": "emerging", "keywords_learned": "growing",
          "ready_for_promotion": "growing", "promoted": "mature", "retired": "declining"}
INFERRED = {"emerging": ("growing", 0.6, "4-8 weeks"), "growing": ("mature", 0.5, "8-16 weeks"),
            "mature": ("declining", 0.3, "6-12 months"), "declining": ("retired", 0.7, "4-12 weeks")}


def transitions(d: DataFrame) -> DataFrame:
    """Stage by stage probabilities: long (category, to_stage, probability), zeros left out."""
    conv, kc, s = F.col("convergence"), F.coalesce("keyword_confidence", F.lit(0.0)), F.col("stage")
    table = {
        "detected": [("detected", F.lit(0.5)), ("trend_validated", F.when(conv >= 25, 0.4).otherwise(0.1)), ("retired", F.lit(0.1))],
        "trend_validated": [("trend_validated", F.lit(0.4)), ("keywords_learned", F.when(kc >= 0.5, 0.5).otherwise(0.1)), ("retired", F.lit(0.1))],
        "keywords_learned": [("keywords_learned", F.lit(0.3)), ("ready_for_promotion", F.when(conv >= 50, 0.5).otherwise(0.1)),
                             ("promoted", F.when(conv >= 50, 0.1).otherwise(0.0)), ("retired", F.lit(0.1))],
        "ready_for_promotion": [("ready_for_promotion", F.lit(0.3)), ("promoted", F.lit(0.6)), ("retired", F.lit(0.1))],
        "promoted": [("promoted", F.lit(0.85)), ("retired", F.lit(0.15))],
        "retired": [("retired", F.lit(0.9)), ("detected", F.lit(0.1))],
    }
    pairs = cascade([(s == k, F.array(*[F.struct(F.lit(t).alias("to_stage"), p.alias("probability")) for t, p in v])) for k, v in table.items()])
    return d.select("category", "stage", F.inline(pairs)).where("probability > 0")


def states(d: DataFrame) -> DataFrame:
    st = cascade([(F.col("stage") == k, v) for k, v in STATES.items()], "emerging")
    d = d.withColumn("state", st)
    pick = lambda i: cascade([(F.col("state") == k, v[i]) for k, v in INFERRED.items()])
    return d.withColumn("next_state", pick(0)).withColumn("probability", pick(1)).withColumn("timeframe", pick(2))


# --- channels ----------------------------------------------------------------------------


def criteria(channels: DataFrame) -> DataFrame:
    """channels(channel_id, subscribers, videos): heuristic criterion rows (score, confidence, flags)."""
    sub, vid = F.col("subscribers"), F.col("videos")
    row = lambda i, s, k, fl=None: F.struct(
        F.lit(i).alias("criterion"), s.cast("double").alias("score"), k.cast("double").alias("confidence"),
        (F.array(F.lit(fl)) if fl else F.array().cast("array<string>")).alias("flags"))
    known = F.coalesce(sub, F.lit(0)) > 0
    has_v = F.coalesce(vid, F.lit(0)) > 0
    return channels.select("channel_id", F.inline(F.array(
        row("published_books", F.lit(30), F.lit(0.2)), row("editorial_vetting", F.lit(50), F.lit(0.3)),
        row("media_presence", cascade([(~known, 50), (sub > 100000, 80), (sub > 10000, 60)], 35),
            cascade([(~known, 0.3), (sub > 100000, 0.7), (sub > 10000, 0.6)], 0.5)),
        row("professional_credentials", F.lit(40), F.lit(0.2), "credentials_unverified"),
        row("institutional_affiliation", F.lit(35), F.lit(0.2)), row("ethical_alignment", F.lit(55), F.lit(0.3)),
        row("production_quality", F.when(has_v, cap(vid * 0.2 + 40, 80)).otherwise(50.0), F.when(has_v, 0.5).otherwise(0.3)))))


def _weight() -> Column:
    return cascade([(F.col("criterion") == k, v) for k, v in fixed.CRITERION_WEIGHTS.items()], 0.1)


def vet(rows: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """criterion rows -> composite, confidence, review reasons, decision and escalation per channel."""
    a = rows.groupBy("channel_id").agg(
        (F.sum(F.col("score") * _weight()) / F.sum(_weight())).alias("composite"), F.avg("confidence").alias("_c"),
        F.count_if(F.col("confidence") < 0.5).alias("_l5"), F.count_if(F.col("confidence") < 0.6).alias("_l6"),
        F.stddev_pop("score").alias("score_spread"), F.array_sort(F.flatten(F.collect_list("flags"))).alias("flags"))
    if external is not None:
        a = a.join(external.select("channel_id", F.lit(0.1).alias("_x")).distinct(), "channel_id", "left")
    else:
        a = a.withColumn("_x", F.lit(0.0))
    reasons = F.filter(F.array(
        F.when(F.col("_l5") >= 3, F.concat(F.col("_l5").cast("string"), F.lit(" criteria have low confidence"))),
        F.when(F.col("score_spread") > 25, "Conflicting criterion scores"),
        F.when(F.size("flags") > 0, F.concat(F.lit("Flags: "), F.array_join("flags", ", ")))), lambda x: x.isNotNull())
    a = a.withColumn("confidence", cap(F.col("_c") + F.coalesce("_x", F.lit(0.0)), 1)).withColumn("reasons", reasons)
    a = a.withColumn("review", (F.col("confidence") < 0.65) | (F.size("reasons") > 0))
    return a.withColumn("decision", cascade([
        (F.col("review"), "needs_review"), (F.col("composite") >= 70, "approved"), (F.col("composite") <= 40, "rejected")], "needs_review")
    ).withColumn("escalate", (F.col("_l6") >= 3) | (F.col("score_spread") > 25) | F.col("composite").between(55, 75)).drop("_c", "_l5", "_l6", "_x")


def adjust(rows: DataFrame, adjustments: DataFrame) -> DataFrame:
    a = adjustments.select("channel_id", "criterion", F.col("adjustment").alias("_a"), F.col("reason").alias("_why"))
    d = rows.join(a, ["channel_id", "criterion"], "left")
    return d.withColumn("score", F.when(F.col("_a").isNotNull(), clamp(F.col("score") + F.col("_a"), 0, 100)).otherwise(F.col("score"))).withColumn(
        "note", F.concat(F.lit("AI adjustment: "), "_why")).drop("_a", "_why")


DIMENSION = {"media_presence": "reach", "production_quality": "engagement", "editorial_vetting": "quality",
             "published_books": "quality", "professional_credentials": "trust",
             "institutional_affiliation": "trust", "ethical_alignment": "commercial"}


def dimensions(rows: DataFrame) -> DataFrame:
    """Both five-dimension views: `*_means` of named criteria and `*_group` averages."""
    p = rows.groupBy("channel_id").pivot("criterion", list(fixed.CRITERION_WEIGHTS)).agg(F.first("score"))
    g = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    mean = lambda *xs: half_up(sum([g(x) for x in xs[1:]], g(xs[0])) / len(xs))

    def group(name):
        xs = [k for k, v in DIMENSION.items() if v == name]
        return half_up(sum([g(x) for x in xs[1:]], g(xs[0])) / len(xs)).alias(f"{name}_group")
    return p.select(
        "channel_id", g("media_presence").alias("reach_means"), mean("production_quality", "editorial_vetting").alias("engagement_means"),
        mean("professional_credentials", "editorial_vetting").alias("quality_means"),
        mean("published_books", "institutional_affiliation", "ethical_alignment").alias("trust_means"),
        mean("production_quality", "media_presence").alias("commercial_means"),
        *[group(n) for n in ["reach", "engagement", "quality", "trust", "commercial"]])


# --- programs ----------------------------------------------------------------------------


def keyword_relevance(programs: DataFrame, keywords: dict | None = None) -> DataFrame:
    """programs(program_id, name, description, terms): narrow scoring by contained keywords."""
    keywords = keywords or fixed.PROGRAM_KEYWORDS
    d = programs.withColumn("_t", F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), F.coalesce("terms", F.lit("")))))
    per = {k: F.size(F.filter(F.lit([x.lower() for x in v]), lambda w: F.contains(F.col("_t"), w))) for k, v in keywords.items()}
    for k, v in per.items():
        d = d.withColumn(f"_n_{k}", v)
    n = sum([F.col(f"_n_{k}") for k in list(per)[1:]], F.col(f"_n_{list(per)[0]}"))
    cats = sum([F.when(F.col(f"_n_{k}") > 0, 1).otherwise(0) for k in list(per)], F.lit(0))
    d = d.withColumn("matched", n.cast("long")).withColumn("categories", cats.cast("long"))
    base = ladder("matched", [(5, 90), (3, 75), (2, 60), (1, 40)], 0)
    d = d.withColumn("relevance", F.when(F.col("categories") >= 3, F.least(base + 10, F.lit(100))).otherwise(base).cast("long"))
    flags = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.col(f"_n_{k}") > 0) for k in per]))
    return d.withColumn("relevant", F.col("relevance") >= 50).withColumn("category_flags", flags).drop("_t", *[f"_n_{k}" for k in per])


def route(scored: DataFrame, high: int = 70, low: int = 20) -> DataFrame:
    return scored.withColumn("route", F.when((F.col("relevance") >= high) | (F.col("relevance") <= low), "keyword").otherwise("review"))


def route_stats(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"), F.sum(F.when(F.col("route") == "keyword", 0.001).otherwise(0.0)).alias("cost_saved"))


def preset_stats(scored: DataFrame, presets: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """What each preset of thresholds would cost: one row for each, also over no programs.

    Programs are counted by their relevance first, so presets multiply a hundred rows at most.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(h).alias("_high"), F.lit(lo).alias("_low"))
                               for k, (h, lo) in (presets or fixed.HYBRID_PRESETS).items()]))
    per = scored.groupBy("relevance").agg(F.count("*").alias("_n"))
    names = scored.sparkSession.range(1).select(each.alias("_p")).select("_p.*")
    d = names.join(per.withColumnRenamed("relevance", "_rel").hint("broadcast"), F.lit(True), "left")
    sure = (F.col("_rel") >= F.col("_high")) | (F.col("_rel") <= F.col("_low"))
    d = d.groupBy("preset").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(F.when(sure, F.col("_n"))), F.lit(0)).alias("keyword_only"))
    d = d.withColumn("ai_calls", F.col("processed") - F.col("keyword_only")).withColumn("cost_saved", F.col("keyword_only") * 0.001)
    return d.withColumn("ai_percentage", F.coalesce(half_up(ratio("ai_calls", "processed") * 100, 1), F.lit(0.0))).withColumn(
        "cost_per_scan", F.col("ai_calls") * 0.001)


def discover(scored: DataFrame, minimum: int = 50) -> DataFrame:
    """commission_groups ARRAY<STRUCT<min,max>>; the minimum includes 0, the true floor is kept too."""
    zero = F.array(F.lit(0.0))
    lo, hi = F.transform("commission_groups", lambda g: g["min"]), F.transform("commission_groups", lambda g: g["max"])
    return scored.where(F.col("relevant") & (F.col("relevance") >= minimum)).withColumn(
        "commission_min", F.array_min(F.concat(lo, zero))).withColumn("commission_max", F.array_max(F.concat(hi, zero))).withColumn(
        "commission_floor", F.array_min(lo)).orderBy(F.desc("relevance"), "program_id")


def region_bucket(country) -> Column:
    low = F.lower(c(country))
    return F.coalesce(cascade([(any_contained(low, subs) | low.isin(whole) if whole else any_contained(low, subs), b)
                               for b, subs, whole in fixed.REGION_RULES], "OTHER"), F.lit("OTHER"))


def coverage_report(programs: DataFrame, keys: list[str]) -> DataFrame:
    return programs.agg(
        F.count("*").alias("programs"), F.count_if(F.col("country").isNotNull()).alias("located"), F.avg("relevance").alias("avg_relevance"),
        *[F.count_if(F.element_at("category_flags", F.lit(k))).alias(f"n_{k}") for k in keys])


def top_programs(programs: DataFrame, keep: int = 10) -> DataFrame:
    """The `keep` most relevant programs (ties to the lower id) with their line of the report."""
    best = programs.orderBy(F.desc("relevance"), "program_id").limit(keep)
    best = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("relevance"), "program_id")))  # `keep` rows
    place = F.coalesce("country", F.lit("Location unknown"))
    return best.select("rank", "program_id", F.concat(
        F.col("rank").cast("string"), F.lit(". "), "name", F.lit(" ("), F.col("relevance").cast("string"), F.lit("/100) - "), place).alias("line"))


def coverage_text(programs: DataFrame, keys: list[str], keep: int = 10) -> DataFrame:
    """The coverage report as one text; without programs a single sentence."""
    report = coverage_report(programs, keys)
    top = top_programs(programs, keep).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("_top"))
    label = lambda k: re.sub(r"(?<=[a-z])(?=[A-Z])", " ", k).title()
    share = half_up(F.col("located") / F.col("programs") * 100).cast("long").cast("string")
    text = lambda col: F.col(col).cast("string")
    lines = [F.lit("AFFILIATE DISCOVERY REPORT"), F.lit("=========================="), F.lit(""),
             F.concat(F.lit("Total Programs Discovered: "), text("programs")),
             F.concat(F.lit("Programs with Location Data: "), text("located"), F.lit(" ("), share, F.lit("%)")),
             F.concat(F.lit("Average Relevance Score: "), half_up("avg_relevance", 1).cast("string"), F.lit("/100")),
             F.lit(""), F.lit("Coverage by Vertical:"),
             *[F.concat(F.lit(f"- {label(k)}: "), text(f"n_{k}")) for k in keys],
             F.lit(""), F.lit("Top Programs:"), F.col("_top")]
    return report.crossJoin(top).select(  # one row each
        F.when(F.col("programs") == 0, "No programs discovered.").otherwise(F.concat_ws("\n", *lines)).alias("report"))


def select_programs(programs: DataFrame, category: str) -> DataFrame:
    """Programs whose terms or description hold any word of the category; all when none does."""
    words = [w for w in category.lower().replace(",", " ").split() if len(w) > 2]
    if not words:
        return programs
    hit = any_contained(F.lower("terms"), words) | any_contained(F.lower("description"), words)
    p = programs.withColumn("_h", F.coalesce(hit, F.lit(False)))
    anyhit = p.agg(F.coalesce(F.bool_or("_h"), F.lit(False)).alias("_any"))
    return p.crossJoin(F.broadcast(anyhit)).where(F.col("_h") | ~F.col("_any")).drop("_h", "_any")


# --- discovery ---------------------------------------------------------------------------


def cluster_words(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", " "), r"\s+"),
                    lambda w: (F.length(w) > 2) & ~w.isin(fixed.CLUSTER_STOP_WORDS))


def clusters(products: DataFrame, min_products: int = 50, min_videos: int = 10, samples: int = 10) -> DataFrame:
    """products(id, name, video_id, confidence): groups by first word.

    Products with the same name share their words, so word frequencies come from distinct
    names with counts; distinct videos are counted from distinct (word, video) rows.
    """
    p = products.withColumn("first", F.try_element_at(cluster_words(F.col("name")), F.lit(1))).where("first IS NOT NULL")
    names = p.groupBy("first", "name").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.min("id").alias("id"))
    vids = p.select("first", "video_id").distinct().groupBy("first").agg(F.count("*").alias("videos"))
    size = names.groupBy("first").agg(F.sum("n").alias("products"), (F.sum("conf") / F.sum("n")).alias("avg_confidence"))
    big = size.where(F.col("products") >= min_products).join(vids.where(F.col("videos") >= min_videos), "first")
    freq = names.select("first", "n", F.explode(cluster_words(F.col("name"))).alias("word")).groupBy("first", "word").agg(F.sum("n").alias("f"))
    w = W.partitionBy("first").orderBy(F.desc("f"), "word")
    top = freq.join(big.select("first", "products"), "first").where(F.col("f") >= F.col("products") * 0.3).withColumn(
        "_r", F.row_number().over(w)).where("_r <= 10").groupBy("first").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "word"))), lambda x: x["word"]).alias("keywords"))
    sw = W.partitionBy("first").orderBy("id")
    smp = names.withColumn("_r", F.row_number().over(sw)).where(F.col("_r") <= samples).groupBy("first").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("sample_names"))
    name = F.coalesce(F.nullif(F.array_join(F.transform(F.slice("keywords", 1, 3), F.initcap), " "), F.lit("")), F.lit("Miscellaneous Products"))
    return big.join(top, "first", "left").join(smp, "first").withColumn("cluster_name", name).withColumn(
        "cluster_key", F.regexp_replace(F.regexp_replace(F.lower("cluster_name"), r"[^a-z0-9\s-]", ""), r"\s+", "_"))


def three_forces(cands: DataFrame, min_convergence: float = 50.0) -> DataFrame:
    """cands(products, videos, programs, avg_confidence)."""
    d = cands.withColumn("demand", cap(F.col("products") / 100.0 * 40 + F.col("videos") / 20.0 * 40 + 20, 100)).withColumn(
        "commission", cap(F.col("programs") * 20, 100)).withColumn("authority", cap(F.col("avg_confidence") * 80 + 20, 100))
    return d.withColumn("convergence", F.col("demand") * F.col("commission") * F.col("authority") / 10000).withColumn(
        "validated", F.col("convergence") >= min_convergence / 2)


CANDIDATE_CATEGORIES = {"plant": "PLANT", "plants": "PLANT", "seed": "SEEDS", "seeds": "SEEDS", "tool": "TOOLS",
                        "tools": "TOOLS", "material": "MATERIALS", "materials": "MATERIALS", "structure": "STRUCTURES",
                        "structures": "STRUCTURES", "book": "BOOKS", "books": "BOOKS"}


def candidate_category(name, rules: dict | None = None) -> Column:
    low = F.lower(c(name))
    return cascade([(low.contains(k), v) for k, v in (rules or CANDIDATE_CATEGORIES).items()], "OTHER")
