"""Content scoring: seasons, quality, skills, potential, monetisation, verticals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions import text as tx
from shelfsight.functions.num import c, cap, cascade, half_up, ladder, ratio
from shelfsight.operators.joins import containment_join

# --- seasons ------------------------------------------------------------------------


def _labels(low: Column, patterns) -> Column:
    marks = F.array(*[F.when(low.rlike(tx.word_bounded(f"(?:{p[1]})")), F.lit(p[0])) for p in patterns])
    return F.filter(marks, lambda x: x.isNotNull())


def _season_phrases() -> str:
    """One alternation of every phrase, longest first, so a short phrase never hides a longer one."""
    lists = [fixed.SEASON_PATTERNS, fixed.MONTH_PATTERNS, fixed.REGION_PATTERNS, fixed.WEATHER_PATTERNS]
    words = {w for pats in lists for p in pats for w in p[1].split("|")} | set(fixed.YEAR_ROUND_PATTERN.split("|"))
    return "|".join([fixed.ZONE_PATTERN, *sorted(words, key=lambda w: (-len(w), w))])


def seasonal_context(docs: DataFrame, text: str = "text") -> DataFrame:
    """Season, month, region, zone and weather mentions with a confidence; a narrow job.

    The text is scanned once for all phrases; the labels are then read off the few hits.
    """
    low = F.col("_low")
    found = F.regexp_extract_all(F.lower(text), F.lit(tx.word_bounded(f"(?:{_season_phrases()})")), F.lit(0))
    d = docs.withColumn("_low", F.array_join(found, " | "))
    d = d.withColumn("seasons", _labels(low, fixed.SEASON_PATTERNS)).withColumn(
        "months", _labels(low, fixed.MONTH_PATTERNS)).withColumn(
        "regions", _labels(low, fixed.REGION_PATTERNS)).withColumn(
        "weather", _labels(low, fixed.WEATHER_PATTERNS)).withColumn(
        "zone", F.nullif(F.regexp_extract("_low", tx.word_bounded(fixed.ZONE_PATTERN), 0), F.lit(""))).withColumn(
        "year_round", low.rlike(tx.word_bounded(f"(?:{fixed.YEAR_ROUND_PATTERN})")))
    has = lambda arr, v: F.array_contains(arr, v)
    hemi = F.coalesce(*[F.when(has("regions", name), F.lit(h))
                        for name, _, h in reversed(fixed.REGION_PATTERNS) if h])
    conf = (F.lit(0.5) + F.size("seasons") * 0.1 + F.size("months") * 0.05 + F.size("regions") * 0.08
            + F.when(F.col("zone").isNotNull(), 0.1).otherwise(0.0) + F.size("weather") * 0.05
            + F.when(F.col("year_round"), 0.1).otherwise(0.0))
    return (
        d.withColumn("hemisphere", hemi)
        .withColumn("season_specific", F.size("seasons").between(1, 2))
        .withColumn("temperate", has("regions", "Temperate") | has("weather", "frost"))
        .withColumn("tropical", has("regions", "Tropical"))
        .withColumn("season_confidence", cap(conf, 1.0)).drop("_low"))


def season_summary() -> Column:
    names = F.array_join(F.transform("seasons", F.initcap), ", ")
    months = F.when(F.size("months").between(1, 3), F.array_join(
        F.transform("months", lambda i: F.element_at(F.lit(fixed.MONTH_NAMES), i)), ", "))
    parts = F.filter(F.array(F.when(F.size("seasons") > 0, names), months), lambda x: x.isNotNull())
    return cascade([(F.col("year_round"), "Year-round"),
                    ((F.size("seasons") == 0) & (F.size("months") == 0), "Not season-specific"),
                    (F.size(parts) == 0, "Variable")], F.array_join(parts, " - "))


def climate_summary() -> Column:
    parts = F.concat(F.filter(F.array(
        F.col("zone"), F.concat("hemisphere", F.lit(" hemisphere")),
        cascade([(F.col("temperate"), "Temperate"), (F.col("tropical"), "Tropical")])),
        lambda x: x.isNotNull()), F.slice("regions", 1, 2))
    return F.when(F.size("regions") == 0, F.lit("Not region-specific")).otherwise(F.array_join(parts, ", "))


def season_of(month, hemisphere) -> Column:
    m, north = c(month), c(hemisphere) == "northern"
    return cascade([
        (m.between(3, 5), F.when(north, "spring").otherwise("autumn")),
        (m.between(6, 8), F.when(north, "summer").otherwise("winter")),
        (m.between(9, 11), F.when(north, "autumn").otherwise("spring"))],
        F.when(north, "winter").otherwise("summer"))


def hemisphere_of(region) -> Column:
    return F.when(F.upper(c(region)).isin(fixed.SOUTHERN_REGIONS), "southern").otherwise("northern")


def seasonal_relevance(context: DataFrame, month: Column, hemisphere: Column) -> DataFrame:
    """Relevance of each video for a month and hemisphere; `fall` counts as autumn."""
    user = season_of(month, hemisphere)
    near = F.array(F.when(month == 1, 12).otherwise(month - 1), month, F.when(month == 12, 1).otherwise(month + 1))
    seasons = F.transform("seasons", lambda s: F.when(s == "fall", "autumn").otherwise(s))
    wrong = F.col("hemisphere").isNotNull() & (F.col("hemisphere") != hemisphere)
    label = cascade([
        (F.col("year_round") | ~F.col("season_specific"), "relevant"),
        (F.array_contains("months", month), "relevant"),
        (F.arrays_overlap("months", near), "Near-season content"),
        (wrong, "Wrong hemisphere (seasons reversed)"),
        (F.array_contains(seasons, user), "relevant")],
        F.concat(F.lit("Not in season (video is "), F.array_join("seasons", "/"), F.lit(" content)")))
    d = context.withColumn("_l", label)
    return d.withColumn("relevant", F.col("_l").isin("relevant", "Near-season content")).withColumn(
        "reason", F.when(F.col("_l") != "relevant", F.col("_l"))).drop("_l")


# --- quality and skills ---------------------------------------------------------------


def tier(score) -> Column:
    return ladder(score, [(70, "FEATURED"), (60, "SUPPORTING")], "ARCHIVE")


def estimate_quality(videos: DataFrame) -> DataFrame:
    """videos(entities, avg_confidence, items, season_confidence): heuristic scores."""
    n = F.col("entities")
    d = videos.withColumn("literacy", cap(n * 8 + F.when(F.col("avg_confidence") > 0.7, 20).otherwise(0), 100)).withColumn(
        "depth", cap(n * 5 + F.col("items") * 10, 100)).withColumn(
        "seasonal", F.when(F.col("season_confidence") > 0, half_up(F.col("season_confidence") * 100)).otherwise(30.0))
    d = d.withColumn("overall", half_up((F.col("literacy") + F.col("depth") + F.col("seasonal")) / 3))
    return d.withColumn("tier", tier("overall"))


DIMENSIONS = ["visual", "depth", "seasonal", "design", "narrative", "literacy"]


def normalise_quality(scores: DataFrame) -> DataFrame:
    """Six dimensions, default 50 where missing or 0, clamped; overall given or rounded mean."""
    given = lambda x: F.when(F.coalesce(F.col(x), F.lit(0.0)) != 0, F.col(x))
    d = scores
    for x in DIMENSIONS:
        d = d.withColumn(x, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(given(x), F.lit(50.0)))))
    mean = half_up(sum([F.col(x) for x in DIMENSIONS[1:]], F.col(DIMENSIONS[0])) / len(DIMENSIONS))
    return d.withColumn("overall", F.coalesce(given("overall"), mean)).withColumn("tier", tier("overall"))


def infer_skills(actions: DataFrame, secondary: int = 3) -> DataFrame:
    """actions(video_id, ord, category, keyword): categories by frequency, first seen first."""
    per = actions.groupBy("video_id", F.lower("category").alias("category")).agg(
        F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min_by("keyword", "ord").alias("skill"))
    w = W.partitionBy("video_id").orderBy(F.desc("n"), "first_ord")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 1 + secondary).withColumn(
        "role", F.when(F.col("rank") == 1, "primary").otherwise("secondary"))


def high_intent_actions(actions: DataFrame, keep: int = 6) -> DataFrame:
    good = actions.where((F.col("category") == "garden_task") & (F.col("strength") == "high") & (F.col("score") >= 7))
    w = W.partitionBy("video_id").orderBy("ord")
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def top_sections(sections: DataFrame, n: int = 100) -> DataFrame:
    return sections.orderBy(F.desc("score"), "section_id").limit(n)


def budget_selection(rows: DataFrame, order: list[str], cost: str, budget: float, buckets: int = 64) -> DataFrame:
    """Rows in order while the cost accumulated before the row is below the budget.

    The global running sum is taken in two levels: rows are range-split by the first order
    key, each slice gets the total of the slices before it, and the running sum itself only
    spans one slice.
    """
    lead = F.col(order[0])
    bounds = rows.agg(F.min(lead).alias("_lo"), F.max(lead).alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / buckets, F.lit(1e-9))
    r = rows.crossJoin(F.broadcast(bounds)).withColumn("_s", F.floor((lead - F.col("_lo")) / width)).drop("_lo", "_hi")
    sums = r.groupBy("_s").agg(F.sum(cost).alias("_t"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_t").over(
        W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).drop("_t")
    run = W.partitionBy("_s").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (r.withColumn("_in", F.coalesce(F.sum(cost).over(run), F.lit(0.0))).join(F.broadcast(base), "_s")
            .withColumn("spent_before", F.col("_base") + F.col("_in")).drop("_s", "_in", "_base")
            .where(F.col("spent_before") < budget))


# --- category potential ----------------------------------------------------------------


def _hits(arr: str, words: list[str]) -> Column:
    pat = "(?:" + "|".join(words) + ")"
    return F.size(F.filter(arr, lambda k: k.rlike(pat)))


def category_potential(candidates: DataFrame, existing: DataFrame, as_of) -> DataFrame:
    """candidates(id, name, keywords[], programs, videos, first_detected date).

    Similarity to existing categories (slug token Jaccard above .7) comes from an equi-join
    on slug tokens, so only categories that share a token meet.
    """
    k = F.col("_kw")
    d = candidates.withColumn("_kw", F.array_append("keywords", F.lower("name"))).withColumn("slug", tx.slugify(F.col("name")))
    high = _hits("_kw", fixed.HIGH_VALUE_WORDS) > 0
    d = d.withColumn("affiliate", F.least(F.col("programs") * 10, F.when(high, 40).otherwise(30)).cast("double")).withColumn(
        "price", cascade([(high, 30.0), (_hits("_kw", ["seed", "bulb"]) > 0, 15.0)], 20.0)).withColumn(
        "purchase", cap(_hits("_kw", fixed.PURCHASE_WORDS) * 5, 30)).withColumn(
        "progression", F.when(_hits("_kw", fixed.BEGINNER_WORDS) > 0, 15.0).otherwise(0.0)
        + F.when(_hits("_kw", fixed.INTERMEDIATE_WORDS) > 0, 15.0).otherwise(0.0)
        + F.when(_hits("_kw", fixed.ADVANCED_WORDS) > 0, 10.0).otherwise(0.0)).withColumn(
        "content_depth", cap(F.col("videos") / 10.0 * 30, 30)).withColumn(
        "accessibility", cap(_hits("_kw", fixed.LEARNING_WORDS) * 10, 30)).withColumn(
        "evergreen", cap(_hits("_kw", fixed.EVERGREEN_WORDS) * 15, 100))
    tok = lambda col: F.array_distinct(F.split(col, "-"))
    a = d.select("id", tok("slug").alias("_a")).select("id", F.size("_a").alias("_na"), F.explode("_a").alias("_t"))
    b = existing.select("key", tok("key").alias("_b")).select("key", F.size("_b").alias("_nb"), F.explode("_b").alias("_t"))
    shared = a.join(b, "_t").groupBy("id", "key", "_na", "_nb").agg(F.count("*").alias("_i"))
    similar = shared.where(F.col("_i") / (F.col("_na") + F.col("_nb") - F.col("_i")) > 0.7).groupBy("id").agg(F.count("*").alias("similar"))
    d = d.join(similar, "id", "left").withColumn("similar", F.coalesce("similar", F.lit(0)))
    days = F.datediff(F.lit(as_of).cast("date"), "first_detected")
    parts = F.size(F.split("slug", "-"))
    novelty = (cascade([(days < 7, 5.0), (days < 30, 3.0)], 0.0)
               + F.when(parts.between(2, 4), 3.0).otherwise(0.0)
               + F.when((F.length("slug") > 10) & (F.length("slug") < 40), 2.0).otherwise(0.0)
               + cascade([(F.col("similar") == 0, 5.0), (F.col("similar") <= 2, 2.0)], 0.0))
    d = d.withColumn("novelty", novelty).withColumn("commercial", F.col("affiliate") + F.col("price") + F.col("purchase")).withColumn(
        "learning", F.col("progression") + F.col("content_depth") + F.col("accessibility"))
    d = d.withColumn("potential", cap(F.col("commercial") * 0.4 + F.col("learning") * 0.4 + F.col("evergreen") * 0.2 + F.col("novelty"), 100))
    return d.withColumn("action", ladder("potential", [(70, "priority"), (50, "promote"), (30, "monitor")], "reject")).drop("_kw")


def top_priority(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.where("action = 'priority'").orderBy(F.desc("potential"), "id").limit(n)


# --- responses ---------------------------------------------------------------------------


def commercial_intent() -> Column:
    n = F.col("entities")
    s = F.when(n > 0, (ratio("shoppable", "entities") * 0.6 + cap(n / 20.0, 1) * 0.4) * 40).otherwise(0.0)
    s = s + F.coalesce(cap(F.col("avg_commercial_value"), 1) * 30, F.lit(0.0))
    s = s + cascade([(F.col("tier") == "FEATURED", 20.0), (F.col("tier") == "SUPPORTING", 12.0),
                     (F.col("tier") == "ARCHIVE", 5.0), (F.col("tier").isNotNull(), 10.0)], 0.0)
    s = s + cascade([(F.col("season_specific"), 7.0), (F.col("year_round"), 4.0)], 0.0)
    s = s + F.when(F.col("season_confidence") > 0.7, 3.0).otherwise(0.0)
    return half_up(cap(s, 100))


def monetisation_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("video_id").agg(
        F.count("*").alias("entities"), F.count_if("shoppable").alias("shoppable"),
        F.countDistinct("category").alias("categories"), F.count_if(F.col("affiliate_score") > 0.7).alias("high_value"))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def strategies(videos: DataFrame) -> DataFrame:
    """videos(video_id, shoppable, affiliate_score, avg_commercial_value, top_intent, season_specific,
    teaching, level, progression, overall, literacy): up to three ranked strategies each."""
    mean = F.coalesce("affiliate_score", F.lit(0.5))
    value = F.coalesce("avg_commercial_value", F.lit(0.3))
    aff_why = F.concat(
        F.col("shoppable").cast("string"), F.lit(" shoppable entities"),
        F.coalesce(F.concat(F.lit(", "), "top_intent", F.lit(" intent detected")), F.lit("")),
        F.when(F.col("season_specific"), ", seasonal buying window").otherwise(""))
    aff = videos.where("shoppable > 0").select(
        "video_id", F.lit("affiliate_commerce").alias("strategy"), half_up(mean, 2).alias("score"),
        half_up(F.col("shoppable") * mean * value * 10, 2).alias("revenue_per_1k"), clip(aff_why, 100).alias("reasoning"))
    no = F.lit(None).cast("double")
    whole = lambda x: F.col(x).cast("long").cast("string")
    course = videos.where("teaching >= 50").select(
        "video_id", F.lit("course_creation").alias("strategy"),
        half_up(cap(F.col("teaching") / 100 + F.when(F.col("progression"), 0.15).otherwise(0.0), 1), 2).alias("score"),
        no.alias("revenue_per_1k"),
        clip(F.concat(F.lit("Teaching quality "), whole("teaching"), F.lit("/100, "), "level", F.lit(" level"),
                      F.when(F.col("progression"), ", clear skill progression").otherwise("")), 100).alias("reasoning"))
    spons = videos.where("overall >= 55").select(
        "video_id", F.lit("sponsored_content").alias("strategy"),
        half_up((F.col("overall") / 100 + F.col("literacy") / 100) / 2, 2).alias("score"), no.alias("revenue_per_1k"),
        clip(F.concat(F.lit("Editorial quality "), whole("overall"), F.lit("/100, botanical literacy "), whole("literacy"),
                      F.lit("/100, trusted editorial voice")), 100).alias("reasoning"))
    out = aff.unionByName(course).unionByName(spons)
    pos = cascade([(F.col("strategy") == "affiliate_commerce", 0), (F.col("strategy") == "course_creation", 1)], 2)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("score"), pos)))


def top_products(entities: DataFrame, n: int = 5) -> DataFrame:
    w = W.partitionBy("video_id").orderBy(F.desc("affiliate_score"), "ord")
    return entities.where("shoppable").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


MARKET_TREND = {"priority": "rising", "promote": "emerging", "monitor": "stable", "reject": "declining"}


def market_position(scored: DataFrame) -> DataFrame:
    t = cascade([(F.col("action") == k, v) for k, v in MARKET_TREND.items()])
    return scored.withColumn("trend", t).withColumn("competition", (F.lit(100.0) - F.col("potential")) / 100)


def content_gaps(affinity: DataFrame, topics: DataFrame, minimum: float = 50.0) -> DataFrame:
    """Complementary neighbours (adjacent or unrelated) above the affinity minimum, per source.

    affinity(source, target, relation, score); topics(category, demand, competition, trend).
    """
    good = affinity.where(F.col("relation").isin("adjacent", "unrelated") & (F.col("score") > minimum))
    g = good.join(topics, good.target == topics.category).withColumn(
        "opportunity", half_up(F.col("demand") * (F.lit(100.0) - F.col("competition")) / 100, 2))
    pick = lambda *t: F.array_sort(F.collect_set(F.when(F.col("trend").isin(*t), F.col("target"))))
    return g.groupBy("source").agg(
        F.count("*").alias("gaps"), F.max("opportunity").alias("best_opportunity"),
        pick("rising", "emerging").alias("emerging"), pick("declining").alias("declining"))


def shared_entities(entities: DataFrame, minimum: int = 2) -> DataFrame:
    """Names (case-insensitive) found in at least `minimum` videos, each counted once per video."""
    per = entities.groupBy(F.lower("entity").alias("name"), "video_id").agg(F.min(F.lower("category")).alias("category"))
    return per.groupBy("name").agg(F.min_by("category", "video_id").alias("category"), F.count("*").alias("videos")).where(
        F.col("videos") >= minimum)


def single_topics(topics: DataFrame) -> DataFrame:
    return topics.select("topic", "video_id").groupBy("topic").agg(F.count("*").alias("n")).where("n = 1").select("topic")


def audience_map(distribution: DataFrame) -> DataFrame:
    """Sum of average scores per intent, scaled by the largest."""
    s = distribution.groupBy("intent").agg(F.sum("avg_score").alias("_s"))
    return s.withColumn("share", half_up(F.col("_s") / F.max("_s").over(W.partitionBy()), 2)).drop("_s")


def outcomes(results: DataFrame) -> DataFrame:
    return results.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).groupBy(
        "status").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


# --- verticals ---------------------------------------------------------------------------


def detect_vertical(docs: DataFrame, terms: DataFrame, minimum: float = 0.15) -> DataFrame:
    """terms(vertical, vertical_pos, term): share of a vertical's terms found; best above the minimum."""
    use = terms.where("vertical <> 'generic'")
    size = use.groupBy("vertical").agg(F.count("*").alias("_size"))
    low = docs.select("video_id", F.lower("text").alias("_low"))
    hit = containment_join(low, use.select("vertical", "vertical_pos", "term"), "_low", "term", keep=["video_id"])
    s = hit.groupBy("video_id", "vertical", "vertical_pos").agg(F.count("*").alias("_n")).join(size, "vertical")
    s = s.withColumn("_score", F.col("_n") / F.col("_size"))
    best = s.groupBy("video_id").agg(F.max_by(F.struct("vertical", "_score"), F.struct("_score", -F.col("vertical_pos"))).alias("b"))
    ok = F.col("b._score") > minimum
    return docs.select("video_id").join(best, "video_id", "left").select(
        "video_id", F.when(ok, F.col("b.vertical")).otherwise("unknown").alias("vertical"),
        F.when(ok, F.least(F.col("b._score") * 3, F.lit(0.95))).otherwise(F.lit(0.0)).alias("confidence"))


def resolve_verticals(requests: DataFrame, registered: DataFrame, learned: DataFrame) -> DataFrame:
    """requests(request_id, vertical_id): registered, else learned, else generic."""
    reg = registered.select(F.col("vertical_id"), F.col("display").alias("_r"))
    lea = learned.select(F.col("vertical_id"), F.col("display").alias("_l"))
    return requests.join(reg, "vertical_id", "left").join(lea, "vertical_id", "left").select(
        "request_id", "vertical_id", F.coalesce("_r", "_l", F.lit("Generic")).alias("display"),
        cascade([(F.col("_r").isNotNull(), "registered"), (F.col("_l").isNotNull(), "learned")], "generic").alias("resolved_from"))


def vertical_lists(terms: DataFrame) -> DataFrame:
    return terms.groupBy("vertical").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), ",").alias("keywords"))


def vertical_terms(terms: DataFrame) -> DataFrame:
    """terms(vertical, kind, cat_pos, pos, term): all keywords or brands of a vertical, one after the other.

    Rows (vertical, kind, n, term), the lists of the categories in category order, repeats kept. Rows
    are numbered inside a category and moved by the sizes of the categories before.
    """
    own = F.row_number().over(W.partitionBy("vertical", "kind", "cat_pos").orderBy("pos", "term"))
    before = W.partitionBy("vertical", "kind").orderBy("cat_pos").rowsBetween(W.unboundedPreceding, -1)
    sizes = terms.groupBy("vertical", "kind", "cat_pos").agg(F.count("*").alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return terms.withColumn("_own", own).join(sizes, ["vertical", "kind", "cat_pos"]).select(
        "vertical", "kind", (F.col("_own") + F.col("_off")).cast("long").alias("n"), "term")


def collect_feedback(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Per video: counts, mean confidence, confident shoppable names and commerce counts."""
    e = entities.groupBy("video_id").agg(
        F.count("*").alias("entity_count"), F.avg("confidence").alias("avg_confidence"),
        F.array_sort(F.collect_set(F.when(F.col("shoppable") & (F.col("confidence") > 0.7), F.col("entity")))).alias("shoppable_names"))
    i = items.groupBy("video_id", "category").agg(F.count("*").alias("n")).groupBy("video_id").agg(
        F.sum("n").alias("item_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("item_categories"))
    return e.join(i, "video_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def fold_feedback(feedback: DataFrame, start: float = 0.5) -> DataFrame:
    """feedback(vertical, ord, video_id, entity_count, avg_confidence, item_count).

    Sums and the weighted mean are plain aggregates. The clamped walk of aggressiveness is
    a composition of maps x -> clamp(x + a, lo, hi); such maps compose into one of the same
    form, so runs are folded per slice of the log and the slices are folded in order: no
    task holds a vertical's whole history.
    """
    delta = cascade([((F.col("entity_count") > 5) & (F.col("avg_confidence") > 0.6), 1), (F.col("entity_count") < 3, -1)], 0)
    f = feedback.withColumn("_d", delta).withColumn("_slice", F.floor(F.col("ord") / 10_000))
    # State (lo, hi, shift): x -> min(hi, max(lo, x + shift)), in steps of .05 above .05.
    top, low = 15, 0  # .8 and .05

    def run(steps, get):
        zero = F.struct(F.lit(-(10**9)).alias("lo"), F.lit(10**9).alias("hi"), F.lit(0).alias("sh"))

        def compose(a, x):
            lo2, hi2, sh2 = get(x)
            return F.struct(
                F.least(hi2, F.greatest(lo2, a["lo"] + sh2)).cast("int").alias("lo"),
                F.least(hi2, F.greatest(lo2, a["hi"] + sh2)).cast("int").alias("hi"),
                (a["sh"] + sh2).cast("int").alias("sh"))
        return F.aggregate(steps, zero, compose)

    def event(x):
        d = x["_d"]
        return (F.when(d < 0, low).otherwise(-(10**9)), F.when(d > 0, top).otherwise(10**9), d)
    slices = f.groupBy("vertical", "_slice").agg(
        F.count("*").alias("uses"), F.sum("entity_count").alias("entities"), F.sum("item_count").alias("items"),
        F.sum(F.col("entity_count") * F.col("avg_confidence")).alias("weighted"),
        F.countDistinct("video_id").alias("videos"),
        run(F.array_sort(F.collect_list(F.struct("ord", "_d"))), event).alias("st"))
    out = slices.groupBy("vertical").agg(
        F.sum("uses").alias("uses"), F.sum("entities").alias("entities"), F.sum("items").alias("items"),
        F.sum("weighted").alias("weighted"),
        run(F.array_sort(F.collect_list(F.struct("_slice", "st"))), lambda x: (x["st"]["lo"], x["st"]["hi"], x["st"]["sh"])).alias("st"))
    begin = int(round((start - 0.05) / 0.05))
    level = F.least(F.col("st.hi"), F.greatest(F.col("st.lo"), F.lit(begin) + F.col("st.sh")))
    return out.select("vertical", "uses", "entities", "items",
                      half_up(ratio("weighted", "entities"), 3).alias("avg_confidence"), (level * 0.05 + 0.05).alias("aggressiveness"))


def merged_names(rows: DataFrame, keep: int) -> DataFrame:
    """rows(vertical, ord, name): distinct names in first-seen order, first `keep` of each vertical."""
    first = rows.groupBy("vertical", "name").agg(F.min("ord").alias("_o"))
    w = W.partitionBy("vertical").orderBy("_o", "name")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("_o")


def vertical_insights(folded: DataFrame, categories: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """folded(vertical, uses, videos, entities, items, avg_confidence); categories(vertical, category, n).

    With names(vertical, rank, name) also the first ten shoppable names. Most used verticals first.
    """
    w = W.partitionBy("vertical").orderBy(F.desc("n"), "category")
    top = categories.withColumn("_r", F.row_number().over(w)).where("_r <= 5").groupBy("vertical").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "category"))), lambda x: x["category"]), ",").alias("top_categories"))
    d = folded.withColumn("maturity", ladder("uses", [(10, "stable"), (3, "developing")], "emerging")).withColumn(
        "avg_items", half_up(ratio("items", "videos"), 1)).withColumn("avg_entities", half_up(ratio("entities", "videos"), 1))
    d = d.withColumn("commercial_potential", ladder("avg_items", [(3.0, "high"), (1.0, "medium")], "low"))
    advice = cascade([
        (F.col("maturity") == "emerging", "needs more data to stabilize"),
        ((F.col("commercial_potential") == "high") & (F.col("maturity") == "developing"), "consider building a dedicated vertical config"),
        (F.col("commercial_potential") == "low", "commerce extraction needs improvement")])
    text = F.concat_ws(" — ", F.concat(F.initcap("commercial_potential"), F.lit(" commerce yield")),
                       F.concat(F.col("videos").cast("string"), F.when(F.col("videos") == 1, " video analyzed").otherwise(" videos analyzed")), advice)
    d = d.withColumn("opportunity", text).join(top, "vertical", "left")
    if names is not None:
        ten = names.where("rank <= 10").groupBy("vertical").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("top_entities"))
        d = d.join(ten, "vertical", "left")
    return d.orderBy(F.desc("uses"), "vertical")
