"""Knowledge hints: alias tables, containment hints, keyword lists and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions import text as tx
from shelfsight.functions.num import cascade
from shelfsight.operators.joins import containment_join, stored

PRIORITY = {"high": 3, "medium": 2, "low": 1}
HINT = ["term", "source", "confidence", "priority", "genus", "species", "cultivar"]


def priority_rank(col: str = "priority") -> Column:
    return cascade([(F.col(col) == k, v) for k, v in PRIORITY.items()], 0)


def usage_priority(usage: Column, ambiguity: Column) -> Column:
    amb = F.coalesce(ambiguity, F.lit(0.0))
    return cascade([((usage > 10) & (amb < 0.3), "high"), ((usage > 3) | (amb < 0.5), "medium")], "low")


def alias_hints(dictionary: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per alias; a clash goes to the higher priority, then to the first inserted."""
    amb = F.coalesce("ambiguity", F.lit(0.0))
    base = usage_priority(F.col("usage_count"), F.col("ambiguity"))
    d = dictionary.withColumn("_p", base)

    def kind(term: Column, conf: Column, prio: Column, k: int, lineage: bool = True) -> DataFrame:
        gone = F.lit(None).cast("string")
        return d.select(
            term.alias("term"), F.lit("plant_dictionary").alias("source"), conf.alias("confidence"),
            prio.alias("priority"), *[(F.col(x) if lineage else gone).alias(y) for x, y in
                                      [("genus", "genus"), ("species", "species"), ("variety", "cultivar")]],
            F.struct(F.col("entry_pos").cast("long").alias("e"), F.lit(k).alias("k")).alias("ord"))
    medium = F.lit("medium")
    rows = kind(F.lower("latin"), 1.0 - amb, F.col("_p"), 0)
    rows = rows.unionByName(kind(F.explode(F.transform("common", F.lower)), 0.9 - amb, F.col("_p"), 1))
    rows = rows.unionByName(kind(F.explode(F.transform("synonyms", F.lower)), 0.85 - amb, medium, 2))
    rows = rows.unionByName(kind(F.explode(F.transform("trade", F.lower)), F.lit(0.80), medium, 3, lineage=False))
    if rules is not None:
        rows = rows.unionByName(rules.select(
            F.lower("pattern").alias("term"), F.lit("disambiguation_rule").alias("source"),
            F.coalesce("confidence", F.lit(0.9)).alias("confidence"), F.lit("high").alias("priority"),
            "genus", "species", "cultivar",
            F.struct(F.lit(2**40).alias("e"), F.lit(4).alias("k")).alias("ord")))
    best = F.row_number().over(W.partitionBy("term").orderBy(F.desc(priority_rank()), "ord"))
    return rows.withColumn("_r", best).where("_r = 1").select(*HINT)


def entity_hints(docs: DataFrame, aliases: DataFrame, dictionary: DataFrame, trends: DataFrame) -> DataFrame:
    """docs(video_id, text): hints contained in the text, one per (document, term).

    Genus hints are added only where no alias hint of the document carries that genus; a
    term found by several sources keeps the last source.
    """
    none = F.lit(None).cast("string")
    genera = dictionary.where("genus IS NOT NULL").select(F.lower("genus").alias("term")).distinct()
    terms = aliases.select(*HINT, F.lower("genus").alias("_gk"), F.lit(0).alias("_src"))
    terms = terms.unionByName(genera.select(
        "term", F.lit("plant_dictionary").alias("source"), F.lit(0.85).alias("confidence"), F.lit("high").alias("priority"),
        F.col("term").alias("genus"), none.alias("species"), none.alias("cultivar"), F.col("term").alias("_gk"), F.lit(1).alias("_src")))
    terms = terms.unionByName(trends.select(
        "term", F.lit("market_trend").alias("source"), F.lit(0.75).alias("confidence"), F.lit("medium").alias("priority"),
        none.alias("genus"), none.alias("species"), F.col("term").alias("cultivar"), none.alias("_gk"), F.lit(2).alias("_src")))
    # One scan of the text for all three sources.
    low = docs.select("video_id", F.lower("text").alias("_low"))
    # Dealt by document once; the window and the grouping below then need no shuffle of their own.
    hit = containment_join(low, terms, "_low", "term", keep=["video_id"]).repartition("video_id")
    carried = F.min("_src").over(W.partitionBy("video_id", "_gk")) == 0
    every = hit.withColumn("_has", carried).where((F.col("_src") != 1) | ~F.col("_has"))
    # Column by column, so that what nobody reads is not shuffled.
    return every.groupBy("video_id", "term").agg(*[F.max_by(x, "_src").alias(x) for x in HINT[1:]])


def product_keywords(products: DataFrame) -> DataFrame:
    """Distinct keywords of product titles, varieties and brands."""
    words = F.concat(
        tx.title_words(F.col("title"), fixed.TITLE_STOP_WORDS, "'-"),
        F.filter(F.array(F.lower("variety"), F.lower("brand")), lambda x: x.isNotNull()))
    return products.select("title", "variety", "brand").distinct().select(F.explode(words).alias("keyword")).distinct()


def market_trends(products: DataFrame, minimum: int = 3) -> DataFrame:
    """Terms of recent products that occur at least `minimum` times.

    Equal titles are counted before the words are split out, so the explode runs over
    distinct titles, not over mentions.
    """
    titles = products.groupBy("title", "variety").agg(F.count("*").alias("n"))
    words = F.concat(
        F.filter(F.array(F.lower("variety")), lambda x: x.isNotNull()),
        tx.title_words(F.col("title"), fixed.TITLE_STOP_WORDS, "'-"))
    return (titles.select("n", F.explode(words).alias("term")).groupBy("term")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= minimum))


def adaptive_keywords(hints: DataFrame, rules: DataFrame | None = None, cap: int = 100, lineage: bool = True) -> DataFrame:
    """High-priority terms (with genus, species, cultivar), then medium terms up to `cap`,
    then the context words of matching rules. One row per (document, keyword).

    With rules the hints are read twice and so stored once: their search is not repeated."""
    parts = ["genus", "species", "cultivar"] if lineage else []
    if rules is not None:
        hints = stored(hints.select("video_id", "term", "priority", *parts))
    high = F.filter(F.array("term", *[F.lower(x) for x in parts]), lambda x: x.isNotNull())
    words = hints.where("priority IN ('high', 'medium')").select(
        "video_id", F.explode(F.when(F.col("priority") == "high", high).otherwise(F.array("term"))).alias("keyword"),
        F.col("priority").alias("_from"))
    if rules is not None:
        ctx = rules.select(F.lower("pattern").alias("term"), F.explode("context_keywords").alias("keyword"))
        words = words.unionByName(hints.select("video_id", "term").join(ctx, "term").select(
            "video_id", F.lower("keyword").alias("keyword"), F.lit("rule").alias("_from")))
    one = words.groupBy("video_id", "keyword").agg(*[F.bool_or(F.col("_from") == x).alias(f"_{x}") for x in ("high", "medium", "rule")])
    # As in a join, a null id equals no other.
    known = F.col("video_id").isNotNull()
    per = W.partitionBy("video_id")
    one = one.withColumn("_medium", F.col("_medium") & ~(F.col("_high") & known)).withColumn(
        "_n", F.count_if(F.col("_high") & known).over(per)).withColumn(
        "_r", F.count_if("_medium").over(per.orderBy("keyword").rowsBetween(W.unboundedPreceding, 0)))
    return one.where(F.col("_high") | F.col("_rule") | (F.col("_medium") & (F.col("_r") + F.col("_n") <= cap))).select("video_id", "keyword")


def lost_hints(hints: DataFrame, processed: DataFrame) -> DataFrame:
    """High-priority hints whose term is missing from the processed text.

    The processed texts are stored first: a test of them, as a join adds for nulls, would be moved to
    their source and process every text twice, there in as many tasks as the source has splits.
    """
    p = stored(processed.select("video_id", F.lower("processed").alias("_p")))
    return hints.where("priority = 'high'").join(p, "video_id").where(
        ~F.contains(F.col("_p"), F.col("term"))).select("video_id", "term")


def commerce_priority(category: Column, confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.5))
    return cascade([(category.isin(fixed.HIGH_VALUE_COMMERCE) & (c >= 0.85), "high"), (c >= 0.75, "medium")], "low")


def commerce_history(items: DataFrame, minimum: float = 0.7) -> DataFrame:
    """items(name, category, confidence, ord): last confident write per name."""
    good = items.where(F.col("confidence") >= minimum).withColumn("term", F.lower("name"))
    last = F.max_by(F.struct("category", "confidence"), "ord").alias("x")
    return good.groupBy("term").agg(last).select("term", "x.*").withColumn(
        "priority", commerce_priority(F.col("category"), F.col("confidence")))


def category_hints(docs: DataFrame, history: DataFrame, offers: DataFrame, category_terms: DataFrame) -> DataFrame:
    """Commerce names, offer words (0.70) and category words (0.75); last source wins per term.

    category_terms(term, category, cat_pos): the last category of a term in list order wins.
    """
    low = docs.select("video_id", F.lower("text").alias("_low"))
    ct = category_terms.groupBy("term").agg(F.max_by("category", "cat_pos").alias("category"))
    src = (history.select("term", "confidence", "priority", F.lit(0).alias("_src"))
           .unionByName(offers.select("term").distinct().select(
               "term", F.lit(0.70).alias("confidence"), F.lit("medium").alias("priority"), F.lit(1).alias("_src")))
           .unionByName(ct.select("term", F.lit(0.75).alias("confidence"),
                                  commerce_priority(F.col("category"), F.lit(0.75)).alias("priority"), F.lit(2).alias("_src"))))
    src = src.groupBy("term").agg(F.max_by(F.struct("confidence", "priority"), "_src").alias("x")).select("term", "x.*")
    return containment_join(low, src, "_low", "term", keep=["video_id"])


def detect_categories(docs: DataFrame, category_terms: DataFrame, minimum: int = 3) -> DataFrame:
    """Categories with at least `minimum` distinct terms in the text."""
    low = docs.select("video_id", F.lower("text").alias("_low"))
    hit = containment_join(low, category_terms.select("term", "category").distinct(), "_low", "term", keep=["video_id"])
    return hit.groupBy("video_id", "category").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def hinted_categories(hints: DataFrame, category_terms: DataFrame, minimum: int = 3) -> DataFrame:
    """detect_categories over each document's distinct hint terms, sorted and joined by blanks.

    A category term without a blank lies in that text exactly when it lies in one hint term without
    a blank, or in one word of the others; so the distinct hint terms are searched once, not every
    document's list. Terms with a blank may reach over two hints and are searched in the lists.
    """
    ct = category_terms.select("term", "category").distinct()
    plain, wide = ct.where(~F.contains("term", F.lit(" "))), ct.where(F.contains("term", F.lit(" ")))
    names = hints.select(F.col("term").alias("_hint")).distinct().withColumn("_text", F.col("_hint"))
    inside = containment_join(names, plain, "_text", "term", keep=["_hint"])
    each = hints.select("video_id", F.col("term").alias("_hint"))
    hit = each.join(inside, "_hint").select("video_id", "term", "category")
    if not wide.isEmpty():
        joined = hints.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("text"))
        hit = hit.unionByName(containment_join(joined, wide, "text", "term", keep=["video_id"]))
    return hit.distinct().groupBy("video_id", "category").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def multi_category_keywords(hints: DataFrame, category_terms: DataFrame, cap: int = 150, per_category: int = 20) -> DataFrame:
    """High and medium hint terms (capped), plus the first words of each category that the
    hint terms themselves indicate. category_terms(term, category, pos)."""
    base = adaptive_keywords(hints, cap=cap, lineage=False)
    cats = hinted_categories(hints, category_terms).select("video_id", "category")
    first = category_terms.where(F.col("pos") <= per_category).select("category", F.col("term").alias("keyword"))
    return base.unionByName(cats.join(first, "category").select("video_id", "keyword")).distinct()
