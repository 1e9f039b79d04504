"""Entity lookup, resolution, disambiguation, calibration and enrichment.

Dictionary: entry_pos, latin, genus, species, variety, common[], synonyms[], trade[],
usage_count, ambiguity. Ties always go to the lower entry_pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions import similarity as sim
from shelfsight.functions import text as tx
from shelfsight.functions.num import cap, cascade, clamp, half_up
from shelfsight.operators.joins import containment_join, coverage_spans, edit_ratio_join, salted_join, stored, within_spans_join

STAGES = [  # (stage, alias kind, match type, confidence)
    (1, "latin", "exact", 1.0), (2, "common", "exact", 0.95), (3, "synonym", "synonym", 0.9),
    (4, "variety", "synonym", 0.88), (5, "trade", "synonym", 0.85),
]


def alias_table(dictionary: DataFrame) -> DataFrame:
    """Long alias table (entry_pos, kind, alias_no, alias), lower-cased."""
    def one(kind, arr):
        return dictionary.select("entry_pos", F.lit(kind).alias("kind"), F.posexplode(arr).alias("alias_no", "alias"))
    low = lambda c: F.transform(c, F.lower)
    out = one("latin", F.array(F.lower("latin")))
    for kind, col in (("common", "common"), ("synonym", "synonyms"), ("trade", "trade")):
        out = out.unionByName(one(kind, low(F.col(col))))
    return out.unionByName(one("variety", F.filter(F.array(F.lower("variety")), lambda x: x.isNotNull())))


def validate_dictionary(rows: DataFrame) -> DataFrame:
    """Add `problems`: empty for valid rows. Names required, levels an enum, ambiguity 0-1, usage >= 0."""
    levels = ["genus", "species", "cultivar", "variety", "subspecies"]
    checks = [
        (F.coalesce(F.length(F.trim("latin")), F.lit(0)) == 0, "latin name missing"),
        (F.coalesce(F.size("common"), F.lit(0)) <= 0, "common names missing"),
        (F.col("level").isNotNull() & ~F.col("level").isin(levels), "unknown level"),
        (F.col("ambiguity").isNotNull() & ~F.col("ambiguity").between(0.0, 1.0), "ambiguity out of range"),
        (F.col("usage_count") < 0, "usage negative"),
    ]
    found = F.array(*[F.when(c, F.lit(m)) for c, m in checks])
    return rows.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def lookup(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Exact lookup of lower+trimmed names: latin, else first common owner, else first synonym owner."""
    rank = {"latin": 1, "common": 2, "synonym": 3}
    al = alias_table(dictionary).where(F.col("kind").isin(list(rank)))
    al = al.withColumn("_k", cascade([(F.col("kind") == k, v) for k, v in rank.items()]))
    # One winner per alias before the join, so the join cannot multiply rows.
    al = al.groupBy("alias").agg(F.min(F.struct("_k", "entry_pos", "kind")).alias("w")).select(
        F.col("alias").alias("_key"), F.col("w.entry_pos").alias("entry_pos"), F.col("w.kind").alias("found_by"))
    return names.withColumn("_key", F.lower(F.trim("name"))).join(al, "_key", "left").drop("_key")


def search(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries with the query inside latin, common, synonym or genus; one row per (query, entry)."""
    al = alias_table(dictionary).where("kind IN ('latin','common','synonym')").select("entry_pos", "alias")
    al = al.unionByName(dictionary.where("genus IS NOT NULL").select("entry_pos", F.lower("genus").alias("alias"))).distinct()
    q = queries.select("query", F.lower(F.trim("query")).alias("_q")).distinct()
    hit = containment_join(al, q, "alias", "_q", keep=["entry_pos"])
    return hit.select("query", "entry_pos").distinct()


def resolve_exact(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """queries(query): the first stage of the cascade that matches, by one equi-join.

    Latin, common and synonym aliases are compared as written, variety and trade aliases
    normalised. Unmatched queries keep null match columns.
    """
    al = alias_table(dictionary).withColumn(
        "alias", F.when(F.col("kind").isin("variety", "trade"), tx.normalise_name(F.col("alias"))).otherwise(F.col("alias")))
    stage = cascade([(F.col("kind") == k, s) for s, k, _, _ in STAGES])
    best = al.groupBy("alias").agg(F.min(F.struct(stage.alias("stage"), "entry_pos")).alias("b")).select(
        F.col("alias").alias("norm"), "b.stage", "b.entry_pos")
    out = queries.select("query").distinct().withColumn("norm", tx.normalise_name(F.col("query"))).join(best, "norm", "left")
    pick = lambda i: cascade([(F.col("stage") == s[0], s[i]) for s in STAGES])
    return out.withColumn("match_type", pick(2)).withColumn("confidence", pick(3))


def fuzzy_candidates(queries: DataFrame, dictionary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Scored (query, entry) pairs at or above the threshold; queries(query, norm).

    The score weighs word overlap .2, edit ratio .5 and Jaro-Winkler .3. Without a shared
    word it is at most .8, and reaches .8 only for equal strings, so for thresholds from .8
    up a shared word is a necessary condition and the equi-join on words loses nothing.
    Below, pairs without a shared word need an edit ratio of (threshold - .3) / .5, which a
    join on lengths and signatures finds; thresholds go down to .55, where that ratio is one half.
    Null names pair with nothing; words that many targets hold are split over tasks.
    """
    if threshold < 0.55:
        raise ValueError("thresholds below 0.55 have no exact blocking rule")
    al = alias_table(dictionary).where("kind IN ('latin','common','variety')").withColumn(
        "target", F.when(F.col("kind") == "variety", tx.normalise_name(F.col("alias"))).otherwise(F.col("alias")))
    al = al.select("entry_pos", "kind", "alias_no", "target")
    if threshold < 0.8:
        # Both are read by many branches of the plan.
        queries, al = stored(queries.select("query", "norm")), stored(al)

    def words(c):
        return F.explode(F.array_distinct(F.split(c, " "))).alias("_w")
    q = queries.select("norm").distinct().select("norm", words(F.col("norm")))
    t = al.select("target").distinct().select("target", words(F.col("target")))
    a, b = F.col("norm"), F.col("target")
    word, edit = sim.word_overlap(a, b), sim.edit_ratio(a, b)
    whole = sim.contained_as_words(a, b)
    # The length band bounds the edit ratio and is tested inside the join.
    need = (threshold - 0.2 - 0.3) / 0.5
    band = (F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b)) * need) | F.contains(b, a)
    pairs = salted_join(q, t, "_w").where(band).select("norm", "target")
    if threshold < 0.8:
        # Stored, or the conditions below would be moved into the join, ahead of its cheap bounds.
        close = stored(edit_ratio_join(queries, al, "norm", "target", (threshold - 0.3) / 0.5 - 1e-9 if threshold > 0.55 else 0.5))
        # Jaro makes small rows dear: a fixed number of tasks, which is not lowered by their size.
        pairs = pairs.unionByName(close).repartition(8 * close.sparkSession.sparkContext.defaultParallelism, "norm", "target")
    pairs = pairs.distinct()
    pairs = pairs.withColumn("_whole", whole).withColumn("_part", word * 0.2 + edit * 0.5)
    # Jaro-Winkler is at most 1: pairs that cannot reach the threshold never meet the UDF.
    pairs = pairs.where(F.col("_whole") | (F.col("_part") + 0.3 >= threshold - 1e-9))
    equal_or_whole = F.when(a == b, F.lit(1.0)).when(F.col("_whole"), sim.contained_score(a, b))
    pairs = pairs.withColumn("score", F.coalesce(
        equal_or_whole, F.col("_part") + sim.jaro_winkler(a, b) * 0.3)).where(F.col("score") >= threshold)
    # Per entry: latin, else the first common name, else the variety at 0.95 of its score.
    kind_rank = cascade([(F.col("kind") == "latin", 0), (F.col("kind") == "common", 1)], 2)
    # Strings are scored once, then carried to every query and alias that has them.
    pairs = pairs.select("norm", "target", "score").join(queries.select("query", "norm"), "norm").join(al, "target")
    best = pairs.groupBy("query", "entry_pos").agg(
        F.min(F.struct(kind_rank.alias("k"), "alias_no", "score")).alias("b"))
    return best.select("query", "entry_pos", F.when(
        F.col("b.k") == 2, F.col("b.score") * 0.95).otherwise(F.col("b.score")).alias("score"))


def fuzzy_ranked(candidates: DataFrame, keep: int = 4) -> DataFrame:
    w = W.partitionBy("query").orderBy(F.desc(F.floor(F.col("score") * 1e9 + 0.5)), "entry_pos")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def resolve(queries: DataFrame, dictionary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per distinct query: cheap equi-join first, only the rest goes to the fuzzy stage."""
    exact = resolve_exact(queries, dictionary)
    rest = exact.where("stage IS NULL").select("query", "norm")
    fz = fuzzy_ranked(fuzzy_candidates(rest, dictionary, threshold)).groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("entry_pos"))).alias("_e"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_s"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "entry_pos")))),
                    lambda x: x["entry_pos"]).alias("alternatives"))
    out = exact.join(fz, "query", "left")
    return out.select(
        "query", F.coalesce("entry_pos", "_e").alias("entry_pos"),
        F.coalesce("match_type", F.when(F.col("_e").isNotNull(), "fuzzy"), F.lit("none")).alias("match_type"),
        F.coalesce("confidence", F.col("_s") * 0.85, F.lit(0.0)).alias("confidence"), "alternatives")


def match_report(resolved: DataFrame) -> DataFrame:
    return resolved.rollup("match_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def related(dictionary: DataFrame, limit: int = 5) -> DataFrame:
    """Entries whose latin starts with the genus, or with a common name containing the
    entry's first common name; the first `limit` in dictionary order."""
    d = dictionary.select("entry_pos", "latin", F.split("latin", " ")[0].alias("g"), F.lower(F.try_element_at("common", F.lit(1))).alias("c"))
    # Prefix test as an equi-join on the genus' leading word plus the distinct prefix lengths.
    others = dictionary.select(F.col("entry_pos").alias("other"), F.col("latin").alias("other_latin"), "common")
    prefixes = others.select("other", "other_latin", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("other_latin")), lambda n: F.substr(F.col("other_latin"), F.lit(1), n))).alias("g"))
    by_genus = d.where(F.length("g") > 0).join(prefixes, "g").select("entry_pos", "latin", "other", "other_latin")
    names = others.select("other", "other_latin", F.explode(F.transform("common", F.lower)).alias("_n"))
    firsts = d.where("c IS NOT NULL").select("entry_pos", "latin", "c")
    by_name = containment_join(names, firsts, "_n", "c", keep=["other", "other_latin"])
    pairs = by_genus.unionByName(by_name.select(*by_genus.columns)).where("latin <> other_latin").select("entry_pos", "other").distinct()
    w = W.partitionBy("entry_pos").orderBy("other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def candidates(names: DataFrame, dictionary: DataFrame, limit: int = 10) -> DataFrame:
    """names(entity): dictionary entries containing the name, first `limit`, with match score."""
    al = alias_table(dictionary).where("kind IN ('latin','common')")
    q = names.select("entity", F.lower(F.trim("entity")).alias("_q")).distinct()
    hit = containment_join(al, q, "alias", "_q", keep=["entry_pos", "kind", "alias"])
    eq = F.col("alias") == F.col("_q")
    score = cascade([((F.col("kind") == "latin") & eq, 1.0), (eq, 0.95), (F.col("kind") == "latin", 0.7)], 0.6)
    per = hit.groupBy("entity", "entry_pos").agg(F.max(score).alias("match_score"))
    w = W.partitionBy("entity").orderBy("entry_pos")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def genus_nearby(mentions: DataFrame, genera: DataFrame, seconds: float = 60) -> DataFrame:
    """(mention, genus) where another mention within `seconds` starts with the genus.

    Counted by a range frame per (video, genus, time block), so no mention pairs appear
    and a long video is split by time.
    """
    block = 3600
    m = mentions.select("mention_id", "video_id", "t", F.lower("entity").alias("_e"))
    # Prefixes of the entity meet genera by an equi-join; an empty entity has none.
    pre = m.where("_e <> ''").select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("_e")), lambda n: F.substr(F.col("_e"), F.lit(1), n))).alias("genus"))
    starts = pre.join(genera.select("genus"), "genus").select("mention_id", "video_id", "t", "genus")
    spans = coverage_spans(starts, ["video_id", "genus"], "t", seconds)
    near = within_spans_join(m.select("mention_id", "video_id", "t"), spans, ["video_id"], "t", block)
    # A mention's own start only counts when another start lies within reach of it.
    dense = starts.withColumn("_c", F.count("*").over(
        W.partitionBy("video_id", "genus").orderBy("t").rangeBetween(-int(seconds), int(seconds))))
    alone = dense.where("_c = 1").select("mention_id", "genus")
    return near.select("mention_id", "genus").join(alone, ["mention_id", "genus"], "left_anti")


#: Candidates, of short columns, that may be copied to every task.
FEW_CANDIDATES = 100_000


def score_candidates(mentions: DataFrame, cands: DataFrame, dictionary: DataFrame, seconds: float = 60) -> DataFrame:
    """mentions(mention_id, video_id, t, entity, context): candidates scored with context."""
    c = stored(cands.join(dictionary.select("entry_pos", "latin"), "entry_pos").withColumn(
        "genus", F.lower(F.split("latin", " ")[0])))
    small = c.count() <= FEW_CANDIDATES
    near = genus_nearby(mentions, c.select("genus").distinct(), seconds).withColumn("_near", F.lit(True))
    m = mentions.select("mention_id", "entity", F.lower("context").alias("_ctx"))
    # The context is tested before the pairs are shuffled and stays behind; few candidates come to the contexts.
    j = m.join(F.broadcast(c) if small else c, "entity").select(
        "mention_id", *c.columns, F.contains("_ctx", "genus").alias("_named"),
        (F.contains(F.col("latin"), F.lit(" ")) & F.contains(F.col("_ctx"), F.lit("variety"))).alias("_variety"))
    j = j.join(near, ["mention_id", "genus"], "left")
    s = F.col("match_score")
    s = s * F.when(F.col("_near"), 1.2).otherwise(1.0)
    s = s * F.when(F.col("_named"), 1.15).otherwise(1.0)
    s = s * F.when(F.col("_variety"), 1.1).otherwise(1.0)
    return j.withColumn("score", cap(s, 1.0)).drop("_named", "_variety", "_near", "rank")


def disambiguate(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    """Best candidate per mention; close seconds are flagged for review."""
    key = F.floor(F.col("score") * 1e9 + 0.5)
    w = W.partitionBy("mention_id").orderBy(F.desc(key), "entry_pos")
    r = scored.withColumn("_r", F.row_number().over(w)).withColumn("_second", F.lead("score").over(w)).withColumn(
        "_n", F.count("*").over(W.partitionBy("mention_id")))
    top = r.where("_r = 1").select(
        "mention_id", "entry_pos", F.when(F.col("_n") == 1, 0.95).otherwise(F.col("score")).alias("confidence"),
        F.coalesce(F.col("_second") >= F.col("score") * 0.9, F.lit(False)).alias("needs_review"),
        F.least(F.col("_n") - 1, F.lit(3)).cast("long").alias("alternatives"))
    return mentions.select("mention_id", "entity").join(top, "mention_id", "left").select(
        "mention_id", "entity", F.col("entry_pos").isNotNull().alias("resolved"), "entry_pos",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce("alternatives", F.lit(0)).alias("alternatives"))


def nearby_entities(mentions: DataFrame, seconds: float = 60) -> DataFrame:
    """Distinct names of other mentions within `seconds`, one row per (mention, name).

    Each name's mentions are merged into covered spans first, so a mention meets a name
    once however often the name occurs. Mentions are told apart by their mention_id; several
    names of one video may share it and are then no others to each other.
    """
    m = mentions.select("mention_id", "video_id", "t", "entity").distinct()
    spans = coverage_spans(m, ["video_id", "entity"], "t", seconds).withColumnRenamed("entity", "nearby")
    near = within_spans_join(m, spans, ["video_id"], "t", 600)
    # A name only counts when a mention of it with another id lies in reach. Only names under the
    # mention's own id can fail that; each such pair looks at the name's ids around its moment.
    same = m.join(m.select("video_id", "mention_id", F.col("entity").alias("nearby")).distinct(), ["video_id", "mention_id"])
    probes = same.select("video_id", F.col("nearby").alias("_name"), "t", F.col("mention_id").alias("_of"), "entity")
    points = m.select("video_id", F.col("entity").alias("_name"), "t", "mention_id")
    w = W.partitionBy("video_id", "_name").orderBy("t").rangeBetween(-int(seconds), int(seconds))
    seen = points.unionByName(probes, allowMissingColumns=True).withColumn(
        "_lo", F.min("mention_id").over(w)).withColumn("_hi", F.max("mention_id").over(w))
    alone = seen.where("_of IS NOT NULL AND _lo = _of AND _hi = _of").select(
        "video_id", F.col("_of").alias("mention_id"), "entity", "t", F.col("_name").alias("nearby"))
    return near.join(alone, ["video_id", "mention_id", "entity", "t", "nearby"], "left_anti").select(
        "mention_id", "video_id", "entity", "nearby")


def last_per_name(results: DataFrame, order: str = "mention_id") -> DataFrame:
    return results.groupBy("video_id", "entity").agg(F.max_by(F.struct(*[c for c in results.columns if c not in ("video_id", "entity")]), order).alias("x")).select("video_id", "entity", "x.*")


def ambiguity_reason(entity: Column, latin: Column, common: Column, confidence: Column) -> Column:
    low = F.lower(entity)
    known = F.lit(False)
    for t in fixed.AMBIGUOUS_NAMES:
        known = known | F.contains(low, F.lit(t))
    no_latin = F.coalesce(F.length(latin), F.lit(0)) == 0
    return cascade([
        (no_latin & (F.coalesce(F.length(common), F.lit(0)) > 0), "Common name only - no Latin name provided"),
        ((F.size(F.split(entity, r"\s+")) == 1) & (confidence < 0.7), "Single word with low confidence"),
        (known & no_latin, "Known ambiguous common name")])


def context_quality(context: Column) -> Column:
    words = tx.word_count(context)
    low = F.lower(context)
    desc = low.rlike("(?:" + "|".join(fixed.DESCRIPTIVE_WORDS) + ")")
    s = F.lit(0.5) + cascade([(words.between(5, 25), 0.2), (words < 3, -0.2)], 0.0)
    s = s + F.when(desc, 0.15).otherwise(0.0)
    s = s + F.when(context.rlike("(?i)(?:" + fixed.SPECIFICS_PATTERN + ")"), 0.15).otherwise(0.0)
    s = s - F.when(context.rlike("(?i)(?:" + fixed.VAGUE_PATTERN + ")"), 0.2).otherwise(0.0)
    return clamp(s, 0, 1)


def specificity(latin: Column, genus: Column, subspecies: Column, variety: Column) -> Column:
    has = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    return cascade([(has(variety), 1.0), (has(subspecies), 0.8),
                    (has(latin) & (F.size(F.split(latin, " ")) >= 2), 0.6), (has(latin) | has(genus), 0.3)], 0.0)


FACTORS = ["pattern_match", "in_dictionary", "dictionary_confidence", "multiple", "mentions", "duration_s",
           "context_quality", "has_variety", "specificity", "with_known", "co_occurrences", "visual",
           "caption_type", "tag_match", "topic_match", "description_match", "vertical_confidence"]


def calibrate(mentions: DataFrame) -> DataFrame:
    """Calibrated confidence from the raw one and FACTORS; penalties apply to the running value."""
    raw = F.col("confidence")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    bonus = {
        "pattern": F.when(on("pattern_match"), raw * 0.15).otherwise(0.0),
        "dictionary": F.when(on("in_dictionary"), raw * 0.2 * F.when(
            F.coalesce(F.col("dictionary_confidence"), F.lit(0.0)) > 0, F.col("dictionary_confidence")).otherwise(1.0)).otherwise(0.0),
        "temporal": F.when(on("multiple"), cap(F.col("mentions") / 5.0, 1) * 0.15 * raw
                           + cap(F.col("duration_s") / 120.0, 1) * 0.1 * raw).otherwise(0.0),
        "context": F.when(F.col("context_quality") > 0.7, F.col("context_quality") * 0.1 * raw).otherwise(0.0),
        "variety": F.when(on("has_variety"), F.col("specificity") * 0.1 * raw).otherwise(0.0),
        "co_occurrence": F.when(on("with_known"), cap(F.col("co_occurrences") / 3.0, 1) * 0.08 * raw).otherwise(0.0),
        "visual": F.when(on("visual"), raw * 0.2).otherwise(0.0),
        "metadata": (F.when(F.col("caption_type") == "manual", raw * 0.05).otherwise(0.0)
                     + F.when(on("tag_match"), raw * 0.1).otherwise(0.0)
                     + F.when(on("topic_match"), raw * 0.08).otherwise(0.0)
                     + F.when(on("description_match"), raw * 0.12).otherwise(0.0)
                     + F.when(F.col("vertical_confidence") > 0.7, raw * 0.05).otherwise(0.0)),
    }
    d = mentions
    for k, v in bonus.items():
        d = d.withColumn(f"{k}_bonus", v)
    b = lambda k: F.col(f"{k}_bonus")
    run = raw + b("pattern") + b("dictionary") + b("temporal")
    run = F.when(F.col("context_quality") < 0.3, run * 0.9).otherwise(run + b("context"))
    run = run + b("variety") + b("co_occurrence") + b("visual")
    run = run * F.when(F.col("caption_type") == "auto", 0.95).otherwise(1.0)
    run = run * F.when(F.col("vertical_confidence") < 0.3, 0.85).otherwise(1.0)
    d = d.withColumn("calibrated", cap(run + b("metadata"), 1.0))
    warn = F.array(
        F.when(~on("in_dictionary") & (raw > 0.7), "Entity not found in canonical dictionary"),
        F.when(~on("multiple") & (F.col("mentions") == 1) & (F.col("duration_s") < 15), "Only mentioned once and briefly"),
        F.when(F.col("context_quality") < 0.3, "Context quality is low"),
        F.when(F.col("caption_type") == "auto", "Auto-generated captions may contain ASR errors"),
        F.when(F.col("vertical_confidence") < 0.3, "Video may not match target vertical"))
    return d.withColumn("adjustment", F.when(raw > 0, F.col("calibrated") / raw).otherwise(1.0)).withColumn(
        "reliability", cascade([((F.col("calibrated") >= 0.85) & on("in_dictionary") & on("multiple"), "high"),
                                (F.col("calibrated") >= 0.6, "medium")], "low")).withColumn(
        "warnings", F.filter(warn, lambda x: x.isNotNull()))


def co_occurrence(mentions: DataFrame, seconds: float = 60) -> DataFrame:
    """Per (video, key): over its own mentions, how many other keys have a time within `seconds`.

    Every key's reach is merged into disjoint spans; each span opens with +1 and closes
    with -1, and a running sum over time counts the keys in reach of any moment. The sum is
    taken per (video, hour) on top of hour totals, so neither key pairs nor a whole video
    are ever gathered.
    """
    m = mentions.withColumn("key", F.coalesce("latin", "entity"))
    # Mentions at one moment each count, so moments keep their number of mentions.
    own = m.groupBy("video_id", "key", "t").agg(F.count("*").alias("_m"))
    first = m.groupBy("video_id", "key").agg(F.min_by("in_dictionary", "mention_id").alias("known"))
    spans = coverage_spans(own, ["video_id", "key"], "t", seconds).join(first, ["video_id", "key"])

    one = F.when(F.col("known"), 1).otherwise(0)
    opens = spans.select("video_id", F.col("span_lo").alias("t"), F.lit(0).alias("_o"), F.lit(1).alias("_d"), one.alias("_k"))
    closes = spans.select("video_id", F.col("span_hi").alias("t"), F.lit(2).alias("_o"), F.lit(-1).alias("_d"), (-one).alias("_k"))
    points = own.join(first, ["video_id", "key"]).select(
        "video_id", "key", "known", "t", "_m", F.lit(1).alias("_o"), F.lit(0).alias("_d"), F.lit(0).alias("_k"))
    ev = opens.unionByName(closes).unionByName(points, allowMissingColumns=True).withColumn("_h", F.floor(F.col("t") / 3600))
    hours = ev.groupBy("video_id", "_h").agg(F.sum("_d").alias("_hd"), F.sum("_k").alias("_hk"))
    before = W.partitionBy("video_id").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    hours = hours.select("video_id", "_h", F.coalesce(F.sum("_hd").over(before), F.lit(0)).alias("_bd"),
                         F.coalesce(F.sum("_hk").over(before), F.lit(0)).alias("_bk"))
    run = W.partitionBy("video_id", "_h").orderBy("t", "_o").rowsBetween(W.unboundedPreceding, 0)
    ev = ev.withColumn("_d", F.sum("_d").over(run)).withColumn("_k", F.sum("_k").over(run)).where("_o = 1").join(hours, ["video_id", "_h"])
    others = F.col("_d") + F.col("_bd") - 1
    known = F.col("_k") + F.col("_bk") - F.when(F.col("known"), 1).otherwise(0)
    return ev.groupBy("video_id", "key").agg(F.sum(others * F.col("_m")).alias("co_occurrences"), (F.max(known) > 0).alias("with_known"))


def potential_genera(docs: DataFrame, genera=None) -> DataFrame:
    """Capitalised word followed by a lower-case word, plus known genera in the text; distinct."""
    pat = tx.word_bounded(r"([A-Z][a-z]{3,})\s+[a-z]{3,}")
    found = F.regexp_extract_all("text", F.lit(pat), F.lit(1))
    known = F.filter(F.lit(genera or fixed.KNOWN_GENERA), lambda g: F.contains(F.col("text"), g))
    return docs.select("video_id", F.explode(F.array_union(found, known)).alias("genus"))


def variety_hints(genera: DataFrame, dictionary: DataFrame, keep: int = 10) -> DataFrame:
    """genera(genus) -> one rendered line per genus with its most used varieties."""
    g = genera.select("genus", F.lower("genus").alias("_g")).distinct()
    d = dictionary.where("variety IS NOT NULL AND genus IS NOT NULL").select(
        F.lower("genus").alias("_g"), "species", "variety", "usage_count", "entry_pos")
    w = W.partitionBy("_g").orderBy(F.desc("usage_count"), "entry_pos")
    top = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    label = F.concat(F.lit("'"), "variety", F.lit("'"), F.coalesce(F.concat(F.lit(" "), "species"), F.lit("")))
    lines = top.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", label.alias("l")))), lambda x: x["l"]).alias("_l"))
    return g.join(lines, "_g").select("genus", F.size("_l").cast("long").alias("hints"),
                                      F.concat("genus", F.lit(": "), F.array_join("_l", ", ")).alias("line"))


def entity_id(latin: Column) -> Column:
    return F.regexp_replace(F.lower(latin), r"\s+", "_")


def enrich(mentions: DataFrame, dictionary: DataFrame, disambiguated: DataFrame | None = None) -> DataFrame:
    """Add entity_id: by latin name, by name, by disambiguation, or derived at confidence >= .7."""
    latin_key = dictionary.groupBy(F.lower("latin").alias("_k")).agg(F.min_by("latin", "entry_pos").alias("_l1"))
    m = mentions.withColumn("needs_disambiguation", F.coalesce(
        (F.col("level") == "genus") | ((F.length("latin") > 0) & ~F.contains(F.col("latin"), F.lit(" "))), F.lit(False)))
    m = m.withColumn("_k", F.lower(F.trim("latin"))).join(latin_key, "_k", "left").drop("_k")
    names = lookup(mentions.select(F.col("entity").alias("name")).distinct(), dictionary).join(
        dictionary.select("entry_pos", F.col("latin").alias("_l2")), "entry_pos").select(F.col("name").alias("entity"), "_l2")
    m = m.join(names, "entity", "left")
    if disambiguated is not None:
        dis = disambiguated.where("resolved").join(dictionary.select("entry_pos", F.col("latin").alias("_l3")), "entry_pos")
        m = m.join(dis.select("mention_id", "_l3", F.col("confidence").alias("_c3")), "mention_id", "left")
    else:
        m = m.withColumn("_l3", F.lit(None).cast("string")).withColumn("_c3", F.lit(None).cast("double"))
    third = F.col("_l1").isNull() & F.col("_l2").isNull() & F.col("needs_disambiguation") & F.col("_l3").isNotNull()
    derived = F.when((F.length("latin") > 0) & (F.col("confidence") >= 0.7), entity_id(F.col("latin")))
    return m.withColumn("disambiguated", third).withColumn(
        "entity_id", F.coalesce(entity_id(F.col("_l1")), entity_id(F.col("_l2")), F.when(third, entity_id(F.col("_l3"))), derived)
    ).withColumn("confidence", F.when(third, F.col("_c3")).otherwise(F.col("confidence"))).drop("_l1", "_l2", "_l3", "_c3")


def enrichment_metrics(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("video_id").agg(
        F.count("*").alias("entities"), F.count_if("disambiguated").alias("disambiguated"),
        F.count_if("needs_disambiguation").alias("genus_only"), F.avg("confidence").alias("avg_confidence"))


def first_timestamps(entities: DataFrame, segments: DataFrame) -> DataFrame:
    """entities(video_id, entity, ts): earliest segment of the video that contains the name.

    Distinct names are searched in every segment once, then kept for the videos that list them.
    """
    names = entities.select("entity", F.lower("entity").alias("_n")).distinct()
    seg = segments.select(F.struct("video_id", "start_s").alias("_k"), "video_id", "start_s", F.lower("text").alias("_x"))
    hit = containment_join(seg, names, "_x", "_n", keep=["_k"])
    first = hit.groupBy(F.col("_k.video_id").alias("video_id"), "entity").agg(F.min("_k.start_s").alias("_first"))
    given = F.when(F.col("ts") != "00:00:00", tx.clock_seconds(F.col("ts")))
    out = entities.join(first, ["video_id", "entity"], "left").withColumn(
        "seconds", F.coalesce("_first", given, F.lit(0.0)).cast("long")).drop("_first")
    return out.withColumn("link", F.concat(F.lit("https://youtube.com/watch?v="), "video_id", F.lit("&t="), "seconds"))


def filter_categories(entities: DataFrame, categories: list[str]) -> DataFrame:
    wanted = [c.upper().rstrip("S") if c.upper() not in fixed.COMMERCE_CATEGORIES else c.upper() for c in categories]
    return entities.where(F.upper("category").isin(wanted)).groupBy("video_id").agg(
        F.count("*").alias("entities"), F.array_sort(F.collect_set(F.lower("category"))).alias("categories"))


def language_rollup(videos: DataFrame, results: DataFrame) -> DataFrame:
    """Left join of extraction results: language default `en`, commercial score default 0."""
    r = results.select("video_id", F.col("language").alias("_l"), F.col("commercial_score").alias("_s"))
    j = videos.join(r, "video_id", "left").select(
        "video_id", F.coalesce("_l", F.lit("en")).alias("language"), F.coalesce("_s", F.lit(0.0)).alias("commercial_score"))
    return j.groupBy("language").agg(F.count("*").alias("videos"), F.avg("commercial_score").alias("avg_commercial"))
