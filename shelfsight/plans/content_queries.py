"""Content scores. Videos are documents or orders; see each query for its stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.functions import fixed
from shelfsight.functions.num import half_up
from shelfsight.operators import content as ct
from shelfsight.operators import intent
from shelfsight.plans import entity_queries as eq
from shelfsight.plans import intent_queries as iq
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r, table


def _m(pats):
    return "list_filter([" + ",".join(f"CASE WHEN regexp_matches(low,'\\b(?:{p[1]})\\b') THEN {repr(p[0])} END" for p in pats) + "], lambda x: x IS NOT NULL)"


HEMI = "CASE " + " ".join(f"WHEN list_contains(regions,'{n}') THEN '{h}'" for n, _, h in reversed(fixed.REGION_PATTERNS) if h) + " END"
SEA = (
    f"se0 AS (SELECT video_id, {_m(fixed.SEASON_PATTERNS)} AS seasons, {_m(fixed.MONTH_PATTERNS)} AS months, {_m(fixed.REGION_PATTERNS)} AS regions, {_m(fixed.WEATHER_PATTERNS)} AS weather, "
    f"nullif(regexp_extract(low,'\\b{fixed.ZONE_PATTERN}\\b'),'') AS zone, regexp_matches(low,'\\b(?:{fixed.YEAR_ROUND_PATTERN})\\b') AS year_round FROM (SELECT video_id, lower(text) AS low FROM sdoc)), "
    f"se AS (SELECT *, {HEMI} AS hemisphere, len(seasons) BETWEEN 1 AND 2 AS season_specific, list_contains(regions,'Temperate') OR list_contains(weather,'frost') AS temperate, list_contains(regions,'Tropical') AS tropical, "
    "least(0.5e0+len(seasons)*0.1e0+len(months)*0.05e0+len(regions)*0.08e0+(zone IS NOT NULL)::INT*0.1e0+len(weather)*0.05e0+year_round::INT*0.1e0,1e0) AS conf FROM se0)")
# documents with a seasonal phrase chosen by their id, so that every branch occurs
PHRASES = ["", " early spring in may.", " the fall harvest, october rain in england.", " winter frost, zone 7b, usa.", " summer heat and drought in australia, jan.",
           " all year round in the tropics, spring summer autumn winter.", " spring in the southern hemisphere, temperate, mar and apr."]
SDOC = "sdoc AS (SELECT doc_id AS video_id, text||([" + ",".join(f"'{p}'" for p in PHRASES) + "])[doc_id%7+1] AS text FROM documents)"


def season_docs(spark, d):
    x = m.transcripts(spark, d)
    return x.withColumn("text", F.concat("text", F.element_at(F.lit(PHRASES), (F.col("video_id") % 7 + 1).cast("int"))))


def seasons(spark, d):
    return ct.seasonal_context(season_docs(spark, d))


@query("e1_seasonal_context", m.with_(SDOC, SEA) + f"""SELECT video_id, array_to_string(seasons,',') AS seasons, array_to_string(months,',') AS months, array_to_string(regions,',') AS regions,
 array_to_string(weather,',') AS weather, zone, year_round, hemisphere, season_specific, temperate, tropical, {r('conf')} AS confidence FROM se""")
def e1(spark, d):
    j = lambda x: F.array_join(x, ",").alias(x)
    return seasons(spark, d).withColumn("months", F.transform("months", lambda v: v.cast("string"))).select(
        "video_id", j("seasons"), j("months"), j("regions"), j("weather"), "zone", "year_round", "hemisphere",
        "season_specific", "temperate", "tropical", half_up("season_confidence", 6).alias("confidence"))


MN = "[" + ",".join(f"'{x}'" for x in fixed.MONTH_NAMES) + "]"


@query("e2_season_summary", m.with_(SDOC, SEA) + f"""SELECT video_id, CASE WHEN year_round THEN 'Year-round' WHEN len(seasons)=0 AND len(months)=0 THEN 'Not season-specific'
 WHEN len(seasons)=0 AND len(months)>3 THEN 'Variable' ELSE array_to_string(list_filter([CASE WHEN len(seasons)>0 THEN array_to_string(list_transform(seasons, lambda s: upper(s[1])||s[2:]),', ') END,
 CASE WHEN len(months) BETWEEN 1 AND 3 THEN array_to_string(list_transform(months, lambda i: ({MN})[i]),', ') END], lambda x: x IS NOT NULL),' - ') END AS season,
 CASE WHEN len(regions)=0 THEN 'Not region-specific' ELSE array_to_string(list_concat(list_filter([zone, hemisphere||' hemisphere', CASE WHEN temperate THEN 'Temperate' WHEN tropical THEN 'Tropical' END], lambda x: x IS NOT NULL), regions[:2]),', ') END AS climate FROM se""")
def e2(spark, d):
    return seasons(spark, d).select("video_id", ct.season_summary().alias("season"), ct.climate_summary().alias("climate"))


@query("e3_seasonal_relevance", m.with_(SDOC, SEA) + """, u AS (SELECT se.*, o.mo, o.he, CASE WHEN mo BETWEEN 3 AND 5 THEN CASE WHEN he='northern' THEN 'spring' ELSE 'autumn' END WHEN mo BETWEEN 6 AND 8 THEN CASE WHEN he='northern' THEN 'summer' ELSE 'winter' END
 WHEN mo BETWEEN 9 AND 11 THEN CASE WHEN he='northern' THEN 'autumn' ELSE 'spring' END ELSE CASE WHEN he='northern' THEN 'winter' ELSE 'summer' END END AS us FROM se JOIN (SELECT doc_id, doc_id%12+1 AS mo, CASE WHEN doc_id%5<3 THEN 'northern' ELSE 'southern' END AS he FROM documents) o ON o.doc_id=video_id),
 v AS (SELECT video_id, CASE WHEN year_round OR NOT season_specific OR list_contains(months,mo) THEN 'relevant' WHEN list_has_any(months,[CASE WHEN mo=1 THEN 12 ELSE mo-1 END, CASE WHEN mo=12 THEN 1 ELSE mo+1 END]) THEN 'Near-season content'
 WHEN hemisphere IS NOT NULL AND hemisphere<>he THEN 'Wrong hemisphere (seasons reversed)' WHEN list_contains(list_transform(seasons, lambda s: CASE WHEN s='fall' THEN 'autumn' ELSE s END), us) THEN 'relevant'
 ELSE 'Not in season (video is '||array_to_string(seasons,'/')||' content)' END AS l FROM u)
SELECT video_id, l IN ('relevant','Near-season content') AS relevant, CASE WHEN l<>'relevant' THEN l END AS reason FROM v""")
def e3(spark, d):
    mo = (F.col("video_id") % 12 + 1).cast("int")
    he = F.when(F.col("video_id") % 5 < 3, "northern").otherwise("southern")
    return ct.seasonal_relevance(seasons(spark, d), mo, he).select("video_id", "relevant", "reason")


# video facts: an order is a video, its lines are the entities, lines of quantity > 30 the items
FACT = ("fact AS (SELECT video_id, count(*) AS entities, avg(0.5e0+discount*4e0) AS avg_confidence, count_if(l_quantity>30)::BIGINT AS items, "
        "count_if(l_quantity>20)::BIGINT AS shoppable, 0.5e0+(video_id%10)/20e0 AS sc FROM prod GROUP BY video_id)")
QUAL = ("q0 AS (SELECT *, least(entities*8+CASE WHEN avg_confidence>0.7e0 THEN 20 ELSE 0 END,100)::DOUBLE AS literacy, least(entities*5+items*10,100)::DOUBLE AS depth, floor(sc*100+0.5e0) AS seasonal FROM fact), "
        "qual AS (SELECT *, floor((literacy+depth+seasonal)/3+0.5e0) AS overall, CASE WHEN floor((literacy+depth+seasonal)/3+0.5e0)>=70 THEN 'FEATURED' WHEN floor((literacy+depth+seasonal)/3+0.5e0)>=60 THEN 'SUPPORTING' ELSE 'ARCHIVE' END AS tier FROM q0)")


def facts(spark, d):
    p = m.products(spark, d)
    return p.groupBy("video_id").agg(
        F.count("*").alias("entities"), F.avg(F.col("discount") * 4.0 + 0.5).alias("avg_confidence"),
        F.count_if(F.col("l_quantity") > 30).alias("items"), F.count_if(F.col("l_quantity") > 20).alias("shoppable"),
    ).withColumn("season_confidence", F.col("video_id") % 10 / 20.0 + 0.5)


def quality(spark, d):
    return ct.estimate_quality(facts(spark, d))


@query("e4_quality_estimate", m.with_(m.PROD, FACT, QUAL) + "SELECT video_id, literacy, depth, seasonal, overall, tier FROM qual")
def e4(spark, d):
    return quality(spark, d).select("video_id", "literacy", "depth", "seasonal", "overall", "tier")


E5 = ", ".join(f"greatest(0e0,least(100e0,coalesce(nullif({x},0e0),50e0))) AS d{i}" for i, x in enumerate(
    ["quality*80e0", "toxic*-20e0", "(doc_id%130)::DOUBLE", "quality*toxic*10e0", "(doc_id%7)*15e0", "NULL::DOUBLE"]))


@query("e5_quality_normalise", f"""SELECT doc_id, overall, CASE WHEN overall>=70 THEN 'FEATURED' WHEN overall>=60 THEN 'SUPPORTING' ELSE 'ARCHIVE' END AS tier FROM (
 SELECT doc_id, coalesce(nullif(CASE WHEN doc_id%3=0 THEN (doc_id%100)::DOUBLE END,0e0), floor((d0+d1+d2+d3+d4+d5)/6+0.5e0)) AS overall FROM (SELECT doc_id, {E5} FROM labels))""")
def e5(spark, d):
    q, t, i = F.col("quality"), F.col("toxic"), F.col("doc_id")
    s = table(spark, d, "labels").select(
        "doc_id", (q * 80.0).alias("visual"), (t * -20.0).alias("depth"), (i % 130).cast("double").alias("seasonal"),
        (q * t * 10.0).alias("design"), (i % 7 * 15.0).alias("narrative"), F.lit(None).cast("double").alias("literacy"),
        F.when(i % 3 == 0, (i % 100).cast("double")).alias("overall"))
    return ct.normalise_quality(s).select("doc_id", "overall", "tier")


# actions: events of a user; the type is the category
ACT = "act AS (SELECT user_id AS video_id, event_id AS ord, upper(event_type) AS category, event_type||'_'||k AS keyword, k FROM us0)"


def actions(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), F.upper("event_type").alias("category"),
                    F.concat_ws("_", "event_type", k).alias("keyword"), k.alias("k"))


@query("e6_skills", m.with_(m.USAGE.split(", us AS")[0], ACT) + """SELECT video_id, category, n, skill, rank, CASE WHEN rank=1 THEN 'primary' ELSE 'secondary' END AS role FROM (
 SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, fo) AS rank FROM (SELECT video_id, lower(category) AS category, count(*) AS n, min(ord) AS fo, arg_min(keyword,ord) AS skill FROM act GROUP BY ALL)) WHERE rank<=4""")
def e6(spark, d):
    return ct.infer_skills(actions(spark, d)).select("video_id", "category", "n", "skill", F.col("rank").cast("long").alias("rank"), "role")


@query("e7_high_intent_actions", m.with_(m.USAGE.split(", us AS")[0], ACT) + """SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS rank FROM act
WHERE category='PURCHASE' AND k%2=0 AND k%11>=7 QUALIFY rank<=6""")
def e7(spark, d):
    k = F.col("k")
    a = actions(spark, d).withColumn("category", F.when(F.col("category") == "PURCHASE", "garden_task").otherwise(F.col("category"))).withColumn(
        "strength", F.when(k % 2 == 0, "high").otherwise("low")).withColumn("score", k % 11)
    return ct.high_intent_actions(a).select("video_id", "ord", F.col("rank").cast("long").alias("rank"))


@query("e8_top_sections", "SELECT doc_id AS section_id, n_chars::DOUBLE AS score FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def e8(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("section_id"), F.col("n_chars").cast("double").alias("score"))
    return ct.top_sections(s)


@query("e9_budget_selection", f"""SELECT count(*) AS processed, sum(CASE WHEN doc_id%13=0 THEN 1 ELSE 0 END)::BIGINT AS failed, {r('sum(cost)')} AS spent FROM (
 SELECT *, coalesce(sum(cost) OVER (ORDER BY neg, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0e0) AS before FROM (SELECT doc_id, -n_chars AS neg, n_chars*0.001e0+0.05e0 AS cost FROM documents)) WHERE floor(before*1e6+0.5e0)/1e6 < 500e0""")
def e9(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (-F.col("n_chars")).alias("neg"), (F.col("n_chars") * 0.001 + 0.05).alias("cost"))
    return ct.budget_selection(rows, ["neg", "doc_id"], "cost", 500.0).agg(
        F.count("*").alias("processed"), F.count_if(F.col("doc_id") % 13 == 0).alias("failed"), half_up(F.sum("cost"), 6).alias("spent"))


# candidates: a product name of a type; categories: the names of every fourth part
EXTRA = ["buy the best kit", "how to prune", "soil care basics", "seed", "greenhouse tool", "expert technique", "plain"]
CND = ("cnd AS (SELECT min(p_partkey) AS id, p_name||' '||lower(p_type) AS name, list(DISTINCT (" + str(EXTRA) + ")[p_size%7+1]) AS kws, count(*)%6 AS programs, count(*) AS videos, "
       "DATE '2024-01-31'-CAST(min(p_size)%40 AS INT) AS fd FROM part GROUP BY p_name, p_type), "
       "exist AS (SELECT DISTINCT replace(p_name,' ','-')||'-'||lower(p_type) AS key FROM part WHERE p_partkey%4=0)")


def _hit(words):
    return f"len(list_filter(k, lambda x: regexp_matches(x,'{'|'.join(words)}')))"


POT = (
    "p0 AS (SELECT *, list_append(kws, lower(name)) AS k, replace(name,' ','-') AS slug FROM cnd), "
    f"p1 AS (SELECT *, {_hit(fixed.HIGH_VALUE_WORDS)}>0 AS hv, (SELECT count(*) FROM exist e WHERE len(list_intersect(string_split(p0.slug,'-'),string_split(e.key,'-')))/"
    "(len(list_distinct(string_split(p0.slug,'-')))+len(list_distinct(string_split(e.key,'-')))-len(list_intersect(string_split(p0.slug,'-'),string_split(e.key,'-'))))>0.7e0) AS simn FROM p0), "
    f"p2 AS (SELECT *, least(programs*10, CASE WHEN hv THEN 40 ELSE 30 END)+CASE WHEN hv THEN 30 WHEN {_hit(['seed','bulb'])}>0 THEN 15 ELSE 20 END+least({_hit(fixed.PURCHASE_WORDS)}*5,30) AS commercial, "
    f"CASE WHEN {_hit(fixed.BEGINNER_WORDS)}>0 THEN 15 ELSE 0 END+CASE WHEN {_hit(fixed.INTERMEDIATE_WORDS)}>0 THEN 15 ELSE 0 END+CASE WHEN {_hit(fixed.ADVANCED_WORDS)}>0 THEN 10 ELSE 0 END+least(videos/10*30e0,30e0)+least({_hit(fixed.LEARNING_WORDS)}*10,30) AS learning, "
    f"least({_hit(fixed.EVERGREEN_WORDS)}*15,100) AS evergreen, CASE WHEN DATE '2024-01-31'-fd<7 THEN 5 WHEN DATE '2024-01-31'-fd<30 THEN 3 ELSE 0 END+CASE WHEN len(string_split(slug,'-')) BETWEEN 2 AND 4 THEN 3 ELSE 0 END"
    "+CASE WHEN length(slug)>10 AND length(slug)<40 THEN 2 ELSE 0 END+CASE WHEN simn=0 THEN 5 WHEN simn<=2 THEN 2 ELSE 0 END AS novelty FROM p1), "
    "pot AS (SELECT id, name, commercial::DOUBLE AS commercial, learning::DOUBLE AS learning, evergreen::DOUBLE AS evergreen, novelty::DOUBLE AS novelty, least(commercial*0.4e0+learning*0.4e0+evergreen*0.2e0+novelty,100e0) AS potential FROM p2), "
    "pota AS (SELECT *, CASE WHEN potential>=70 THEN 'priority' WHEN potential>=50 THEN 'promote' WHEN potential>=30 THEN 'monitor' ELSE 'reject' END AS action FROM pot)")


def potential(spark, d):
    p = table(spark, d, "part")
    cand = p.groupBy("p_name", "p_type").agg(
        F.min("p_partkey").alias("id"),
        F.collect_set(F.element_at(F.lit(EXTRA), (F.col("p_size") % 7 + 1).cast("int"))).alias("keywords"),
        (F.count("*") % 6).alias("programs"), F.count("*").alias("videos"),
        F.date_sub(F.lit("2024-01-31").cast("date"), (F.min("p_size") % 40).cast("int")).alias("first_detected"),
    ).withColumn("name", F.concat_ws(" ", "p_name", F.lower("p_type")))
    exist = p.where("p_partkey % 4 = 0").select(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_type")).alias("key")).distinct()
    return ct.category_potential(cand, exist, "2024-01-31")


@query("e10_category_potential", m.with_(CND, POT) + f"SELECT id, name, commercial, {r('learning')} AS learning, evergreen, novelty, {r('potential')} AS potential, action FROM pota")
def e10(spark, d):
    return potential(spark, d).select("id", "name", "commercial", half_up("learning", 6).alias("learning"), "evergreen", "novelty",
                                      half_up("potential", 6).alias("potential"), "action")


@query("e11_top_candidates", m.with_(CND, POT) + f"SELECT id, {r('potential')} AS potential FROM (SELECT id, floor(potential*1e6+0.5e0)/1e6 AS potential FROM pota WHERE action='priority' ORDER BY potential DESC, id LIMIT 10)")
def e11(spark, d):
    s = potential(spark, d).select("id", half_up("potential", 6).alias("potential"), "action")
    return ct.top_priority(s).select("id", "potential")


CI = "floor(least((shoppable/entities*0.6e0+least(entities/20e0,1e0)*0.4e0)*40+least(acv,1e0)*30+CASE tier WHEN 'FEATURED' THEN 20 WHEN 'SUPPORTING' THEN 12 ELSE 5 END+CASE WHEN video_id%3=0 THEN 7 WHEN video_id%3=1 THEN 4 ELSE 0 END+CASE WHEN sc>0.7e0 THEN 3 ELSE 0 END,100e0)+0.5e0)"


def commercial_input(spark, d):
    i = F.col("video_id")
    return quality(spark, d).withColumn("avg_commercial_value", i % 8 / 8.0).withColumn(
        "season_specific", i % 3 == 0).withColumn("year_round", i % 3 == 1)


@query("e12_commercial_intent", m.with_(m.PROD, FACT, QUAL) + f"SELECT video_id, {CI} AS score FROM (SELECT *, (video_id%8)/8e0 AS acv FROM qual)")
def e12(spark, d):
    return commercial_input(spark, d).select("video_id", ct.commercial_intent().alias("score"))


@query("e13_monetisation_counts", m.with_(m.PROD) + "SELECT video_id, count(*) AS entities, count_if(l_quantity>20)::BIGINT AS shoppable, count(DISTINCT category) AS categories, count_if(discount*10>0.7e0)::BIGINT AS high_value FROM prod GROUP BY video_id")
def e13(spark, d):
    p = m.products(spark, d).select("video_id", "category", (F.col("l_quantity") > 20).alias("shoppable"), (F.col("discount") * 10).alias("affiliate_score"))
    return ct.monetisation_counts(p)


STR = ("st0 AS (SELECT video_id, shoppable, avg_confidence AS aff, (video_id%8)/8e0 AS acv, 'intent_'||(video_id%4) AS ti, video_id%3=0 AS ss, (video_id%100)::DOUBLE AS teach, (['beginner','intermediate'])[video_id%2+1] AS level, video_id%5=0 AS prog, overall, literacy FROM qual), "
       f"st AS (SELECT video_id, 'affiliate_commerce' AS strategy, {r('aff',2)} AS score, {r('shoppable*aff*acv*10',2)} AS revenue_per_1k, shoppable||' shoppable entities, '||ti||' intent detected'||CASE WHEN ss THEN ', seasonal buying window' ELSE '' END AS reasoning, 0 AS pos FROM st0 WHERE shoppable>0 UNION ALL "
       f"SELECT video_id, 'course_creation', {r('least(teach/100+CASE WHEN prog THEN 0.15e0 ELSE 0e0 END,1e0)',2)}, NULL, 'Teaching quality '||teach::BIGINT||'/100, '||level||' level'||CASE WHEN prog THEN ', clear skill progression' ELSE '' END, 1 FROM st0 WHERE teach>=50 UNION ALL "
       f"SELECT video_id, 'sponsored_content', {r('(overall/100+literacy/100)/2',2)}, NULL, 'Editorial quality '||overall::BIGINT||'/100, botanical literacy '||literacy::BIGINT||'/100, trusted editorial voice', 2 FROM st0 WHERE overall>=55)")


def strategy_rows(spark, d):
    i = F.col("video_id")
    v = quality(spark, d).select(
        "video_id", "shoppable", F.col("avg_confidence").alias("affiliate_score"), (i % 8 / 8.0).alias("avg_commercial_value"),
        F.concat(F.lit("intent_"), i % 4).alias("top_intent"), (i % 3 == 0).alias("season_specific"), (i % 100).cast("double").alias("teaching"),
        F.when(i % 2 == 0, "beginner").otherwise("intermediate").alias("level"), (i % 5 == 0).alias("progression"), "overall", "literacy")
    return ct.strategies(v)


@query("e14_monetisation_strategies", m.with_(m.PROD, FACT, QUAL, STR) + "SELECT video_id, strategy, score, revenue_per_1k, CASE WHEN length(reasoning)>100 THEN reasoning[1:100]||'…' ELSE reasoning END AS reasoning, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) AS rank FROM st")
def e14(spark, d):
    return strategy_rows(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query("e14_top_products", m.with_(*eq.MEN) + """SELECT video_id, entity, confidence AS affiliate_score, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, mention_id) AS rank
FROM men WHERE shoppable QUALIFY rank<=5""")
def e14_top(spark, d):
    x = eq.mentions(spark, d).select("video_id", "entity", F.col("confidence").alias("affiliate_score"), "shoppable", F.col("mention_id").alias("ord"))
    return ct.top_products(x).select("video_id", "entity", "affiliate_score", F.col("rank").cast("long").alias("rank"))


@query("e15_market_position", m.with_(CND, POT) + f"SELECT id, CASE action WHEN 'priority' THEN 'rising' WHEN 'promote' THEN 'emerging' WHEN 'monitor' THEN 'stable' ELSE 'declining' END AS trend, {r('(100e0-potential)/100')} AS competition FROM pota")
def e15(spark, d):
    return ct.market_position(potential(spark, d)).select("id", "trend", half_up("competition", 6).alias("competition"))


@query("e17_shared_entities", m.with_(*eq.MEN) + "SELECT name, arg_min(category, video_id) AS category, count(*) AS videos FROM (SELECT lower(entity) AS name, video_id, min(lower(category)) AS category FROM men GROUP BY ALL) GROUP BY name HAVING count(*)>=2")
def e17(spark, d):
    return ct.shared_entities(eq.mentions(spark, d))


@query("e17_single_topics", m.with_(*eq.MEN) + "SELECT topic FROM (SELECT arg_min(entity, mention_id) AS topic FROM men GROUP BY video_id) GROUP BY topic HAVING count(*)=1")
def e17t(spark, d):
    # Ids repeat in a video once rk passes 999: the commoner word then, so that the result does not depend on the order of rows.
    first = F.when(F.col("mention_id").isNotNull(), F.struct("mention_id", "rk"))
    t = eq.mentions(spark, d).groupBy("video_id").agg(F.min_by("entity", first).alias("topic"))
    return ct.single_topics(t)


@query("e17_audience_map", iq.BASE[:-1] + f", {iq.DIST} SELECT intent, floor(s/max(s) OVER ()*100+0.5e0)/100 AS share FROM (SELECT intent, sum(avg_score) AS s FROM dist GROUP BY intent)")
def e17a(spark, d):
    return ct.audience_map(intent.intent_distribution(iq.detections(spark, d)))


@query("e18_batch_outcomes", "SELECT CASE WHEN length(trim(text))<200 THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, count(CASE WHEN length(trim(text))<200 THEN 1 END) AS errors FROM documents GROUP BY status")
def e18(spark, d):
    x = m.transcripts(spark, d).select("video_id", F.when(F.length(F.trim("text")) < 200, "too short").alias("error"))
    return ct.outcomes(x)


VT = "vt AS (SELECT (['alpha','beta','gamma','generic'])[rk%4+1] AS vertical, rk%4 AS vp, term, rk FROM vocab)"


def vertical_terms(spark, d):
    return m.vocab(spark, d).select(
        F.element_at(F.lit(["alpha", "beta", "gamma", "generic"]), (F.col("rk") % 4 + 1).cast("int")).alias("vertical"),
        (F.col("rk") % 4).alias("vertical_pos"), "term", F.col("rk").alias("pos"))


@query("e19_vertical_detection", m.with_(m.DOC, m.VOCAB, VT) + f""", vz AS (SELECT vertical, count(*) AS sz FROM vt GROUP BY vertical), s AS (SELECT video_id, vt.vertical, vp, count(*)/any_value(sz) AS sc FROM doc JOIN vt ON vt.vertical<>'generic' AND contains(lower(text),term) JOIN vz ON vz.vertical=vt.vertical GROUP BY ALL),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY sc DESC, vp)=1)
SELECT doc.video_id, CASE WHEN sc>0.15e0 THEN vertical ELSE 'unknown' END AS vertical, {r('CASE WHEN sc>0.15e0 THEN least(sc*3,0.95e0) ELSE 0e0 END')} AS confidence FROM doc LEFT JOIN b USING (video_id)""")
def e19(spark, d):
    return ct.detect_vertical(m.transcripts(spark, d), vertical_terms(spark, d)).withColumn("confidence", half_up("confidence", 6))


@query("e20_vertical_resolution", """SELECT doc_id AS request_id, lang||'_'||source AS vertical_id, CASE WHEN lang='en' AND source IN (SELECT 'src'||s_suppkey FROM supplier WHERE s_suppkey<10) THEN 'Registered '||source
 WHEN lang='fr' THEN 'Learned '||source ELSE 'Generic' END AS display, CASE WHEN lang='en' AND source IN (SELECT 'src'||s_suppkey FROM supplier WHERE s_suppkey<10) THEN 'registered' WHEN lang='fr' THEN 'learned' ELSE 'generic' END AS resolved_from FROM documents""")
def e20(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.concat_ws("_", "lang", "source").alias("vertical_id"))
    src = F.concat(F.lit("src"), "s_suppkey")
    reg = table(spark, d, "supplier").where("s_suppkey < 10").select(F.concat(F.lit("en_"), src).alias("vertical_id"), F.concat(F.lit("Registered "), src).alias("display"))
    lea = table(spark, d, "documents").where("lang = 'fr'").select(F.concat_ws("_", "lang", "source").alias("vertical_id"), F.concat(F.lit("Learned "), "source").alias("display")).distinct()
    return ct.resolve_verticals(docs, reg, lea)


@query("e21_vertical_lists", "WITH vt AS (SELECT p_type AS vertical, p_brand AS term, min(p_partkey) AS rk FROM part GROUP BY ALL) SELECT vertical, count(*) AS n, string_agg(term, ',' ORDER BY rk) AS keywords FROM vt GROUP BY vertical")
def e21(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_type").alias("vertical"), F.col("p_brand").alias("term")).agg(F.min("p_partkey").alias("pos"))
    return ct.vertical_lists(t)


@query("e21_vertical_brands", """WITH c AS (SELECT p_type AS vertical, p_size%7 AS cat_pos, min(p_partkey) AS pos, 'brand' AS kind, p_brand AS term FROM part GROUP BY ALL
 UNION ALL SELECT p_type, p_size%7, min(p_partkey), 'keyword', p_name FROM part GROUP BY p_type, p_size%7, p_name)
SELECT vertical, kind, row_number() OVER (PARTITION BY vertical, kind ORDER BY cat_pos, pos, term) AS n, term FROM c""")
def e21_brands(spark, d):
    """Categories of a vertical: parts by p_size % 7; each knows its brands and its keywords."""
    part = table(spark, d, "part").select(
        F.col("p_type").alias("vertical"), (F.col("p_size") % 7).alias("cat_pos"), F.col("p_partkey"), F.explode(F.array(
            F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("term")),
            F.struct(F.lit("keyword").alias("kind"), F.col("p_name").alias("term")))).alias("t"))
    return ct.vertical_terms(part.groupBy("vertical", "t.kind", "cat_pos", "t.term").agg(F.min("p_partkey").alias("pos")))


FB = ("fbe AS (SELECT video_id, count(*) AS entity_count, avg(0.5e0+discount*4e0) AS avg_confidence, string_agg(DISTINCT CASE WHEN l_quantity>20 AND 0.5e0+discount*4e0>0.7e0 THEN name END, ',' ORDER BY CASE WHEN l_quantity>20 AND 0.5e0+discount*4e0>0.7e0 THEN name END) AS names FROM prod GROUP BY video_id), "
      "fbi AS (SELECT video_id, sum(n)::BIGINT AS item_count, string_agg(category||'='||n, ',' ORDER BY category) AS cats FROM (SELECT video_id, category, count(*) AS n FROM prod WHERE l_quantity>30 GROUP BY ALL) GROUP BY video_id)")


def feedback(spark, d):
    p = m.products(spark, d).select("video_id", F.col("name").alias("entity"), "category", "l_quantity",
                                    (F.col("discount") * 4.0 + 0.5).alias("confidence"), (F.col("l_quantity") > 20).alias("shoppable"))
    return ct.collect_feedback(p, p.where("l_quantity > 30"))


@query("e22_feedback", m.with_(m.PROD, FB) + f"SELECT video_id, entity_count, {r('avg_confidence')} AS avg_confidence, coalesce(names,'') AS names, coalesce(item_count,0) AS item_count, coalesce(cats,'') AS cats FROM fbe LEFT JOIN fbi USING (video_id)")
def e22(spark, d):
    f = feedback(spark, d)
    cats = F.array_join(F.transform(F.map_entries("item_categories"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return f.select("video_id", "entity_count", half_up("avg_confidence", 6).alias("avg_confidence"),
                    F.array_join("shoppable_names", ",").alias("names"), "item_count", F.coalesce(cats, F.lit("")).alias("cats"))


def vertical_feedback(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("vertical"))
    return feedback(spark, d).join(o, "video_id").withColumn("ord", F.col("video_id"))


@query("e23_feedback_fold", m.with_(m.PROD, FB) + """, f AS (SELECT o_orderpriority AS vertical, row_number() OVER (PARTITION BY o_orderpriority ORDER BY video_id) AS i, entity_count, avg_confidence, coalesce(item_count,0) AS ic,
 CASE WHEN entity_count>5 AND avg_confidence>0.6e0 THEN 1 WHEN entity_count<3 THEN -1 ELSE 0 END AS dl FROM fbe LEFT JOIN fbi USING (video_id) JOIN orders ON o_orderkey=video_id),
 w AS (SELECT vertical, list_reduce(list_prepend(9, list(dl ORDER BY i)), lambda a, x: CASE WHEN x>0 THEN least(15,a+1) WHEN x<0 THEN greatest(0,a-1) ELSE a END) AS lv FROM f GROUP BY vertical)
SELECT vertical, count(*) AS uses, sum(entity_count)::BIGINT AS entities, sum(ic)::BIGINT AS items, floor(sum(entity_count*avg_confidence)/sum(entity_count)*1000+0.5e0)/1000 AS avg_confidence,
 floor((any_value(lv)*0.05e0+0.05e0)*1e6+0.5e0)/1e6 AS aggressiveness FROM f JOIN w USING (vertical) GROUP BY vertical""")
def e23(spark, d):
    return ct.fold_feedback(vertical_feedback(spark, d)).withColumn("aggressiveness", half_up("aggressiveness", 6))


@query("e23_merged_keywords", m.with_(m.PROD) + """SELECT vertical, name, row_number() OVER (PARTITION BY vertical ORDER BY o, name) AS rank FROM (SELECT o_orderpriority AS vertical, name, min(video_id) AS o FROM prod JOIN orders ON o_orderkey=video_id WHERE l_quantity>20 GROUP BY ALL) QUALIFY rank<=20""")
def e23k(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("vertical"))
    rows = m.products(spark, d).where("l_quantity > 20").join(o, "video_id").select("vertical", F.col("video_id").alias("ord"), "name")
    return ct.merged_names(rows, 20).withColumn("rank", F.col("rank").cast("long"))


INSIGHTS = m.with_(m.PROD, FB) + """, f AS (SELECT o_orderpriority AS vertical, count(*) AS uses, sum(entity_count) AS en, sum(coalesce(item_count,0)) AS it FROM fbe LEFT JOIN fbi USING (video_id) JOIN orders ON o_orderkey=video_id GROUP BY ALL),
 c AS (SELECT o_orderpriority AS vertical, category, count(*) AS n FROM prod JOIN orders ON o_orderkey=video_id WHERE l_quantity>30 GROUP BY ALL),
 t AS (SELECT vertical, string_agg(category, ',' ORDER BY n DESC, category) AS tc FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vertical ORDER BY n DESC, category)<=5) GROUP BY vertical),
 i AS (SELECT *, CASE WHEN uses>=10 THEN 'stable' WHEN uses>=3 THEN 'developing' ELSE 'emerging' END AS mat, floor(it/uses*10+0.5e0)/10 AS ai, floor(en/uses*10+0.5e0)/10 AS ae FROM f)
SELECT vertical, mat AS maturity, ai AS avg_items, ae AS avg_entities, CASE WHEN ai>=3 THEN 'high' WHEN ai>=1 THEN 'medium' ELSE 'low' END AS commercial_potential,
 CASE WHEN ai>=3 THEN 'High' WHEN ai>=1 THEN 'Medium' ELSE 'Low' END||' commerce yield — '||uses||' videos analyzed'||CASE WHEN mat='emerging' THEN ' — needs more data to stabilize' WHEN ai>=3 AND mat='developing' THEN ' — consider building a dedicated vertical config' WHEN ai<1 THEN ' — commerce extraction needs improvement' ELSE '' END AS opportunity,
 tc AS top_categories FROM i LEFT JOIN t USING (vertical)"""


@query("e24_vertical_insights", INSIGHTS)
def e24(spark, d):
    f = vertical_feedback(spark, d)
    folded = f.groupBy("vertical").agg(F.count("*").alias("uses"), F.countDistinct("video_id").alias("videos"),
                                       F.sum("entity_count").alias("entities"), F.sum("item_count").alias("items"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("vertical"))
    cats = m.products(spark, d).where("l_quantity > 30").join(o, "video_id").groupBy("vertical", "category").agg(F.count("*").alias("n"))
    return ct.vertical_insights(folded, cats).select(
        "vertical", "maturity", "avg_items", "avg_entities", "commercial_potential", "opportunity", "top_categories")


# The same with uses, the mean confidence and the first ten confident shoppable names of each vertical.
REPORT = INSIGHTS.replace("sum(entity_count) AS en,", "sum(entity_count) AS en, floor(sum(entity_count*avg_confidence)/sum(entity_count)*1000+0.5e0)/1000 AS avg_confidence,").replace(
    "\nSELECT vertical,", """,
 nm AS (SELECT o_orderpriority AS vertical, name, min(video_id) AS o FROM prod JOIN orders ON o_orderkey=video_id WHERE l_quantity>20 AND 0.5e0+discount*4e0>0.7e0 GROUP BY ALL),
 ten AS (SELECT vertical, string_agg(name, ',' ORDER BY o, name) AS top_entities FROM (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY vertical ORDER BY o, name)<=10) GROUP BY vertical)
SELECT uses, avg_confidence, top_entities, vertical,""") + " LEFT JOIN ten USING (vertical)"


@query("e24_vertical_report", REPORT)
def e24_report(spark, d):
    folded = ct.fold_feedback(vertical_feedback(spark, d)).withColumn("videos", F.col("uses"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("vertical"))
    p = m.products(spark, d).join(o, "video_id")
    cats = p.where("l_quantity > 30").groupBy("vertical", "category").agg(F.count("*").alias("n"))
    sure = p.where((F.col("l_quantity") > 20) & (F.col("discount") * 4.0 + 0.5 > 0.7))
    names = ct.merged_names(sure.select("vertical", F.col("video_id").alias("ord"), "name"), 50)
    return ct.vertical_insights(folded, cats, names).select(
        "uses", "avg_confidence", "top_entities", "vertical", "maturity", "avg_items", "avg_entities", "commercial_potential", "opportunity", "top_categories")
