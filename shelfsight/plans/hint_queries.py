"""Knowledge hints over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions.num import half_up
from shelfsight.operators import hints as h
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r, table
from shelfsight.plans.text_queries import STAGE, processed

PRIO = "CASE WHEN usage_count>10 AND ambiguity<0.3e0 THEN 'high' WHEN usage_count>3 OR ambiguity<0.5e0 THEN 'medium' ELSE 'low' END"
RULE = "rules AS (SELECT latin AS pattern, 0.9e0 AS confidence, genus, species, variety AS cultivar, [species||' care', 'grow '||genus] AS ctx FROM dict WHERE entry_pos%10=0)"
ALIAS = (
    f"al0 AS (SELECT latin AS term, 'plant_dictionary' AS source, 1e0-ambiguity AS confidence, {PRIO} AS priority, genus, species, variety AS cultivar, entry_pos AS e, 0 AS k FROM dict UNION ALL "
    f"SELECT unnest(common), 'plant_dictionary', 0.9e0-ambiguity, {PRIO}, genus, species, variety, entry_pos, 1 FROM dict UNION ALL "
    "SELECT unnest(synonyms), 'plant_dictionary', 0.85e0-ambiguity, 'medium', genus, species, variety, entry_pos, 2 FROM dict UNION ALL "
    "SELECT unnest(trade), 'plant_dictionary', 0.80e0, 'medium', NULL, NULL, NULL, entry_pos, 3 FROM dict UNION ALL "
    "SELECT pattern, 'disambiguation_rule', confidence, 'high', genus, species, cultivar, 1099511627776, 4 FROM rules), "
    "alias AS (SELECT * FROM al0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, e, k)=1)")
BASE = [m.DOC, m.VOCAB, m.DICT, RULE, ALIAS, "trend AS (SELECT term FROM vocab WHERE n>=3)"]
HINTS = (
    "hf AS (SELECT video_id, a.* FROM doc JOIN alias a ON contains(lower(text), term)), "
    "hg AS (SELECT video_id, g.term FROM doc JOIN (SELECT DISTINCT genus AS term FROM dict) g ON contains(lower(text), g.term) "
    "WHERE NOT EXISTS (SELECT 1 FROM hf WHERE hf.video_id=doc.video_id AND hf.genus=g.term)), "
    "ha AS (SELECT video_id, term, source, confidence, priority, genus, species, cultivar, 0 AS src FROM hf UNION ALL "
    "SELECT video_id, term, 'plant_dictionary', 0.85e0, 'high', term, NULL, NULL, 1 FROM hg UNION ALL "
    "SELECT video_id, term, 'market_trend', 0.75e0, 'medium', NULL, NULL, term, 2 FROM doc JOIN trend ON contains(lower(text), term)), "
    "hints AS (SELECT * FROM ha QUALIFY row_number() OVER (PARTITION BY video_id, term ORDER BY src DESC)=1)")


def rules(spark, d):
    return m.dictionary(spark, d).where("entry_pos % 10 = 0").select(
        F.col("latin").alias("pattern"), F.lit(0.9).alias("confidence"), "genus", "species", F.col("variety").alias("cultivar"),
        F.array(F.concat("species", F.lit(" care")), F.concat(F.lit("grow "), "genus")).alias("context_keywords"))


def aliases(spark, d):
    return h.alias_hints(m.dictionary(spark, d), rules(spark, d))


def trends(spark, d):
    return m.vocab(spark, d).where("n >= 3").select("term")


def hints(spark, d):
    return h.entity_hints(m.transcripts(spark, d), aliases(spark, d), m.dictionary(spark, d), trends(spark, d))


@query("b12_alias_hints", m.with_(*BASE) + f"SELECT term, source, {r('confidence')} AS confidence, priority, genus, species, cultivar FROM alias")
def b12(spark, d):
    return aliases(spark, d).withColumn("confidence", half_up("confidence", 6))


@query("b13_entity_hints", m.with_(*BASE, HINTS) + f"SELECT video_id, term, source, {r('confidence')} AS confidence, priority FROM hints")
def b13(spark, d):
    return hints(spark, d).select("video_id", "term", "source", half_up("confidence", 6).alias("confidence"), "priority")


def _catalog(spark, d):
    return m.products(spark, d).select(
        F.concat(F.initcap("name"), F.lit(" Set, 3 x "), "category").alias("title"), F.lower("category").alias("variety"), "brand")


STOP = "('the','a','an','and','or','but','in','on','at','to','for','with','from','by','of','cm','mm','l','litre','liter','inch','pack','set','x','uk','eu','us')"
TITLE = "title AS (SELECT name||' Set, 3 x '||category AS title, lower(category) AS variety, brand FROM prod)"
WORDS = f"list_filter(regexp_split_to_array(regexp_replace(lower(title),'[^a-z0-9_\\s''-]',' ','g'),'\\s+'), lambda w: length(w)>2 AND w NOT IN {STOP})"


@query("b14_product_keywords", m.with_(m.PROD, TITLE) + f"""SELECT DISTINCT keyword FROM (SELECT unnest({WORDS}) AS keyword FROM title
 UNION SELECT variety FROM title UNION SELECT lower(brand) FROM title)""")
def b14(spark, d):
    return h.product_keywords(_catalog(spark, d))


@query("b15_market_trends", m.with_(m.PROD, TITLE) + f"""SELECT term, count(*) AS n FROM (SELECT unnest({WORDS}) AS term FROM title
 UNION ALL SELECT variety FROM title) GROUP BY term HAVING count(*)>=3""")
def b15(spark, d):
    return h.market_trends(_catalog(spark, d))


ADAPT = (
    "hi AS (SELECT DISTINCT video_id, unnest([term, genus, species, cultivar]) AS keyword FROM hints WHERE priority='high'), "
    "hi2 AS (SELECT * FROM hi WHERE keyword IS NOT NULL), "
    "med AS (SELECT video_id, term AS keyword FROM hints h WHERE priority='medium' AND NOT EXISTS (SELECT 1 FROM hi2 WHERE hi2.video_id=h.video_id AND hi2.keyword=h.term)), "
    "med2 AS (SELECT med.video_id, keyword FROM med LEFT JOIN (SELECT video_id, count(*) AS n FROM hi2 GROUP BY ALL) c ON c.video_id=med.video_id "
    "QUALIFY row_number() OVER (PARTITION BY med.video_id ORDER BY keyword)+coalesce(c.n,0)<=100), "
    "adapt AS (SELECT * FROM hi2 UNION SELECT * FROM med2 UNION SELECT video_id, unnest(ctx) FROM hints JOIN rules ON pattern=term)")


@query("b16_adaptive_keywords", m.with_(*BASE, HINTS, ADAPT) + "SELECT video_id, keyword FROM adapt")
def b16(spark, d):
    return h.adaptive_keywords(hints(spark, d), rules(spark, d))


@query("b17_lost_hints", m.with_(*STAGE, m.DICT, RULE, ALIAS, BASE[5], HINTS) + """SELECT h.video_id, h.term FROM hints h JOIN l8 USING (video_id)
WHERE priority='high' AND NOT contains(lower(l8.t), h.term)""")
def b17(spark, d):
    return h.lost_hints(hints(spark, d), processed(spark, d))


ITEMS = ("items AS (SELECT CASE WHEN l_orderkey%2=0 THEN upper(t.term) ELSE t.term END AS name, (['PLANT','TOOL','MATERIAL','BOOK'])[l_partkey%4+1] AS category, "
         "(60+l_suppkey%40)/100e0 AS confidence, l_orderkey*10+l_linenumber AS ord FROM lineitem JOIN vocab t ON t.rk=l_partkey%(SELECT count(*) FROM vocab)+1)")
HIST = ("hist AS (SELECT term, category, confidence, CASE WHEN category IN ('PLANT','TOOL','SEED','BOOK','COURSE') AND confidence>=0.85e0 THEN 'high' "
        "WHEN confidence>=0.75e0 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT lower(name) AS term, arg_max(category, {'o':ord,'c':category,'f':confidence}) AS category, "
        "arg_max(confidence, {'o':ord,'c':category,'f':confidence}) AS confidence FROM items WHERE confidence>=0.7e0 GROUP BY ALL))")


def items(spark, d):
    v = m.vocab(spark, d)
    size = v.agg(F.count("*").alias("_size"))  # one row
    li = table(spark, d, "lineitem").crossJoin(F.broadcast(size)).select(
        (F.col("l_partkey") % F.col("_size") + 1).alias("rk"),
        F.element_at(F.lit(["PLANT", "TOOL", "MATERIAL", "BOOK"]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("category"),
        ((F.col("l_suppkey") % 40 + 60) / 100.0).alias("confidence"), "l_orderkey", "l_linenumber")
    j = li.join(v.select("rk", "term"), "rk")
    ord_ = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "category", "confidence")
    return j.select(F.when(F.col("l_orderkey") % 2 == 0, F.upper("term")).otherwise(F.col("term")).alias("name"),
                    "category", "confidence", ord_.alias("ord"))


@query("b18_commerce_history", m.with_(m.VOCAB, ITEMS, HIST) + "SELECT * FROM hist")
def b18(spark, d):
    return h.commerce_history(items(spark, d))


CT = ("ct AS (SELECT term, 'cat'||(rk%5) AS category, rk%5 AS cat_pos, row_number() OVER (PARTITION BY rk%5 ORDER BY rk) AS pos FROM vocab)")


def category_terms(spark, d):
    from pyspark.sql import Window as W
    return m.vocab(spark, d).select(
        "term", F.concat(F.lit("cat"), F.col("rk") % 5).alias("category"), (F.col("rk") % 5).alias("cat_pos"),
        F.row_number().over(W.partitionBy(F.col("rk") % 5).orderBy("rk")).alias("pos"))


CATH = (
    "offers AS (SELECT term FROM vocab WHERE rk%7=0), "
    "csrc AS (SELECT term, confidence, priority, 0 AS src FROM hist UNION ALL SELECT term, 0.7e0, 'medium', 1 FROM offers UNION ALL "
    "SELECT term, 0.75e0, 'medium', 2 FROM ct WHERE rk2%2=0), "
    "csrc2 AS (SELECT * FROM csrc QUALIFY row_number() OVER (PARTITION BY term ORDER BY src DESC)=1), "
    "cath AS (SELECT video_id, term, confidence, priority FROM doc JOIN csrc2 ON contains(lower(text), term))")
CTX = CT.replace("AS pos FROM", "AS pos, rk AS rk2 FROM")


def cat_hints(spark, d):
    ct = category_terms(spark, d).join(m.vocab(spark, d).where("rk % 2 = 0").select("term"), "term")
    return h.category_hints(m.transcripts(spark, d), h.commerce_history(items(spark, d)),
                            m.vocab(spark, d).where("rk % 7 = 0"), ct)


@query("b19_category_hints", m.with_(m.DOC, m.VOCAB, ITEMS, HIST, CTX, CATH) + f"SELECT video_id, term, {r('confidence')} AS confidence, priority FROM cath")
def b19(spark, d):
    return cat_hints(spark, d).withColumn("confidence", half_up("confidence", 6))


@query("b20_category_detection", m.with_(m.DOC, m.VOCAB, CT) + """SELECT video_id, category, count(*) AS n FROM doc JOIN ct ON contains(lower(text), term)
GROUP BY ALL HAVING count(*)>=3""")
def b20(spark, d):
    return h.detect_categories(m.transcripts(spark, d), category_terms(spark, d))


@query("b21_multi_category_keywords", m.with_(m.DOC, m.VOCAB, ITEMS, HIST, CTX, CATH) + """,
 hi AS (SELECT DISTINCT video_id, term AS keyword FROM cath WHERE priority='high'), nh AS (SELECT video_id, count(*) AS n FROM hi GROUP BY ALL),
 me AS (SELECT c.video_id, c.term AS keyword FROM (SELECT DISTINCT video_id, term FROM cath WHERE priority='medium') c LEFT JOIN nh ON nh.video_id=c.video_id
   QUALIFY row_number() OVER (PARTITION BY c.video_id ORDER BY c.term)+coalesce(nh.n,0)<=150),
 tx AS (SELECT video_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS t FROM cath GROUP BY ALL),
 dc AS (SELECT video_id, category FROM tx JOIN ct ON contains(t, term) GROUP BY ALL HAVING count(*)>=3)
SELECT * FROM hi UNION SELECT * FROM me UNION SELECT video_id, term FROM dc JOIN ct USING (category) WHERE pos<=20""")
def b21(spark, d):
    return h.multi_category_keywords(cat_hints(spark, d), category_terms(spark, d))
