"""Entities over conversation turns and dictionaries derived from passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import fixed
from shelfsight.functions.num import half_up
from shelfsight.operators import entities as en
from shelfsight.operators.joins import stored
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r, table

AL = (
    "al AS (SELECT entry_pos, 'latin' AS kind, 0 AS alias_no, latin AS alias FROM dict UNION ALL SELECT entry_pos, 'common', 0, common[1] FROM dict "
    "UNION ALL SELECT entry_pos, 'synonym', 0, synonyms[1] FROM dict UNION ALL SELECT entry_pos, 'trade', 0, trade[1] FROM dict WHERE len(trade)>0 "
    "UNION ALL SELECT entry_pos, 'variety', 0, variety FROM dict WHERE variety IS NOT NULL)")
# lookups: the words of every conversation turn; queries: words plus every passage word pair
WORDS = "words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text),'[^a-z]+')) AS name FROM conversations)"
QRY = ("qry AS (SELECT name AS query FROM words WHERE length(name)>=5 UNION SELECT upper(g)||'  '||s FROM bp UNION SELECT g||s[2:] FROM bp "
       "UNION SELECT g||' '||s||'s' FROM bp)")
NORM = "regexp_replace(regexp_replace(trim(lower(query)),'[^a-z0-9_\\s]','','g'),'\\s+',' ','g')"


def words(spark, d):
    return table(spark, d, "conversations").select(
        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).distinct()


def pairs(spark, d):
    toks = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 5)
    return table(spark, d, "benchmark").select(toks.alias("t")).select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))),
        lambda i: F.struct(F.try_element_at("t", i).alias("g"), F.try_element_at("t", i + 1).alias("s")))).alias("p")).where(
        "p.s IS NOT NULL").select("p.*").distinct()


def name_queries(spark, d):
    p = pairs(spark, d)
    q = words(spark, d).where("length(name) >= 5").select(F.col("name").alias("query"))
    q = q.unionByName(p.select(F.concat(F.upper("g"), F.lit("  "), "s").alias("query")))
    q = q.unionByName(p.select(F.concat("g", F.substring("s", 2, 100)).alias("query")))
    return q.unionByName(p.select(F.concat("g", F.lit(" "), "s", F.lit("s")).alias("query"))).distinct()


@query("a7_dictionary_index", m.with_(m.DICT, AL) + "SELECT entry_pos, kind, alias FROM al")
def a7(spark, d):
    return en.alias_table(m.dictionary(spark, d)).select("entry_pos", "kind", "alias")


@query("a8_dictionary_validation", """SELECT problems, count(*) AS n FROM (SELECT array_to_string(list_filter([
 CASE WHEN p_partkey%11=0 THEN 'latin name missing' END, CASE WHEN p_size%10=0 THEN 'common names missing' END,
 CASE WHEN p_type='PROMO' THEN 'unknown level' END, CASE WHEN p_size/40e0>1 THEN 'ambiguity out of range' END,
 CASE WHEN p_size-3<0 THEN 'usage negative' END], lambda x: x IS NOT NULL),'; ') AS problems FROM part) GROUP BY problems""")
def a8(spark, d):
    rows = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name")).alias("latin"),
        F.when(F.col("p_size") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("common"),
        F.when(F.col("p_type") == "PROMO", "promo").otherwise("species").alias("level"),
        (F.col("p_size") / 40.0).alias("ambiguity"), (F.col("p_size") - 3).alias("usage_count"))
    return en.validate_dictionary(rows).groupBy(F.array_join("problems", "; ").alias("problems")).agg(F.count("*").alias("n"))


@query("c1_exact_lookup", m.with_(m.DICT, AL, WORDS) + """SELECT name, entry_pos, kind AS found_by FROM words LEFT JOIN (
 SELECT alias, entry_pos, kind FROM al WHERE kind IN ('latin','common','synonym') QUALIFY row_number() OVER (PARTITION BY alias
 ORDER BY CASE kind WHEN 'latin' THEN 1 WHEN 'common' THEN 2 ELSE 3 END, entry_pos)=1) ON alias=name""")
def c1(spark, d):
    return en.lookup(words(spark, d), m.dictionary(spark, d))


@query("c2_substring_search", m.with_(m.DICT, AL, WORDS) + """SELECT DISTINCT name AS query, entry_pos FROM words JOIN (
 SELECT entry_pos, alias FROM al WHERE kind IN ('latin','common','synonym') UNION SELECT entry_pos, genus FROM dict) ON contains(alias, name)
 WHERE length(name)>=4""")
def c2(spark, d):
    q = words(spark, d).where("length(name) >= 4").select(F.col("name").alias("query"))
    return en.search(q, m.dictionary(spark, d))


EXACT = (f"nq AS (SELECT query, {NORM} AS norm FROM qry), "
         "al2 AS (SELECT entry_pos, kind, alias, CASE kind WHEN 'latin' THEN 1 WHEN 'common' THEN 2 WHEN 'synonym' THEN 3 WHEN 'variety' THEN 4 ELSE 5 END AS stage FROM al), "
         "ex AS (SELECT query, norm, stage, entry_pos FROM nq LEFT JOIN al2 ON alias=norm QUALIFY row_number() OVER (PARTITION BY query ORDER BY stage, entry_pos)=1)")
FUZZY = (
    "pr AS (SELECT query, norm AS a, al2.entry_pos, kind, alias AS b, string_split(norm,' ') AS wa, string_split(alias,' ') AS wb, instr(alias,norm) AS ix FROM ex, al2 "
    "WHERE ex.stage IS NULL AND kind IN ('latin','common','variety') AND norm<>''), "
    "ps AS (SELECT *, jaro_similarity(a,b) AS j, CASE WHEN a[1:4]=b[1:4] AND least(length(a),length(b))>=4 THEN 4 WHEN a[1:3]=b[1:3] AND least(length(a),length(b))>=3 THEN 3 "
    "WHEN a[1:2]=b[1:2] AND least(length(a),length(b))>=2 THEN 2 WHEN a[1:1]=b[1:1] THEN 1 ELSE 0 END AS pf FROM pr), "
    "sc AS (SELECT query, entry_pos, kind, CASE WHEN a=b THEN 1e0 WHEN ix>0 AND (ix=1 OR b[ix-1:ix-1]=' ') AND (ix+length(a)=length(b)+1 OR b[ix+length(a):ix+length(a)]=' ') "
    "THEN 1e0-((length(b)-length(a))/length(b))*0.2e0 ELSE len(list_filter(wa, lambda w: list_contains(wb,w)))/greatest(len(wa),len(wb))*0.2e0 "
    "+(1e0-levenshtein(a,b)/greatest(length(a),length(b)))*0.5e0+(j+pf*0.1e0*(1e0-j))*0.3e0 END AS s FROM ps), "
    "fz AS (SELECT query, entry_pos, CASE WHEN kind='variety' THEN s*0.95e0 ELSE s END AS score FROM sc WHERE s>=0.8e0 "
    "QUALIFY row_number() OVER (PARTITION BY query, entry_pos ORDER BY CASE kind WHEN 'latin' THEN 0 WHEN 'common' THEN 1 ELSE 2 END)=1), "
    "fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY floor(score*1e9+0.5e0) DESC, entry_pos) AS rank FROM fz QUALIFY rank<=4)")
RES = ("res AS (SELECT ex.query, coalesce(ex.entry_pos, fr.entry_pos) AS entry_pos, CASE WHEN stage IN (1,2) THEN 'exact' WHEN stage>=3 THEN 'synonym' WHEN fr.query IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_type, "
       "CASE stage WHEN 1 THEN 1e0 WHEN 2 THEN 0.95e0 WHEN 3 THEN 0.9e0 WHEN 4 THEN 0.88e0 WHEN 5 THEN 0.85e0 ELSE coalesce(fr.score*0.85e0,0e0) END AS confidence FROM ex LEFT JOIN fr ON fr.query=ex.query AND fr.rank=1)")
CB = [m.DICT, AL, WORDS, QRY, EXACT]


@query("c3_exact_cascade", m.with_(*CB) + f"SELECT query, norm, stage, entry_pos FROM ex")
def c3(spark, d):
    x = en.resolve_exact(name_queries(spark, d), m.dictionary(spark, d))
    return x.select("query", "norm", F.col("stage").cast("long").alias("stage"), "entry_pos")


def _rest(spark, d):
    x = en.resolve_exact(name_queries(spark, d), m.dictionary(spark, d))
    return x.where("stage IS NULL AND norm <> ''").select("query", "norm")


@query("c4_fuzzy_top", m.with_(*CB, FUZZY) + f"SELECT query, entry_pos, {r('score')} AS score, rank FROM fr")
def c4(spark, d):
    f = en.fuzzy_ranked(en.fuzzy_candidates(_rest(spark, d), m.dictionary(spark, d)))
    return f.select("query", "entry_pos", half_up("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("c5_fuzzy_score", m.with_(*CB, FUZZY) + f"SELECT query, entry_pos, {r('score')} AS score FROM fz")
def c5(spark, d):
    return en.fuzzy_candidates(_rest(spark, d), m.dictionary(spark, d)).withColumn("score", half_up("score", 6))


# The engine's own Jaro rounds an odd number of transposed characters down, so at .6 it is spelled out:
# used characters of b turn into chr(1), matched ones of a are kept in order.
JARO = (
    "jr AS (SELECT DISTINCT a, b, greatest(length(a),length(b))//2-1 AS reach FROM ps WHERE a<>b AND "
    "len(list_filter(wa, lambda w: list_contains(wb,w)))/greatest(len(wa),len(wb))*0.2e0+(1e0-levenshtein(a,b)/greatest(length(a),length(b)))*0.5e0+0.3e0>=0.59e0), "
    "jm AS (SELECT a, b, list_reduce(list_prepend({'i':0,'c':'','s':b,'m':'','lo':0::BIGINT,'hi':0::BIGINT}, list_transform(range(1,length(a)+1), lambda i: "
    "{'i':i::INT,'c':a[i:i],'s':'','m':'','lo':greatest(1,i-reach)::BIGINT,'hi':(i+reach)::BIGINT})), lambda x, e: CASE WHEN instr(x.s[e.lo:e.hi],e.c)>0 AND e.hi>=e.lo "
    "THEN {'i':0,'c':'','s':x.s[1:e.lo+instr(x.s[e.lo:e.hi],e.c)-2]||chr(1)||x.s[e.lo+instr(x.s[e.lo:e.hi],e.c):],'m':x.m||e.c,'lo':0::BIGINT,'hi':0::BIGINT} ELSE x END) AS z FROM jr), "
    "jt AS (SELECT a, b, z.m AS ma, array_to_string(list_transform(list_filter(range(1,length(b)+1), lambda k: z.s[k:k]=chr(1)), lambda k: b[k:k]),'') AS mb FROM jm), "
    "jx AS (SELECT a, b, CASE WHEN ma='' THEN 0e0 ELSE (length(ma)/length(a)+length(ma)/length(b)+(length(ma)-len(list_filter(range(1,length(ma)+1), "
    "lambda k: ma[k:k]<>mb[k:k]))/2e0)/length(ma))/3e0 END AS j FROM jt), "
    "pt AS (SELECT ps.* EXCLUDE (j), coalesce(jx.j, 0e0) AS j FROM ps LEFT JOIN jx USING (a, b)), ")
LOW = FUZZY.replace("s>=0.8e0", "s>=0.6e0").replace("FROM ps)", "FROM pt)").replace("sc AS (", JARO + "sc AS (")


@query("c5_fuzzy_score_low", m.with_(*CB, LOW) + f"SELECT query, entry_pos, {r('score')} AS score FROM fz")
def c5_low(spark, d):
    """Every pair from .6 up, most of them without a shared word."""
    return en.fuzzy_candidates(_rest(spark, d), m.dictionary(spark, d), threshold=0.6).withColumn("score", half_up("score", 6))


@query("c6_batch_resolve", m.with_(*CB, FUZZY, RES) + f"SELECT query, entry_pos, match_type, {r('confidence')} AS confidence FROM res")
def c6(spark, d):
    return en.resolve(name_queries(spark, d), m.dictionary(spark, d)).select(
        "query", "entry_pos", "match_type", half_up("confidence", 6).alias("confidence"))


@query("c7_match_report", m.with_(*CB, FUZZY, RES) + f"SELECT match_type, count(*) AS n, {r('avg(confidence)')} AS avg_confidence FROM res GROUP BY ROLLUP(match_type)")
def c7(spark, d):
    return en.match_report(en.resolve(name_queries(spark, d), m.dictionary(spark, d))).withColumn(
        "avg_confidence", half_up("avg_confidence", 6))


@query("c8_related_entities", m.with_(m.DICT) + """SELECT e.entry_pos, o.entry_pos AS other, row_number() OVER (PARTITION BY e.entry_pos ORDER BY o.entry_pos) AS rank
FROM dict e JOIN dict o ON e.latin<>o.latin AND (starts_with(o.latin, e.genus) OR contains(o.common[1], e.common[1])) QUALIFY rank<=5""")
def c8(spark, d):
    return en.related(m.dictionary(spark, d)).withColumn("rank", F.col("rank").cast("long"))


MEN = [m.SEG, m.VOCAB, m.DICT, AL, m.MENTION,
       "men AS (SELECT *, video_id*1000000+seg_no*1000+rk AS mention_id, entity[1:4] AS short FROM mention)"]
CAND = ("cand AS (SELECT short, entry_pos, match_score FROM (SELECT short, entry_pos, max(CASE WHEN kind='latin' AND alias=short THEN 1e0 WHEN alias=short THEN 0.95e0 WHEN kind='latin' THEN 0.7e0 ELSE 0.6e0 END) AS match_score "
        "FROM (SELECT DISTINCT short FROM men) JOIN al ON kind IN ('latin','common') AND contains(alias, short) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY short ORDER BY entry_pos)<=10)")
SCORED = (
    "scd AS (SELECT x.mention_id, c.entry_pos, least(match_score*CASE WHEN EXISTS (SELECT 1 FROM men y WHERE y.video_id=x.video_id AND y.mention_id<>x.mention_id AND abs(y.t-x.t)<=60 AND starts_with(y.short, d.genus)) THEN 1.2e0 ELSE 1e0 END "
    "*CASE WHEN contains(lower(x.context), d.genus) THEN 1.15e0 ELSE 1e0 END*CASE WHEN contains(lower(x.context),'variety') THEN 1.1e0 ELSE 1e0 END, 1e0) AS score "
    "FROM men x JOIN cand c USING (short) JOIN dict d USING (entry_pos))")


def mentions(spark, d, most=None):
    x = m.mentions(spark, d, most)
    return x.withColumn("mention_id", F.col("video_id") * 1000000 + F.col("seg_no") * 1000 + F.col("rk"))


def short_mentions(spark, d):
    return mentions(spark, d).withColumn("entity", F.substring("entity", 1, 4))


def cands(spark, d):
    return en.candidates(short_mentions(spark, d), m.dictionary(spark, d))


@query("c9_candidates", m.with_(*MEN, CAND) + "SELECT short AS entity, entry_pos, match_score FROM cand")
def c9(spark, d):
    return cands(spark, d).select("entity", "entry_pos", "match_score")


@query("c10_disambiguation", m.with_(*MEN, CAND, SCORED) + f""", rk AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, count(*) OVER (PARTITION BY mention_id) AS n FROM scd
 WINDOW w AS (PARTITION BY mention_id ORDER BY floor(score*1e9+0.5e0) DESC, entry_pos))
SELECT men.mention_id, short AS entity, rk.entry_pos IS NOT NULL AS resolved, rk.entry_pos, {r('coalesce(CASE WHEN n=1 THEN 0.95e0 ELSE score END,0e0)')} AS confidence,
 coalesce(second>=score*0.9e0, false) AS needs_review, CASE WHEN n IS NULL THEN 0 ELSE least(n-1,3) END AS alternatives FROM men LEFT JOIN rk ON rk.mention_id=men.mention_id AND rn=1""")
def c10(spark, d):
    # One search of the segments for mentions and candidates: a second one would be shuffled anew.
    ms = stored(short_mentions(spark, d).select("mention_id", "video_id", "t", "entity", "context"))
    scored = en.score_candidates(ms, en.candidates(ms, m.dictionary(spark, d)), m.dictionary(spark, d))
    return en.disambiguate(ms, scored).withColumn("confidence", half_up("confidence", 6))


@query("c11_nearby_entities", m.with_(*MEN) + """SELECT DISTINCT x.mention_id, x.video_id, x.entity, y.entity AS nearby FROM men x JOIN men y
ON x.video_id=y.video_id AND x.mention_id<>y.mention_id AND abs(x.t-y.t)<=60""")
def c11(spark, d):
    return en.nearby_entities(mentions(spark, d))


@query("c11_last_per_name", m.with_(*MEN) + "SELECT video_id, entity, max(mention_id) AS mention_id, arg_max(confidence, mention_id) AS confidence FROM men GROUP BY ALL")
def c11_last(spark, d):
    return en.last_per_name(mentions(spark, d).select("video_id", "entity", "mention_id", "confidence"))


@query("c12_ambiguity", m.with_(*MEN) + """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN latin IS NULL AND rk%4=1 THEN 'Common name only - no Latin name provided'
 WHEN confidence<0.7e0 THEN 'Single word with low confidence' WHEN regexp_matches(entity,'rose|lily|palm|pine|sage|mint|basil') AND latin IS NULL THEN 'Known ambiguous common name' END AS reason FROM men)
WHERE reason IS NOT NULL GROUP BY reason""")
def c12(spark, d):
    x = mentions(spark, d).withColumn("common", F.when(F.col("rk") % 4 == 1, F.col("entity")))
    x = x.withColumn("reason", en.ambiguity_reason(F.col("entity"), F.col("latin"), F.col("common"), F.col("confidence")))
    return x.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


DESC = "|".join(fixed.DESCRIPTIVE_WORDS)
CQ = (f"least(1e0,greatest(0e0, 0.5e0+CASE WHEN nw BETWEEN 5 AND 25 THEN 0.2e0 WHEN nw<3 THEN -0.2e0 ELSE 0e0 END+CASE WHEN regexp_matches(lower(context),'{DESC}') THEN 0.15e0 ELSE 0e0 END "
      f"+CASE WHEN regexp_matches(context,'(?i){fixed.SPECIFICS_PATTERN}') THEN 0.15e0 ELSE 0e0 END-CASE WHEN regexp_matches(context,'(?i){fixed.VAGUE_PATTERN}') THEN 0.2e0 ELSE 0e0 END))")
SPEC = "CASE WHEN rk%7=0 THEN 1e0 WHEN latin IS NOT NULL THEN 0.6e0 ELSE 0.3e0 END"
FAC = (
    "cl AS (SELECT video_id, coalesce(latin,entity) AS key, count(*) AS n, arg_min(in_dictionary, mention_id) AS known FROM men GROUP BY ALL), "
    "kt AS (SELECT video_id, coalesce(latin,entity) AS key, t, count(*) AS m FROM men GROUP BY ALL), "
    "cp AS (SELECT DISTINCT a.video_id, a.key, a.t, a.m, b.key AS bk FROM kt a JOIN kt b ON a.video_id=b.video_id AND a.key<>b.key AND abs(a.t-b.t)<=60), "
    "co AS (SELECT cp.video_id, cp.key, sum(cp.m)::BIGINT AS co, coalesce(bool_or(c.known),false) AS wk FROM cp JOIN cl c ON c.video_id=cp.video_id AND c.key=cp.bk GROUP BY ALL), "
    f"fac AS (SELECT men.*, cl.n AS mentions, cl.n*30e0 AS duration_s, coalesce(co.co,0) AS co, coalesce(co.wk,false) AS wk, {CQ} AS cq, {SPEC} AS spec FROM (SELECT *, len(regexp_split_to_array(context,'\\s+')) AS nw FROM men) men "
    "JOIN cl ON cl.video_id=men.video_id AND cl.key=coalesce(men.latin,men.entity) LEFT JOIN co ON co.video_id=men.video_id AND co.key=coalesce(men.latin,men.entity))")
CAL = (
    "cal0 AS (SELECT *, confidence AS raw, CASE WHEN rk%2=0 THEN 0.15e0*confidence ELSE 0e0 END AS pb, CASE WHEN in_dictionary THEN 0.2e0*confidence*0.9e0 ELSE 0e0 END AS db, "
    "CASE WHEN mentions>1 THEN least(mentions/5e0,1e0)*0.15e0*confidence+least(duration_s/120e0,1e0)*0.1e0*confidence ELSE 0e0 END AS tb, "
    "CASE WHEN rk%7=0 THEN spec*0.1e0*confidence ELSE 0e0 END AS vb, CASE WHEN wk THEN least(co/3e0,1e0)*0.08e0*confidence ELSE 0e0 END AS ob, "
    "CASE WHEN rk%11=0 THEN 0.2e0*confidence ELSE 0e0 END AS xb, CASE WHEN seg_no%3=0 THEN 'manual' WHEN seg_no%3=1 THEN 'auto' ELSE 'none' END AS cap, (rk%10)/10e0 AS vc FROM fac), "
    "cal1 AS (SELECT *, CASE WHEN cq<0.3e0 THEN (raw+pb+db+tb)*0.9e0 ELSE raw+pb+db+tb+CASE WHEN cq>0.7e0 THEN cq*0.1e0*raw ELSE 0e0 END END+vb+ob+xb AS run FROM cal0), "
    "cal AS (SELECT *, least(run*CASE WHEN cap='auto' THEN 0.95e0 ELSE 1e0 END*CASE WHEN vc<0.3e0 THEN 0.85e0 ELSE 1e0 END "
    "+CASE WHEN cap='manual' THEN 0.05e0*raw ELSE 0e0 END+CASE WHEN rk%5=0 THEN 0.1e0*raw ELSE 0e0 END+CASE WHEN rk%6=0 THEN 0.08e0*raw ELSE 0e0 END+CASE WHEN rk%9=0 THEN 0.12e0*raw ELSE 0e0 END+CASE WHEN vc>0.7e0 THEN 0.05e0*raw ELSE 0e0 END, 1e0) AS calibrated FROM cal1)")


def factors(spark, d):
    # The search runs once and the texts end with it: what follows reads short stored rows.
    found = stored(mentions(spark, d).withColumn("context_quality", en.context_quality(F.col("context"))).select(
        "mention_id", "video_id", "seg_no", "t", "rk", "entity", "latin", "confidence", "in_dictionary", "context_quality"))
    x = found.withColumn("key", F.coalesce("latin", "entity"))
    n = x.groupBy("video_id", "key").agg(F.count("*").alias("mentions"))
    x = x.join(n, ["video_id", "key"]).join(en.co_occurrence(found), ["video_id", "key"], "left")
    rk, none = F.col("rk"), F.lit(None).cast("string")
    variety = F.when(rk % 7 == 0, F.lit("v"))
    return x.select(
        "mention_id", "video_id", "entity", "confidence", (rk % 2 == 0).alias("pattern_match"), "in_dictionary",
        F.lit(0.9).alias("dictionary_confidence"), (F.col("mentions") > 1).alias("multiple"), "mentions",
        (F.col("mentions") * 30.0).alias("duration_s"), "context_quality",
        (rk % 7 == 0).alias("has_variety"), en.specificity(F.col("latin"), F.col("entity"), none, variety).alias("specificity"),
        F.coalesce("with_known", F.lit(False)).alias("with_known"), F.coalesce("co_occurrences", F.lit(0)).alias("co_occurrences"),
        (rk % 11 == 0).alias("visual"),
        F.element_at(F.lit(["manual", "auto", "none"]), (F.col("seg_no") % 3 + 1).cast("int")).alias("caption_type"),
        (rk % 5 == 0).alias("tag_match"), (rk % 6 == 0).alias("topic_match"), (rk % 9 == 0).alias("description_match"),
        (rk % 10 / 10.0).alias("vertical_confidence"))


@query("c13_calibration", m.with_(*MEN, FAC, CAL) + f"""SELECT mention_id, {r("calibrated", 9)} AS calibrated, {r("CASE WHEN raw>0 THEN calibrated/raw ELSE 1e0 END", 9)} AS adjustment,
 CASE WHEN calibrated>=0.85e0 AND in_dictionary AND mentions>1 THEN 'high' WHEN calibrated>=0.6e0 THEN 'medium' ELSE 'low' END AS reliability,
 CAST((NOT in_dictionary AND raw>0.7e0)::INT+(cq<0.3e0)::INT+(cap='auto')::INT+(vc<0.3e0)::INT AS BIGINT) AS warnings FROM cal""")
def c13(spark, d):
    return en.calibrate(factors(spark, d)).select(
        "mention_id", half_up("calibrated", 9).alias("calibrated"), half_up("adjustment", 9).alias("adjustment"),
        "reliability", F.size("warnings").cast("long").alias("warnings"))


@query("c14_context_quality", m.with_(m.SEG) + f"""SELECT video_id, seg_no, {r(CQ)} AS quality FROM (SELECT video_id, seg_no, text AS context, len(regexp_split_to_array(text,'\\s+')) AS nw FROM seg)""")
def c14(spark, d):
    return m.segments(spark, d).select("video_id", "seg_no", half_up(en.context_quality(F.col("text")), 6).alias("quality"))


@query("c15_specificity", m.with_(*MEN) + f"SELECT entity, {SPEC} AS specificity, count(*) AS n FROM men GROUP BY ALL")
def c15(spark, d):
    v = F.when(F.col("rk") % 7 == 0, F.lit("v"))
    return mentions(spark, d).groupBy("entity", en.specificity(
        F.col("latin"), F.col("entity"), F.lit(None).cast("string"), v).alias("specificity")).agg(F.count("*").alias("n"))


@query("c16_co_occurrence", m.with_(*MEN, FAC) + """SELECT cl.video_id, cl.key, coalesce(co.co,0) AS co_occurrences, coalesce(co.wk,false) AS with_known FROM cl LEFT JOIN co ON co.video_id=cl.video_id AND co.key=cl.key""")
def c16(spark, d):
    return en.co_occurrence(stored(mentions(spark, d).select("mention_id", "video_id", "t", "entity", "latin", "in_dictionary")))


@query("c17_potential_genera", m.with_(m.DOC) + r"""SELECT DISTINCT video_id, unnest(regexp_extract_all(text,'\b([A-Z][a-z]{3,})\s+[a-z]{3,}\b',1)) AS genus FROM doc""")
def c17(spark, d):
    return en.potential_genera(m.transcripts(spark, d))


@query("c18_variety_hints", m.with_(m.DOC, m.DICT) + r""", g AS (SELECT DISTINCT genus FROM (SELECT unnest(regexp_extract_all(text,'\b([A-Z][a-z]{3,})\s+[a-z]{3,}\b',1)) AS genus FROM doc)),
 h AS (SELECT genus AS g, variety, species, row_number() OVER (PARTITION BY genus ORDER BY usage_count DESC, entry_pos) AS rn FROM dict WHERE variety IS NOT NULL QUALIFY rn<=10)
SELECT g.genus, count(*) AS hints, g.genus||': '||string_agg(''''||variety||''' '||species, ', ' ORDER BY rn) AS line FROM g JOIN h ON h.g=lower(g.genus) GROUP BY g.genus""")
def c18(spark, d):
    return en.variety_hints(en.potential_genera(m.transcripts(spark, d)).select("genus").distinct(), m.dictionary(spark, d))


ENR = (
    "byname AS (SELECT name, d.latin AS l2 FROM (SELECT alias AS name, entry_pos FROM al WHERE kind IN ('latin','common','synonym') QUALIFY row_number() OVER (PARTITION BY alias ORDER BY CASE kind WHEN 'latin' THEN 1 WHEN 'common' THEN 2 ELSE 3 END, entry_pos)=1) JOIN dict d USING (entry_pos)), "
    "enr AS (SELECT men.*, rk%5=0 AS need, coalesce(replace(l2,' ','_'), CASE WHEN latin IS NOT NULL AND confidence>=0.7e0 THEN replace(latin,' ','_') END) AS entity_id FROM men LEFT JOIN byname ON name=entity)")


def enriched(spark, d):
    x = mentions(spark, d).withColumn("level", F.when(F.col("rk") % 5 == 0, "genus"))
    return en.enrich(x, m.dictionary(spark, d))


@query("c19_enrichment", m.with_(*MEN, ENR) + "SELECT mention_id, entity_id, need AS needs_disambiguation FROM enr")
def c19(spark, d):
    return enriched(spark, d).select("mention_id", "entity_id", "needs_disambiguation")


@query("c20_enrichment_metrics", m.with_(*MEN, ENR) + f"SELECT video_id, count(*) AS entities, 0 AS disambiguated, count_if(need)::BIGINT AS genus_only, {r('avg(confidence)', 9)} AS avg_confidence FROM enr GROUP BY video_id")
def c20(spark, d):
    return en.enrichment_metrics(enriched(spark, d)).withColumn("avg_confidence", half_up("avg_confidence", 9))


@query("c21_first_timestamp", m.with_(*MEN) + """, e AS (SELECT DISTINCT video_id, entity FROM men UNION SELECT DISTINCT video_id, 'nowhere' FROM seg)
SELECT video_id, entity, coalesce((SELECT min(start_s) FROM seg WHERE seg.video_id=e.video_id AND contains(lower(text), entity)), 75)::BIGINT AS seconds,
 'https://youtube.com/watch?v='||video_id||'&t='||coalesce((SELECT min(start_s) FROM seg WHERE seg.video_id=e.video_id AND contains(lower(text), entity)), 75)::BIGINT AS link FROM e""")
def c21(spark, d):
    e = mentions(spark, d).select("video_id", "entity").distinct().unionByName(
        m.segments(spark, d).select("video_id", F.lit("nowhere").alias("entity")).distinct())
    return en.first_timestamps(e.withColumn("ts", F.lit("01:15")), m.segments(spark, d)).drop("ts")


@query("c22_category_filter", m.with_(*MEN) + """SELECT video_id, count(*) AS entities, string_agg(DISTINCT lower(category), ',' ORDER BY lower(category)) AS categories FROM men WHERE category IN ('PLANT','BOOK') GROUP BY video_id""")
def c22(spark, d):
    return en.filter_categories(mentions(spark, d), ["plants", "book"]).withColumn("categories", F.array_join("categories", ","))


@query("c23_language_rollup", f"""SELECT coalesce(l,'en') AS language, count(*) AS videos, {r('avg(coalesce(s,0e0))')} AS avg_commercial FROM (
 SELECT d.doc_id, CASE WHEN b.doc_id IS NOT NULL THEN d.lang END AS l, CASE WHEN b.doc_id IS NOT NULL THEN b.quality*60e0+b.toxic*20e0 END AS s FROM documents d LEFT JOIN labels b ON b.doc_id=d.doc_id) GROUP BY ALL""")
def c23(spark, d):
    docs = m.transcripts(spark, d).select("video_id", "lang")
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("video_id"), (F.col("quality") * 60.0 + F.col("toxic") * 20.0).alias("commercial_score"))
    res = lab.join(docs, "video_id").select("video_id", F.col("lang").alias("language"), "commercial_score")
    return en.language_rollup(docs, res).withColumn("avg_commercial", half_up("avg_commercial", 6))
