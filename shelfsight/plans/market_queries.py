"""The market layer over product, order, supplier and part facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import fixed
from shelfsight.functions.num import half_up
from shelfsight.operators import content as ct
from shelfsight.operators import market as mk
from shelfsight.plans import model as m
from shelfsight.plans.registry import query, r, table


def _r6(df, *cols):
    for x in cols:
        df = df.withColumn(x, half_up(x, 6))
    return df


# Categories are brands: scores derived from their parts, history from weekly line items.
CAT = ("cat AS (SELECT p_brand AS category, 'Brand#'||(CAST(p_brand[7:] AS INT)%5) AS parent, (avg(p_size)*2e0) AS demand, (sum(p_partkey)%101)::DOUBLE AS commission, (count(*)%90)::DOUBLE AS authority, "
       "count(DISTINCT p_name) AS competitors, count(*)*4 AS volume, max(p_size)::DOUBLE AS quality, 0.8e0 AS trend_quality FROM part GROUP BY p_brand)")
COMP = ("comp AS (SELECT *, least(competitors/50*100,100)*0.6e0+least(volume/500*100,100)*0.4e0 AS competition, CASE WHEN volume>10 THEN 1e0 ELSE volume/10 END AS cq FROM cat), "
        "conv AS (SELECT *, competition*0.5e0+quality*0.5e0 AS barrier, greatest(0e0,least(100e0,demand*commission*authority/10000-competition/2)) AS convergence FROM comp)")
HIST = ("hist AS (SELECT category, week, score FROM (SELECT brand AS category, CAST(floor(epoch(seen_at)/604800) AS BIGINT) AS week, avg(discount)*1000 AS score FROM prod GROUP BY ALL))")
TREND = ("tr0 AS (SELECT category, count(*) AS samples, avg(score) FILTER (rn<=7) AS rec, avg(score) FILTER (rn BETWEEN 8 AND 14) AS prv FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY week DESC) AS rn FROM hist) GROUP BY category), "
         "tr1 AS (SELECT category, samples, CASE WHEN samples>=7 AND coalesce(prv,rec)>0 THEN (rec-coalesce(prv,rec))/coalesce(prv,rec)*100 ELSE 0e0 END AS velocity FROM tr0), "
         "tr AS (SELECT *, CASE WHEN samples<7 THEN 'stable' WHEN velocity>20 THEN 'emerging' WHEN velocity>5 THEN 'rising' WHEN velocity>-5 THEN 'stable' WHEN velocity>-20 THEN 'declining' ELSE 'dying' END AS trend FROM tr1)")
OPP = ("op0 AS (SELECT conv.*, coalesce(samples,0) AS samples, coalesce(velocity,0e0) AS velocity, coalesce(trend,'stable') AS trend FROM conv LEFT JOIN tr USING (category)), "
       "op1 AS (SELECT *, least(convergence*0.5e0+CASE trend WHEN 'emerging' THEN 20 WHEN 'rising' THEN 10 ELSE 0 END+(100e0-competition)*0.2e0,100e0) AS opportunity FROM op0), "
       "opp AS (SELECT *, CASE WHEN opportunity>=35 THEN 'critical' WHEN opportunity>=30 THEN 'high' WHEN opportunity>=25 THEN 'medium' WHEN opportunity>=20 THEN 'low' ELSE 'avoid' END AS priority, "
       "CASE WHEN convergence>=25 AND trend='emerging' THEN 'invest_now' WHEN convergence>=20 AND authority<50 THEN 'partner_first' WHEN convergence>=15 THEN 'test_small' WHEN convergence>=10 THEN 'watch_closely' ELSE 'skip' END AS recommendation, "
       "floor(demand*commission/100*((100e0-competition)/100)*15+0.5e0) AS revenue, floor((competition/100+1e0)*300+0.5e0) AS cost, CASE WHEN competition>70 THEN 8 WHEN competition>50 THEN 5 ELSE 3 END AS weeks_to_revenue FROM op1)")
REASON = ("CASE recommendation WHEN 'invest_now' THEN 'GREEN LIGHT' ELSE upper(replace(recommendation,'_',' ')) END||': '||array_to_string(list_filter(["
          "CASE WHEN demand>=75 THEN 'Strong consumer demand (' WHEN demand>=60 THEN 'Moderate demand (' ELSE 'Low demand (' END||floor(demand+0.5e0)::BIGINT||'/100)', "
          "CASE WHEN commission>=70 THEN 'excellent profit margins' WHEN commission>=50 THEN 'decent profit margins' ELSE 'low profit margins' END, "
          "CASE WHEN authority>=70 THEN 'authoritative creators present' WHEN authority>=50 THEN 'some authority established' ELSE 'authority gap - partnership opportunity' END, "
          "CASE WHEN competition<40 THEN 'low competition' WHEN competition<70 THEN 'moderate competition' ELSE 'high competition' END, "
          "CASE trend WHEN 'emerging' THEN 'rapid growth' WHEN 'rising' THEN 'steady growth' WHEN 'declining' THEN 'declining trend' END], lambda x: x IS NOT NULL),', ')||'.'")
CB = [CAT, COMP]
DB = [m.PROD, CAT, COMP, HIST, TREND, OPP]


def categories(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(
        (F.avg("p_size") * 2.0).alias("demand"), (F.sum("p_partkey") % 101).cast("double").alias("commission"),
        (F.count("*") % 90).cast("double").alias("authority"), F.countDistinct("p_name").alias("competitors"),
        (F.count("*") * 4).alias("volume"), F.max("p_size").cast("double").alias("quality"), F.lit(0.8).alias("trend_quality"),
    ).withColumn("parent", F.concat(F.lit("Brand#"), F.substring("category", 7, 9).cast("int") % 5))


def history(spark, d):
    return m.products(spark, d).groupBy(
        F.col("brand").alias("category"), F.floor(F.unix_timestamp(F.col("seen_at").cast("timestamp")) / 604800).alias("observed_at")
    ).agg((F.avg("discount") * 1000).alias("score"))


def detected(spark, d):
    return mk.detect(categories(spark, d), history(spark, d))


@query("f1_convergence", m.with_(*CB) + f"SELECT category, {r('convergence')} AS convergence FROM conv")
def f1(spark, d):
    return mk.competition(categories(spark, d)).select("category", half_up(mk.convergence(), 6).alias("convergence"))


@query("f2_competition", m.with_(*CB) + f"SELECT category, {r('competition')} AS competition, {r('barrier')} AS barrier, {r('cq')} AS competition_quality FROM conv")
def f2(spark, d):
    return _r6(mk.competition(categories(spark, d)).select("category", "competition", "barrier", "competition_quality"),
               "competition", "barrier", "competition_quality")


@query("f3_trend", m.with_(m.PROD, HIST, TREND) + f"SELECT category, samples, {r('velocity')} AS velocity, trend FROM tr")
def f3(spark, d):
    return _r6(mk.trend(history(spark, d)), "velocity")


@query("f4_opportunity", m.with_(*DB) + f"SELECT category, {r('opportunity')} AS opportunity, priority, recommendation FROM opp")
def f4(spark, d):
    return _r6(detected(spark, d).select("category", "opportunity", "priority", "recommendation"), "opportunity")


@query("f5_financials", m.with_(*DB) + f"SELECT category, revenue, cost, floor(revenue/cost*10+0.5e0)/10 AS roi, weeks_to_revenue FROM opp")
def f5(spark, d):
    return detected(spark, d).select("category", "revenue", "cost", "roi", "weeks_to_revenue")


@query("f6_confidence_reasoning", m.with_(*DB) + f"SELECT category, {r('(trend_quality+cq)/2*least(samples/7,1)')} AS confidence, {REASON} AS reasoning FROM opp")
def f6(spark, d):
    return _r6(detected(spark, d).select("category", "confidence", "reasoning"), "confidence")


@query("f7_opportunities", m.with_(*DB) + f"SELECT category, {r('convergence')} AS convergence, {r('opportunity')} AS opportunity, trend, priority FROM opp WHERE opportunity>=20")
def f7(spark, d):
    return _r6(mk.opportunities(detected(spark, d), 0.2).select("category", "convergence", "opportunity", "trend", "priority"), "convergence", "opportunity")


# Internal signals: category = part type, video = order, creator = supplier.
IFACT = "cvf AS (SELECT category, video_id, count(*) AS matches, sum(discount*0.01e0) AS weight, count_if(l_quantity>30) AS items FROM prod GROUP BY ALL)"
DEM = ("vid AS (SELECT o_orderkey AS video_id, o_totalprice/50e0 AS views, o_orderdate AS published FROM orders), "
       "dm0 AS (SELECT category, sum(matches)::BIGINT AS matches, sum(weight)/sum(matches) AS aw, count(*) AS videos, sum(items)::BIGINT AS items, sum(views) AS views, avg(views) AS av, "
       "coalesce(avg(views) FILTER (published>=TIMESTAMP '1998-07-01'),0e0) AS rv, coalesce(avg(views) FILTER (published<TIMESTAMP '1998-07-01'),0e0) AS ov FROM cvf JOIN vid USING (video_id) GROUP BY category), "
       "dm1 AS (SELECT *, CASE WHEN rv>ov*1.2e0 THEN 'rising' WHEN rv<ov*0.8e0 THEN 'declining' ELSE 'stable' END AS rt, (least(matches*aw*2,100)*0.35e0+least(videos/(SELECT count(*) FROM vid)*100,100)*0.25e0+least(items/(sum(items) OVER ())*100,100)*0.25e0+least(av/100,100)*0.15e0) AS s FROM dm0), "
       "dem AS (SELECT *, greatest(0e0,least(100e0,floor(s*CASE rt WHEN 'rising' THEN 1.2e0 WHEN 'declining' THEN 0.8e0 ELSE 1e0 END+0.5e0))) AS demand, ((matches>0)::INT+(videos>0)::INT+(items>0)::INT+(views>0)::INT)*25e0 AS dc FROM dm1)")
COM = ("cm0 AS (SELECT category, count(DISTINCT CASE WHEN price>950 THEN product_id END) AS available, (SELECT count(*) FROM part) AS products, avg(discount)*100 AS rate, count_if(discount>0.05e0) AS linked, count(*) AS links, count(DISTINCT creator_id)%5 AS programs FROM prod GROUP BY category), "
       "com AS (SELECT *, greatest(0e0,least(100e0,floor(least(available/products*500,100)*0.4e0+rate*6*0.35e0+least(linked/links*300,100)*0.25e0+0.5e0))) AS commission, greatest(50e0,least(programs/3*100,100)) AS cc FROM cm0)")
AUT = ("cr AS (SELECT category, creator_id, count(DISTINCT video_id) AS videos, count(*)/count(DISTINCT video_id)*5 AS ae, count_if(l_quantity>30)/count(DISTINCT video_id)*3 AS ai FROM prod GROUP BY ALL), "
       "au0 AS (SELECT *, floor(least(ae/15*50+ai/8*50,100)+0.5e0) AS q FROM cr), au1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY q DESC, creator_id) AS rn FROM au0), "
       "au2 AS (SELECT category, count(*) AS creators, sum(videos)::BIGINT AS cv, avg(q) FILTER (rn<=10) AS aq FROM au1 GROUP BY category), "
       "aut AS (SELECT *, greatest(0e0,least(100e0,floor(least(creators/(SELECT count(DISTINCT creator_id) FROM prod)*300,100)*0.3e0+aq*0.4e0+least(cv/creators*20,100)*0.3e0+0.5e0))) AS authority, greatest(30e0,least(cv/10*100,100)) AS ac FROM au2)")


def video_facts(spark, d):
    p = m.products(spark, d).select("category", "video_id", (F.col("discount") * 0.01).alias("weight"), (F.col("l_quantity") > 30).alias("is_item"))
    return mk.category_video_facts(p)


def videos(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("video_id"), (F.col("o_totalprice") / 50.0).alias("views"), F.col("o_orderdate").alias("published"))


def demand(spark, d):
    import datetime
    return mk.internal_demand(video_facts(spark, d), videos(spark, d), datetime.datetime(1998, 7, 1))


def commission(spark, d):
    total = table(spark, d, "part").agg(F.count("*").alias("products"))
    a = m.products(spark, d).groupBy("category").agg(
        F.countDistinct(F.when(F.col("price") > 950, F.col("product_id"))).alias("available"), (F.avg("discount") * 100).alias("rate"),
        F.count_if(F.col("discount") > 0.05).alias("linked"), F.count("*").alias("links"), (F.countDistinct("creator_id") % 5).alias("programs"))
    return mk.internal_commission(a.crossJoin(F.broadcast(total)))


def authority(spark, d):
    p = m.products(spark, d)
    per = p.groupBy("category", "creator_id", "video_id").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 30).alias("i"))
    cr = per.groupBy("category", "creator_id").agg(
        F.count("*").alias("videos"), (F.sum("n") / F.count("*") * 5).alias("avg_entities"), (F.sum("i") / F.count("*") * 3).alias("avg_items"))
    return mk.internal_authority(cr, p.agg(F.countDistinct("creator_id").alias("channels")))


@query("f8_internal_demand", m.with_(m.PROD, IFACT, DEM) + f"SELECT category, matches, videos, items, {r('av',4)} AS avg_views, rt AS recent_trend, demand, dc AS demand_confidence FROM dem")
def f8(spark, d):
    x = demand(spark, d).withColumn("avg_views", half_up("avg_views", 4))
    return x.select("category", "matches", "videos", "items", "avg_views", "recent_trend", "demand", "demand_confidence")


@query("f9_internal_commission", m.with_(m.PROD, COM) + f"SELECT category, available, linked, links, programs, commission, {r('cc')} AS commission_confidence FROM com")
def f9(spark, d):
    return _r6(commission(spark, d).select("category", "available", "linked", "links", "programs", "commission", "commission_confidence"), "commission_confidence")


@query("f10_internal_authority", m.with_(m.PROD, AUT) + f"SELECT category, creators, cv AS creator_videos, {r('aq')} AS avg_quality, authority, ac AS authority_confidence FROM aut")
def f10(spark, d):
    return _r6(authority(spark, d), "avg_quality")


@query("f11_internal_convergence", m.with_(m.PROD, IFACT, DEM, COM, AUT) + f"SELECT category, demand, commission, authority, floor(demand*commission*authority/10000+0.5e0) AS convergence, {r('(dc+cc+ac)/3')} AS confidence, CASE rt WHEN 'rising' THEN 'emerging' WHEN 'declining' THEN 'declining' ELSE 'stable' END AS trend_direction FROM dem JOIN com USING (category) JOIN aut USING (category)")
def f11(spark, d):
    x = mk.internal_convergence(demand(spark, d), commission(spark, d), authority(spark, d))
    return _r6(x.select("category", "demand", "commission", "authority", "convergence", "confidence", "trend_direction"), "confidence")


# Affinity between brands. Keywords: words of part names priced above 905.
KWS = "ckw AS (SELECT DISTINCT p_brand AS category, unnest(string_split(p_name,' ')) AS member FROM part)"


def _ov(name, src):
    return (f"{name}_m AS (SELECT DISTINCT category, member FROM ({src})), {name}_n AS (SELECT category, count(*) AS n FROM {name}_m GROUP BY ALL), "
            f"{name}_b AS (SELECT x.category AS a, y.category AS b, count(*) AS bth FROM {name}_m x JOIN {name}_m y ON x.member=y.member AND x.category<y.category GROUP BY ALL), "
            f"{name}_o AS (SELECT a, b, bth/(p.n+q.n-bth)*100 AS v FROM {name}_b JOIN {name}_n p ON p.category=a JOIN {name}_n q ON q.category=b)")


AFF = ", ".join([_ov("kw", "SELECT category, member FROM ckw"), _ov("vi", "SELECT brand AS category, video_id AS member FROM prod"),
                 _ov("au", "SELECT brand AS category, o_custkey AS member FROM prod JOIN orders ON o_orderkey=video_id"),
                 _ov("co", "SELECT brand AS category, product_id%97 AS member FROM prod"), _ov("cr", "SELECT brand AS category, creator_id AS member FROM prod"),
                 "pr AS (SELECT x.category AS a, y.category AS b, x.parent AS pa, y.parent AS pb FROM cat x JOIN cat y ON x.category<y.category), "
                 "af0 AS (SELECT pr.*, kw_o.v AS keyword, vi_o.v AS video, au_o.v AS audience, co_o.v AS commerce, cr_o.v AS creator, coalesce(vi_o.v,0)*0.3e0+coalesce(kw_o.v,0)*0.25e0+coalesce(au_o.v,0)*0.2e0+coalesce(co_o.v,0)*0.15e0+coalesce(cr_o.v,0)*0.1e0 AS score FROM pr "
                 "LEFT JOIN kw_o USING (a,b) LEFT JOIN vi_o USING (a,b) LEFT JOIN au_o USING (a,b) LEFT JOIN co_o USING (a,b) LEFT JOIN cr_o USING (a,b))",
                 "aff AS (SELECT *, CASE WHEN pa=b OR pb=a THEN 'parent_child' WHEN pa=pb THEN 'sibling' WHEN score>=50 THEN 'adjacent' ELSE 'unrelated' END AS relation FROM af0)",
                 "ed AS (SELECT a AS source, b AS target, score, relation FROM aff UNION ALL SELECT b, a, score, relation FROM aff)"])


def keywords(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("category"), F.explode(F.split("p_name", " ")).alias("keyword"))


def pairs(spark, d):
    p = m.products(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), "o_custkey")
    by = lambda col: p.select(F.col("brand").alias("category"), col.alias("member"))
    return mk.affinity(
        categories(spark, d), keyword=mk.keyword_overlap(keywords(spark, d)), video=mk.overlap(by(F.col("video_id")), "video"),
        audience=mk.overlap(p.join(o, "video_id").select(F.col("brand").alias("category"), F.col("o_custkey").alias("member")), "audience"),
        commerce=mk.overlap(by(F.col("product_id") % 97), "commerce"), creator=mk.overlap(by(F.col("creator_id")), "creator"))


@query("f12_keyword_overlap", m.with_(KWS, _ov("kw", "SELECT category, member FROM ckw")) + f"SELECT a, b, {r('v')} AS keyword FROM kw_o")
def f12(spark, d):
    return _r6(mk.keyword_overlap(keywords(spark, d)), "keyword")


AB = [m.PROD, CAT, KWS, AFF]


@query("f13_affinity", m.with_(*AB) + f"SELECT a, b, {r('score')} AS score, relation, {r('video')} AS video, {r('audience')} AS audience, "
       f"{r('least((coalesce(video,0)+coalesce(commerce,0)+coalesce(creator,0))/100,1e0)')} AS confidence, "
       "CAST(floor(coalesce(video,0)+coalesce(commerce,0)+coalesce(creator,0)+0.5e0) AS BIGINT) AS sample_size FROM aff")
def f13(spark, d):
    x = pairs(spark, d).select("a", "b", "score", "relation", "video", "audience", "confidence", "sample_size")
    return _r6(x, "score", "video", "audience", "confidence")


@query("f14_estimated_overlap", m.with_(CAT, KWS, _ov("kw", "SELECT category, member FROM ckw")) + f"""SELECT a, b, {r('least(100,k*0.8e0+bo)')} AS video, {r('least(100,k*0.6e0+bo)')} AS commerce, {r('least(100,k*0.5e0+bo*0.5e0)')} AS creator, {r('least(100,k*0.7e0+bo)')} AS audience FROM (
 SELECT x.category AS a, y.category AS b, coalesce(v,0) AS k, CASE WHEN x.parent=y.category OR y.parent=x.category THEN 25e0 ELSE 0e0 END AS bo FROM cat x JOIN cat y ON x.category<y.category LEFT JOIN kw_o ON a=x.category AND b=y.category)""")
def f14(spark, d):
    base = mk.affinity(categories(spark, d), keyword=mk.keyword_overlap(keywords(spark, d)))
    x = mk.estimated_overlaps(base.withColumn("related", F.col("relation") == "parent_child"))
    return _r6(x.select("a", "b", "video", "commerce", "creator", "audience"), "video", "commerce", "creator", "audience")


@query("f15_category_affinity", m.with_(*AB) + f"SELECT target, {r('score')} AS score, relation FROM ed WHERE source='Brand#7'")
def f15(spark, d):
    x = mk.oriented(pairs(spark, d)).where("source = 'Brand#7'")
    return _r6(x.select("target", "score", "relation"), "score").orderBy(F.desc("score"), "target")


WANTED = ("nm AS (SELECT category, 'brand-number-'||category[7:] AS key, 'Brand Number '||category[7:] AS name FROM cat), "
          "wt AS (SELECT category AS wanted, category FROM nm UNION ALL SELECT upper(name), category FROM nm UNION ALL SELECT key, category FROM nm UNION ALL SELECT 'no '||key, NULL FROM nm)")


@query("f15_affinity_lookup", m.with_(*AB, WANTED) + f"SELECT wanted, category AS source, target, {r('score')} AS score, relation FROM wt LEFT JOIN ed ON source=category")
def f15_lookup(spark, d):
    """Every brand by id, by name in capitals and by key, and as many names that no brand has."""
    number = F.substring("category", 7, 9)
    known = categories(spark, d).select("category", F.concat(F.lit("brand-number-"), number).alias("key"), F.concat(F.lit("Brand Number "), number).alias("name"))
    wanted = known.select(F.explode(F.array(F.col("category"), F.upper("name"), F.col("key"), F.concat(F.lit("no "), "key"))).alias("wanted"))
    return _r6(mk.category_affinity(wanted, known, mk.oriented(pairs(spark, d))), "score")


@query("f16_expansion_paths", m.with_(*AB) + f""", d1 AS (SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY floor(score*1e9+0.5e0) DESC, target) AS rank FROM ed WHERE score>=20 QUALIFY rank<=5),
 h2 AS (SELECT d1.source, d1.rank, e.target AS nxt, row_number() OVER (PARTITION BY d1.source, d1.rank ORDER BY floor(e.score*1e9+0.5e0) DESC, e.target) AS o FROM d1 JOIN ed e ON e.source=d1.target AND e.score>=15 AND e.target<>d1.source)
SELECT d1.source, d1.rank, d1.source||'>'||d1.target||coalesce('>'||nxt,'') AS path, {r('score')} AS score,
 CASE WHEN score>=50 THEN 'Strong cross-sell opportunity -- audiences highly overlap' WHEN score>=30 THEN 'Moderate affinity -- test with related content' ELSE 'Weak connection -- monitor for emerging crossover' END AS recommendation FROM d1 LEFT JOIN h2 ON h2.source=d1.source AND h2.rank=d1.rank AND o=1""")
def f16(spark, d):
    x = mk.expansion_paths(mk.oriented(pairs(spark, d)), depth=2)
    return _r6(x.select("source", F.col("rank").cast("long").alias("rank"), F.array_join("path", ">").alias("path"), "score", "recommendation"), "score")


@query("f17_cross_sell", m.with_(*AB) + f"SELECT a, b, CASE relation WHEN 'parent_child' THEN 'parent' WHEN 'sibling' THEN 'sibling' ELSE 'complementary' END AS shown_relation, {r('least(coalesce(commerce,0)/100*0.4e0+coalesce(audience,0)/100*0.35e0+(1e0-abs(coalesce(keyword,0)-50)/50)*0.25e0,1)')} AS cross_sell FROM aff WHERE relation<>'unrelated'")
def f17(spark, d):
    return _r6(mk.presented(pairs(spark, d)).select("a", "b", "shown_relation", "cross_sell"), "cross_sell")


@query("e16_content_gaps", m.with_(*AB, COMP, HIST, TREND) + f""", tp AS (SELECT conv.category, demand, competition, coalesce(trend,'stable') AS trend FROM conv LEFT JOIN tr USING (category)),
 g AS (SELECT source, target, trend, {r('demand*(100e0-competition)/100',2)} AS o FROM ed JOIN tp ON target=category WHERE relation IN ('adjacent','unrelated') AND score>50)
SELECT source, count(*) AS gaps, max(o) AS best_opportunity, coalesce(string_agg(target, ',' ORDER BY target) FILTER (trend IN ('rising','emerging')),'') AS emerging, coalesce(string_agg(target, ',' ORDER BY target) FILTER (trend='declining'),'') AS declining FROM g GROUP BY source""")
def e16(spark, d):
    topics = mk.competition(categories(spark, d)).join(mk.trend(history(spark, d)), "category", "left").fillna({"trend": "stable"})
    g = ct.content_gaps(mk.oriented(pairs(spark, d)), topics.select("category", "demand", "competition", "trend"))
    return g.withColumn("emerging", F.array_join("emerging", ",")).withColumn("declining", F.array_join("declining", ","))


# Lifecycle: candidates are (name, type) groups of parts.
LC = ("lc AS (SELECT p_name||' '||p_type AS category, (min(p_partkey)*7%100)::DOUBLE AS convergence, count(*)*25 AS products, count(*)+5 AS videos, count(*) AS competitors, max(p_size)::DOUBLE*2 AS demand, "
      "CASE WHEN min(p_partkey)%9=0 THEN NULL WHEN min(p_partkey)%9=1 THEN '{bad' ELSE '{\"primary\":['||string_agg('\"w'||p_size||'\"', ',')||']}' END AS lk, "
      "count(*)*CASE WHEN min(p_partkey)%9>1 THEN 1 ELSE 0 END AS nk, (min(p_partkey)%10)/10e0 AS kc, (['detected','trend_validated','keywords_learned','ready_for_promotion','promoted','retired'])[min(p_partkey)%6+1] AS stage FROM part GROUP BY p_name, p_type), "
      "lp AS (SELECT *, CASE WHEN convergence<30 THEN 'convergence' WHEN products<100 THEN 'product_mentions' WHEN videos<10 THEN 'video_mentions' WHEN lk IS NULL OR kc<0.5e0 THEN 'keywords_not_learned' WHEN lk='{bad' THEN 'keywords_unparseable' WHEN nk<5 THEN 'too_few_keywords' ELSE 'promoted' END AS reason FROM lc)")
GATES = {**mk.GATES, "convergence": 30.0, "keywords": 5}


def lifecycle(spark, d):
    k = F.min("p_partkey")
    words = F.to_json(F.struct(F.transform(F.collect_list("p_size"), lambda x: F.concat(F.lit("w"), x)).alias("primary")))
    return table(spark, d, "part").groupBy("p_name", "p_type").agg(
        (k * 7 % 100).cast("double").alias("convergence"), (F.count("*") * 25).alias("products"), (F.count("*") + 5).alias("videos"),
        F.count("*").alias("competitors"), (F.max("p_size") * 2.0).alias("demand"),
        F.when(k % 9 == 0, None).when(k % 9 == 1, "{bad").otherwise(words).alias("learned_keywords"), (k % 10 / 10.0).alias("keyword_confidence"),
        F.element_at(F.lit(list(mk.STATES)), (k % 6 + 1).cast("int")).alias("stage"),
    ).withColumn("category", F.concat_ws(" ", "p_name", "p_type"))


@query("f18_promotion_gate", m.with_(LC) + "SELECT category, reason='promoted' AS promoted, reason FROM lp")
def f18(spark, d):
    return mk.promotion(lifecycle(spark, d), GATES).select("category", "promoted", "reason")


@query("f19_retirement", m.with_(m.PROD, HIST) + f"SELECT category, count(*) AS points, {r('avg(score)')} AS mean FROM hist GROUP BY category HAVING count(*)>=8 AND avg(score)<50.5e0")
def f19(spark, d):
    return _r6(mk.retirement(history(spark, d), {"points": 8, "mean": 50.5}), "mean")


@query("f20_next_stage", m.with_(LC) + """SELECT category, CASE WHEN stage='detected' AND convergence>=15 THEN 'trend_validated' WHEN stage='trend_validated' AND lk IS NOT NULL AND kc>=0.5e0 THEN 'keywords_learned'
 WHEN stage='keywords_learned' AND reason='promoted' THEN 'promoted' ELSE stage END AS next_stage FROM lp""")
def f20(spark, d):
    return mk.next_stage(mk.promotion(lifecycle(spark, d), GATES), GATES).select("category", "next_stage")


@query("f21_lifecycle_signals", m.with_(*DB) + f""", ch AS (SELECT category, (avg(score) FILTER (rn<=4)-avg(score) FILTER (rn BETWEEN 5 AND 8))/greatest(avg(score) FILTER (rn BETWEEN 5 AND 8),1)*100 AS chg FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY week DESC) AS rn FROM hist) GROUP BY category),
 s AS (SELECT category, 'Demand score' AS signal, demand AS value, CASE WHEN demand>=75 THEN 'positive' WHEN demand>=50 THEN 'neutral' ELSE 'negative' END AS direction FROM cat UNION ALL
 SELECT category, 'Convergence trend (4-week)', chg, CASE WHEN chg>5 THEN 'positive' WHEN chg<-5 THEN 'negative' ELSE 'neutral' END FROM ch WHERE chg IS NOT NULL UNION ALL
 SELECT category, 'Product mentions', volume, CASE WHEN volume>=100 THEN 'positive' ELSE 'neutral' END FROM cat UNION ALL SELECT category, 'Video mentions', volume/4, CASE WHEN volume/4>=10 THEN 'positive' ELSE 'neutral' END FROM cat UNION ALL
 SELECT category, 'Keyword confidence', quality/60*100, CASE WHEN quality/60>=0.75e0 THEN 'positive' ELSE 'neutral' END FROM cat UNION ALL
 SELECT category, 'Competition', competitors, CASE WHEN competitors<15 THEN 'positive' WHEN competitors>30 THEN 'negative' ELSE 'neutral' END FROM cat)
SELECT category, signal, {r('value')} AS value, direction FROM s""")
def f21(spark, d):
    x = categories(spark, d).withColumn("products", F.col("volume")).withColumn("videos", F.col("volume") / 4).withColumn("keyword_confidence", F.col("quality") / 60)
    return _r6(mk.lifecycle_signals(x, history(spark, d)), "value")


@query("f21_transitions", m.with_(LC) + """SELECT category, stage, p.to_stage, p.pr AS probability FROM (SELECT category, stage, unnest(CASE stage
 WHEN 'detected' THEN [{'to_stage':'detected','pr':0.5e0},{'to_stage':'trend_validated','pr':CASE WHEN convergence>=25 THEN 0.4e0 ELSE 0.1e0 END},{'to_stage':'retired','pr':0.1e0}]
 WHEN 'trend_validated' THEN [{'to_stage':'trend_validated','pr':0.4e0},{'to_stage':'keywords_learned','pr':CASE WHEN kc>=0.5e0 THEN 0.5e0 ELSE 0.1e0 END},{'to_stage':'retired','pr':0.1e0}]
 WHEN 'keywords_learned' THEN [{'to_stage':'keywords_learned','pr':0.3e0},{'to_stage':'ready_for_promotion','pr':CASE WHEN convergence>=50 THEN 0.5e0 ELSE 0.1e0 END},{'to_stage':'promoted','pr':CASE WHEN convergence>=50 THEN 0.1e0 ELSE 0e0 END},{'to_stage':'retired','pr':0.1e0}]
 WHEN 'ready_for_promotion' THEN [{'to_stage':'ready_for_promotion','pr':0.3e0},{'to_stage':'promoted','pr':0.6e0},{'to_stage':'retired','pr':0.1e0}]
 WHEN 'promoted' THEN [{'to_stage':'promoted','pr':0.85e0},{'to_stage':'retired','pr':0.15e0}] ELSE [{'to_stage':'retired','pr':0.9e0},{'to_stage':'detected','pr':0.1e0}] END) AS p FROM lc) WHERE p.pr>0""")
def f21t(spark, d):
    return mk.transitions(lifecycle(spark, d))


@query("f21_states", m.with_(LC) + """SELECT state, count(*) AS n, any_value(CASE state WHEN 'emerging' THEN 'growing' WHEN 'growing' THEN 'mature' WHEN 'mature' THEN 'declining' ELSE 'retired' END) AS next_state FROM (
 SELECT CASE WHEN stage IN ('detected','trend_validated') THEN 'emerging' WHEN stage IN ('keywords_learned','ready_for_promotion') THEN 'growing' WHEN stage='promoted' THEN 'mature' ELSE 'declining' END AS state FROM lc) GROUP BY state""")
def f21s(spark, d):
    return mk.states(lifecycle(spark, d)).groupBy("state", "next_state").agg(F.count("*").alias("n"))


# Channels: suppliers with their line items as videos.
CH = ("ch AS (SELECT s_suppkey AS channel_id, (s_acctbal*15)::BIGINT AS subs, n AS videos FROM supplier LEFT JOIN (SELECT l_suppkey, count(*)%250 AS n FROM lineitem GROUP BY l_suppkey) ON l_suppkey=s_suppkey), "
      "cri AS (SELECT channel_id, 'published_books' AS criterion, 30e0 AS score, 0.2e0 AS cf, 0.15e0 AS w FROM ch UNION ALL SELECT channel_id, 'editorial_vetting', 50e0, 0.3e0, 0.1e0 FROM ch UNION ALL "
      "SELECT channel_id, 'media_presence', CASE WHEN subs IS NULL OR subs<=0 THEN 50e0 WHEN subs>100000 THEN 80e0 WHEN subs>10000 THEN 60e0 ELSE 35e0 END, CASE WHEN subs IS NULL OR subs<=0 THEN 0.3e0 WHEN subs>100000 THEN 0.7e0 WHEN subs>10000 THEN 0.6e0 ELSE 0.5e0 END, 0.15e0 FROM ch UNION ALL "
      "SELECT channel_id, 'professional_credentials', 40e0, 0.2e0, 0.2e0 FROM ch UNION ALL SELECT channel_id, 'institutional_affiliation', 35e0, 0.2e0, 0.15e0 FROM ch UNION ALL SELECT channel_id, 'ethical_alignment', 55e0, 0.3e0, 0.1e0 FROM ch UNION ALL "
      "SELECT channel_id, 'production_quality', CASE WHEN coalesce(videos,0)>0 THEN least(80e0,40+videos*0.2e0) ELSE 50e0 END, CASE WHEN coalesce(videos,0)>0 THEN 0.5e0 ELSE 0.3e0 END, 0.15e0 FROM ch)")
VET = ("adj AS (SELECT cri.*, CASE WHEN criterion='media_presence' AND channel_id%3=0 THEN greatest(0,least(100,score+45)) ELSE score END AS sc, CASE WHEN channel_id%5=0 THEN cf+0.6e0 ELSE cf END AS c2, criterion='professional_credentials' AND channel_id%5<>0 AS fl FROM cri), "
       "ve0 AS (SELECT channel_id, sum(sc*w)/sum(w) AS composite, avg(c2) AS ac, count_if(c2<0.5e0) AS l5, count_if(c2<0.6e0) AS l6, stddev_pop(sc) AS sd, bool_or(fl) AS fl FROM adj GROUP BY channel_id), "
       "vet AS (SELECT *, least(1,ac+CASE WHEN channel_id%10=0 THEN 0.1e0 ELSE 0e0 END) AS conf, (l5>=3)::INT+(sd>25)::INT+fl::INT AS nr FROM ve0), "
       "vd AS (SELECT *, CASE WHEN conf<0.65e0 OR nr>0 THEN 'needs_review' WHEN composite>=70 THEN 'approved' WHEN composite<=40 THEN 'rejected' ELSE 'needs_review' END AS decision FROM vet)")


def criteria(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel_id")).agg((F.count("*") % 250).alias("videos"))
    ch = table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.round(F.col("s_acctbal") * 15).cast("long").alias("subscribers"))
    return mk.criteria(ch.join(n, "channel_id", "left"))


def adjusted(spark, d):
    adj = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(
        F.col("s_suppkey").alias("channel_id"), F.lit("media_presence").alias("criterion"), F.lit(45.0).alias("adjustment"), F.lit("strong reach").alias("reason"))
    x = mk.adjust(criteria(spark, d), adj)
    five = F.col("channel_id") % 5 == 0
    return x.withColumn("confidence", F.when(five, F.col("confidence") + 0.6).otherwise(F.col("confidence"))).withColumn(
        "flags", F.when(five, F.array().cast("array<string>")).otherwise(F.col("flags")))


def vetted(spark, d):
    ext = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("channel_id"))
    return mk.vet(adjusted(spark, d), ext)


@query("f22_channel_composite", m.with_(CH, VET) + f"SELECT channel_id, {r('composite')} AS composite FROM vd")
def f22(spark, d):
    return _r6(vetted(spark, d).select("channel_id", "composite"), "composite")


@query("f23_vetting_confidence", m.with_(CH, VET) + f"SELECT channel_id, {r('conf')} AS confidence, {r('sd')} AS score_spread, nr::BIGINT AS reasons, conf<0.65e0 OR nr>0 AS review FROM vd")
def f23(spark, d):
    return _r6(vetted(spark, d).select("channel_id", "confidence", "score_spread", F.size("reasons").cast("long").alias("reasons"), "review"), "confidence", "score_spread")


@query("f24_vetting_decision", m.with_(CH, VET) + "SELECT channel_id, decision, l6>=3 OR sd>25 OR composite BETWEEN 55 AND 75 AS escalate FROM vd")
def f24(spark, d):
    return vetted(spark, d).select("channel_id", "decision", "escalate")


@query("f25_adjustments", m.with_(CH, VET) + f"SELECT channel_id, criterion, {r('sc')} AS score, CASE WHEN criterion='media_presence' AND channel_id%3=0 THEN 'AI adjustment: strong reach' END AS note FROM adj")
def f25(spark, d):
    return _r6(adjusted(spark, d).select("channel_id", "criterion", "score", "note"), "score")


@query("f26_batch_vetting", m.with_(CH, VET) + f"SELECT decision, count(*) AS channels, {r('avg(composite)')} AS avg_composite FROM vd GROUP BY decision")
def f26(spark, d):
    return vetted(spark, d).groupBy("decision").agg(F.count("*").alias("channels"), half_up(F.avg("composite"), 6).alias("avg_composite"))


@query("f27_five_dimensions", m.with_(CH) + """, pv AS (SELECT channel_id, max(score) FILTER (criterion='published_books') AS pb, max(score) FILTER (criterion='editorial_vetting') AS ev, max(score) FILTER (criterion='media_presence') AS mp,
 max(score) FILTER (criterion='professional_credentials') AS pc, max(score) FILTER (criterion='institutional_affiliation') AS ia, max(score) FILTER (criterion='ethical_alignment') AS ea, max(score) FILTER (criterion='production_quality') AS pq FROM cri GROUP BY channel_id)
SELECT channel_id, mp AS reach_means, floor((pq+ev)/2+0.5e0) AS engagement_means, floor((pc+ev)/2+0.5e0) AS quality_means, floor((pb+ia+ea)/3+0.5e0) AS trust_means, floor((pq+mp)/2+0.5e0) AS commercial_means,
 floor(mp+0.5e0) AS reach_group, floor(pq+0.5e0) AS engagement_group, floor((ev+pb)/2+0.5e0) AS quality_group, floor((pc+ia)/2+0.5e0) AS trust_group, floor(ea+0.5e0) AS commercial_group FROM pv""")
def f27(spark, d):
    return mk.dimensions(criteria(spark, d))


# Programs: suppliers with a description and a country chosen by their keys.
TEXTS = ["Garden plants and bulbs", "Seed and compost store with tools like spade and rake", "Fashion outlet", "Greenhouse, soil, seeds, flower show and roses",
         "Gardening book club", "Electronics", "Tree nursery and hedge plants, garden tool hire", "Pots"]
COUNTRIES = ["United Kingdom", "Germany", "USA", "Australia", "Wales", "Japan", "Canada", "New Zealand", "Czech Republic", "Ukraine"]
PRG = ("prg AS (SELECT s_suppkey AS program_id, s_name AS name, (" + str(TEXTS) + ")[s_suppkey%8+1] AS description, n_name AS terms, CASE WHEN s_suppkey%11<>0 THEN (" + str(COUNTRIES) + ")[s_nationkey%10+1] END AS country, s_acctbal FROM supplier JOIN nation ON n_nationkey=s_nationkey)")
_N = {k: "+".join(f"contains(low,'{w.lower()}')::INT" for w in v) for k, v in fixed.PROGRAM_KEYWORDS.items()}
REL = ("rl0 AS (SELECT *, lower(name||' '||description||' '||terms) AS low FROM prg), rl1 AS (SELECT *, " + ", ".join(f"({e}) AS n_{k}" for k, e in _N.items()) + " FROM rl0), "
       "rl2 AS (SELECT *, " + "+".join(f"n_{k}" for k in _N) + " AS matched, " + "+".join(f"(n_{k}>0)::INT" for k in _N) + " AS cats FROM rl1), "
       "rel AS (SELECT *, CASE WHEN cats>=3 THEN least(100,b+10) ELSE b END AS relevance FROM (SELECT *, CASE WHEN matched>=5 THEN 90 WHEN matched>=3 THEN 75 WHEN matched>=2 THEN 60 WHEN matched>=1 THEN 40 ELSE 0 END AS b FROM rl2))")


def programs(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    at = lambda xs, col, n: F.element_at(F.lit(xs), (F.col(col) % n + 1).cast("int"))
    k = F.col("s_suppkey")
    groups = F.when(k % 4 == 0, F.array().cast("array<struct<min:double,max:double>>")).otherwise(
        F.array(F.struct((k % 7 + 1).cast("double").alias("min"), (k % 13 + 8).cast("double").alias("max")), F.struct(F.lit(5.0).alias("min"), F.lit(9.0).alias("max"))))
    return s.select(k.alias("program_id"), F.col("s_name").alias("name"), at(TEXTS, "s_suppkey", 8).alias("description"),
                    F.col("n_name").alias("terms"), F.when(k % 11 != 0, at(COUNTRIES, "s_nationkey", 10)).alias("country"), groups.alias("commission_groups"))


@query("f28_program_relevance", m.with_(PRG, REL) + "SELECT program_id, matched, cats AS categories, relevance, relevance>=50 AS relevant FROM rel")
def f28(spark, d):
    return mk.keyword_relevance(programs(spark, d)).select("program_id", "matched", "categories", "relevance", "relevant")


@query("f29_hybrid_routing", m.with_(PRG, REL) + f"SELECT route, count(*) AS n, {r("sum(CASE WHEN route='keyword' THEN 0.001e0 ELSE 0e0 END)")} AS cost_saved FROM (SELECT CASE WHEN relevance>=70 OR relevance<=30 THEN 'keyword' ELSE 'review' END AS route FROM rel) GROUP BY route")
def f29(spark, d):
    return _r6(mk.route_stats(mk.route(mk.keyword_relevance(programs(spark, d)), 70, 30)), "cost_saved")


@query("f29_filter_presets", m.with_(PRG, REL) + f"""SELECT preset, count(*) AS processed, count_if(s) AS keyword_only, count_if(NOT s) AS ai_calls, {r('count_if(s)*0.001e0')} AS cost_saved,
 floor(count_if(NOT s)/count(*)*1000+0.5e0)/10 AS ai_percentage, {r('count_if(NOT s)*0.001e0')} AS cost_per_scan FROM (SELECT preset, relevance>=hi OR relevance<=lo AS s FROM rel,
 (VALUES ('aggressive-cost-saving',70,30),('balanced',80,20),('quality-first',90,10)) v(preset,hi,lo)) GROUP BY preset""")
def f29_presets(spark, d):
    return _r6(mk.preset_stats(mk.keyword_relevance(programs(spark, d))), "cost_saved", "cost_per_scan")


@query("f30_program_discovery", m.with_(PRG, REL) + """SELECT program_id, relevance, CASE WHEN program_id%4=0 THEN 0e0 ELSE least(program_id%7+1,5,0)::DOUBLE END AS commission_min,
 CASE WHEN program_id%4=0 THEN 0e0 ELSE greatest(program_id%13+8,9,0)::DOUBLE END AS commission_max, CASE WHEN program_id%4<>0 THEN least(program_id%7+1,5)::DOUBLE END AS commission_floor FROM rel WHERE relevance>=60""")
def f30(spark, d):
    return mk.discover(mk.keyword_relevance(programs(spark, d)), 60).select("program_id", "relevance", "commission_min", "commission_max", "commission_floor")


@query("f31_region_bucket", m.with_(PRG) + """SELECT CASE WHEN country IN ('United Kingdom','Wales','Ukraine') THEN 'UK' WHEN country IN ('Germany','Czech Republic') THEN 'EU' WHEN country IN ('USA','Canada') THEN 'NA'
 WHEN country IN ('Australia','New Zealand') THEN 'AU' ELSE 'OTHER' END AS region, count(*) AS programs FROM prg GROUP BY region""")
def f31(spark, d):
    return programs(spark, d).groupBy(mk.region_bucket("country").alias("region")).agg(F.count("*").alias("programs"))


@query("f32_program_coverage", m.with_(PRG, REL) + f"SELECT count(*) AS programs, count(country) AS located, {r('avg(relevance)')} AS avg_relevance, " + ", ".join(f"count_if(n_{k}>0)::BIGINT AS n_{k}" for k in _N) + " FROM rel WHERE relevance>=50")
def f32(spark, d):
    x = mk.coverage_report(mk.keyword_relevance(programs(spark, d)).where("relevant"), list(fixed.PROGRAM_KEYWORDS))
    return _r6(x, "avg_relevance")


TOP = ("top AS (SELECT row_number() OVER (ORDER BY relevance DESC, program_id) AS rank, program_id, name||' ('||relevance||'/100) - '||coalesce(country,'Location unknown') AS l "
       "FROM rel WHERE relevance>=50 ORDER BY rank LIMIT 10)")


@query("f32_top_programs", m.with_(PRG, REL, TOP) + "SELECT rank, program_id, rank||'. '||l AS line FROM top")
def f32_top(spark, d):
    best = mk.top_programs(mk.keyword_relevance(programs(spark, d)).where("relevant"))
    return best.withColumn("rank", F.col("rank").cast("long"))


def _title(key):
    return "".join(f" {x}" if x.isupper() else x for x in key).strip().title()


@query("f32_coverage_text", m.with_(PRG, REL, TOP) + "SELECT array_to_string(['AFFILIATE DISCOVERY REPORT','==========================','','Total Programs Discovered: '||count(*),"
       "'Programs with Location Data: '||count(country)||' ('||floor(count(country)/count(*)*100+0.5e0)::BIGINT||'%)','Average Relevance Score: '||(floor(avg(relevance)*10+0.5e0)/10)||'/100','',"
       "'Coverage by Vertical:'," + ",".join(f"'- {_title(k)}: '||count_if(n_{k}>0)" for k in _N) +
       ",'','Top Programs:',(SELECT string_agg(rank||'. '||l, chr(10) ORDER BY rank) FROM top)],chr(10)) AS report FROM rel WHERE relevance>=50")
def f32_text(spark, d):
    return mk.coverage_text(mk.keyword_relevance(programs(spark, d)).where("relevant"), list(fixed.PROGRAM_KEYWORDS))


@query("a10_program_selection", m.with_(PRG) + "SELECT program_id, name FROM prg WHERE contains(lower(description),'seed') OR contains(lower(description),'tools') OR contains(lower(terms),'seed')")
def a10(spark, d):
    return mk.select_programs(programs(spark, d), "Seed, tools of").select("program_id", "name")


@query("a10_program_selection_fallback", m.with_(PRG) + "SELECT program_id, name FROM prg")
def a10f(spark, d):
    return mk.select_programs(programs(spark, d), "submarines").select("program_id", "name")


# Discovery: product mentions named "<name> Pack for <type>".
CLU = ("pn AS (SELECT video_id*10+l_linenumber AS id, name||' Pack for '||category AS name, video_id, 0.5e0+discount AS confidence FROM prod), "
       "pw AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(name),'[^a-z0-9\\s-]',' ','g'),'\\s+'), lambda w: length(w)>2 AND w NOT IN ('the','and','for','with','from','pack','set')) AS ws FROM pn), "
       "cg AS (SELECT ws[1] AS first, count(*) AS products, count(DISTINCT video_id) AS videos, avg(confidence) AS ac FROM pw GROUP BY ALL HAVING count(*)>=50 AND count(DISTINCT video_id)>=10), "
       "cw AS (SELECT first, word, f, row_number() OVER (PARTITION BY first ORDER BY f DESC, word) AS rn FROM (SELECT first, word, count(*) AS f FROM (SELECT ws[1] AS first, unnest(ws) AS word FROM pw) GROUP BY ALL) JOIN cg USING (first) WHERE f>=products*0.3e0 QUALIFY rn<=10), "
       "clu AS (SELECT cg.*, (SELECT string_agg(word, ',' ORDER BY rn) FROM cw WHERE cw.first=cg.first) AS kw, (SELECT string_agg(upper(word[1])||word[2:], ' ' ORDER BY rn) FROM cw WHERE cw.first=cg.first AND rn<=3) AS cn FROM cg)")


def clusters(spark, d):
    p = m.products(spark, d).select((F.col("video_id") * 10 + F.col("l_linenumber")).alias("id"), F.concat("name", F.lit(" Pack for "), "category").alias("name"),
                                    "video_id", (F.col("discount") + 0.5).alias("confidence"))
    return mk.clusters(p)


@query("f33_product_clusters", m.with_(m.PROD, CLU) + f"SELECT first, products, videos, {r('ac')} AS avg_confidence, kw AS keywords, cn AS cluster_name, replace(lower(cn),' ','_') AS cluster_key FROM clu")
def f33(spark, d):
    x = clusters(spark, d).withColumn("keywords", F.array_join("keywords", ","))
    return _r6(x.select("first", "products", "videos", "avg_confidence", "keywords", "cluster_name", "cluster_key"), "avg_confidence")


@query("f34_candidate_validation", m.with_(m.PROD, CLU) + f"SELECT first, {r('co')} AS convergence, co>=25 AS validated FROM (SELECT first, least(100,products/40/100*40+videos/800/20*40+20)*least(100,length(first)*12)*least(100,ac*80+20)/10000 AS co FROM clu)")
def f34(spark, d):
    x = clusters(spark, d).withColumn("programs", F.length("first") * 0.6).withColumn("products", F.col("products") / 40).withColumn("videos", F.col("videos") / 800)
    return _r6(mk.three_forces(x).select("first", "convergence", "validated"), "convergence")


@query("f35_candidate_category", "SELECT CASE WHEN contains(n,'plant') THEN 'PLANT' WHEN contains(n,'seed') THEN 'SEEDS' WHEN contains(n,'tool') THEN 'TOOLS' WHEN contains(n,'book') THEN 'BOOKS' ELSE 'OTHER' END AS mapped, count(*) AS n FROM (SELECT lower((" + str(TEXTS) + ")[p_size%8+1]||' '||p_name) AS n FROM part) GROUP BY mapped")
def f35(spark, d):
    n = F.concat_ws(" ", F.element_at(F.lit(TEXTS), (F.col("p_size") % 8 + 1).cast("int")), "p_name")
    return table(spark, d, "part").groupBy(mk.candidate_category(n).alias("mapped")).agg(F.count("*").alias("n"))
