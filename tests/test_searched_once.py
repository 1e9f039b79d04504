"""Steps that read or shuffle a text once."""

import random

from pyspark.sql import functions as F

from shelfsight.operators import entities as en
from shelfsight.operators import hints as h


def test_contexts_stay_behind_when_candidates_are_shuffled(spark):
    mentions = spark.createDataFrame(
        [(1, 1, 0.0, "rosa", "Rosa and a variety"), (2, 1, 30.0, "rose", "no names"), (3, 2, 0.0, "rosa", None)],
        "mention_id long, video_id long, t double, entity string, context string")
    cands = spark.createDataFrame([("rosa", 1, 0.5), ("rosa", 2, 0.4), ("rose", 1, 0.5)], "entity string, entry_pos long, match_score double")
    entries = spark.createDataFrame([(1, "rosa gallica"), (2, "acer")], "entry_pos long, latin string")
    df = en.score_candidates(mentions, cands, entries)

    def joins(node):
        return [x for c in range(node.children().size()) for x in joins(node.children().apply(c))] + (
            [node] if node.nodeName() == "Join" and "LeftOuter" in node.joinType().toString() else [])
    sides = [j.left().output().toString() for j in joins(df._jdf.queryExecution().optimizedPlan())]
    assert sides and not any("_ctx" in s or "context" in s for s in sides)
    got = {(r.mention_id, r.entry_pos): round(r.score, 6) for r in df.collect()}
    assert got == {(1, 1): 0.6325, (1, 2): 0.4, (2, 1): 0.6, (3, 1): 0.5, (3, 2): 0.4}


def test_processed_texts_are_stored_before_they_are_tested(spark):
    hints = spark.createDataFrame([(1, "rose", "high"), (1, "oak", "high"), (1, "elm", "low"), (2, "rose", "high"), (3, "rose", "high")], "video_id long, term string, priority string")
    processed = spark.createDataFrame([(1, "An OAK"), (2, None)], "video_id long, processed string")
    df = h.lost_hints(hints, processed)
    assert any("/stored-" in f for f in df.inputFiles())
    assert [tuple(r) for r in df.collect()] == [(1, "rose")]


def test_adaptive_keywords_read_stored_hints_and_equal_plain_python(spark):
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = [(v, t, rng.choice(["high", "medium", "medium", "low"]), rng.choice([None, *map(str.upper, names)]), rng.choice(names), None)
            for v in (1, 2, None) for t in rng.sample(names, 18)]
    hints = spark.createDataFrame(rows, "video_id long, term string, priority string, genus string, species string, cultivar string")
    rules = spark.createDataFrame([("AX", ["ax", "Care of AX", None]), ("by", ["bz"])], "pattern string, context_keywords array<string>")
    context = {"ax": ["ax", "care of ax", None], "by": ["bz"]}
    for cap in (0, 14, 100):
        want = set()
        for v in (1, 2, None):
            own = [r for r in rows if r[0] == v]
            high = {x.lower() for r in own if r[2] == "high" for x in (r[1], *r[3:]) if x}
            medium = sorted({r[1] for r in own if r[2] == "medium"} - (high if v else set()))
            keep = medium[: max(0, cap - (len(high) if v else 0))]
            want |= {(v, k) for k in [*high, *keep, *(k for r in own for k in context.get(r[1], []))]}
        df = h.adaptive_keywords(hints, rules, cap)
        assert all("/stored-" in f for f in df.inputFiles()) and df.inputFiles()
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
    assert h.adaptive_keywords(hints.where(F.lit(False)), rules).count() == 0


def test_disambiguation_reads_stored_mentions_and_candidates(spark):
    from shelfsight.plans import catalog
    files = catalog.QUERIES["c10_disambiguation"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/stored-" in f for f in files)
