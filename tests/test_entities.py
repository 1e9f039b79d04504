"""Resolution confidences, similarity, disambiguation helpers and sweep joins."""

import random
from collections import Counter

from pyspark.sql import functions as F

from shelfsight.functions.similarity import jaro
from shelfsight.operators import entities as en

ROWS = [
    (1, "Lavandula angustifolia", "Lavandula", "angustifolia", "Hidcote", ["English lavender", "Lavender"], ["Lavandula vera"], ["Blue Cushion"], 20, 0.1),
    (2, "Solanum lycopersicum", "Solanum", "lycopersicum", None, ["Tomato"], ["Lycopersicon esculentum"], [], 30, 0.0),
    (3, "Rosa", "Rosa", None, None, ["Rose", "Lavender"], [], [], 2, 0.8),
]
SCHEMA = ("entry_pos long, latin string, genus string, species string, variety string, common array<string>, "
          "synonyms array<string>, trade array<string>, usage_count long, ambiguity double")


def dic(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_cascade_confidences(spark):
    q = ["Lavandula angustifolia", " TOMATO ", "Lavandula vera", "hidcote", "blue cushion!", "lavendr english", "nothing like it"]
    r = {x.query: x for x in en.resolve(spark.createDataFrame([(x,) for x in q], "query string"), dic(spark)).collect()}
    assert (r[q[0]].confidence, r[q[0]].match_type) == (1.0, "exact")
    assert r[q[1]].confidence == 0.95 and r[q[2]].confidence == 0.9
    assert r[q[3]].confidence == 0.88 and r[q[4]].confidence == 0.85
    assert r[q[6]].match_type == "none" and r[q[6]].confidence == 0.0


def test_alias_clash_goes_to_first_entry(spark):
    n = spark.createDataFrame([("Lavender",)], "name string")
    assert en.lookup(n, dic(spark)).head().entry_pos == 1


def test_jaro_values():
    assert abs(jaro("martha", "marhta") - 0.944444) < 1e-5
    assert jaro("", "a") == 0.0 and jaro("abc", "abc") == 1.0


def test_fuzzy_blocking_equals_all_pairs(spark):
    rng = random.Random(3)
    words = ["rosa", "rose", "alba", "albus", "canina", "lavender", "lavander", "blue"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(40)})
    d = spark.createDataFrame([(i, n, None, None, None, [], [], [], 1, 0.0) for i, n in enumerate(names)], SCHEMA)
    q = spark.createDataFrame([(n + "s", n + "s") for n in names], "query string, norm string")
    for threshold in (0.8, 0.7):
        got = {(r.query, r.entry_pos) for r in en.fuzzy_candidates(q, d, threshold).collect()}
        pairs = q.crossJoin(d.select("entry_pos", F.col("latin").alias("b")))
        from shelfsight.functions import similarity as sim
        a, b = F.col("norm"), F.col("b")
        s = F.when(a == b, 1.0).when(sim.contained_as_words(a, b), sim.contained_score(a, b)).otherwise(
            sim.word_overlap(a, b) * 0.2 + sim.edit_ratio(a, b) * 0.5 + sim.jaro_winkler(a, b) * 0.3)
        want = {(r.query, r.entry_pos) for r in pairs.withColumn("s", s).where(F.col("s") >= threshold).collect()}
        assert got == want


def test_nearby_and_co_occurrence_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, v, float(rng.randint(0, 9000)), rng.choice("abcd"), None, rng.random() < 0.5)
            for i, v in enumerate(rng.choice([1, 1, 1, 2]) for _ in range(120))]
    df = spark.createDataFrame(rows, "mention_id long, video_id long, t double, entity string, latin string, in_dictionary boolean")
    got = {(r.mention_id, r.nearby) for r in en.nearby_entities(df).collect()}
    assert got == {(a[0], b[3]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 60}
    co = {(r.video_id, r.key): r.co_occurrences for r in en.co_occurrence(df).collect()}
    times = {}
    for _, v, t, e, _, _ in rows:
        times.setdefault((v, e), set()).add(t)
    want = {(v, e): sum(any(abs(t - o) <= 60 for o in ts2) for t in ts for (v2, e2), ts2 in times.items() if v2 == v and e2 != e) for (v, e), ts in times.items()}
    assert co == want


def test_co_occurrence_counts_mentions_at_one_second(spark):
    rows = [(1, 1, "rose", 30.0, True), (2, 1, "rose", 30.0, True), (3, 1, "mint", 60.0, False), (4, 1, "fern", 500.0, True)]
    m = spark.createDataFrame(rows, "mention_id long, video_id long, entity string, t double, in_dictionary boolean")
    got = {r.key: (r.co_occurrences, r.with_known) for r in en.co_occurrence(m.withColumn("latin", F.lit(None).cast("string"))).collect()}
    assert got == {"rose": (2, False), "mint": (1, True), "fern": (0, False)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_ratio_join_agrees_with_all_pairs(spark):
    from shelfsight.operators.joins import edit_ratio_join
    rng = random.Random(7)
    made = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))) for _ in range(90)]
    made += ["aaaaaaaaaa", "aaaaaab", "baaaaaa", "abababab", "babababa", "x", "xy", "\U0001f339 rose", "rose \U0001f339"]
    left, right = made[::2] + ["", None, made[0]], made[1::2] + made[:20] + ["", None]
    a = spark.createDataFrame([(x, 1) for x in left], "name string, _key int")
    b = spark.createDataFrame([(x, 2) for x in right], "target string, _salt int")
    for ratio in (0.5, 0.6, 0.75, 1.0):
        want = {(x, y) for x in left if x for y in right if y if _edits(x, y) <= max(len(x), len(y)) * (1 - ratio) + 1e-9}
        got = [tuple(r) for r in edit_ratio_join(a, b, "name", "target", ratio, rows=5).collect()]
        assert sorted(got) == sorted(want)
    assert edit_ratio_join(a.limit(0), b, "name", "target", 0.6).count() == 0


def test_signatures_reject_most_pairs_and_no_near_one(spark):
    from shelfsight.operators import joins
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(40)]
    near = [w[:3] + "x" + w[4:] for w in words]
    a, b = (joins._signed(spark.createDataFrame([(w,) for w in x], "_s string"), "_s", n) for x, n in ((words, "_a"), (near, "_b")))
    got = a.crossJoin(b).select("_a", "_b", *[joins._lacking("_a", "_b", k).alias(f"l{k}") for k in (1, 2)]).collect()
    assert len(got) == 1600
    for r in got:
        for k, lacking in ((1, r.l1), (2, r.l2)):
            x, y = ("\1" * (k - 1) + s + "\1" * (k - 1) for s in (r._a, r._b))
            left = Counter(x[i : i + k] for i in range(len(x) - k + 1)) - Counter(y[i : i + k] for i in range(len(y) - k + 1))
            assert lacking <= sum(left.values())
    # Of unrelated pairs, next to none may reach the full comparison.
    assert sum(r.l2 <= 2 * 12 * 0.4 for r in got) < 80


def test_salted_join_splits_a_hot_key_and_keeps_repeats(spark):
    from shelfsight.operators.joins import salted_join
    left = spark.createDataFrame([("hot", 1), ("hot", 1), ("cold", 2), (None, 3)], "k string, l int")
    right = spark.createDataFrame([("hot", i % 7) for i in range(40)] + [("cold", 9), (None, 9)], "k string, r int")
    got, want = salted_join(left, right, "k", rows=3), left.join(right, "k")
    assert sorted(got.collect()) == sorted(want.collect())


def test_nearby_entities_with_shared_mention_ids(spark):
    # rose and oak share id 7, ten seconds apart: no others to each other, but ash is to both.
    rows = [(7, 1, 0.0, "rose"), (7, 1, 10.0, "oak"), (8, 1, 20.0, "ash"), (9, 2, 0.0, "rose"), (9, 2, 30.0, "oak"), (10, 2, 80.0, "rose")]
    df = spark.createDataFrame(rows, "mention_id long, video_id long, t double, entity string")
    got = sorted((r.mention_id, r.entity, r.nearby) for r in en.nearby_entities(df).collect())
    want = {(a[0], a[3], b[3]) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0] and abs(a[2] - b[2]) <= 60}
    assert got == sorted(want)


def test_disambiguation_searches_the_segments_once(spark):
    from shelfsight.plans import catalog
    df = catalog.QUERIES["c10_disambiguation"](spark, "/root/testdata/sf0.001")
    indexes = {p for f in df.inputFiles() for p in f.split("/") if p.startswith("substring-index-")}
    assert len(indexes) == 2  # mentions and candidates


def test_hinted_categories_equal_the_search_of_joined_hints(spark):
    from shelfsight.operators import hints as h
    hints = spark.createDataFrame([(1, t) for t in ("rosemary", "oak tree", "elm", "elm")] + [(2, "rose"), (2, "oak"), (3, "elm oak")], "video_id long, term string")
    terms = spark.createDataFrame([("rose", "a"), ("mary", "a"), ("oak", "a"), ("tree", "b"), ("elm oak", "b"), ("tree rosemary", "b"), ("elm", "b"), ("elm", "c")], "term string, category string")
    joined = hints.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("text"))
    got = sorted(map(tuple, h.hinted_categories(hints, terms, 1).select("video_id", "category", "n").collect()))
    assert got == sorted(map(tuple, h.detect_categories(joined, terms, 1).select("video_id", "category", "n").collect()))
    assert (1, "b", 4) in got


def test_mentions_are_searched_once_for_calibration_and_co_occurrence(spark):
    from shelfsight.plans import catalog
    for name in ("c13_calibration", "c16_co_occurrence"):
        files = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and all("/stored-" in f for f in files)


def test_single_topic_of_mentions_that_share_an_id(spark, tmp_path):
    """Turn 0 with the word of rank 1000 + i and turn 1 with that of rank i share an id: the commoner word, whatever comes first."""
    from shelfsight.plans import catalog
    words = sorted(f"{a}{b}{c}qqqq" for a in "bcdfghjklm" for b in "bcdfghjklm" for c in "bcdfghjklmn")
    spark.createDataFrame([(" ".join(words),)], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [x for i in range(40) for x in ((i, 0, "user", words[1000 + i]), (i, 1, "assistant", words[i]))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [x.topic for x in catalog.QUERIES["e17_single_topics"](spark, str(tmp_path)).collect()]
    assert sorted(got) == words[:40]
