"""Text pipeline: hand-made cases for every stage and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfsight.functions import text as tx
from shelfsight.operators import preprocess as p
from shelfsight.operators import market as mk
from shelfsight.operators.joins import PIECE, containment_join, gram_counts


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("o")).head().o


def test_fillers_respect_ascii_words(spark):
    r = one(spark, "Um, I like the éum um thing. er", tx.remove_fillers)
    assert r.text == ", I  the éum  thing. " or r.text == ", I  the é  thing. "
    assert r.removed >= 4


def test_sponsor_and_intro(spark):
    r = one(spark, "Good soil. Use code ABC for 10% off! Bye", tx.drop_sponsor_sentences)
    assert (r.text, r.dropped) == ("Good soil.  Bye", 1)
    assert one(spark, "Hi everyone welcome back to my channel. Hi everyone", tx.strip_intro_outro) == ". Hi everyone"


def test_first_match_only(spark):
    assert one(spark, "a until next time b until next time", lambda c: tx.remove_first(c, "until next time")) == "a  b until next time"


def windows_by_hand(text, kws, w, slack=50):
    low = text.lower()
    hits = sorted({i for k in kws for i in range(len(low)) if low.startswith(k, i)})
    if not hits:
        return ""
    spans = []
    for h in hits:
        s, e = max(0, h - w), min(len(text), h + w)
        if spans and s <= spans[-1][1] + slack:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    out = " ... ".join(text[s:e].strip() for s, e in spans)
    return text if len(out) > len(text) else out


@pytest.mark.parametrize("seed", range(4))
def test_context_windows_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["rose", "rosemary", "banana", "x", "lorem", "ipsum", "dolor", "Rose", "anana"]
    rows = [(i, " ".join(rng.choice(words[2:7] if rng.random() < 0.93 else words) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(100, ""), (101, "rose"), (102, "x" * 300 + "rose"), (103, "rose" + "y" * 500 + "rosemary"), (104, "   ")]
    kws = ["rose", "rosemary", "ana"]
    df = spark.createDataFrame(rows, "id int, text string").select("id", tx.context_windows(F.col("text"), kws, 20).alias("o"))
    got = {r.id: r.o for r in df.collect()}
    assert got == {i: windows_by_hand(t, kws, 20) for i, t in rows}


def test_context_windows_of_hits_that_lie_apart(spark):
    # anana at 0 overlaps itself at 2; kayak at 33 ends where kayak at 37 begins.
    texts = ["ananana" + "x" * 60 + "anana", "x" * 30 + "zz kayakayak " + "y" * 50, "rose", ""]
    kws = ["anana", "kayak", "rose"]

    def apart(text, w, slack=50):
        hits = sorted({x.start() for k in kws for x in re.finditer(k, text)})
        spans = []
        for h in hits:
            s, e = max(0, h - w), min(len(text), h + w)
            if spans and s <= spans[-1][1] + slack:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        out = " ... ".join(text[s:e].strip() for s, e in spans)
        return text if len(out) > len(text) else out
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.o for r in df.select(tx.context_windows(F.col("text"), kws, 5, overlapping=False).alias("o")).collect()]
    assert got == [apart(t, 5) for t in texts]
    full = [r.o for r in df.select(tx.context_windows(F.col("text"), kws, 5).alias("o")).collect()]
    assert full == [windows_by_hand(t, kws, 5) for t in texts] and full != got
    docs = spark.createDataFrame([(1, "The kayakayak " + "y" * 50)], "video_id long, text string")
    two = [p.preprocess(docs, kws, p.Options(window=5, overlapping=o)).head().processed for o in (True, False)]
    assert two[0] != two[1]


def test_keywords_found_keeps_the_beginnings_of_longer_ones(spark):
    kws = ["rosemary", "mary", "rose", "two words", "ros", "aa", "aaa", "z"]
    for text in ("a ROSEMARY bush", "roses", "aaaa", "two words", "", "\nrose\nz"):
        assert one(spark, text, lambda c: tx.keywords_found(c, kws)) == [k for k in kws if " " not in k and k in text.lower()]
    assert one(spark, "x", lambda c: tx.keywords_found(c, [])) == []


def test_dedupe_limit_and_idempotence(spark):
    r = one(spark, "a ... b ...  ... a... c", tx.dedupe_pieces)
    assert (r.text, r.repeats) == ("a ... b ... c", 1)
    assert one(spark, r.text, tx.dedupe_pieces).text == r.text
    assert one(spark, "abcdef", lambda c: tx.limit_length(c, 3)) == "abc..."


def test_preprocess_metrics_and_gate(spark):
    docs = spark.createDataFrame([(1, "Um the rose grows. Nothing here. Plant the rose again."), (2, ""), (3, " \n ")], "video_id long, text string")
    full = {r.video_id: r for r in p.preprocess(docs).collect()}
    assert [s.stage for s in full[1].stages] == [1, 2, 3, 4, 5, 6]
    assert full[1].sentences_removed == 1 and "Nothing" not in full[1].processed
    assert full[2].processed == "" and full[2].reduction_pct == 0.0
    lenient = p.preprocess(docs, [], p.Options(aggressiveness=0.1)).head()
    assert [s.stage for s in lenient.stages] == [1, 5, 6]


def test_partitioning_does_not_change_results(spark):
    docs = spark.createDataFrame([(i, f"Rose {i % 5} in soil. Filler text {i}. um") for i in range(60)], "video_id long, text string")
    outs = [sorted(map(tuple, p.preprocess(docs.repartition(n)).select("video_id", "processed").collect())) for n in (1, 7, 16)]
    assert outs[0] == outs[1] == outs[2]


def meets(docs, terms):
    return sorted((i, t, k) for i, x in docs for t, k in terms if t and x and t in x)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_containment_join(spark, bits):
    """Repeated ids and rows, short and null texts, repeated, empty and null terms: equal multisets."""
    rng = random.Random(5)
    docs = [(i % 20, "".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 2, 3, 30])))) for i in range(60)]
    docs += docs[:5] + [(1, None), (1, ""), (2, "abcabc"), (3, "a😀b😀😀c\n😀ab")]
    terms = [("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))), i % 3) for i in range(40)]
    terms += terms[:3] + [("", 1), (None, 2), ("abc", 0), ("abc", 1), ("😀", 0), ("b😀😀c", 1), ("c\n😀ab", 2)]
    d = spark.createDataFrame(docs, "id long, text string")
    t = spark.createDataFrame(terms, "term string, kind long")
    got = sorted(map(tuple, containment_join(d, t, "text", "term", bits=bits).collect()))
    assert got == meets(docs, terms)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_containment_join_of_words_searches_no_text_by_characters(spark, bits):
    """Terms of letters alone: within longer words, in either case, several words of a text holding one term, equal rows, nulls."""
    rng = random.Random(8)
    docs = [(i % 9, "".join(rng.choice("abC é1-😀\n") for _ in range(rng.choice([0, 1, 5, 80]))), f"w{i % 2}") for i in range(50)]
    docs += docs[:6] + [(None, "abcab xab", "n"), (None, "abcab xab", "n"), (1, None, "n"), (1, "", "n"), (2, "ab" * PIECE + "C", "n")]
    terms = [("".join(rng.choice("abC") for _ in range(rng.randint(1, 4))), i % 3) for i in range(20)]
    terms += terms[:3] + [("", 1), (None, 2), ("bab" * PIECE, 0), ("ab" * PIECE + "C", 0)]
    d = spark.createDataFrame(docs, "id long, text string, wide string")
    t = spark.createDataFrame(terms, "term string, kind long")
    hit = containment_join(d, t, "text", "term", keep=["id"], carry=["wide"], bits=bits)
    order = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    want = [(i, w, a, k) for i, x, w in docs for a, k in terms if a and x and a in x]
    assert order(hit.collect()) == order(want) and want
    assert order(containment_join(d, t, "text", "term", keep=[], bits=bits).collect()) == order(r[2:] for r in want)
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert "_body" not in plan and "_run" in plan


def test_containment_join_over_block_ends(spark):
    """Terms across the ends of blocks, longer than a block, at the very end, and repeated in a long text."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcd😀 ") for _ in range(3 * PIECE + 17))
    docs = [(1, long), (1, long), (2, long[: PIECE]), (3, long[PIECE - 3:]), (4, "xyzzy " * 400)]
    terms = [(long[i:i + n], n) for n in (2, 4, 5, 40, PIECE, PIECE + 9, 2 * PIECE + 1) for i in
             (0, PIECE - n // 2, PIECE - 1, PIECE, 2 * PIECE - 3, len(long) - n) if 0 <= i <= len(long) - n]
    terms += [("xyzzy", 0), ("zy xy", 0), ("nowhere", 0)]
    d = spark.createDataFrame(docs, "id long, text string")
    t = spark.createDataFrame(terms, "term string, kind long")
    assert sorted(map(tuple, containment_join(d, t, "text", "term").collect())) == meets(docs, terms)


def test_containment_join_of_empty_tables_and_stored_counts(spark):
    d = spark.createDataFrame([(1, "garden soil")], "id long, text string")
    t = spark.createDataFrame([("soil", 0)], "term string, kind long")
    assert containment_join(d.where("id > 1"), t, "text", "term").count() == 0
    assert containment_join(d, t.where("kind > 1"), "text", "term").count() == 0
    counts = gram_counts(d.where("id > 1"), "text")
    assert [tuple(x) for x in containment_join(d, t, "text", "term", counts=counts).collect()] == [(1, "soil", 0)]


def test_containment_join_carries_wide_columns_and_equal_rows(spark):
    docs = spark.createDataFrame([(1, "rose rose oak", "x"), (1, "rose rose oak", "x"), (1, "rose", "y"), (None, "oak", "z"), (None, "oak", "z"), (2, None, "w")],
                                 "id long, text string, wide string")
    terms = spark.createDataFrame([("rose", 1), ("rose", 1), ("oak", 2)], "term string, k long")
    hit = containment_join(docs, terms, "text", "term", keep=["id"], carry=["wide"])
    got = sorted(tuple(str(x) for x in r) for r in hit.collect())
    want = sorted(tuple(map(str, (i, w, t, k))) for i, x, w in docs.collect() if x for t, k in map(tuple, terms.collect()) if t in x)
    assert got == want
    # What nothing reads is not taken through the search.
    plan = hit.select("id", "term")._jdf.queryExecution().optimizedPlan().toString()
    assert "first(wide" not in plan and "Aggregate [_id" in plan


def test_affinity_sample_and_confidence(spark):
    """The sum of video, commerce and creator overlaps; missing ones count 0, confidence stops at 1."""
    c = spark.createDataFrame([("a", None), ("b", "a"), ("c", None)], "category string, parent string")

    def part(name, rows):
        return spark.createDataFrame(rows, f"a string, b string, {name} double")
    got = mk.affinity(c, video=part("video", [("a", "b", 60.0), ("a", "c", 10.25)]), commerce=part("commerce", [("a", "b", 70.0)]),
                      creator=part("creator", [("a", "c", 0.25)]), audience=part("audience", [("b", "c", 90.0)]))
    assert {(r.a, r.b): (r.sample_size, r.confidence) for r in got.collect()} == {
        ("a", "b"): (130, 1.0), ("a", "c"): (11, 0.105), ("b", "c"): (0, 0.0)}


def test_alternation_prefers_the_longest():
    terms = ["rose", "rosemary", "ros", "tea rose", "a.b", "a"]
    pattern = re.compile(tx.alternation(terms))
    assert [m[0] for m in pattern.finditer("rosemary rose ros tea rose a.b axb")] == ["rosemary", "rose", "ros", "tea rose", "a.b", "a"]


def test_clock_and_slug(spark):
    assert one(spark, "3725", lambda c: tx.clock(c.cast("double"))) == "01:02:05"
    assert one(spark, "65", lambda c: tx.clock(c.cast("double"))) == "01:05"
    assert one(spark, "1:02:05", tx.clock_seconds) == 3725
    assert one(spark, " Raised Bed_Kits! ", tx.slugify) == "raised-bed-kits"
    assert re.fullmatch("[a-z ]+", one(spark, "Lavandula  'Hidcote'", tx.normalise_name))
