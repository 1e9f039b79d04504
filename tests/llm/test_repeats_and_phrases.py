"""Substring dedup, collocations and the filter audit against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfsight.llm import audit, collocations, debruijn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, size):
    """(doc_id, n_words, n_removed, sha) of each row, by looking at every window of every row."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages(rows):
    """The awkward documents, with copies, passages at every place, overlaps and shared ids."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(200)]
    long = [rng.choice(vocabulary) for _ in range(60)]
    more = []
    for k in range(25):
        lo = rng.randrange(40)
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        more.append((500 + k, " ".join(own + long[lo : lo + rng.randrange(10, 30)] + own[::-1])))
    more += [(520, "another text of this id " + " ".join(long)), (None, " ".join(long)), (900, " ".join(long[:13])),
             (901, " ".join(long[:12])), (902, "x " * 40), (903, "y " + "x " * 30), (904, " ".join(long) + "\t\n" + " ".join(long))]
    return [(r[0], r[1]) for r in rows] + more + [more[0], more[0]]


@pytest.mark.parametrize("size", [13, 4])
def test_substrings_of_earlier_documents_go(spark, passages, size):
    docs = spark.createDataFrame(passages, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeats(docs, size).collect()), key=str)
    assert got == without_repeats(passages, size)
    assert sum(x[2] for x in got) > 500


def test_substrings_of_empty_tables(nothing):
    assert debruijn.remove_repeats(nothing).count() == 0


def test_spans_name_their_source(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = debruijn.keyed(spark.createDataFrame([(1, "a b " + long), (2, long + " z"), (3, "c " + long)], "doc_id long, text string"))
    got = {(r.doc_id, r.lo, r.hi, r.source, r.source_lo) for r in debruijn.repeated_spans(rows, debruijn.text_copies(rows)).collect()}
    assert got == {(2, 0, 18, 1, 2), (3, 1, 19, 1, 2)}


def best_phrases(rows, least, percent, top):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(a for p, a in count.items() if len(p) == 1)
        held = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items()):
                continue
            score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations_of_every_language(spark, rows, top):
    rng = random.Random(9)
    more = []
    for k in range(120):
        words = [rng.choice(["Red", "red", "fish", "ocean\tblue", "tea", "ß", "Ä", "x" * 30, "\x00n"]) for _ in range(rng.randrange(40))]
        more.append((k, " ".join(w + rng.choice(["", "", "", ".", ",", "\n", "!", " "]) for w in words), rng.choice(["en", "de", None, "und"])))
    more += [(300, "a a a a a a a a a a a a a a", "en", ), more[0], more[0]]
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + more, "doc_id long, text string, lang string")
    docs = docs.withColumn("h", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("words", F.lit("clash")).repartition(4)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(docs, top=top).collect())
    want = best_phrases([(r[2], r[1]) for r in rows] + [(x[2], x[1]) for x in more], 10, 50, top)
    assert got == want and len(got) >= 12


def test_collocations_of_empty_tables(nothing):
    assert collocations.collocations(nothing).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 10**13 + 7, 10**13 + 9)], "a long, l long, r long")
    assert row.select(collocations._score("a", "l", "r").alias("s")).first().s == 10**6 * 10**26 // ((10**13 + 7) * (10**13 + 9))


def audited(rows, labels):
    """Every count by walking each document through each order."""
    mark = collections.defaultdict(lambda: [0, 0])
    for d, q, t in labels:
        mark[d][0] |= q == 1
        mark[d][1] |= t == 1
    out = collections.Counter()
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = {s or "" for _, _, s in rows}
    every = list(itertools.permutations("ABCDE"))
    for d, t, s in rows:
        t, part = t or "", s or ""
        w = WORD.findall(t)
        bad = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                          bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])) if x}
        good, toxic = mark[d] if d is not None and d in mark else (0, 0)
        for o in every:
            gone = False
            for step, f in enumerate(o):
                key = (part, "".join(o), step + 1)
                if f in bad:
                    out[key, "redundant"] += gone
                    out[key, "unique_fails"] += len(bad) == 1
                    if not gone:
                        out[key, "removed"] += 1
                        out[key, "good_lost"] += good
                        out[key, "toxic_lost"] += toxic
                        for o2 in every:
                            out[(part, "".join(o2), o2.index(f) + 1), "shapley"] += 1
                        gone = True
                out[key, "kept"] += not gone
    return {(p, "".join(o), k): tuple(out[(p, "".join(o), k), c] for c in audit.COUNTS) for p in parts for o in every for k in range(1, 6)}


def test_filter_audit(spark, rows):
    plain = [(r[0], r[1], r[3]) for r in rows] + [(None, "No id", "src0"), (None, "No id", "src0"), (7000, "No id", None), (7000, "no # id", "src1"),
                                                  (6999, "Much TOO loud " * 90, ""), (7001, "a " * 300, "src1"), (7001, "a " * 300, "src1")]
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (200, 1, 0), (201, 1, 1), (201, 0, 0), (7001, None, 1), (7000, 1, None), (99999, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(plain, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("n", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in audit.audit(docs.repartition(3), marks).collect()}
    assert got == audited(plain, labels)


def test_filter_audit_of_empty_tables(spark, nothing, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(nothing, none).count() == 0
    assert audit.audit(docs, none).where("good_lost > 0 OR toxic_lost > 0").count() == 0
