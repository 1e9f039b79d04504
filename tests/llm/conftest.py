"""Small documents with every awkward case: nulls, empties, repeats, ties, long texts, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = []
    for i in range(40):
        out.append((i, prose(rng, rng.randint(3, 120), vocabulary), rng.choice(["en", "fr"]), f"src{i % 4}", 0))
    base = out[0][1] + " " + out[1][1]
    words = base.split()
    for k in range(12):  # near copies of one text, each with one word changed, and a chain away from it
        changed = list(words)
        changed[(k * 7) % len(words)] = f"new{k}"
        out.append((100 + k, " ".join(changed), "en", "src0", 0))
    for k in range(6):
        out.append((200 + k, base, "en", f"src{k}", 0))
    out += [(300, None, None, None, None), (301, "", "", "", 0), (302, " \n\t ", "en", "src1", 0), (303, "Solo", "en", "src1", 0),
            (304, "solo", "en", "src2", 0), (305, "two words", None, "src2", 0), (306, "Ünï çode 😀 text's  don't\r\n\x0b x", "en", None, 0),
            (307, "ab " * 4000, "en", "src0", 0), (308, "a" * 3000, "en", "src0", 0)]
    out += [out[3], out[3]]  # repeated rows
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("rep", "key", "digest", "tk", "h", "score", "node", "block", "slot", "judged", "w", "size"):
        d = d.withColumn(c, F.lit("clash"))
    return d.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
