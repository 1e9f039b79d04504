"""Filter interaction audit by min-plus removal ranks.

Filters that run in some order remove a document at the first step whose filter it fails. With a
mask matrix (0 where a row fails a filter, infinite elsewhere) and the inverse permutations of all
orders (the place of each filter in each order), that step is their min-plus product. Rows that
fail the same filters are counted together first, so the product works on the distinct masks of a
part, and weighted scatter counts over the steps give what every step removes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import own_columns

FILTERS = "ABCDE"
NEVER = 99
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
CHUNK = 512
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: str | None) -> int:
    """Bits 0 to 3: whether a text fails A (under 200 words), B (fewer than half of the words distinct),
    C (over 2 % capitals) and D (holds one of `_SYMBOLS`)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    return ((n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * len(text or "")) << 2
            | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            found = pa.array([text_failures(t.as_py()) for t in part["text"]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].cast(pa.int64()), part["part"], part["digest"], found], names=["doc_id", "part", "digest", "mask"])


def orders(n: int) -> np.ndarray:
    """All orders of n filters, sorted: one row of filter numbers each."""
    return np.array(list(permutations(range(n))), dtype=np.int64)


def removal_steps(masks: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The step (from 0) at which each mask is removed in each order, NEVER where it fails nothing.

    The min-plus product of the masks' 0-or-NEVER matrix with the inverse permutations.
    """
    n = every.shape[1]
    cost = np.where(masks[:, None] >> np.arange(n) & 1, 0, NEVER)
    place = np.argsort(every, axis=1)  # the inverse of each permutation
    return np.minimum((cost[:, :, None] + place.T[None]).min(axis=1), NEVER)


def _interactions(names: Sequence[str]):
    n = len(names)

    def run(table: pa.Table) -> pa.Table:
        every = orders(n)
        masks, weight = table["mask"].to_numpy(), {k: table[k].to_numpy() for k in ("n", "good", "toxic")}
        step = removal_steps(masks, every)
        at = np.broadcast_to(np.arange(len(every)), step.shape)
        gone = step < NEVER

        def scatter(w: np.ndarray) -> np.ndarray:
            out = np.zeros((len(every), n), dtype=np.int64)
            np.add.at(out, (at[gone], step[gone]), np.broadcast_to(w[:, None], step.shape)[gone])
            return out

        removed = scatter(weight["n"])
        fails = (masks[:, None] >> np.arange(n) & 1).astype(bool)
        in_order = fails[:, every]  # mask, order, step: whether the step's filter fails
        redundant = ((in_order & (step[:, :, None] < np.arange(n))) * weight["n"][:, None, None]).sum(axis=0)
        alone = np.array([weight["n"][masks == 1 << f].sum() for f in range(n)], dtype=np.int64)
        shapley = np.zeros(n, dtype=np.int64)
        np.add.at(shapley, every, removed)
        columns = {
            "kept": weight["n"].sum() - removed.cumsum(axis=1), "removed": removed, "redundant": redundant,
            "unique_fails": alone[every], "good_lost": scatter(weight["good"]), "toxic_lost": scatter(weight["toxic"]),
            "shapley": shapley[every]}
        rows = every.size
        return pa.table({
            "part": pa.array([table["part"][0].as_py()] * rows, pa.string()),
            "filter_order": pa.array(np.repeat(["".join(names[f] for f in o) for o in every], n)),
            "step": pa.array(np.tile(np.arange(1, n + 1), len(every)), pa.int32()),
            **{c: pa.array(columns[c].ravel().astype(np.int64)) for c in COUNTS}})
    return run


def interactions(failures: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    failures has (part, mask, n, good, toxic): how many documents of a part fail the filters whose
    bits are set, and how many of them are good and toxic. One row comes out for each part, order of
    the filters and step. `names` gives each bit's one-letter name; filters are few, as all their
    orders are listed. An empty table gives no rows.
    """
    rows = failures.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])
    return rows.groupBy("part").applyInArrow(
        _interactions(names), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of documents (doc_id, text, source) and labels (doc_id, quality, toxic).

    Bits 0 to 3 as in `text_failures`; bit 4, E: the text is identical to that of any smaller doc_id.
    A null text is empty, and equal to an empty one; a null source is the part ''. Rows without a
    doc_id never fail E, make no other fail it and carry no label. Rows that repeat an id count one by one; of one
    id's label rows, any 1 counts. Other columns are not read.
    """
    docs, labels = own_columns(docs, ["doc_id", "text", "source"]), own_columns(labels, ["doc_id", "quality", "toxic"])
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    masks = named.mapInArrow(_masks, "doc_id long, part string, digest binary, mask int")
    rows = masks.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left").select(
        "doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    # Copies are counted together with the first of their kind before they meet by text.
    kinds = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("lead"))
    least = kinds.groupBy(F.col("digest").alias("of")).agg(F.min("lead.doc_id").alias("least"))
    met = kinds.join(least, F.col("digest") == F.col("of"))
    new = F.col("nameless") + F.when(F.col("lead.doc_id") == F.col("least"), F.col("lead.n")).otherwise(0)
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), new.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - new).alias("n"))))
    each = met.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "x.n", "good", "toxic").where("n > 0")
    return each.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over documents; empty tables give no rows. See the steps above."""
    return interactions(document_failures(docs, labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
lead_ AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
    100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 2 * length(w.t) AS fc,
    regexp_matches(w.t, '[#$%&*|]') AS fd, coalesce(w.doc_id > least, false) AS fe
    FROM w JOIN lead_ USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id),
kind AS (SELECT part, [fa, fb, fc, fd, fe] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
r AS (SELECT part, o, n, good, toxic, fails, list_position(list_transform(o, lambda x: fails[x]), true) AS gone FROM kind, o),
s AS (SELECT part, o, l.k AS step, sum(n) FILTER (WHERE gone IS NULL OR gone > l.k) AS kept,
    sum(n) FILTER (WHERE gone = l.k) AS removed, sum(n) FILTER (WHERE fails[o[l.k]] AND gone < l.k) AS redundant,
    sum(n) FILTER (WHERE fails[o[l.k]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (WHERE gone = l.k) AS good_lost, sum(toxic) FILTER (WHERE gone = l.k) AS toxic_lost
    FROM r, l GROUP BY part, o, l.k)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
    CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM s"""
