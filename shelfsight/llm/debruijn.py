"""Substring dedup on a De Bruijn graph of word k-mers.

A window of k consecutive words is an edge from the node of its first k - 1 words to the node of
its last. Only edges of two documents or more matter. Windows that may be such are found by their
minimizer, the least hash of the shorter runs of words inside: equal windows have equal ones, so a
window whose minimizer stays in one document is left out before any edge is shuffled. Repeated
edges carry their source coordinate, the smallest doc_id and a place that hold them. Joined to these,
the edges of later documents that go on with their source, edge by edge, are one path without
branches: they are compacted into a span of the document, held against the span of the source.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import bit_filter, own_columns, passes, saved, shared_folder

SEED = 7  # words of the runs whose least hash is a window's minimizer
CHUNK = 512  # documents handled at a time
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_Q1, _Q2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray, p: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * p
    return x ^ (x >> np.uint64(29))


def run_hash(h: np.ndarray, at: np.ndarray, size: int, p: np.uint64 = _P1, q: np.uint64 = _P2) -> np.ndarray:
    """Hashes of the runs of `size` words that start at the places given."""
    out = np.full(len(at), np.uint64(size))
    for k in range(size):
        out = _mix(out * p ^ h[at + k], q)
    return out


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of some texts in a row, each word's text, and each text's first place."""
    rows = [words_of(t.as_py()) for t in texts]
    size = np.array([len(r) for r in rows], dtype=np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for r in rows for w in r), dtype=np.uint64, count=int(size.sum()))
    return h, np.repeat(np.arange(len(rows)), size), np.concatenate(([0], np.cumsum(size)))[:-1]


def _windows(h: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that stay inside a text, with their minimizers."""
    last = len(h) - size + 1
    if last <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    seed = min(SEED, size)
    runs = run_hash(h, np.arange(len(h) - seed + 1), seed)
    least = np.lib.stride_tricks.sliding_window_view(runs, size - seed + 1).min(axis=1)
    at = np.flatnonzero(of[:last] == of[size - 1:])
    return at, least[at]


def _unique_rows(batch: pa.RecordBatch, copied: np.ndarray | None) -> pa.RecordBatch:
    """Without the rows whose text may have copies; those come apart, one of each."""
    if copied is None:
        return batch
    return batch.filter(pa.array(~passes(copied, batch["x"].to_numpy().view(np.uint64))))


def _seeds(size: int, copied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = _unique_rows(whole, copied and copied.value)
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                h, of, _ = _joined(part["text"])
                at, least = _windows(h, of, size)
                # The same minimizer serves neighbouring windows: one row for each run of them.
                new = np.ones(len(at), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (of[at[1:]] != of[at[:-1]])
                ids = part["doc_id"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[new].view(np.int64)), pa.array(ids[of[at[new]]], pa.int64())], names=["seed", "doc_id"])
    return run


def _edges(size: int, repeated, copied):
    """Windows whose minimizer two documents share: a key of 96 bits and its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = _unique_rows(whole, copied and copied.value)
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                h, of, first = _joined(part["text"])
                at, least = _windows(h, of, size)
                at = at[passes(repeated.value, least)]
                ids, x = part["doc_id"].to_numpy(), part["x"].to_numpy().astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_hash(h, at, size).view(np.int64)), pa.array(run_hash(h, at, size, _Q1, _Q2).astype(np.uint32).view(np.int32)),
                     pa.array(ids[of[at]], pa.int64()), pa.array(x[of[at]]), pa.array((at - first[of[at]]).astype(np.int32))],
                    names=["a", "b", "doc_id", "variant", "at"])
    return run


def _suspect(copied):
    """The rows that `_unique_rows` leaves out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(copied.value, batch["x"].to_numpy().view(np.uint64))))
    return run


def _stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/debruijn-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest, x): a row's text has a digest and a 64-bit hash for filters."""
    text = F.coalesce("text", F.lit(""))
    return own_columns(docs, ["doc_id", "text"]).select(
        "doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.xxhash64(text).alias("x"))


def text_copies(rows: DataFrame) -> DataFrame:
    """(digest, x, rep): texts of several rows with a doc_id, and the smallest of these."""
    return saved(rows.where("doc_id IS NOT NULL").groupBy("digest", "x").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))


def _islands(places: Column) -> Column:
    """Runs of consecutive numbers of a sorted array as (lo, hi) with hi exclusive."""
    lo = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    hi = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1))
    return F.zip_with(lo, hi, lambda x, y: F.struct(x.alias("lo"), (y + 1).alias("hi")))


def repeated_spans(rows: DataFrame, copies: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, variant, lo, hi, source, source_lo): runs of windows that start in an earlier document too.

    rows come from `keyed`, copies from `text_copies`; variant is the text's part of the row's key. lo and
    hi count windows by their first word, hi exclusive; `source` is the smallest doc_id that holds the same
    windows, from its word `source_lo` on. Of rows with one text only those of the smallest doc_id take
    part, once for each.
    """
    spark = rows.sparkSession
    rows = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "digest", "x")
    copied = spark.sparkContext.broadcast(bit_filter(copies, "x"))
    some = rows.mapInArrow(_suspect(copied), "doc_id long, text string, digest binary, x long")
    # Texts that only share a bit with copied ones are as good as unique.
    apart = some.join(copies.select("digest", "rep"), "digest", "left").where("rep IS NULL OR rep = doc_id")
    apart = _stored(apart.dropDuplicates(["doc_id", "digest"]).select("doc_id", "text", "x"))
    rows = rows.select("doc_id", "text", "x")

    def over_texts(make, schema: str) -> DataFrame:
        return rows.mapInArrow(make(copied), schema).unionAll(apart.mapInArrow(make(None), schema))

    seeds = over_texts(lambda c: _seeds(size, c), "seed long, doc_id long").groupBy("seed") \
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    repeated = spark.sparkContext.broadcast(bit_filter(_stored(seeds), "seed"))
    found = over_texts(lambda c: _edges(size, repeated, c), "a long, b int, doc_id long, variant int, at int")
    edges = found.groupBy("a", "b").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("source_at")) \
        .where("source < last").drop("last")
    edges = _stored(edges)  # so that the join below reads two shuffles, whose hot partitions can be split
    later = found.join(edges, ["a", "b"]).where("doc_id > source")
    # Edges that go on with their source stand at one shift against it.
    shift = F.col("at") - F.col("source_at")
    along = later.groupBy("doc_id", "variant", "source", shift.alias("shift")).agg(F.array_sort(F.collect_list("at")).alias("places"))
    spans = along.select("doc_id", "variant", "source", "shift", F.explode(_islands(F.col("places"))).alias("s"))
    return spans.select("doc_id", "variant", "s.lo", "s.hi", "source", (F.col("s.lo") - F.col("shift")).alias("source_lo"))


def _remaining(size: int):
    """What is left of texts without the words inside their spans of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sha = [], []
            for text, spans in zip(batch["text"], batch["spans"]):
                w = words_of(text.as_py())
                keep = np.ones(len(w), dtype=bool)
                for s in spans.as_py() or ():
                    keep[s["lo"] : s["hi"] + size - 1] = False
                gone.append(len(w) - int(keep.sum()))
                sha.append(hashlib.sha256(b" ".join([x for x, k in zip(w, keep.tolist()) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["variant"], pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "variant", "gone", "sha"])
    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [words_of(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["digest"], batch["variant"], pa.array([len(w) for w in rows], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in rows], pa.string())], names=["doc_id", "digest", "variant", "n_words", "sha"])


def _marked(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted.value, batch["k"].to_numpy().view(np.uint64)))).select(["doc_id", "text", "variant"])
    return run


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of documents (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word is removed if it stands in a window of `size` words
    that also starts in a document with a smaller doc_id; windows are judged on the input. kept_sha256
    is over the words left, joined by one space. Texts with fewer words, null and empty ones lose nothing.
    Rows without a doc_id lose nothing and take nothing from others. Rows that repeat a doc_id and text
    all get the same answer; two texts of one doc_id are judged apart and never against each other. An
    empty table gives no rows; other columns are not read. Windows are compared as 96-bit hashes.
    """
    rows = keyed(docs)
    spark = docs.sparkSession
    copies = text_copies(rows)
    spans = _stored(repeated_spans(rows, copies, size).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    key = F.xxhash64("doc_id", "variant").alias("k")
    wanted = spark.sparkContext.broadcast(bit_filter(spans.select(key), "k"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "digest", F.col("x").bitwiseAND(0xFFFFFFFF).alias("low")) \
        .select("doc_id", "text", "digest", F.when(F.col("low") >= 1 << 31, F.col("low") - (1 << 32)).otherwise(F.col("low")).cast("int").alias("variant"))
    texts = rows.where("doc_id IS NOT NULL").select("doc_id", "text", "variant", key).mapInArrow(_marked(wanted), "doc_id long, text string, variant int")
    partly = texts.join(spans, ["doc_id", "variant"]).mapInArrow(_remaining(size), "doc_id long, variant int, gone long, sha string") \
        .dropDuplicates(["doc_id", "variant"])
    every = rows.mapInArrow(_whole, "doc_id long, digest binary, variant int, n_words long, sha string")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = every.join(copies.select("digest", "rep"), "digest", "left") \
        .join(partly.select("doc_id", "variant", "gone", F.col("sha").alias("left_sha")), ["doc_id", "variant"], "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= size)
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"))
