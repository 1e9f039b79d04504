"""Benchmark decontamination by a distributed positional inverted index.

Items are cut into windows of consecutive words. A window is looked up by its rarest words, as
counted over the corpus: the index stores the positions of these words in every document, and
lists are intersected after each is shifted by the word's offset. Equal shifted positions give
phrase candidates, positions within a slop give proximity matches. Phrase candidates are
confirmed on the whole window.

The items are worked off in blocks of at most BLOCK windows, which bounds what is shipped to
the executors whatever the size of the benchmark.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import id_bitmap, id_slot, in_bitmap, own_columns, saved

BLOCK = 200_000
#: ASCII letters in lower case, digits kept, every other ASCII character a space; other bytes are word bytes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(window, item_ids): distinct windows as space-joined words, with the items that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"]):
                w = words_of(text.as_py())
                for lo in range(0, max(0, len(w) - size) + 1 if w else 0, 10_000):
                    own = {b" ".join(w[i : i + size]) for i in range(lo, min(lo + 10_000, max(0, len(w) - size) + 1))}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(own), pa.string()), pa.array(list(own), pa.binary())], names=["item_id", "window"])
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL")
    return named.mapInArrow(run, "item_id string, window binary").groupBy("window") \
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def _counts(vocabulary):
    """Occurrences of the items' words in one batch of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.value
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(filter(wanted.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])
    return run


def _postings(probes):
    """The index: positions of the probe words, one row for each document and word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = probes.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                terms, ids, places = [], [], []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"]):
                    found = defaultdict(list)
                    for i, w in enumerate(words_of(text.as_py())):
                        if w in wanted:
                            found[w].append(i)
                    terms += found
                    ids += [doc] * len(found)
                    places += found.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.binary()), pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
                    names=["term", "doc_id", "places"])
    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(words_of(t.as_py())) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_words"])


def _candidate_texts(bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bitmap, dtype=np.int64)
        for batch in batches:
            keep = in_bitmap(wanted, batch["slot"].to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep)).select(["doc_id", "text"])
    return run


def _confirmed(by_key, item_ids):
    """Spans of words inside whole windows, and the items, for documents with their candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, items = by_key.value, item_ids.value
        for batch in batches:
            spans, found = [], []
            for text, cands in zip(batch["text"], batch["cands"]):
                w = words_of(text.as_py())
                hits, own = set(), set()
                for c in cands.as_py():
                    for offset, size, window in windows[c["k"]]:
                        lo = c["at"] - offset
                        if lo >= 0 and lo + size <= len(w) and b" ".join(w[lo : lo + size]) == window:
                            hits.add((lo, lo + size))
                            own.update(items[window])
                merged: list[list[int]] = []
                for lo, hi in sorted(hits):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(hi, merged[-1][1])
                    else:
                        merged.append([lo, hi])
                spans.append([{"lo": lo, "hi": hi} for lo, hi in merged])
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                 pa.array(found, pa.list_(pa.string()))], names=["doc_id", "spans", "items"])
    return run


def _keys(windows: list[bytes], counts: dict[bytes, int], probes: int):
    """Probe keys: a window's rarest words with their distances from the rarest.

    Windows that slide over the same rare words share a key. A window with a word that the corpus
    lacks is left out.
    """
    keys: dict[tuple, int] = {}
    by_key: list[list] = []
    for window in windows:
        w = window.split(b" ")
        if any(x not in counts for x in w):
            continue
        order = sorted(range(len(w)), key=lambda i: (counts[w[i]], w[i], i))[:probes]
        first = order[0]
        key = tuple((w[i], i - first) for i in order)
        if key not in keys:
            keys[key] = len(by_key)
            by_key.append([])
        by_key[keys[key]].append((first, len(w), window))
    return keys, by_key


def matches(docs: DataFrame, items: DataFrame, size: int = 13, probes: int = 3, slop: int = 2) -> DataFrame:
    """(doc_id, n_words, spans array<struct<lo,hi>>, items array<string>, n_near) for every document row.

    docs has (doc_id, text), items (item_id, text); doc_id is an integer and names one row (rows that
    repeat an id count as one document with the words of each). Words are runs of ASCII letters and
    digits, letters lower-cased, and of all non-ASCII characters. A window is `size` consecutive words
    of an item, or the whole item if it has fewer; an item without words, or with a null id, has none.
    spans are the merged word ranges covered by occurrences of windows; items lists the ids with an
    occurring window, sorted as text. n_near counts the places where a window's rarest words stand in
    order with each distance off by `slop` at most: phrase matches are among them. Null texts have no
    words; empty tables give no rows or no matches. Other columns are not read.
    """
    docs = own_columns(docs, ["doc_id", "text"])
    items = own_columns(items, ["item_id", "text"])
    spark = docs.sparkSession
    ctx = spark.sparkContext
    windows = saved(item_windows(items, size))
    blocks = max(1, -(-windows.count() // BLOCK))
    per_block = []
    for block in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        item_ids = {bytes(x["window"]): x["item_ids"] for x in rows}
        vocabulary = {w for window in item_ids for w in window.split(b" ")}
        counted = docs.select("text").mapInArrow(_counts(ctx.broadcast(vocabulary)), "term binary, n long") \
            .groupBy("term").agg(F.sum("n").alias("n")).collect()
        keys, by_key = _keys(list(item_ids), {bytes(x["term"]): x["n"] for x in counted}, probes)
        per_block.append(_block(docs, keys, by_key, item_ids, slop))
    found = per_block[0]
    for more in per_block[1:]:
        found = found.unionByName(more)
    merged = found.groupBy("doc_id").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
    lengths = docs.mapInArrow(_lengths, "doc_id long, n_words long")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return lengths.join(merged, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def _block(docs: DataFrame, keys: dict[tuple, int], by_key: list, item_ids: dict, slop: int) -> DataFrame:
    """(doc_id, spans, items, n_near) of documents with a match in one block of windows."""
    spark = docs.sparkSession
    ctx = spark.sparkContext
    probes = ctx.broadcast({t for key in keys for t, _ in key})
    index = saved(docs.mapInArrow(_postings(probes), "term binary, doc_id long, places array<int>"))
    # One row for each key: at most BLOCK, so this side may be broadcast.
    schema = "k int, term binary, rest array<struct<term:binary,shift:int>>"
    wanted = F.broadcast(spark.createDataFrame(
        [(k, key[0][0], [(t, s) for t, s in key[1:]]) for key, k in keys.items()], schema))
    cand = index.join(wanted, "term").select("k", "doc_id", F.explode("places").alias("at"), "rest") \
        .withColumn("off", F.lit(0))
    places = index.select("term", "doc_id", F.explode("places").alias("place"))
    longest = max((len(key) for key in keys), default=1)
    for step in range(longest - 1):
        cand = saved(cand)
        has = cand.where(F.size("rest") > step)
        shifted = has.select(
            "*", F.col("rest")[step]["term"].alias("t"),
            F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("d")) \
            .withColumn("p", F.col("at") + F.col("rest")[step]["shift"] + F.col("d"))
        # Intersection of the shifted lists: an equi-join on word, document and position.
        met = shifted.join(
            places.select(F.col("term").alias("t"), "doc_id", F.col("place").alias("p")), ["t", "doc_id", "p"], "left_semi")
        met = met.groupBy("k", "doc_id", "at").agg(F.first("rest").alias("rest"), F.min(F.col("off") + F.abs("d")).alias("off"))
        cand = met.unionByName(cand.where(F.size("rest") <= step).select(*met.columns))
    cand = saved(cand.select("k", "doc_id", "at", "off"))
    near = cand.groupBy("doc_id").agg(F.count("*").alias("n_near"))
    exact = cand.where("off = 0").groupBy("doc_id").agg(F.collect_list(F.struct("k", "at")).alias("cands"))
    exact = saved(exact)
    texts = docs.select("doc_id", "text", id_slot(F.col("doc_id")).alias("slot")) \
        .mapInArrow(_candidate_texts(id_bitmap(exact, "doc_id")), "doc_id long, text string")
    hits = texts.join(exact, "doc_id").mapInArrow(
        _confirmed(ctx.broadcast(by_key), ctx.broadcast(item_ids)),
        "doc_id long, spans array<struct<lo:int,hi:int>>, items array<string>")
    return near.join(hits, "doc_id", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "n_near")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near).

    A document is contaminated if at least `percent` in a hundred of its words, and one at least,
    stand inside occurrences of windows. See `matches` for the rest.
    """
    found = matches(docs, items, size)
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"] - 1)))
    # The spans of one block are disjoint; those of several may overlap.
    hit = F.size(F.array_distinct(inside)).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 100 >= F.col("n_words") * percent)).alias("contaminated"), "n_near")
