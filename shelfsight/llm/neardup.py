"""MinHash near-duplicate classes.

One hash per shingle fills every bin of the signature (one-permutation hashing); empty bins
borrow from a filled one along a fixed random walk of their own (optimal densification).
Bins are cut into bands; a band's value names a bucket. A bucket links its members to one hub,
a star, never to each other, so pairs grow with members and not with their square. Every
candidate is confirmed on the full shingle sets. Members of buckets that still hold two classes
meet once more, outside their buckets: an exact prefix join on their rarest shingles finds every
link that is left, without pairing the members of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import id_bitmap, id_slot, in_bitmap, merged, own_columns, saved
from shelfsight.llm.components import components

BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Rows of a task, of signatures and of whole sets.
SIGNED_ROWS, SET_ROWS = 8192, 2048
LIGHT = 16  # sets that share a shingle and are listed as pairs; more are tested inside their join
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PRIME2 = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * _PRIME ^ h[k : k + len(out)])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _PRIME2
    return x ^ (x >> np.uint64(29))


def _walks() -> np.ndarray:
    """For each bin, the order in which it asks the other bins for a value."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int32)


def signature(hashes: np.ndarray, walks: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty sorted hash array, every bin filled."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    sig = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    at = bins[first].astype(np.int64)
    sig[at], full[at] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        w = walks[empty]
        sig[empty] = sig[w[np.arange(len(empty)), full[w].argmax(axis=1)]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME
    for k in range(ROWS):
        key = _mix(key * _PRIME ^ parts[:, k])
    return key.view(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = _walks()
        for batch in batches:
            size, digest, keys, bits = [], [], [], []
            for text in batch["text"]:
                s = shingles(text.as_py(), n)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s, walks) if len(s) else None
                keys.append(band_keys(sig) if len(s) else np.empty(0, dtype=np.int64))
                bits.append((sig & np.uint64(255)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 _lists(keys, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "keys", "bits"])
    return run


def _sets(n: int, bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(bitmap, dtype=np.int64)
        for batch in batches:
            keep = in_bitmap(wanted, batch["slot"].to_numpy(zero_copy_only=False))
            part = batch.filter(pa.array(keep))
            for lo in range(0, part.num_rows, 512):
                piece = part.slice(lo, 512)
                sets = [shingles(t.as_py(), n).view(np.int64) for t in piece["text"]]
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"].cast(pa.int64()), _lists(sets, pa.int64())], names=["doc_id", "items"])
    return run


def _plausible(percent: int):
    """Drop pairs whose signatures agree so rarely that the true similarity cannot reach the bar.

    The bound lies six standard deviations below the threshold, for as many independent bins as
    the smaller set can fill; one chance match in 256 per bin only raises the agreement.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("bits_a", "bits_b"))
            agree = (a == b).mean(axis=1)
            least = np.minimum(batch["n_a"].to_numpy(), batch["n_b"].to_numpy()).clip(1, BINS)
            keep = agree >= t - 6 * np.sqrt(t * (1 - t) / least)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate classes of documents (doc_id, text).

    A document's set holds its distinct `words`-word shingles, ASCII letters lower-cased; a shorter
    text is one shingle; a text without words, or null, has none and is linked with nothing. Two
    documents are linked when 100 * |intersection| >= percent * |union|. component_id is the smallest
    doc_id reachable over links, kept marks that document. Documents with equal sets are one class
    from the start: only its smallest doc_id takes part in the search. Repeated rows of one doc_id
    with one set come back as they came; ids must be integers. An empty table gives an empty result.
    Columns other than doc_id and text are not read.

    With 48 bands of 6 bins a linked pair at the threshold shares no bucket with probability 5e-7.
    Sets are compared as 64-bit shingle hashes. `percent` should be 60 or more.
    """
    docs = own_columns(docs, ["doc_id", "text"])
    prints = saved(docs.mapInArrow(
        _fingerprints(words), "doc_id long, n_shingles long, digest binary, keys array<long>, bits binary"))
    most = prints.count()
    prints = merged(prints, most, SIGNED_ROWS)
    classes = saved(
        prints.where("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), most)
    reps = prints.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi") \
        .dropDuplicates(["doc_id"])
    reps = saved(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "keys", "bits"), most, SIGNED_ROWS)
    roots = _classes(docs, reps, most, words, percent)
    rep_root = classes.join(roots, F.col("rep") == F.col("node"), "left") \
        .select("digest", F.coalesce("root", "rep").alias("component_id"))
    # A document alone with its set is its own class: only shared or linked sets go through the join.
    out = prints.select("doc_id", "n_shingles", "digest").join(rep_root, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _classes(docs: DataFrame, reps: DataFrame, most: int, words: int, percent: int) -> DataFrame:
    """(node, root) of every representative that is linked to another; there are `most` of them at most.

    Tables are merged into as many tasks as their rows need: every table read in many tasks costs a file, and a
    line of the log, for each task of each later step, whatever it holds.
    """
    dealt = reps.select("rep", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    star = saved(dealt.join(shared.select("key", "hub"), "key"), BANDS * most)
    met = star.count()
    star = merged(star, met)
    pairs = star.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    pairs = saved(pairs.groupBy("a", "b").agg(F.count("*").alias("m")), met)
    # First each member with the hub it meets most often, then what still lies apart.
    best = saved(pairs.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a")).select("a", "b"), min(met, most))
    roots = _joined(roots, _confirm(docs, reps, best, words, percent))
    others = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    roots = _joined(roots, _confirm(docs, reps, saved(_apart(others, roots), met), words, percent))
    # Hubs have met their whole buckets; the other members of buckets that hold two classes have not met each other.
    return _joined(roots, _left(docs, reps, _open(star.where("rep <> hub").select("key", "rep"), roots, most), words, percent))


def _open(members: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(rep, c): the members given, with their classes, of buckets in which they belong to two classes or more."""
    named = members.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("c"))
    open_keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return saved(named.join(open_keys, "key", "left_semi").select("rep", "c").distinct(), most)


def _left(docs: DataFrame, reps: DataFrame, rest: DataFrame, words: int, percent: int) -> DataFrame:
    """Every link across classes among `rest` (rep, c), by an exact prefix join.

    Shingles are ordered from the rarest among `rest` to the commonest. Of two linked sets the smaller, of n,
    shares one of its first n - ceil(2 p n / (100 + p)) + 1 with the first n - ceil(p n / 100) + 1 of the larger, p being
    `percent`. Shingles that no other set holds come first and meet nothing, so texts that were each changed in a
    few places hardly take part. For each shingle the sets outside its largest class meet all those of other
    classes. Where more than LIGHT sets meet, the overlap is bounded by 32-bit hashes in the join itself, so that
    few pairs but links become rows, however many near copies there are.
    """
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    most = rest.count()
    if not most:
        return none
    sets = _load_sets(docs, rest.select(F.col("rep").alias("doc_id")), most, words)
    each = sets.select(F.col("doc_id").alias("rep"), F.explode("items").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    known = saved(each.join(shared, "item").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("by_rarity")), most, SET_ROWS)
    size = rest.join(reps.select("rep", "n", "bits"), "rep")

    def room(share: int, of: int) -> Column:
        """What the unshared shingles leave of a prefix for an overlap of share / of."""
        whole = F.col("n") - F.ceil(F.col("n") * share / of) + 1
        return F.greatest(whole.cast("int") - (F.col("n").cast("int") - F.size("by_rarity")), F.lit(0))

    first = known.join(size, "rep").select(
        "rep", "c", "n", room(2 * percent, 100 + percent).alias("as_smaller"),
        F.posexplode(F.slice("by_rarity", 1, room(percent, 100))).alias("i", "x"))
    first = saved(first.select("rep", "c", "n", F.col("x.item").alias("item"), (F.col("i") < F.col("as_smaller")).alias("small")))
    first = merged(first, first.count())
    classes = first.groupBy("item", "c").agg(F.count("*").alias("m"), F.max("small").alias("small"))
    groups = classes.groupBy(F.col("item").alias("of")).agg(
        F.max_by("c", F.struct("m", "c")).alias("most"), F.count("*").alias("k"), F.sum("m").alias("sets"), F.max("small").alias("any")) \
        .where("k > 1 AND any").select("of", "most", "sets")
    apart = saved(first.join(groups, F.col("item") == F.col("of")).select("rep", "c", "n", "item", "small", "most", "sets"))
    rows = apart.count()
    if not rows:
        return none
    apart = merged(apart, rows, least=2)  # the joins below compare sets pair by pair: never all in one task
    smaller = (F.col("small") & (F.col("n") <= F.col("n_u"))) | (F.col("small_u") & (F.col("n_u") <= F.col("n")))

    def met(some: DataFrame, test: Column) -> DataFrame:
        few = some.where("c <> most").select(*[F.col(x).alias(f"{x}_u") for x in some.columns if x not in ("item", "most")], "item")
        both = few.join(some, (few["item"] == some["item"]) & (F.col("c") != F.col("c_u")) & smaller & _fit("n", "n_u", percent) & test)
        return both.select(F.least("rep_u", "rep").alias("a"), F.greatest("rep_u", "rep").alias("b")).distinct()

    light = met(apart.where(F.col("sets") <= LIGHT).drop("sets"), F.lit(True))
    side = {s: size.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"}
    light = light.join(side["a"], "a").join(side["b"], "b").mapInArrow(_plausible(percent), "a long, b long")
    # Two shingles of one set with the same short hash meet as one.
    common = F.size(F.array_intersect("h", "h_u")) + F.col("spare")
    enough = common * (100 + percent) >= (F.col("n") + F.col("n_u")) * percent
    short = known.select("rep", F.transform("by_rarity", lambda x: F.hash(x["item"])).alias("h"))
    short = short.withColumn("spare", F.size("h") - F.size(F.array_distinct("h")))
    heavy = met(apart.where(F.col("sets") > LIGHT).drop("sets").join(short, "rep"), enough)
    pairs = saved(light.unionAll(heavy).distinct())
    return _exact(merged(pairs, pairs.count(), SET_ROWS), sets, percent)


def _fit(a: str, b: str, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Classes after new links; old classes count as the stars they are."""
    found = saved(found)
    old = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    new = found.count()
    if not new:
        return roots
    edges = old.unionByName(merged(found, new))
    rows = edges.count()
    return saved(components(edges, rows=rows), 2 * rows)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different classes."""
    name = {s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    return (
        pairs.join(name["a"], "a", "left").join(name["b"], "b", "left")
        .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))


def _confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidate pairs that hold on the full sets."""
    small = reps.select("rep", "n", "bits")
    side = {s: small.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"}
    likely = saved(
        pairs.join(side["a"], "a").join(side["b"], "b").where(_fit("n_a", "n_b", percent))
        .mapInArrow(_plausible(percent), "a long, b long"), pairs.count(), SIGNED_ROWS)
    rows = likely.count()
    if not rows:
        return likely
    likely = merged(likely, rows, SET_ROWS)
    ends = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))
    return _exact(likely, _load_sets(docs, ends, 2 * rows, words), percent)


def _load_sets(docs: DataFrame, ids: DataFrame, most: int, words: int) -> DataFrame:
    """Shingle sets of the documents named, `most` at most; a fixed-size bitmap spares the shuffle of all texts."""
    ids = saved(ids.distinct(), most)
    texts = docs.select("doc_id", "text", id_slot(F.col("doc_id")).alias("slot"))
    some = texts.mapInArrow(_sets(words, id_bitmap(ids, "doc_id")), "doc_id long, items array<long>")
    return saved(some.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), most, SET_ROWS)


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    of = {s: sets.select(F.col("doc_id").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab"}
    both = F.size(F.array_intersect("items_a", "items_b"))
    return (
        pairs.join(of["b"], "b").join(of["a"], "a")
        .withColumn("i", both)
        .where(F.col("i") * 100 >= percent * (F.size("items_a") + F.size("items_b") - F.col("i")))
        .select("a", "b"))
