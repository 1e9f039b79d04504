"""K-d tree sharding by distributed weighted medians, in DataFrame functions only.

A node of the tree holds documents and a number of shards. It is cut along the metadata dimension
in which its documents spread widest, at the weighted quantile that gives both sides bytes in
proportion to their shards. Quantiles come from histograms that narrow down on the cut, all nodes
of a level at once; the driver sees at most BINS rows for each node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.llm.common import own_columns, saved

BINS = 2048
VALUE_BITS, TEXT_BITS, ROW_BITS = 20, 21, 21
TOLERANCE = 0.001  # of a shard's bytes: how far a cut may miss before equal texts are told apart
ROWS_PER_TASK = 20_000


@dataclass
class Node:
    first: int  # shard
    shards: int
    dim: int = 0
    cut: int = 0
    low: "Node | None" = None
    high: "Node | None" = None


def keyed(docs: DataFrame, categories: list[str]) -> DataFrame:
    """(doc_id, size, text_crc32, k0, k1, ...): one 62-bit key for each dimension.

    A key holds the dimension's value, then a hash of the text, then a hash of the row. Values are
    those of the group of equal texts (its least category), so that copies stay side by side in
    every dimension. Dimension 0 is the logarithm of the size; categories take hashed positions.
    """
    text = F.coalesce("text", F.lit(""))
    rows = own_columns(docs, dict.fromkeys(["doc_id", "text", *categories])).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("th"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(categories)])
    rows = saved(rows)
    names = [f"c{i}" for i in range(len(categories))]
    # Copies of one text are added up before the join back.
    groups = rows.groupBy("th").agg(F.count("*").alias("copies"), *[F.min(c).alias(f"g_{c}") for c in names]).where("copies > 1")
    rows = rows.join(groups, "th", "left")
    values = [F.least(F.lit((1 << VALUE_BITS) - 1), F.floor(F.log2("size") * 32768)).cast("long")]
    for c in names:
        values.append(F.pmod(F.xxhash64(F.coalesce(f"g_{c}", c, F.lit(""))), F.lit(1 << VALUE_BITS)))
    same = F.pmod("th", F.lit(1 << TEXT_BITS))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ROW_BITS))
    low = F.shiftleft(same, ROW_BITS) + own
    keys = [(F.shiftleft(v, TEXT_BITS + ROW_BITS) + low).alias(f"k{i}") for i, v in enumerate(values)]
    return saved(rows.select("doc_id", "size", "text_crc32", *keys))


def _place(node: Node, leaf) -> Column:
    if node.low is None:
        return F.lit(leaf(node))
    return F.when(F.col(f"k{node.dim}") < node.cut, _place(node.low, leaf)).otherwise(_place(node.high, leaf))


def grow(rows: DataFrame, dims: int, shards: int) -> Node:
    """The tree for keyed rows, level by level."""
    root = Node(0, shards)
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        index = {id(n): i for i, n in enumerate(open_nodes)}
        at = _place(root, lambda n: index.get(id(n), -1))
        here = rows.select(at.alias("node"), "size", *[f"k{d}" for d in range(dims)]).where("node >= 0")
        shift = TEXT_BITS + ROW_BITS
        stats = {x["node"]: x for x in here.groupBy("node").agg(
            F.sum("size").alias("w"), *[f(f"k{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        search = {}
        for i, node in enumerate(open_nodes):
            x = stats.get(i)
            if x is None:
                node.cut = 0
                continue
            node.dim = max(range(dims), key=lambda d: ((x[f"hi{d}"] >> shift) - (x[f"lo{d}"] >> shift), -d))
            lo, hi = x[f"lo{node.dim}"], x[f"hi{node.dim}"]
            bits = max(0, (hi - lo).bit_length() - 11)
            search[i] = {"lo": lo >> bits << bits, "bits": bits, "below": 0, "goal": x["w"] * (node.shards // 2) / node.shards,
                         "miss": x["w"] / node.shards * TOLERANCE}
        while search:
            _narrow(here, open_nodes, search)
        for node in open_nodes:
            half = node.shards // 2
            node.low = Node(node.first, half)
            node.high = Node(node.first + half, node.shards - half)
        open_nodes = [c for n in open_nodes for c in (n.low, n.high) if c.shards > 1]
    return root


def _narrow(here: DataFrame, nodes: list[Node], search: dict[int, dict]) -> None:
    """One histogram for every node that still looks for its cut."""
    key = bin_ = F.lit(None).cast("long")
    for i, s in search.items():
        k = F.col(f"k{nodes[i].dim}")
        key = F.when(F.col("node") == i, k - s["lo"]).otherwise(key)
        bin_ = F.when(F.col("node") == i, F.shiftright(k - s["lo"], s["bits"])).otherwise(bin_)
    counted = (
        here.select("node", "size", key.alias("d"), bin_.alias("b")).where(F.col("b").between(0, 2 * BINS))
        .groupBy("node", "b").agg(F.sum("size").alias("w"))).collect()
    bins: dict[int, list] = {i: [] for i in search}
    for x in counted:
        bins[x["node"]].append((x["b"], x["w"]))
    for i in list(search):
        s, node = search[i], nodes[i]
        limit = s.get("limit", 2 * BINS)
        for b, w in sorted(x for x in bins[i] if x[0] < limit):
            if s["below"] + w >= s["goal"]:
                break
            s["below"] += w
        start = s["lo"] + (b << s["bits"])
        if w <= s["miss"] or s["bits"] == 0:
            before, after = s["goal"] - s["below"], s["below"] + w - s["goal"]
            node.cut = start if before < after else start + (1 << s["bits"])
            del search[i]
        else:
            bits = max(0, s["bits"] - 11)
            if s["bits"] > ROW_BITS > bits:
                bits = ROW_BITS  # whole groups of equal texts first
            s |= {"lo": start, "limit": 1 << (s["bits"] - bits), "bits": bits}


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `slot`, gapless from 0 within each shard, without sorting a shard in one task."""
    parts = max(1, -(-rows.count() // ROWS_PER_TASK))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")) \
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return rows.join(offsets, ["shard", "part"]).withColumn("slot", F.row_number().over(order) - 1 + F.col("offset"))


def shard(docs: DataFrame, shards: int = 40, categories: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of documents.

    docs has (doc_id, text) and the category columns (source and lang). A row's size is the UTF-8
    bytes of its text, null counting as empty, plus 16. The law that holds is `bytes`: shard sizes are
    equal up to TOLERANCE, or one row or one group of equal texts that small. Copies of a text lie in
    one shard unless a cut runs through a group that is larger than the tolerance. slot numbers a
    shard's rows from 0; grown_shard is null. An empty table gives no rows; with fewer rows than
    shards some shards stay empty. Extra columns are not read.
    """
    categories = ["source", "lang"] if categories is None else categories
    rows = keyed(docs, categories)
    tree = grow(rows, 1 + len(categories), shards)
    placed = saved(rows.select("doc_id", "size", "text_crc32", _place(tree, lambda n: n.first).cast("int").alias("shard")))
    return numbered(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
