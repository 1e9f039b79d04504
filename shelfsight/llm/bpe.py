"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

The rank map is a scalar subquery. Distinct pieces of the corpus, not documents, are
encoded: a fold over a piece's bytes merges the adjacent pair of lowest rank until none has a
rank. Documents then get their pieces' ids back, block by block of documents. Pieces of more than
LONG bytes, on which a fold would take the square of their length, are merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import arrow_rows, own_columns, saved, setting

SLOTS = 1 << 15
NONE = (1 << 31) - 1
DICTIONARY = 1 << 20  # commonest pieces that are encoded once; with MAX_PIECE the bound of what is broadcast
MAX_PIECE = 32
LONG = 512  # bytes of a piece from which on the heap takes over
BATCH_ROWS = 500
SLICE = 60_000  # pieces handled at a time in a Python task


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def spark_pattern(pattern: str) -> str:
    """The split pattern with Unicode white space spelled out: Java's own \\s is ASCII only."""
    space = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    return pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


def _slot(a, b):
    return (a * 40503 + b) & (SLOTS - 1)


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as a one-row relation's value: the ids of single bytes, and the rank of every pair of tokens
    that make a token, dealt into SLOTS small lists so that a lookup scans a few keys only."""
    made = array("q")
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                made.extend((a, b, rank))
    # Arrow buffers, not objects or text for each slot: a literal of the plan would take the driver some hundred times as much.
    made = np.frombuffer(made, dtype=np.int64).reshape(-1, 3)
    slot = _slot(made[:, 0], made[:, 1])
    made = made[np.argsort(slot, kind="stable")]
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=SLOTS)))), pa.int32())
    keys = pa.ListArray.from_arrays(ends, pa.array(made[:, 0] << 32 | made[:, 1]))
    slots = pa.StructArray.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(made[:, 2], pa.int32()))], names=["k", "r"])
    single = pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int32()))
    row = pa.StructArray.from_arrays([single, pa.ListArray.from_arrays(pa.array([0, SLOTS], pa.int32()), slots)], names=["single", "slots"])
    # Spark takes no subquery inside a higher-order function: it stands in a column that one such function reads,
    # and the optimizer puts it in there, so that no row ever holds it.
    return spark.createDataFrame(pa.table({"table": row})).scalar()


def _with(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def pair_rank(a: Column, b: Column, table: Column) -> Column:
    """The rank of the token that two tokens make, NONE where they make none."""
    slot = F.get(table["slots"], (a * 40503 + b).bitwiseAND(SLOTS - 1).cast("int"))
    return _with(slot, lambda s: F.coalesce(F.get(s["r"], F.array_position(s["k"], F.shiftleft(a, 32) + b).cast("int") - 1), F.lit(NONE)))


def merged(piece: Column, table: Column) -> Column:
    """The token ids of one piece: ranked merges folded over its bytes.

    The state holds the parts' ids, -1 before the first and after the last, and the rank of each
    part joined with its right neighbour, NONE where that is no token. The first place of the least
    rank names the leftmost pair of lowest rank; a step joins it, the rank being the new part's id,
    and looks up the two pairs that it made. At the end the ids are what is left.
    """
    raw = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")  # one character for each byte

    def opened(p: Column) -> Column:
        single = F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.get(table["single"], F.ascii(F.substring(p, i, 1))).cast("long"))
        edge = F.array(F.lit(-1).cast("long"))
        ids = F.flatten(F.array(edge, single, edge))
        ranks = F.transform(F.sequence(F.lit(0), F.length(p)), lambda i: F.lit(NONE))
        return _with(ids, lambda t: F.struct(t.alias("t"), F.transform(
            ranks, lambda _, i: pair_rank(F.get(t, i), F.get(t, i + 1), table)).alias("r")))

    def step(state: Column, _: Column) -> Column:
        t, r = state["t"], state["r"]

        def join(m: Column, j: Column) -> Column:
            """j: the one-based place of the pair's left part."""
            new = F.array(pair_rank(F.get(t, j - 2), m, table), pair_rank(m, F.get(t, j + 1), table))
            rest = F.size(t)
            return F.struct(
                F.flatten(F.array(F.slice(t, 1, j - 1), F.array(m), F.slice(t, j + 2, rest))).alias("t"),
                F.flatten(F.array(F.slice(r, 1, j - 2), new, F.slice(r, j + 2, rest))).alias("r"))

        least = F.array_min(r)
        return _with(least, lambda m: F.when(m == NONE, state).otherwise(
            _with(F.array_position(r, m).cast("int"), lambda j: join(m.cast("long"), j))))

    def fold(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(p)), opened(p), step, lambda s: F.slice(s["t"], 2, F.size(s["t"]) - 2))
    return _with(raw, fold).cast("array<int>")


def folded(pieces: Column, table: Column) -> Column:
    """The ids of each piece of an array, the rank map bound once."""
    return _with(table, lambda t: F.transform(pieces, lambda p: merged(p, t)))


def heap_merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece: the same merges off a heap over a linked list of parts, O(n log n)."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part's end is the start of the next
    live = bytearray(b"\1") * n

    def pair(i: int) -> tuple[int, int, int] | None:
        """(rank, start, end) of part i joined with the next."""
        stop = end[end[i]] if end[i] < n else -1
        rank = ranks.get(piece[i:stop]) if stop > 0 else None
        return None if rank is None else (rank, i, stop)

    heap = [x for x in map(pair, range(n)) if x]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] == n or end[end[i]] != stop:
            continue  # one of its parts has changed since
        live[end[i]] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        for x in (before[i], i):
            if x >= 0 and (p := pair(x)):
                heapq.heappush(heap, p)
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


def pieces_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(spark_pattern(pattern)), F.lit(0))


def frequent_pieces(docs: DataFrame, pattern: str, most: int = DICTIONARY) -> DataFrame:
    """(piece): the pieces that occur most often, at most `most` of them and MAX_PIECE bytes each."""
    every = docs.select(F.explode(pieces_of(F.col("text"), pattern)).alias("piece"))
    count = saved(every.groupBy("piece").agg(F.count("*").alias("n"))
                  .where((F.col("n") > 1) & (F.octet_length("piece") <= MAX_PIECE)))
    band = F.floor(F.log2("n") * 64)
    room, cut = most, 0
    # At most 4,096 bands, whatever the corpus.
    for x in sorted(count.groupBy(band.alias("band")).agg(F.count("*").alias("m")).collect(), reverse=True):
        room -= x["m"]
        if room < 0:
            cut = x["band"] + 1
            break
    return count.where(band >= cut).select("piece")


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold at most `most` list elements, or one row."""
    ends = np.cumsum(pc.list_value_length(batch[column]).to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _hashes(pieces: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(p.as_buffer()) for p in pieces), dtype=np.uint64, count=len(pieces))


def _look_up(shipped):
    """Each piece as an index into the dictionary, or as -1-k for the k-th rare piece of its document.

    Long rare pieces are encoded here; `rare` holds "" in their place, `long_ids` their ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, ranks = shipped.value
        table = pa.ipc.open_file(dictionary).get_batch(0)
        hashes, known = table["h"].to_numpy(), table["piece"]
        for batch in (part for whole in batches for part in _slices(whole, "pieces", SLICE)):
            lists = batch["pieces"]
            flat, parent = lists.flatten().cast(known.type), pc.list_parent_indices(lists).to_numpy()
            distinct = flat.dictionary_encode()
            words = distinct.dictionary
            place = np.minimum(np.searchsorted(hashes, _hashes(words)), len(hashes) - 1)
            same = pc.equal(known.take(pa.array(place)), words).to_numpy(zero_copy_only=False)
            codes = np.where(same, place, -1).astype(np.int32)[distinct.indices.to_numpy()]
            rare = np.flatnonzero(codes < 0)
            key, back = np.unique(parent[rare].astype(np.int64) << 32 | distinct.indices.to_numpy()[rare], return_inverse=True)
            owner = key >> 32
            start = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            codes[rare] = -1 - (back - start[owner[back]]) if len(rare) else 0
            sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            words = words.take(pa.array(key & 0xFFFFFFFF)).cast(pa.string())
            big = pc.greater(pc.binary_length(words), LONG)
            by_heap = [heap_merged(w.as_py().encode(), ranks) if x else [] for w, x in zip(words, big.to_pylist())] if pc.any(big).as_py() \
                else [[]] * len(words)
            words = pc.if_else(big, "", words)
            starts = pa.array(start, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_sha256"],
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(codes)),
                 pa.ListArray.from_arrays(starts, words),
                 pa.ListArray.from_arrays(starts, pa.array(by_heap, pa.list_(pa.int32())))],
                names=["doc_id", "text_sha256", "codes", "rare", "long_ids"])
    return run


def _assemble(shipped):
    """Token ids of each document, their digest, and the digest of the bytes that the ids decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, ranks = shipped.value
        known = pa.ipc.open_file(dictionary).get_batch(0)["ids"]
        known = known.values.to_numpy(), known.offsets.to_numpy()
        token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            token_bytes[rank] = token
        spelled = pa.array([str(i) for i in range(len(token_bytes))])
        raw = pa.array(token_bytes, pa.binary())
        for batch in batches:
            for part in _slices(batch, "codes", SLICE):
                yield _digests(part, known, spelled, raw)
    return run


def _digests(part: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray], spelled: pa.Array, raw: pa.Array) -> pa.RecordBatch:
    codes = part["codes"].flatten().to_numpy()
    parent = pc.list_parent_indices(part["codes"]).to_numpy()
    rare = part["rare_ids"]
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(rare).to_numpy())))
    words = rare.flatten()
    rare = words.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy())))
    # The dictionary is read in place: a copy for each slice would outweigh the slice.
    common = codes >= 0
    at, start, size = np.where(common, codes, first[parent] - 1 - codes), np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    for (_, offsets), own in ((known, common), (rare, ~common)):
        start[own] = offsets[at[own]]
        size[own] = offsets[at[own] + 1] - start[own]
    per_piece = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(per_piece[-1]) + np.repeat(start - per_piece[:-1], size)
    common = np.repeat(common, size)
    ids = np.empty(len(place), np.int32)
    for (values, _), own in ((known, common), (rare, ~common)):
        ids[own] = values[place[own]]
    ids = pa.array(ids)
    piece_ends = np.concatenate(([0], np.cumsum(pc.list_value_length(part["codes"]).to_numpy())))
    offsets = pa.array(per_piece[piece_ends], pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(offsets, spelled.take(ids)), ",")
    # Decoding reads the ids alone.
    back = pc.binary_join(pa.ListArray.from_arrays(offsets, raw.take(ids)), pa.scalar(b"", pa.binary()))
    sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in text]
    own = [hashlib.sha256(x.as_buffer()).hexdigest() for x in back]
    return pa.RecordBatch.from_arrays(
        [part["doc_id"], pa.array(np.diff(per_piece[piece_ends]), pa.int64()), pa.array(sha), pa.array(own),
         pc.equal(pa.array(own), part["text_sha256"])],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])


def _file(batch: pa.RecordBatch) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def _dictionary(pieces: DataFrame, table: Column, ranks: dict[bytes, int]) -> Iterator[pa.Buffer]:
    """Two Arrow files of one batch, in the order of the pieces' hashes: (h, piece) and (ids).

    They hold the tokens that are text by themselves and the pieces given.
    """
    whole = {}
    for token, rank in ranks.items():
        try:
            whole[token.decode()] = rank
        except UnicodeDecodeError:
            continue
    # Many pieces to a row: the rank map is bound once for each row.
    rows = pieces.groupBy(F.pmod(F.xxhash64("piece"), F.lit(1024)).alias("s")).agg(F.collect_list("piece").alias("piece"))
    rows = saved(rows.select("piece", table.alias("_ranks")).select("piece", folded(F.col("piece"), F.col("_ranks")).alias("ids"))).toArrow()
    names = pa.concat_arrays([pa.array(whole.keys(), pa.large_string()), *[x.flatten().cast(pa.large_string()) for x in rows["piece"].chunks]])
    kind = pa.large_list(pa.int32())
    ids = pa.concat_arrays([pa.array([[x] for x in whole.values()], kind), *[x.flatten().cast(kind) for x in rows["ids"].chunks]])
    del rows
    h = _hashes(names)
    # Stable: of a token and an equal piece the token comes first, and a search from the left finds it.
    order = pa.array(np.argsort(h, kind="stable"))
    # One after the other, so that the driver never holds both files and what they are made of.
    yield _file(pa.RecordBatch.from_arrays([pa.array(h).take(order), names.take(order)], names=["h", "piece"]))
    del names, h
    yield _file(pa.RecordBatch.from_arrays([ids.take(order)], names=["ids"]))


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, most: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) of documents (doc_id, text).

    ids_sha256 is over the decimal ids joined by commas; the ids are then decoded and hashed.
    A null or empty text has no tokens and the digests of the empty string. Pieces are the
    matches of `pattern`, each encoded by itself, without special tokens; a piece that is a token
    is that token. The rank file must hold every single byte; ids are its ranks, gaps allowed.
    Repeated rows come back as often as they stand, an empty table gives no rows, and columns
    other than doc_id and text are not read.

    The commonest pieces, at most `most`, are encoded once and shipped to the executors (a
    bounded table); all others are encoded where they stand, so no document is shuffled. A piece's
    work grows with n log n of its length beyond LONG bytes, and with its square below.
    """
    docs = own_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    ranks = load_ranks(rank_path)
    table = rank_table(spark, ranks)
    # Long plans: their descriptions, which the driver keeps, are cut.
    with setting(spark, "spark.sql.maxPlanStringLength", "100000"):
        names, ids = (spark.sparkContext.broadcast((x, ranks)) for x in _dictionary(frequent_pieces(docs, pattern, most), table, ranks))
        pa.default_memory_pool().release_unused()
        whole = F.coalesce("text", F.lit("")).cast("binary")
        found = (
            docs.select("doc_id", F.sha2(whole, 256).alias("text_sha256"), pieces_of(F.col("text"), pattern).alias("pieces"))
            .mapInArrow(_look_up(names), "doc_id long, text_sha256 string, codes array<int>, rare array<string>, long_ids array<array<int>>"))
        by_fold = _with(F.col("_ranks"), lambda t: F.zip_with(
            "rare", "long_ids", lambda p, ids: F.when(F.size(ids) > 0, ids).otherwise(merged(p, t))))
        out = (
            found.withColumn("_ranks", table).select("doc_id", "text_sha256", "codes", by_fold.alias("rare_ids"))
            .mapInArrow(_assemble(ids),
                        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"))
        # One small row for each document: kept, so that the batch size below holds while it is computed.
        with arrow_rows(spark, BATCH_ROWS):
            out = saved(out)
    names.destroy()
    ids.destroy()
    return out
