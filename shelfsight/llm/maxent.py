"""Hashed maximum-entropy language model with a class-factored softmax.

p(word | history) = p(class | history) * p(word | class). Classes come from a word's last bytes,
so they need no table. p(class | history) is a softmax over hashed n-gram and skip features of
the words before; p(word | class) is the word's smoothed relative frequency in its class, a unigram
count that neither looks at the history nor is trained. Weights are trained by gradient updates within
blocks of documents, averaged over all blocks after each round. Documents are scored in sparse
batches: a token touches the few weight rows of its features.

Words stand as 64-bit hashes. Counts cover every training token of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import fold, own_columns, saved

CLASSES = 32
ROWS = 1 << 13
FEATURES = 4
BATCH = 8192
CHUNK = 1 << 16  # tokens of documents handled at a time
BLOCK_BYTES = 8 << 20  # text in one block of documents
END = 1  # the hash that stands for the end of a text; 0 stands before its first word
FLAT = 60  # sums of weights up to which no exponential leaves the range of a float32
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    return x ^ (x >> np.uint64(27))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of the words of some texts, for each two zeros, the words, the end; and their numbers of tokens."""
    words = list(chain.from_iterable(texts))
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    stop = np.cumsum(size + 2)
    h, c, own = np.zeros(stop[-1], dtype=np.uint64), np.zeros(stop[-1], dtype=np.int64), np.ones(stop[-1], dtype=bool)
    h[stop - 1] = END
    own[stop - 1] = own[stop - size - 1] = own[stop - size - 2] = False
    if words:
        h[own] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
        end = np.append(np.flatnonzero(raw == 32), len(raw))
        width = np.diff(end, prepend=-1) - 1
        last, prior = raw[end - 1].astype(np.int64), raw[end - np.minimum(width, 2)].astype(np.int64)
        c[own] = 1 + (last * 31 + prior * 7 + np.minimum(width, 6)) % (CLASSES - 1)
    return h, c, size


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes of a text's words, ASCII letters lower-cased: two zeros, the words, the end."""
    return _joined([_words(text)])[:2]


def history(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens in joined texts, and the weight rows of each: the word before, the two
    before, the one before that (a skip), and a bias by place: row 1 for a text's first token, else row 0."""
    at = np.flatnonzero(h)
    last, prior = h[at - 1], h[at - 2]
    kinds = [last * _P1 + np.uint64(11), (last * _P1 + prior) * _P2 + np.uint64(13), prior * _P1 + np.uint64(17)]
    rows = [_mix(k) % np.uint64(ROWS - 2) + np.uint64(2) for k in kinds]
    return at, np.stack([*rows, (last == 0).astype(np.uint64)], axis=1).astype(np.uint16)


def chunks(texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Joined hashes and classes of runs of texts, with the number of tokens of each text."""
    run, waiting = [], 0
    for text in texts:
        run.append(_words(text))
        waiting += len(run[-1]) + 1
        if waiting >= CHUNK:
            yield _joined(run)
            run, waiting = [], 0
    if run:
        yield _joined(run)


def _probabilities(lines: np.ndarray, f: list[np.ndarray], out: np.ndarray) -> np.ndarray:
    """out: for each class a line of its probabilities at the tokens. `lines` are the weights, one line for each class.

    One class at a time, so that what is gathered stays in the cache.
    """
    for c in range(CLASSES):
        z = lines[c].take(f[0])
        for k in range(1, FEATURES):
            z += lines[c].take(f[k])
        out[c] = z
    if out.size and max(out.max(), -out.min()) > FLAT:
        out -= out.max(axis=0)
    np.exp(out, out=out)
    out /= out.sum(axis=0)
    return out


def _kinds(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[:, k].astype(np.intp) for k in range(FEATURES)]


def _softmax(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    return _probabilities(np.ascontiguousarray(w.T), _kinds(f), np.empty((CLASSES, len(f)), w.dtype)).T


def descend(w: np.ndarray, texts: Iterator[str | None], rate: float) -> int:
    """Gradient steps over the tokens of some texts, in place; returns the tokens seen.

    A weight row moves by the summed gradient of its occurrences in the batch, divided by the
    root of their number, so that rare and common features both settle.
    """
    seen = 0
    lines, room = np.ascontiguousarray(w.T), np.empty((CLASSES, BATCH), w.dtype)
    for h, c, _ in chunks(texts):
        at, rows = history(h)
        seen += len(at)
        for lo in range(0, len(at), BATCH):
            f, y = _kinds(rows[lo : lo + BATCH]), c[at[lo : lo + BATCH]]
            g = _probabilities(lines, f, room[:, : len(y)])
            g[y, np.arange(len(y))] -= 1
            steps = [rate / FEATURES / np.sqrt(np.maximum(np.bincount(x, minlength=ROWS), 1)) for x in f[:-1]]
            for k in range(CLASSES):
                own = g[k].astype(float)
                for x, step in zip(f, steps):
                    lines[k] -= np.bincount(x, own, ROWS) * step
            for row in (0, 1):
                own = (f[-1] == row).astype(w.dtype)
                lines[:, row] -= rate / FEATURES * (g @ own) / math.sqrt(max(own.sum(), 1))
    w[:] = lines.T
    return seen


def _train(weights: bytes, rate: float):
    """One block's tokens: its word counts, and its weights after a pass of gradient steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights, dtype=np.float32).reshape(ROWS, CLASSES).copy()
        seen = 0
        for batch in batches:
            texts = (t.as_py() for t, keep in zip(batch["text"], batch["train"].to_pylist()) if keep)
            seen += descend(w, texts, rate)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(ROWS), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, ROWS * CLASSES + 1, CLASSES), pa.int32()), pa.array(w.ravel())),
                 pa.array(np.full(ROWS, seen), pa.int64())], names=["r", "w", "n"])
    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each block within a batch, with their training count and class."""
    for batch in batches:
        table = pa.table({"block": batch["block"], "train": batch["train"], "text": batch["text"]}).sort_by("block")
        block = table["block"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            h, c, size = _joined([_words(t.as_py()) for t in table["text"].slice(lo, hi - lo)])
            at = np.flatnonzero(h)
            train = np.repeat(np.array(table["train"].slice(lo, hi - lo).to_pylist(), dtype=np.int64), size)
            back, words = pd.factorize(h[at])
            n = np.bincount(back, weights=train).astype(np.int64)
            kind = np.empty(len(words), np.int32)
            kind[back] = c[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), block[lo]), pa.int64()), pa.array(words.view(np.int64)), pa.array(n), pa.array(kind)],
                names=["block", "h", "n", "c"])


def _score(weights: bytes, total: int, distinct: int, class_n: list[int], class_v: list[int]):
    """Base and model scores of one block's documents; counts holds its words."""
    base_floor = total + 0.5 * (distinct + 1)
    share = np.log10(np.array(class_n) + 0.5 * (np.array(class_v) + 1))

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        lines = np.ascontiguousarray(np.frombuffer(weights, dtype=np.float32).reshape(ROWS, CLASSES).T)
        room = np.empty((CLASSES, BATCH), lines.dtype)
        order = np.argsort(h := counts["h"].to_numpy().view(np.uint64))
        h, n = h[order], counts["total"].to_numpy()[order]
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for joined, c, size in chunks(t.as_py() for t in docs["text"]):
            at, rows = history(joined)
            c = c[at]
            got = n[np.searchsorted(h, joined[at])]
            up = np.log10(got + 0.5)
            chosen = np.empty(len(at), lines.dtype)
            for lo in range(0, len(at), BATCH):
                y = c[lo : lo + BATCH]
                chosen[lo : lo + BATCH] = _probabilities(lines, _kinds(rows[lo : lo + BATCH]), room[:, : len(y)])[y, np.arange(len(y))]
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            out["n_tokens"] += size.tolist()
            out["n_known"] += np.add.reduceat((got > 0).astype(np.int64), first).tolist()
            out["base_score"] += (np.add.reduceat(up, first) - size * math.log10(base_floor)).tolist()
            out["score"] += np.add.reduceat(np.log10(np.maximum(chosen, 1e-12).astype(float)) + up - share[c], first).tolist()
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "held_out": docs["held_out"],
                         **{k: pa.array(v, kinds[k]) for k, v in out.items()}})
    return run


def score(docs: DataFrame, rounds: int = 2, rate: float = 0.5, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of documents.

    docs has (doc_id, text). Rows whose crc32(doc_id as text) mod 5 is `held_out` are scored but not
    learned from; a null id counts as a training row. Tokens are the words, ASCII letters lower-cased,
    and one end; a null or empty text is the end alone. base_score is the smoothed unigram log10
    probability, score the model's. Within a class a word has probability (c + 0.5) / (N + 0.5 (V + 1))
    with the class's own N and V; unseen words share that of c = 0. Without training rows all counts are
    0 and the weights flat. An empty table gives no rows; repeated rows come back as often as they
    stand. Other columns are not read.
    """
    docs = own_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    bytes_ = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-bytes_ // BLOCK_BYTES))
    mark = F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), mark.alias("held_out"), (~mark).alias("train"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    counted = rows.select("block", "train", "text").mapInArrow(_count, "block long, h long, n long, c int")
    counted = saved(counted.groupBy("block", "h").agg(F.sum("n").alias("n"), F.first("c").alias("c")))
    words = counted.groupBy("h").agg(F.sum("n").alias("total"), F.first("c").alias("c"))
    words = saved(words)
    sizes = words.where("total > 0").groupBy("c").agg(F.sum("total").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = [0] * CLASSES, [0] * CLASSES
    for x in sizes:
        class_n[x["c"]], class_v[x["c"]] = x["n"], x["v"]
    total, distinct = sum(class_n), sum(class_v)
    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    weights[:2] = np.log((np.array(class_n) + 0.5) / (total + 0.5 * CLASSES))
    for k in range(rounds):
        learned = rows.select("train", "text").mapInArrow(_train(weights.tobytes(), rate / (k + 1)), "r int, w array<float>, n long")
        weights = _averaged(learned, weights)
    known = counted.select("block", "h").join(words.select("h", "total"), "h")
    scored = rows.select("doc_id", "text", "held_out", "block").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score(weights.tobytes(), total, distinct, class_n, class_v),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _averaged(learned: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weights averaged over the tasks by their tokens: ROWS rows reach the driver."""
    mean = learned.groupBy("r").agg(*[(F.sum(F.get("w", k) * F.col("n")) / F.sum("n")).alias(f"w{k}") for k in range(CLASSES)]).toArrow()
    out = weights.copy()
    if mean.num_rows:
        out[mean["r"].to_numpy()] = np.stack([mean[f"w{k}"].to_numpy() for k in range(CLASSES)], axis=1)
    return out
