"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BITMAP_BITS = 23  # a fixed-size id filter: one mebibyte, whatever the input


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without that setting, as in tests,
    gets a folder of its own; a cluster without it is an error."""
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not ctx.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        ctx.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return ctx.getCheckpointDir()


ROWS_PER_FILE = 100_000


def merged(df: DataFrame, rows: int, per_task: int = ROWS_PER_FILE, least: int = 1) -> DataFrame:
    """df in no more tasks than `rows`, a bound of its rows, fill with `per_task` each."""
    return df.coalesce(max(least, -(-rows // per_task)))


def saved(df: DataFrame, rows: int | None = None, per_task: int = ROWS_PER_FILE) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage.

    `rows`, a bound of the rows where one is known, merges the tasks of small tables, so that
    the files of what follows do not outgrow its data. A table that fills one task only is then
    grouped and joined with others of its kind without a shuffle.
    """
    shared_folder(df.sparkSession)
    if rows is None:
        return df.checkpoint(eager=True)
    return merged(merged(df, rows, per_task).checkpoint(eager=True), rows, per_task)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for what is computed inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, most: int):
    """Smaller Arrow batches for what is computed inside, where a row holds far more than its text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return setting(spark, key, str(min(most, now) if now > 0 else most))


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n: the fixed split into training and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def id_slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << BITMAP_BITS)).cast("int")


def id_bitmap(ids: DataFrame, col: str) -> bytes:
    """A bitmap of fixed size over hashed ids, for a map-side prefilter ahead of an exact semi-join.

    Bits are OR-ed into 64-bit words on the executors: at most 2^17 rows reach the driver.
    """
    words = (
        ids.select(id_slot(F.col(col)).alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("b"))
    ).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.tobytes()


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bitmap[slots >> 6] >> (slots & 63).astype(np.int64)) & 1).astype(bool)


FILTER_BITS = (20, 27)  # a filter takes 128 KiB at least, 16 MiB at most, whatever the number of keys


def bit_filter(keys: DataFrame, col: str) -> np.ndarray:
    """64-bit words of a two-probe Bloom filter over 64-bit hashes, 16 bits or more for each key up to the size bound.

    For a map-side semi-join ahead of an exact one: keys all pass, and a share of the others.
    """
    bits = min(max(FILTER_BITS[0], int(16 * keys.count()).bit_length()), FILTER_BITS[1])
    high = F.shiftrightunsigned(F.col(col), 64 - bits)
    low = F.col(col).bitwiseAND((1 << bits) - 1)
    words = keys.select(F.explode(F.array(high, low)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes a bit filter lets through."""
    bits = int(len(words) * 64).bit_length() - 1

    def held(slot: np.ndarray) -> np.ndarray:
        return ((words[slot >> np.uint64(6)] >> (slot & np.uint64(63)).astype(np.int64)) & 1).astype(bool)
    return held(hashes >> np.uint64(64 - bits)) & held(hashes & np.uint64((1 << bits) - 1))


def own_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Only the columns an operator reads, so that extra columns can never clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
