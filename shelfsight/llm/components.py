"""Connected components by alternating large-star and small-star steps, all as joins on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import saved


def _state(e: DataFrame) -> tuple:
    now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return now["n"], now["h"]


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """e holds (u, v) with v < u."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return (
        e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component.

    Hubs are never gathered: minima come from partial aggregation and travel back by a join
    that skew handling can split. Rounds grow with the logarithm of the longest chain. An
    empty edge table gives an empty result; loops and repeated edges have no effect. `rows` is a
    bound of the number of edges, where one is known.
    """
    e = saved(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows=rows
    )
    seen = _state(e)
    while seen[0]:
        # No step adds edges beyond one for each node.
        e = saved(_small(_large(e).where("u <> v").distinct()).where("u <> v").distinct(), rows=2 * seen[0])
        now = _state(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
