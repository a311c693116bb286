"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) plus m, the least of u and its partners v. The minimum is taken before the join, so hubs pre-aggregate."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["w"]).drop("w")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node that can be reached.

    Each round links all larger partners of a node to its least one, then its smaller ones; O(log n) rounds
    leave one star per component. Rounds are written to the shared folder; the driver sees two numbers a round.
    Self links and repeated links are allowed; nulls are passed over.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = table(now, "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = table(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
