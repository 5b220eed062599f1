"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, drop, materialize


def _with_least(edges: DataFrame, own: bool, hubs: bool) -> DataFrame:
    """The edges with ``m``, the least ``b`` of their ``a`` (``own``: or ``a`` itself).

    ``hubs``: nodes that hold a thousandth of the edges or more, a thousand at most, get theirs by broadcast,
    so that their edges stay where they are; all others meet their least in the task of their node.
    """
    m = F.least("a", F.min("b")) if own else F.min("b")
    least = edges.groupBy("a").agg(m.alias("m"), F.count("*").alias("n"))
    if not hubs:
        return edges.join(least.drop("n"), "a")
    least = materialize(least, "least")
    total = edges.count()
    hot = F.broadcast(least.where(F.col("n") >= max(HOT, total / HOT)).select("a", "m"))  # HOT rows at most
    return edges.join(hot, "a").unionByName(edges.join(hot, "a", "left_anti").join(least.select("a", "m"), "a"))


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, True, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    return _with_least(down, False, hubs).select(
        F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
    )


def _has_hub(edges: DataFrame) -> bool:
    both = edges.select(F.explode(F.array("a", "b")).alias("a"))
    return not both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).limit(1).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b), longs, into (node, root): root is the smallest node reachable.

    Each round rewires every node to a smaller neighbour; the edge count never grows, and
    the rounds are logarithmic in the size of the largest component. The edges of a round
    are a written table, so a lost executor repeats one round at most; those of the round before
    are deleted. Nodes are aggregated map-side; nothing of a component is gathered in one task.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        hubs = _has_hub(now)
        nxt = materialize(_small_star(_large_star(now, hubs), hubs).distinct(), "edges")
        sign = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        drop(now)
        if sign == seen:
            break
        seen, now = sign, nxt
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("root"))
