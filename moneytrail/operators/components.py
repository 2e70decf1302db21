"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.plans.session import discard, save, written_bytes

FEW_BYTES = 1 << 20  # of written edges up to which one task joins them all: rounds over so few cost only jobs


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges (u, v) of one task, by union and find."""
    above: dict[int, int] = {}

    def root(n: int) -> int:
        above.setdefault(n, n)
        while (up := above[n]) != n:
            above[n] = n = above[up]
        return n

    for b in batches:
        for u, v in zip(b.u.tolist(), b.v.tolist()):
            p, q = root(u), root(v)
            above[max(p, q)] = min(p, q)
    yield pd.DataFrame({"node": list(above), "component": [root(n) for n in above]}, dtype="int64")


def _settled(e: DataFrame) -> bool:
    """All edges (u, v), u > v, lead from nodes with one target to nodes with none: every component is a star."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hit")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("hit")))
    g = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("hit").alias("hit"))
    return g.where("out > 1 or (out = 1 and hit = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node id reachable over edges (a, b).

    Alternates large-star and small-star steps (each a map-side combined minimum and an
    equi-join), so rounds grow with the logarithm of the longest path and no group is ever
    collected.  Edges of at most FEW_BYTES need no rounds: one task joins them.  Null ends and
    loops are ignored; an empty input gives an empty result; nodes without an edge don't appear.
    Every round is a written table.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = save(e.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if written_bytes(e) <= FEW_BYTES:
        groups = save(e.coalesce(1).mapInPandas(_joined, "node long, component long"))
        discard(e)
        return groups
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all lower neighbours of a node and the node itself point to the least of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = save(small.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(e)
        e = nxt
        if _settled(e):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
