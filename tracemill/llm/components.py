"""Connected components of a link table by alternating large-star and small-star steps.

Links point from the greater id to the lesser. A large star hangs every node on the least neighbour of the one that it
hangs on, a small star hangs a node's lesser neighbours on the least of them; minima are
combined before the shuffle. Every round is written to the checkpoint folder; rounds grow with the logarithm
of the longest chain, and links that are stars already take one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import measured


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v."""
    hung = edges.join(_least(edges), F.col("v") == F.col("of"), "left").select("u", F.coalesce("m", "v").alias("v"))
    least = _least(hung)
    joined = hung.join(least, F.col("u") == F.col("of"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    return out.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for every id with a link to another id.

    Nulls and self-links are ignored; repeated links count once; an empty table gives an empty one.
    """
    state = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("state")
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = edges.toDF("u", "v", "known").filter(F.col("known") & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    edges, before = measured(edges, state)
    for _ in range(most_rounds if before.rows else 0):
        edges, now = measured(_round(edges), state)
        if now == before:
            break
        before = now
    else:
        if before.rows:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
