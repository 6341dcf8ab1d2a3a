"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima with map-side combine and two equi joins; the
edge table is written to the shared folder after every round, so lineage stays
short and lost executors cost one round's tasks.  The driver sees two numbers
a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, placed_at, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def labels(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges(u, v)`` of one orderable type, no nulls -> ``(node, root)``: each node that has
    an edge to another, and the smallest node that it reaches."""
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least around u
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours at or below u go to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, written(small, "edges")
        now = _state(e)
        drop(old)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return placed_at(e.select(F.col("u").alias("node"), F.col("v").alias("root")), e._gridloom_path)
