"""Fingerprints, lineage and collections, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(algorithm: Column, version: Column, parameters: Column, inputs: Column) -> Column:
    """SHA-256 of algorithm, version, parameters in key order, and (asset, revision) inputs in order given."""
    p = F.array_join(F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    i = F.array_join(F.transform(inputs, lambda e: F.concat(e["asset"], F.lit("@"), e["revision"].cast("string"))), ";")
    return F.sha2(F.concat_ws("|", algorithm, version, p, i), 256)


def _paths(edges: DataFrame) -> DataFrame:
    """``(asset, path, rank)``: disjoint paths of single derivations; ``path`` is a path's last asset, ``rank`` the derivations from an asset to it.

    An asset made from one input alone leads to that input, if it is the least of
    those that do.  Places are found by pointer doubling, so a path of n assets
    takes log n rounds.  Links that lead round in a circle are left out.
    """
    from .components import _drop, _written

    one = edges.groupBy("output").agg(F.count(F.lit(1)).alias("n"), F.first("input").alias("input")).filter("n = 1 AND output <> input")
    links = _written(one.groupBy("input").agg(F.min("output").alias("output")).select(F.col("output").alias("u"), F.col("input").alias("to"), F.lit(1).alias("hops")))
    step, n, rounds = links, links.count(), 0
    while (1 << rounds) < n + 1:
        further = step.select(F.col("u").alias("to"), F.col("to").alias("_t"), F.col("hops").alias("_h"))
        old, step = step, _written(step.join(further, "to", "left").select("u", F.coalesce("_t", "to").alias("to"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops")))
        rounds += 1
        if old is not links:
            _drop(old)
    ended = step.join(links.select(F.col("u").alias("to")), "to", "left_anti")  # the rest goes round
    ends = ended.select(F.col("to").alias("asset")).distinct().select("asset", F.col("asset").alias("path"), F.lit(0).alias("rank"))
    return _written(ended.select(F.col("u").alias("asset"), F.col("to").alias("path"), F.col("hops").alias("rank")).union(ends))


def upstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(asset, depth)``: everything that the started assets derive from, by least depth (0 for those); ``edges(output, input)``.

    A round takes whole paths of single derivations (`_paths`), so their number
    follows the branchings on the way, not the depth.  What is kept is where
    paths were entered.  Nulls derive from nothing; repeated edges count once;
    circles end where they began.
    """
    from .components import _drop, _written

    edges = _written(edges.select("output", "input").filter("output IS NOT NULL AND input IS NOT NULL").distinct())
    paths = _paths(edges)

    def entered(assets: DataFrame) -> DataFrame:
        """``(path, rank, reach)`` of ``assets(asset, depth)``: ``reach`` is the depth at the path's end."""
        rank = F.coalesce("rank", F.lit(0))
        placed = assets.join(paths, "asset", "left").select(F.coalesce("path", "asset").alias("path"), rank.alias("rank"), (F.col("depth") + rank).alias("reach"))
        return _written(placed.groupBy("path", "rank").agg(F.min("reach").alias("reach")))

    entries = [entered(start.select("asset", F.lit(0).alias("depth")).filter("asset IS NOT NULL"))]
    best = _written(entries[0].groupBy("path").agg(F.min("reach").alias("reach")))
    better = best
    while not better.isEmpty():
        beyond = better.join(edges.withColumnRenamed("output", "path"), "path").select(F.col("input").alias("asset"), (F.col("reach") + 1).alias("depth"))
        entries.append(entered(beyond))
        known = best.withColumnRenamed("reach", "_r")
        better = _written(entries[-1].groupBy("path").agg(F.min("reach").alias("reach")).join(known, "path", "left").filter("_r IS NULL OR reach < _r").select("path", "reach"))
        old, best = best, _written(best.union(better).groupBy("path").agg(F.min("reach").alias("reach")))
        _drop(old)
    at = reduce(DataFrame.union, entries).groupBy("path", "rank").agg(F.min("reach").alias("reach"))
    lone = at.select(F.col("path").alias("asset"), F.col("path"), F.lit(0).alias("r0"))
    members = paths.withColumnRenamed("rank", "r0").union(lone).distinct()
    found = members.join(at, "path").filter("r0 <= rank")
    return found.groupBy("asset").agg(F.min(F.col("reach") - F.col("r0")).alias("depth"))


def collections(df: DataFrame, collection: str, asset: str, order: str) -> DataFrame:
    """Ordered child assets per collection."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(asset).alias("a")))), lambda x: x["a"])
    return df.groupBy(collection).agg(items.alias("assets"))
