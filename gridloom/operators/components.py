"""Connected regions of pixel tables: labels, flood fill, sieve, segmentation, regions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``.  Where that is unset, local
    mode takes a temporary folder and a cluster is refused: its executors would not see one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_gridloom_cut", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = spark._gridloom_cut = tempfile.mkdtemp(prefix="spark-gridloom-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the folder that the cluster shares."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def _drop(*tables: DataFrame) -> None:
    """Delete the files of tables from `_written`; nothing that still reads them may be used again."""
    for df in tables:
        if path := getattr(df, "_gridloom_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def _steps(diagonal: bool) -> list[tuple[int, int]]:
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    return four + [(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else four


def _spread(df: DataFrame, steps) -> DataFrame:
    o = F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("dy"), F.lit(b).cast("bigint").alias("dx")) for a, b in steps]))
    return df.withColumn("_o", o).withColumns({"y": F.col("y") + F.col("_o.dy"), "x": F.col("x") + F.col("_o.dx")}).drop("_o")


def reach(cells: DataFrame, seeds: DataFrame, diagonal: bool = False) -> DataFrame:
    """Cells that seeds reach through neighbouring cells, seeds included: the regions of all cells that hold a seed."""
    seeds = seeds.select("y", "x")
    lab = _written(labels(cells.select("y", "x").union(seeds).distinct().withColumn("label", F.lit(1)), "label", diagonal))
    hit = lab.join(seeds, ["y", "x"], "left_semi").select("region").distinct()
    return lab.join(hit, "region", "left_semi").select("y", "x")


def flood_fill(df: DataFrame, y: int, x: int, tolerance: float, diagonal: bool = False) -> DataFrame:
    """Region of a seed: cells whose value is within ``tolerance`` of the seed's, connected to it."""
    seed = df.filter((F.col("y") == y) & (F.col("x") == x)).select("y", "x", F.col("value").alias("_s"))
    near = df.join(F.broadcast(seed.select("_s")), F.abs(F.col("value") - F.col("_s")) <= tolerance, "left_semi")
    return reach(near, seed, diagonal)


#: Side of the tiles that are labelled on their own first.
TILE = 512


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least that edges (u, v) connect it to."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def settled(edges: DataFrame) -> DataFrame:
    """``(u, r)`` from ``edges(u, v)``: the least node that each node is connected to, for nodes other than that one.

    Alternating large and small stars, each round a written table and the one before deleted.  A round leaves a
    forest of stars as it is and brings any other nearer to one, so rounds end.
    """
    e, before = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()), None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select("u", F.col("v").alias("r"))
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        old, e = e, _written(big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low).distinct())
        before = now
        _drop(old)


def labels(df: DataFrame, cls: str = "label", diagonal: bool = False, width: int = 1 << 31) -> DataFrame:
    """``(y, x, cls, region)``: connected equal-class pixels; a region's id is its least ``y * width + x``.  A pixel without a class is a region of its own."""
    return grown(df.select("y", "x", cls), [cls], lambda a, b: a[cls] == b[cls], diagonal, width)


def grown(df: DataFrame, cols: list[str], alike: Callable, diagonal: bool = False, width: int = 1 << 31) -> DataFrame:
    """``(y, x, cols.., region)``: pixels connected through neighbours that are ``alike``; a region's id is its least ``y * width + x``.

    ``alike(a, b)`` compares two pixels given as mappings from name to value; it is
    asked with arrays inside a tile and with columns over tile borders, so it is
    written in operators that both have.  Nulls and NaN are alike to nothing.
    Tiles are labelled on their own, one shuffle; `settled` then joins regions
    over the tiles' borders only.
    """
    size, half = TILE, [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    kinds = {c: df.schema[c].dataType.simpleString() for c in cols}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable").reset_index(drop=True)
        y, x = pdf["y"].to_numpy() - key[0] * size, pdf["x"].to_numpy() - key[1] * size
        whole = pdf[cols].notna().all(axis=1).to_numpy()
        values = {c: pdf[c].to_numpy() for c in cols}
        at = np.full((size + 2, size + 2), -1)
        at[y + 1, x + 1] = np.arange(len(pdf))
        sides = []
        for dy, dx in half:
            other = at[y + 1 + dy, x + 1 + dx]
            one = np.flatnonzero((other >= 0) & whole & whole[other])
            other = other[one]
            same = np.asarray(alike({c: v[one] for c, v in values.items()}, {c: v[other] for c, v in values.items()}), dtype=bool)
            sides.append((one[same], other[same]))
        root = _joined(len(pdf), *(np.concatenate(s) for s in zip(*sides)))
        ids = pdf["y"].to_numpy() * width + pdf["x"].to_numpy()
        return pdf[["y", "x", *cols]].assign(part=ids[root])

    nodes = df.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), *cols)
    tile = [F.floor(F.col(c) / size).alias(f"t{c}") for c in "yx"]
    local = nodes.select("*", *tile).groupBy("ty", "tx").applyInPandas(run, "y bigint, x bigint, " + "".join(f"`{c}` {k}, " for c, k in kinds.items()) + "part bigint")
    local = _written(local)
    edge = local.filter(" OR ".join(f"{c} % {size} IN (0, {size - 1})" for c in "yx"))
    there = _spread(edge.select("y", "x", F.struct(*cols).alias("_a"), F.col("part").alias("u")), half)
    here = edge.select("y", "x", F.struct(*cols).alias("_b"), F.col("part").alias("v"))
    whole = [F.nanvl(F.col(f"{s}.{c}").cast("double"), F.lit(None).cast("double")).isNotNull() if kinds[c] in ("double", "float") else F.col(f"{s}.{c}").isNotNull() for s in ("_a", "_b") for c in cols]
    pairs = there.join(here, ["y", "x"]).filter(reduce(lambda a, b: a & b, whole) & alike(*({c: F.col(f"{s}.{c}") for c in cols} for s in ("_a", "_b"))))
    root = settled(pairs.select("u", "v"))
    return local.join(root.withColumnRenamed("u", "part"), "part", "left").select("y", "x", *cols, F.coalesce("r", "part").alias("region"))


def border_votes(lab: DataFrame, cls: str) -> DataFrame:
    """``(region, other, cls, n)``: neighbouring pixel pairs between regions (4-connected)."""
    n = _spread(lab.select("y", "x", F.col("region").alias("from")), _steps(False))
    return n.join(lab, ["y", "x"]).filter(F.col("region") != F.col("from")).groupBy(F.col("from").alias("region"), F.col("region").alias("other"), cls).agg(F.count(F.lit(1)).alias("n"))


def sieve(df: DataFrame, cls: str, least: int, diagonal: bool = False, remove: bool = False) -> DataFrame:
    """Regions under ``least`` pixels take their border's commonest class (ties: the smaller), or 0 with ``remove``."""
    lab = _written(labels(df, cls, diagonal))
    small = lab.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") < least)
    votes = border_votes(lab, cls).groupBy("region", cls).agg(F.sum("n").alias("n")).groupBy("region").agg(F.min_by(cls, F.struct(-F.col("n"), F.col(cls))).alias("vote"))
    new = small.join(votes, "region", "left").select("region", (F.lit(0) if remove else F.col("vote")).alias("vote"), F.lit(True).alias("small"))
    out = lab.join(new, "region", "left")
    return out.select("y", "x", F.when(F.col("small") & F.col("vote").isNotNull(), F.col("vote")).otherwise(F.col(cls)).alias(cls))


def segment(df: DataFrame, radius: int = 1, levels: int = 32, low: float = 0.0, high: float = 1.0, least: int = 50) -> DataFrame:
    """Smooth, quantise, 8-connected regions, and small regions joined to the neighbour with the longest border."""
    from .focal import mean_filter

    q = F.least(F.floor((F.col("value") - low) / (high - low) * levels), F.lit(levels - 1)).cast("int")
    lab = _written(labels(mean_filter(df, 2 * radius + 1).select("y", "x", q.alias("label")), "label", True))
    size = lab.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    votes = border_votes(lab, "label").groupBy("region", "other").agg(F.sum("n").alias("n"))
    to = votes.join(size.filter(F.col("size") < least).select("region"), "region", "left_semi").join(size.filter(F.col("size") >= least).select(F.col("region").alias("other")), "other", "left_semi").groupBy("region").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("to"))
    return lab.join(to, "region", "left").select("y", "x", F.coalesce("to", "region").alias("segment_id"))


def regions(df: DataFrame, cls: str, diagonal: bool = False) -> DataFrame:
    """One row a region: class, area, boundary length and box."""
    lab = _written(labels(df, cls, diagonal))
    inner = _spread(lab.select("y", "x", "region"), [(0, 1), (1, 0)]).join(lab.select("y", "x", "region"), ["y", "x", "region"]).groupBy("region").agg(F.count(F.lit(1)).alias("inner"))
    g = lab.groupBy("region").agg(F.first(cls).alias("dn"), F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    return g.join(inner, "region", "left").select("region", "dn", "area", (4 * F.col("area") - 2 * F.coalesce("inner", F.lit(0))).alias("boundary"), "y0", "x0", "y1", "x1")
