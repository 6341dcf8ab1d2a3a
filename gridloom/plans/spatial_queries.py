"""Queries of the spatial, overlay, geometry and region operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expressions import clean
from ..operators import components as C
from ..operators import focal as O
from ..operators import lines, pixel, rings
from ..operators import segmentation as G
from ..operators import spatial as S
from .fixtures import ctes, load
from .focal_queries import around
from .registry import query
from .stats_queries import rounded


def _zones(spark, d):
    return load(spark, d, "zones").withColumnRenamed("zone", "id")


@query("c01_attribute_join", "SELECT n_nationkey, n_name, s.s_name AS sup_s_name FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) s ON s_nationkey = n_nationkey AND rn = 1")
def c01(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")
    sup = spark.read.parquet(f"{d}/supplier.parquet").withColumnRenamed("s_nationkey", "n_nationkey")
    return S.attribute_join(nation, sup, "n_nationkey", ["s_name"], "sup_", "s_suppkey")


@query("c02_relation", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def c02(spark, d):
    r, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    return r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")


_BOX = "b AS (SELECT id, px AS x0, py AS y0, px + 12 AS x1, py + 9 AS y1 FROM pts2), z AS (SELECT zone AS id, x0, y0, x1, y1 FROM zones)"


def _boxes(spark, d):
    return load(spark, d, "pts2").select("id", F.col("px").alias("x0"), F.col("py").alias("y0"), (F.col("px") + 12).alias("x1"), (F.col("py") + 9).alias("y1"))


@query("c03_boxes_intersect", f"{ctes('pts2', 'zones')}, {_BOX} SELECT b.id AS aid, z.id AS bid FROM b JOIN z ON b.x0 <= z.x1 AND z.x0 <= b.x1 AND b.y0 <= z.y1 AND z.y0 <= b.y1")
def c03(spark, d):
    return S.boxes_meet(_boxes(spark, d), _zones(spark, d), 20.0)


@query("c03_boxes_overlap", f"{ctes('pts2', 'zones')}, {_BOX} SELECT b.id AS aid, z.id AS bid FROM b JOIN z ON b.x0 < z.x1 AND z.x0 < b.x1 AND b.y0 < z.y1 AND z.y0 < b.y1 WHERE NOT (b.x0 >= z.x0 AND b.x1 <= z.x1 AND b.y0 >= z.y0 AND b.y1 <= z.y1)")
def c03o(spark, d):
    return S.boxes_meet(_boxes(spark, d), _zones(spark, d), 20.0, "overlaps")


@query("c03_boxes_within", f"{ctes('pts2', 'zones')}, {_BOX} SELECT b.id AS aid, z.id AS bid FROM b JOIN z ON b.x0 >= z.x0 AND b.x1 <= z.x1 AND b.y0 >= z.y0 AND b.y1 <= z.y1")
def c03w(spark, d):
    return S.boxes_meet(_boxes(spark, d), _zones(spark, d), 20.0, "within")


@query("c03_extract_by_location", f"{ctes('pts', 'zones')} SELECT id FROM pts WHERE EXISTS (SELECT 1 FROM zones WHERE class = 2 AND px >= x0 AND px < x1 AND py >= y0 AND py < y1)")
def c03e(spark, d):
    return S.points_in_boxes(load(spark, d, "pts"), load(spark, d, "zones").filter("class = 2"), 20.0).select("id").distinct()


@query("c03_points_in_polygon", f"{ctes('pts')} SELECT id FROM pts WHERE py > 10 AND px - 10 > (py - 10) / 2 AND 90 - px > (py - 10) / 2")
def c03p(spark, d):
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((10.0, 10.0), (90.0, 10.0), (50.0, 90.0))])
    return load(spark, d, "pts").filter(S.in_polygon(F.col("px"), F.col("py"), ring)).select("id")


_NEAR = f"{ctes('pts', 'pts2')}, r AS (SELECT a.id AS aid, b.id AS bid, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS distance FROM pts a, pts2 b)"


@query("c04_nearest", _NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY distance, bid) AS rank FROM r) SELECT aid, bid, round(distance, 6) AS distance, cast(rank AS integer) AS rank FROM k WHERE rank <= 3")
def c04(spark, d):
    return rounded(S.nearest(load(spark, d, "pts"), load(spark, d, "pts2"), 3), "distance")


@query("c04_nearest_features", _NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY distance, bid) AS rank FROM r WHERE distance <= 4) SELECT a.id, a.z, bid AS neighbor_id, round(b.px, 6) AS neighbor_x, round(b.py, 6) AS neighbor_y, round(distance, 6) AS distance, cast(rank AS integer) AS rank FROM k JOIN pts a ON a.id = aid JOIN pts2 b ON b.id = bid WHERE rank <= 2")
def c04f(spark, d):
    """Two neighbours at most, within 4, with their places and the rows' own attributes."""
    found = S.nearest_features(load(spark, d, "pts"), load(spark, d, "pts2"), 2, 4.0, 4.0)
    return rounded(found.drop("px", "py"), "neighbor_x", "neighbor_y", "distance")


@query("c05_distance_matrix", _NEAR + " SELECT aid, bid, round(distance, 6) AS distance FROM r WHERE bid % 20 = 0")
def c05(spark, d):
    return rounded(S.distance_matrix(load(spark, d, "pts"), load(spark, d, "pts2").filter("id % 20 = 0")), "distance")


@query("c06_radius_search", _NEAR + " SELECT aid, bid, round(distance, 6) AS distance FROM r WHERE distance <= 7")
def c06(spark, d):
    return rounded(S.within_radius(load(spark, d, "pts"), load(spark, d, "pts2"), 7.0), "distance")


_IN = f"{ctes('grid', 'zones')}, i AS (SELECT y, x, value, zone, class FROM grid JOIN zones ON x + 0.5 >= x0 AND x + 0.5 < x1 AND y + 0.5 >= y0 AND y + 0.5 < y1)"


@query("c07_training_sample", _IN + ", r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY (y * 7919 + x * 104729 + 42) % 1000003, y, x) AS rn FROM i) SELECT y, x, class, value FROM r WHERE rn <= 50")
def c07(spark, d):
    return S.sample_training(load(spark, d, "grid"), load(spark, d, "zones"), "class", 50)


@query("c08_identify", f"{ctes('ms', 'pts2')} SELECT id, b1, b2, b3, b4 FROM pts2 JOIN ms ON y = floor(py) AND x = floor(px)")
def c08(spark, d):
    p = load(spark, d, "pts2").select("id", F.floor("py").alias("y"), F.floor("px").alias("x"))
    return p.join(load(spark, d, "ms"), ["y", "x"]).select("id", "b1", "b2", "b3", "b4")


_RS = f"{ctes('dem')}, t AS (SELECT y, x, (y + 0.5) * 0.75 - 0.5 AS sy, (x + 0.5) * 0.75 - 0.5 AS sx FROM dem)"


@query("c09_resample_nearest", _RS + " SELECT t.y, t.x, round(s.value, 6) AS value FROM t JOIN dem s ON s.y = floor(sy + 0.5) AND s.x = floor(sx + 0.5)")
def c09(spark, d):
    dem = load(spark, d, "dem")
    return rounded(S.resample(dem, dem, 0.75), "value")


@query("c09_resample_bilinear", _RS + ", w AS (SELECT t.y, t.x, greatest(1 - abs(sy - s.y), 0) * greatest(1 - abs(sx - s.x), 0) AS w, s.value AS v FROM t JOIN dem s ON s.y BETWEEN floor(sy) AND floor(sy) + 1 AND s.x BETWEEN floor(sx) AND floor(sx) + 1) SELECT y, x, round(sum(w * v) / sum(w), 6) AS value FROM w GROUP BY y, x")
def c09b(spark, d):
    dem = load(spark, d, "dem")
    return rounded(S.resample(dem, dem, 0.75, method="bilinear"), "value")


def _cubic(x):
    return f"(CASE WHEN {x} <= 1 THEN 1.5 * pow({x}, 3) - 2.5 * pow({x}, 2) + 1 WHEN {x} < 2 THEN -0.5 * pow({x}, 3) + 2.5 * pow({x}, 2) - 4 * {x} + 2 ELSE 0 END)"


@query("c09_resample_cubic", _RS + f", w AS (SELECT t.y, t.x, {_cubic('abs(sy - s.y)')} * {_cubic('abs(sx - s.x)')} AS w, s.value AS v FROM t JOIN dem s ON s.y BETWEEN floor(sy) - 1 AND floor(sy) + 2 AND s.x BETWEEN floor(sx) - 1 AND floor(sx) + 2) SELECT y, x, round(sum(w * v) / sum(w), 5) AS value FROM w GROUP BY y, x")
def c09c(spark, d):
    dem = load(spark, d, "dem")
    return rounded(S.resample(dem, dem, 0.75, method="cubic"), "value", digits=5)


@query("c12_parent_link", f"{ctes('grid')}, f AS (SELECT cast(floor(x / 7) + 100 * floor(y / 3) + 1 AS bigint) AS child, label AS parent FROM grid), c AS (SELECT child, parent, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS rn FROM c) SELECT child, parent, n FROM r WHERE rn = 1")
def c12(spark, d):
    f = load(spark, d, "grid").select((F.floor(F.col("x") / 7) + 100 * F.floor(F.col("y") / 3) + 1).alias("child"), F.col("label").alias("parent"))
    n = f.filter("child <> 0 AND parent <> 0").groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("child").agg(F.min_by(F.struct("parent", "n"), F.struct(-F.col("n"), F.col("parent"))).alias("b"))
    return best.select("child", "b.parent", "b.n")


@query("d15_roi_mean_spectrum", f"{ctes('ms', 'zones')}, i AS (SELECT zone, b1, b2 FROM ms JOIN zones ON x + 0.5 >= x0 AND x + 0.5 < x1 AND y + 0.5 >= y0 AND y + 0.5 < y1) SELECT zone, 'b1' AS band, round(avg(b1), 6) AS mean, round(stddev_pop(b1), 6) AS stddev FROM i GROUP BY zone UNION ALL SELECT zone, 'b2', round(avg(b2), 6), round(stddev_pop(b2), 6) FROM i GROUP BY zone")
def d15(spark, d):
    px = load(spark, d, "ms").withColumns({"px": F.col("x") + 0.5, "py": F.col("y") + 0.5})
    long = S.points_in_boxes(px, load(spark, d, "zones"), 20.0).select("zone", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in ("b1", "b2")])).alias("p")).select("zone", "p.*")
    return rounded(long.groupBy("zone", "band").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev")), "mean", "stddev")


@query("d20_dissolve", f"{ctes('zones')} SELECT class, count(*) * 400 AS area, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM zones GROUP BY class")
def d20(spark, d):
    cover = S.coverage(load(spark, d, "zones"), ["class"]).distinct()
    g = cover.groupBy("class").agg(F.count(F.lit(1)).alias("area"), F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"), (F.max("x") + 1).cast("double").alias("x1"), (F.max("y") + 1).cast("double").alias("y1"))
    return g


def _gridded(how, expr):
    @query(f"d22_grid_{how}", f"{ctes('pts')}, c AS (SELECT cast(cy AS bigint) AS y, cast(cx AS bigint) AS x, id, z, sqrt(pow(px - (cx + 0.5) * 10, 2) + pow(py - (cy + 0.5) * 10, 2)) AS d FROM pts, range(-1, 12) a(cy), range(-1, 12) b(cx)) SELECT y, x, round({expr}, 5) AS value FROM c WHERE d <= 8 GROUP BY y, x")
    def run(spark, d):
        return rounded(S.grid_points(load(spark, d, "pts"), 10.0, 8.0, how, smoothing=1.0), "value", digits=5)


for _how, _expr in {"nearest": "min_by(z, d)", "average": "avg(z)", "invdist": "sum(z / (d * d + 1)) / sum(1 / (d * d + 1))", "minimum": "min(z)", "maximum": "max(z)", "range": "max(z) - min(z)", "count": "cast(count(z) AS double)"}.items():
    _gridded(_how, _expr)


@query("d23_rasterize", f"{ctes('pts2')}, b AS (SELECT id, px AS x0, py AS y0, px + 12 AS x1, py + 9 AS y1, z FROM pts2), c AS (SELECT cast(y AS bigint) AS y, cast(x AS bigint) AS x, z, id FROM b, range(0, 115) r(y), range(0, 115) s(x) WHERE x + 0.5 >= x0 AND x + 0.5 < x1 AND y + 0.5 >= y0 AND y + 0.5 < y1) SELECT y, x, max_by(z, id) AS value FROM c GROUP BY y, x")
def d23(spark, d):
    b = load(spark, d, "pts2").select("id", F.col("px").alias("x0"), F.col("py").alias("y0"), (F.col("px") + 12).alias("x1"), (F.col("py") + 9).alias("y1"), "z")
    return S.rasterize(b, "z", "id")


@query("f01_top_k", f"{ctes('grid')}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY value DESC, y, x) AS rank FROM grid) SELECT label, y, x, value, cast(rank AS integer) AS rank FROM r WHERE rank <= 5")
def f01(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc("value"), "y", "x")
    return load(spark, d, "grid").withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("label", "y", "x", "value", "rank")


@query("g01_merge_layers", "SELECT c_custkey AS id, c_acctbal AS z, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def g01(spark, d):
    a = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("z"), F.col("c_mktsegment").alias("segment"))
    b = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("z"), F.col("s_name").alias("other"))
    return a.unionByName(b, allowMissingColumns=True).select(*a.columns)


def _mosaic(rule, pick):
    @query(f"g0{2 if rule == 'first' else 3}_mosaic_{rule}", f"{ctes('ms_before', 'ms_after')}, u AS (SELECT y, x, b1 AS v, 0 AS k FROM ms_before UNION ALL SELECT y, x, b1, 1 FROM ms_after) SELECT y, x, {pick}(v, k) AS value FROM u WHERE v IS NOT NULL GROUP BY y, x")
    def run(spark, d):
        return S.mosaic([load(spark, d, t).select("y", "x", F.col("b1").alias("value")) for t in ("ms_before", "ms_after")], rule)


_mosaic("first", "min_by")
_mosaic("last", "max_by")


_OV = f"{ctes('pts2', 'zones')}, a AS (SELECT DISTINCT cast(y AS bigint) AS y, cast(x AS bigint) AS x FROM pts2, range(0, 115) r(y), range(0, 115) s(x) WHERE x + 0.5 >= px AND x + 0.5 < px + 12 AND y + 0.5 >= py AND y + 0.5 < py + 9), b AS (SELECT cast(y AS bigint) AS y, cast(x AS bigint) AS x, zone FROM zones, range(0, 100) r(y), range(0, 100) s(x) WHERE class < 2 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)"


def _overlay(how, sql):
    @query(f"g04_overlay_{how}", _OV + sql)
    def run(spark, d):
        a = S.coverage(_boxes(spark, d), []).distinct()
        b = S.coverage(load(spark, d, "zones").filter("class < 2"), ["zone"])
        return S.overlay(a, b, how).agg(F.count(F.lit(1)).alias("area"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


_S = " SELECT count(*) AS area, cast(sum(x) AS bigint) AS sx, cast(sum(y) AS bigint) AS sy FROM "
_overlay("intersection", _S + "a JOIN b USING (y, x)")
_overlay("clip", _S + "(SELECT y, x FROM a INTERSECT SELECT y, x FROM b)")
_overlay("difference", _S + "(SELECT y, x FROM a EXCEPT SELECT y, x FROM b)")
_overlay("union", _S + "(SELECT y, x FROM a UNION SELECT y, x FROM b)")
_overlay("symmetric", _S + "((SELECT y, x FROM a EXCEPT SELECT y, x FROM b) UNION ALL (SELECT y, x FROM b EXCEPT SELECT y, x FROM a))")


def _components(diagonal: bool) -> str:
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"WITH RECURSIVE {ctes('grid')[5:]}, p AS (SELECT y, x, label, y * 100 + x AS id FROM grid), e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.label = b.label AND {near} AND a.id <> b.id), w AS (SELECT id AS u, id AS v FROM p UNION SELECT w.u, e.v FROM w JOIN e ON w.v = e.u WHERE e.v <> w.u), l AS (SELECT u AS id, min(v) AS region FROM w GROUP BY u)"


@query("j04_clump", _components(False) + " SELECT y, x, label, region FROM p JOIN l USING (id)")
def j04(spark, d):
    return C.labels(load(spark, d, "grid"), "label", False, 100)


@query("j05_polygonize", _components(False) + ", q AS (SELECT y, x, label, region FROM p JOIN l USING (id)), i AS (SELECT a.region, count(*) AS n FROM q a JOIN q b ON a.region = b.region AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.region) SELECT q.region, min(label) AS dn, count(*) AS area, 4 * count(*) - 2 * coalesce(any_value(i.n), 0) AS boundary, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM q LEFT JOIN i ON i.region = q.region GROUP BY q.region")
def j05(spark, d):
    g = load(spark, d, "grid")
    return C.regions(g, "label").withColumn("region", F.floor(F.col("region") / (1 << 31)) * 100 + F.col("region") % (1 << 31))


@query("j01_flood_fill", f"WITH RECURSIVE {ctes('dem')[5:]}, s AS (SELECT value AS v FROM dem WHERE y = 3 AND x = 3), c AS (SELECT y, x FROM dem, s WHERE abs(value - v) <= 18), w AS (SELECT y, x FROM c WHERE y = 3 AND x = 3 UNION SELECT c.y, c.x FROM w JOIN c ON abs(c.y - w.y) + abs(c.x - w.x) = 1) SELECT y, x FROM w")
def j01(spark, d):
    return C.flood_fill(load(spark, d, "dem"), 3, 3, 18.0)


@query("j02_segment")
def j02(spark, d):
    seg = C.segment(load(spark, d, "grid"), 1, 4, 0.0, 500000.0, 20)
    return seg.groupBy("segment_id").agg(F.count(F.lit(1)).alias("area"))


_SIEVE = ", q AS (SELECT y, x, label, region FROM p JOIN l USING (id)), s AS (SELECT region FROM q GROUP BY region HAVING count(*) < 8), v AS (SELECT a.region, b.label, count(*) AS n FROM q a JOIN s USING (region) JOIN q b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.region <> b.region GROUP BY ALL), r AS (SELECT region, label AS vote, row_number() OVER (PARTITION BY region ORDER BY n DESC, label) AS k FROM v) SELECT y, x, coalesce(vote, label) AS label FROM q LEFT JOIN r ON r.region = q.region AND k = 1"


@query("j03_sieve", _components(False) + _SIEVE)
def j03(spark, d):
    return C.sieve(load(spark, d, "grid"), "label", 8)


@query("k01_centroid", f"{ctes('zones')} SELECT zone, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) * (y1 - y0) AS area FROM zones")
def k01(spark, d):
    z = load(spark, d, "zones")
    c = S.centroid(S.box_ring(*[F.col(k) for k in ("x0", "y0", "x1", "y1")]))
    return z.select("zone", c.alias("c")).select("zone", clean(F.col("c.x")).alias("cx"), clean(F.col("c.y")).alias("cy"), clean(F.col("c.area")).alias("area"))


#: A point is a corner of the hull where all others leave a gap of over half a turn around it.
_HULL = f"{ctes('pts')}, p AS (SELECT DISTINCT id % 3 AS g, px, py FROM pts), a AS (SELECT a.g, a.px, a.py, atan2(b.py - a.py, b.px - a.px) AS t FROM p a JOIN p b ON a.g = b.g AND (a.px <> b.px OR a.py <> b.py)), n AS (SELECT g, px, py, coalesce(lead(t) OVER w, min(t) OVER (PARTITION BY g, px, py) + 2 * pi()) - t AS gap FROM a WINDOW w AS (PARTITION BY g, px, py ORDER BY t)) SELECT g, px, py FROM n GROUP BY g, px, py HAVING max(gap) > pi() + 1e-12"


@query("k02_convex_hull", _HULL)
def k02(spark, d):
    p = load(spark, d, "pts").withColumn("g", F.col("id") % 3)
    return S.convex_hull(p.select("g", "px", "py"), "g")


@query("k03_single_parts", "SELECT s_nationkey, cast(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS integer) AS part, s_suppkey FROM supplier")
def k03(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    multi = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("parts"))
    return S.single_parts(multi, "parts").withColumnRenamed("ring", "s_suppkey")


@query("k04_smooth", f"{ctes('zones')} SELECT zone, 8 AS n, round(x0 + (x1 - x0) * 0.25, 6) AS first_x, round((x1 - x0) * (y1 - y0) * 0.875, 6) AS area FROM zones")
def k04(spark, d):
    ring = S.smooth(S.box_ring(*[F.col(k) for k in ("x0", "y0", "x1", "y1")]))
    z = load(spark, d, "zones").select("zone", ring.alias("ring"))
    return z.select("zone", F.size("ring").alias("n"), clean(F.get("ring", F.lit(0))["x"]).alias("first_x"), clean(S.centroid(F.col("ring"))["area"]).alias("area"))


@query("k05_buffer_cells", f"{ctes('grid')} SELECT DISTINCT t.y, t.x FROM grid t JOIN grid s ON s.value >= 450000 AND abs(s.y - t.y) <= 3 AND abs(s.x - t.x) <= 3 AND pow(s.y - t.y, 2) + pow(s.x - t.x, 2) <= 9")
def k05(spark, d):
    return O.proximity(load(spark, d, "grid"), "value >= 450000", 3).filter("distance IS NOT NULL").select("y", "x")


# --- polygons as diamonds |x - cx| + |y - cy| <= r on a half-unit lattice: SQL states their relations by the turned boxes x + y, x - y


_DIA = f"{ctes('pts', 'pts2')}, a AS (SELECT id, floor(px) AS cx, floor(py) AS cy, cast(2 + id % 16 AS double) AS r FROM pts), b AS (SELECT id, floor(px) + 0.5 AS cx, floor(py) + 0.5 AS cy, cast(4 + id % 6 AS double) AS r FROM pts2), p AS (SELECT a.id AS aid, b.id AS bid, abs(a.cx + a.cy - b.cx - b.cy) AS u, abs(a.cx - a.cy - b.cx + b.cy) AS v, a.r + b.r AS far, b.r - a.r AS more FROM a, b)"
_TESTS = {"intersects": "u <= far AND v <= far", "touches": "u <= far AND v <= far AND NOT (u < far AND v < far)", "within": "u <= more AND v <= more", "contains": "u <= -more AND v <= -more", "overlaps": "u < far AND v < far AND NOT (u <= more AND v <= more) AND NOT (u <= -more AND v <= -more)", "equals": "u = 0 AND v = 0 AND more = 0"}


def _diamonds(df, radius, half):
    x, y, r = F.floor("px") + half, F.floor("py") + half, radius.cast("double")
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return df.select("id", F.array(corner(x + r, y), corner(x, y + r), corner(x - r, y), corner(x, y - r)).alias("ring"))


def _related(how, sql):
    @query(f"c03_polygons_{how}", f"{_DIA} SELECT aid, bid FROM p WHERE {sql}")
    def run(spark, d):
        a = _diamonds(load(spark, d, "pts"), 2 + F.col("id") % 16, 0.0)
        return rings.rings_meet(a, _diamonds(load(spark, d, "pts2"), 4 + F.col("id") % 6, 0.5), 16.0, how)


for _how, _sql in _TESTS.items():
    if _how != "equals":
        _related(_how, _sql)


@query("c03_polygons_equal", f"{ctes('pts')}, a AS (SELECT id, floor(px) AS cx, floor(py) AS cy, cast(2 + id % 16 AS double) AS r FROM pts) SELECT a.id AS aid, b.id AS bid FROM a JOIN a b ON a.cx = b.cx AND a.cy = b.cy AND a.r = b.r")
def c03q(spark, d):
    a = _diamonds(load(spark, d, "pts"), 2 + F.col("id") % 16, 0.0)
    return rings.rings_meet(a, a, 16.0, "equals")


@query("c03_polygons_disjoint", f"{_DIA} SELECT aid, bid FROM p WHERE bid % 20 = 0 AND NOT (u <= far AND v <= far)")
def c03d(spark, d):
    """The stated set of ids divisible by 20 against all."""
    a = _diamonds(load(spark, d, "pts"), 2 + F.col("id") % 16, 0.0)
    b = _diamonds(load(spark, d, "pts2").filter("id % 20 = 0"), 4 + F.col("id") % 6, 0.5)
    return rings.rings_meet(a, b, 16.0, "disjoint")


@query("c03_lines_cross", f"{ctes('pts', 'pts2')}, a AS (SELECT id, floor(px) AS x, floor(py) AS y, cast(1 + id % 9 AS double) AS n FROM pts), b AS (SELECT id, floor(px) + 0.5 AS cx, floor(py) + 0.5 AS cy, cast(4 + id % 6 AS double) AS r FROM pts2), p AS (SELECT a.id AS aid, b.id AS bid, x AS lo, x + n AS hi, cx - (r - abs(y - cy)) AS f, cx + (r - abs(y - cy)) AS t, abs(y - cy) < r AS met FROM a, b) SELECT aid, bid FROM p WHERE met AND greatest(lo, f) < least(hi, t) AND NOT (lo >= f AND hi <= t)")
def c03l(spark, d):
    """Level lines that lie partly inside and partly outside of diamonds."""
    end = lambda x: F.struct(x.cast("double").alias("x"), F.floor("py").cast("double").alias("y"))
    a = load(spark, d, "pts").select("id", F.array(end(F.floor("px")), end(F.floor("px") + 1 + F.col("id") % 9)).alias("ring"))
    return rings.rings_meet(a, _diamonds(load(spark, d, "pts2"), 4 + F.col("id") % 6, 0.5), 16.0, "crosses", line=True)


# --- frames: a square with a square hole (a third of them without) and a square part beside it; SQL compares the unit cells and the lattice points of both


def _frame_sql(t: str, k: int) -> str:
    shape = f"SELECT id, cast(floor(px) AS bigint) AS x, cast(floor(py) AS bigint) AS y, cast({k} + id % 4 AS bigint) AS s, id % 3 AS kind FROM {t}"
    return f"SELECT id, x + i AS cx, y + j AS cy FROM ({shape}), range(0, 16) a(i), range(0, 16) b(j) WHERE (i < s AND j < s AND (kind = 0 OR i = 0 OR j = 0 OR i = s - 1 OR j = s - 1)) OR (i BETWEEN s + 1 AND s + 2 AND j < 2)"


_FRAMES = f"{ctes('pts', 'pts2')}, a AS MATERIALIZED ({_frame_sql('pts', 3)}), b AS MATERIALIZED ({_frame_sql('pts2', 5)}), va AS (SELECT DISTINCT id, cx + i AS vx, cy + j AS vy FROM a, range(0, 2) r(i), range(0, 2) q(j)), vb AS (SELECT DISTINCT id, cx + i AS vx, cy + j AS vy FROM b, range(0, 2) r(i), range(0, 2) q(j)), na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id), near AS (SELECT DISTINCT va.id AS aid, vb.id AS bid FROM va JOIN vb USING (vx, vy)), same AS (SELECT a.id AS aid, b.id AS bid, count(*) AS k FROM a JOIN b USING (cx, cy) GROUP BY ALL) SELECT aid, bid, k IS NULL AS touches, coalesce(k = na.n, false) AS within, coalesce(k = nb.n, false) AS contains, coalesce(k < na.n AND k < nb.n, false) AS overlaps FROM near LEFT JOIN same USING (aid, bid) JOIN na ON na.id = aid JOIN nb ON nb.id = bid"


def _frames(df, k):
    x, y, s = F.floor("px").cast("double"), F.floor("py").cast("double"), (k + F.col("id") % 4).cast("double")
    box = lambda x0, y0, w: F.array(*[F.struct((x0 + w * i).alias("x"), (y0 + w * j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    solid = F.array(box(x, y, s), box(x + s + 1, y, F.lit(2.0)))
    return df.select("id", F.when(F.col("id") % 3 == 0, solid).otherwise(F.concat(solid, F.array(box(x + 1, y + 1, s - 2)))).alias("ring"))


@query("c03_multipolygons", _FRAMES)
def c03m(spark, d):
    """Polygons of two parts, most with a hole: what holds of every pair that meets."""
    found = rings.rings_relate(_frames(load(spark, d, "pts"), 3), _frames(load(spark, d, "pts2"), 5), 16.0)
    return found.select("aid", "bid", *[F.array_contains("predicates", p).alias(p) for p in ("touches", "within", "contains", "overlaps")])


@query("c06_rectangle_search", f"{ctes('pts', 'pts2')}, q AS (SELECT id AS box, floor(px) AS x0, floor(py) AS y0, floor(px) + 15 AS x1, floor(py) + 10 AS y1 FROM pts2 WHERE id % 20 = 0) SELECT box, id FROM q JOIN pts ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1")
def c06r(spark, d):
    q = load(spark, d, "pts2").filter("id % 20 = 0").select(F.col("id").alias("box"), F.floor("px").cast("double").alias("x0"), F.floor("py").cast("double").alias("y0"), (F.floor("px") + 15).cast("double").alias("x1"), (F.floor("py") + 10).cast("double").alias("y1"))
    return S.points_in_boxes(load(spark, d, "pts"), q, 16.0, closed=True).select("box", "id")


@query("c07_profile", f"{ctes('grid', 'pts2')}, l AS (SELECT id AS line, px AS x0, py AS y0, px + 12 AS x1, py + 9 AS y1 FROM pts2), k AS (SELECT line, cast(k AS integer) AS k, k * 2.5 AS distance, cast(floor(y0 + 9 * k * 2.5 / 15) AS bigint) AS y, cast(floor(x0 + 12 * k * 2.5 / 15) AS bigint) AS x FROM l, range(0, 7) r(k)) SELECT line, k, cast(distance AS double) AS distance, value FROM k LEFT JOIN grid USING (y, x)")
def c07p(spark, d):
    lines = load(spark, d, "pts2").select(F.col("id").alias("line"), F.col("px").alias("x0"), F.col("py").alias("y0"), (F.col("px") + 12).alias("x1"), (F.col("py") + 9).alias("y1"))
    return S.profile(load(spark, d, "grid"), lines, 2.5)


@query("c13_fusion_join", f"{ctes('grid', 'ms')}, t AS (SELECT y, x, value AS pan, floor((y + 0.5) * 0.5) AS ty, floor((x + 0.5) * 0.5) AS tx FROM grid) SELECT t.y, t.x, pan, b1, b2 FROM t JOIN ms s ON s.y = ty AND s.x = tx")
def c13(spark, d):
    """Multispectral pixels of twice the size brought to the panchromatic grid."""
    return S.fusion_pixels(load(spark, d, "ms").select("y", "x", "b1", "b2"), load(spark, d, "grid"), ["b1", "b2"], 0.5, method="nearest")


@query("c13_fusion_bilinear", f"{ctes('grid', 'ms')}, t AS (SELECT y, x, value AS pan, (y + 0.5) * 0.5 - 0.5 AS sy, (x + 0.5) * 0.5 - 0.5 AS sx FROM grid), w AS (SELECT t.y, t.x, pan, greatest(1 - abs(sy - s.y), 0) * greatest(1 - abs(sx - s.x), 0) AS w, s.b1, s.b2 FROM t JOIN ms s ON s.y BETWEEN floor(sy) AND floor(sy) + 1 AND s.x BETWEEN floor(sx) AND floor(sx) + 1) SELECT y, x, any_value(pan) AS pan, round(sum(w * b1) / sum(w) FILTER (WHERE b1 IS NOT NULL), 6) AS b1, round(sum(w * b2) / sum(w) FILTER (WHERE b2 IS NOT NULL), 6) AS b2 FROM w GROUP BY y, x")
def c13b(spark, d):
    return rounded(S.fusion_pixels(load(spark, d, "ms").select("y", "x", "b1", "b2"), load(spark, d, "grid"), ["b1", "b2"], 0.5), "b1", "b2")


@query("b18_cutline", f"{ctes('grid')} SELECT y, x, value FROM grid WHERE y + 0.5 > 5 AND x + 0.5 - 8 > (y + 0.5 - 5) / 2 AND 93 - x - 0.5 > (y + 0.5 - 5) / 2")
def b18p(spark, d):
    ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((8.0, 5.0), (93.0, 5.0), (50.5, 90.0))])
    return pixel.cutline(load(spark, d, "grid"), ring).select("y", "x", "value")


@query("j02_watershed_basins", around("dem", 1, clamp=False).replace("SELECT t.y, t.x, dy, dx, v.value", "SELECT t.y, t.x, dy, dx, v.y AS vy, v.x AS vx, v.value").replace("WITH ", "WITH RECURSIVE ", 1) + ", p AS (SELECT y, x, min({'v': value, 'a': vy, 'b': vx}) AS low FROM n GROUP BY y, x), r(y, x, a, b) AS (SELECT y, x, low.a, low.b FROM p UNION SELECT r.y, r.x, p.low.a, p.low.b FROM r JOIN p ON p.y = r.a AND p.x = r.b WHERE p.low.a <> r.a OR p.low.b <> r.b), fin AS (SELECT r.* FROM r JOIN p ON p.y = r.a AND p.x = r.b AND p.low.a = r.a AND p.low.b = r.b) SELECT fin.y, fin.x, value, a * 2147483648 + b AS region FROM fin JOIN dem USING (y, x)")
def j02b(spark, d):
    """Where water runs to from every pixel."""
    return G.basins(load(spark, d, "dem"))


@query("j02_watershed")
def j02w(spark, d):
    """Basins deeper than 8, shallower ones joined over their passes."""
    return G.watershed(load(spark, d, "dem"), 8.0)


@query("j02_lsms")
def j02l(spark, d):
    """Mean-shift segments of 6 pixels or more over two bands."""
    px = load(spark, d, "ms").filter("b1 IS NOT NULL").select("y", "x", "b1", "b2")
    return G.lsms(px, ["b1", "b2"], 2, 12.0, 3, 6)


@query("j05_region_rings")
def j05r(spark, d):
    """Boundary rings of the classes' regions."""
    found = lines.region_rings(C.labels(load(spark, d, "grid")))
    return found.select("region", "ring", "hole", "area", F.size("points").alias("n_corners"))


@query("j05_ring_areas", f"{ctes('grid')} SELECT label, cast(count(*) AS double) AS area FROM grid GROUP BY label")
def j05a(spark, d):
    """Signed ring areas of a class add up to its pixels."""
    lab = C._written(C.labels(load(spark, d, "grid")))
    of = lab.select("region", "label").distinct()
    return lines.region_rings(lab).join(of, "region").groupBy("label").agg(F.sum("area").alias("area"))


_SIDES = f"{ctes('dem')}, s AS (SELECT a.y, a.x, 0 AS dy, 1 AS dx, a.value AS p, b.value AS q FROM dem a JOIN dem b ON b.y = a.y AND b.x = a.x + 1 WHERE EXISTS (SELECT 1 FROM dem c JOIN dem d ON d.y = c.y AND d.x = c.x + 1 WHERE c.x = a.x AND abs(c.y - a.y) = 1) UNION ALL SELECT a.y, a.x, 1, 0, a.value, b.value FROM dem a JOIN dem b ON b.x = a.x AND b.y = a.y + 1 WHERE EXISTS (SELECT 1 FROM dem c JOIN dem d ON d.x = c.x AND d.y = c.y + 1 WHERE c.y = a.y AND abs(c.x - a.x) = 1)), l AS (SELECT s.*, k * 10.0 + 0.5 AS level FROM s, range(0, 6) r(k) WHERE (p >= k * 10.0 + 0.5) <> (q >= k * 10.0 + 0.5))"


@query("e15_contour_points", _SIDES + " SELECT DISTINCT level::double AS level, round(x + 0.5 + dx * (level - p) / (q - p), 6) AS px, round(y + 0.5 + dy * (level - p) / (q - p), 6) AS py FROM l")
def e15p(spark, d):
    """Every interpolated crossing of a cell side lies on a line."""
    found = lines.contour_lines(load(spark, d, "dem"), 10.0, 0.5, simplify=False)
    return found.select("level", F.explode("points").alias("p")).select("level", clean(F.col("p.x")).alias("px"), clean(F.col("p.y")).alias("py")).distinct()


@query("e15_contour_lines")
def e15l(spark, d):
    """Lines with their points in order."""
    found = lines.contour_lines(load(spark, d, "dem"), 10.0, 0.5)
    return found.select("level", "line", "closed", F.size("points").alias("n_points"), "points")
