import random

from gridloom.operators.provenance import upstream


def bfs(edges, start):
    depth, frontier = {s: 0 for s in start}, list(start)
    while frontier:
        frontier = sorted({i for o, i in edges if o in set(frontier) and i not in depth})
        d = max(depth.values()) + 1
        depth.update({i: d for i in frontier})
    return depth


def found(spark, edges, start):
    got = upstream(spark.createDataFrame(edges, "output long, input long"), spark.createDataFrame([(s,) for s in start], "asset long"))
    rows = got.collect()
    assert len({r.asset for r in rows}) == len(rows)
    return {r.asset: r.depth for r in rows}


def test_against_breadth_first(spark):
    rng = random.Random(1)
    for _ in range(2):
        edges = []
        for k in range(1, 120):
            edges += [(k, k - 1)] if rng.random() < 0.8 else [(k, rng.randrange(k)) for _ in range(rng.randint(0, 3))]
        edges += [(200, 201), (201, 202), (202, 200), (202, 50)] + edges[:5]  # a circle, repeats
        start = [119, 201, 77]
        assert found(spark, edges, start) == bfs(edges, start)


def test_circle_of_single_derivations_and_loops(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 5)]
    for start in ([4], [2], [6], [9]):
        assert found(spark, edges, start) == bfs(edges, start)


def test_a_chain_of_100_000_derivations(spark):
    edges = spark.range(100_000).selectExpr("id + 1 AS output", "id AS input")
    got = upstream(edges, spark.createDataFrame([(100_000,)], "asset long"))
    assert got.count() == 100_001 and got.filter("depth + asset <> 100000").isEmpty()
