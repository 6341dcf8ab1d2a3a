from gridloom.operators.functions import table_function


def runs(spark, rows):
    """Lengths of runs of equal values, in order."""
    def step(state, row):
        if state and state[1] == row.v:
            return (row.k, row.v, state[2] + 1), []
        return (row.k, row.v, 1), [state] if state else []

    op = table_function(step, "k string, v long, n long", finish=lambda s: [s])
    return sorted(map(tuple, op(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], ["at"]).collect()), key=repr)


def test_state_order_and_end(spark):
    rows = [("a", 3, 5), ("a", 1, 5), ("a", 2, 5), ("b", 1, 5), ("a", 4, 6), (None, 1, 1), (None, 2, 1), ("b", None, 7)]
    assert runs(spark, rows) == sorted([("a", 5, 3), ("a", 6, 1), ("b", 7, 1), ("b", 5, 1), (None, 1, 2)], key=repr)


def test_one_large_partition_and_none(spark):
    assert runs(spark, [("a", k, k // 100) for k in range(20_000)]) == sorted([("a", k, 100) for k in range(200)], key=repr)
    assert runs(spark, []) == []
