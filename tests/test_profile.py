"""Points along lines."""

from gridloom.operators import spatial as S


def test_points_on_pixel_edges(spark):
    """A line whose length is not exactly 15 as doubles go: every second point lies on a row's edge."""
    x = ((30027 * 6007) % 10007) / 100.07
    line = spark.createDataFrame([(30027, x, 0.0, x + 12, 9.0)], "line long, x0 double, y0 double, x1 double, y1 double")
    pixels = spark.createDataFrame([(y, c, 100.0 * y + c) for y in range(10) for c in range(115)], "y long, x long, value double")
    got = {r.k: r.value // 100 for r in S.profile(pixels, line, 2.5).collect()}
    assert got == {0: 0, 1: 1, 2: 3, 3: 4, 4: 6, 5: 7, 6: 9}
