from gridloom.operators.pixel import spectral_index
from gridloom.streaming.pixels import applied, pixel_stream, run_available


def test_index_on_a_stream_equals_the_batch(spark, tmp_path):
    px = spark.range(100).selectExpr("id div 10 AS y", "id % 10 AS x", "cast(id AS double) AS b1", "cast(id * 2 AS double) AS b2")
    px.repartition(3).write.parquet(str(tmp_path / "in"))
    index = lambda df: df.select("y", "x", spectral_index("ndvi", n="b2", r="b1").alias("v"))
    out = applied(pixel_stream(spark, str(tmp_path / "in"), "y long, x long, b1 double, b2 double", 1), index)
    run_available(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, index(px).collect()))
