"""Block files: round trip, and blocks and bands that are not asked for stay unread."""

from pathlib import Path

import pytest

from gridloom.sources import blocks as B

ROWS = [(y, x, float(y * 100 + x), None if x == 7 else y / 2) for y in range(-5, 20) for x in range(30) if (y, x) != (3, 3)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "r")
    df = spark.createDataFrame([*ROWS, (None, 1, 1.0, 1.0)], "y long, x long, a double, b double")
    assert B.write_blocks(df, path, ["a", "b"], 8) == 16  # 4 x 4 blocks
    return path


def test_round_trip(spark, stored):
    assert sorted(map(tuple, B.read_blocks(spark, stored).collect()), key=repr) == sorted(ROWS, key=repr)


def test_only_what_is_asked_for_is_read(spark, stored):
    for f in Path(stored).glob("*.block"):
        ty, tx = map(int, f.stem.split("_"))
        if (ty, tx) not in ((0, 0), (0, 1)):
            f.write_bytes(b"")  # would fail if it were opened
        else:
            f.write_bytes(f.read_bytes()[: 32 + 64 + 8 * 64])  # the second band is gone
    got = B.read_blocks(spark, stored, ["a"], (2, 1, 10, 4))
    assert got.columns == ["y", "x", "a"]
    assert sorted(map(tuple, got.collect())) == sorted(r[:3] for r in ROWS if 1 <= r[0] < 5 and 2 <= r[1] < 12)
    assert B.read_blocks(spark, stored, ["a"], (500, 500, 5, 5)).count() == 0
    with pytest.raises(Exception, match="no bands"):
        B.read_blocks(spark, stored, ["c"]).collect()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "y long, x long, a double")
    assert B.write_blocks(df, str(tmp_path / "e"), ["a"]) == 0
    assert B.read_blocks(spark, str(tmp_path / "e")).count() == 0
