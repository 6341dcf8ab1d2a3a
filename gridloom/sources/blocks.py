"""Raster files in blocks, as a data source of Spark that reads only the blocks and bands asked for.

A block file holds ``y0, x0, rows, columns`` (four 64-bit numbers), a byte a
pixel that says whether the pixel is there, then each band's doubles in turn
(NaN: no value), all little-endian.  ``meta.json`` names bands and block size.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = 32


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or a URI."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


def _put(path: str, name: str, data: bytes) -> None:
    """Whole files only: an attempt that is lost leaves nothing under the name."""
    where, root = _opened(path)
    half = f"{root}/_{uuid.uuid4().hex}"
    with where.open_output_stream(half) as f:
        f.write(data)
    try:
        where.move(half, f"{root}/{name}")
    except OSError:  # another attempt at the same block was first, with the same bytes
        if where.get_file_info(f"{root}/{name}").type != fs.FileType.File:
            raise
        where.delete_file(half)


def write_blocks(df: DataFrame, path: str, bands: list[str], size: int = 256) -> int:
    """Write ``df(y, x, bands..)``, one row a pixel, in blocks of ``size`` x ``size`` under a new shared folder; the number of blocks.

    A block is one task's rows.  Rows without a place are left out.
    """
    where, root = _opened(path)
    where.create_dir(root, recursive=True)

    def run(key, pdf):
        ty, tx = int(key[0]), int(key[1])
        at = ((pdf["y"] - ty * size) * size + pdf["x"] - tx * size).to_numpy(dtype=np.int64)
        there = np.zeros(size * size, dtype=np.uint8)
        there[at] = 1
        out = [np.array([ty * size, tx * size, size, size], dtype="<i8").tobytes(), there.tobytes()]
        for b in bands:
            v = np.full(size * size, np.nan, dtype="<f8")
            v[at] = pdf[b].to_numpy(dtype=float)
            out.append(v.tobytes())
        _put(path, f"{ty}_{tx}.block", b"".join(out))
        return pd.DataFrame({"n": [len(pdf)]})

    px = df.filter("y IS NOT NULL AND x IS NOT NULL").select(F.col("y").cast("bigint"), F.col("x").cast("bigint"), *[F.col(b).cast("double") for b in bands])
    tiles = px.withColumns({"_ty": F.floor(F.col("y") / size), "_tx": F.floor(F.col("x") / size)})
    n = tiles.groupBy("_ty", "_tx").applyInPandas(run, "n long").count()
    _put(path, "meta.json", json.dumps({"bands": bands, "size": size}).encode())
    return n


class _Blocks(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, path, meta, bands, window, together):
        self.path, self.meta, self.bands, self.window, self.together = path, meta, bands, window, together

    def partitions(self):
        """Blocks that the window meets, by their names; no file is opened."""
        where, root = _opened(self.path)
        size, w, names = self.meta["size"], self.window, []
        for f in where.get_file_info(fs.FileSelector(root)):
            if f.base_name.endswith(".block") and not f.base_name.startswith("_"):
                y, x = (int(v) * size for v in f.base_name[: -len(".block")].split("_"))
                if w is None or (x < w[0] + w[2] and w[0] < x + size and y < w[1] + w[3] and w[1] < y + size):
                    names.append(f.base_name)
        names.sort()
        return [_Blocks(names[k : k + self.together]) for k in range(0, len(names), self.together)] or [_Blocks([])]

    def read(self, partition):
        where, root = _opened(self.path)
        for name in partition.names:
            with where.open_input_file(f"{root}/{name}") as f:
                y0, x0, rows, cols = (int(v) for v in np.frombuffer(f.read(HEAD), dtype="<i8"))
                n = rows * cols
                at = np.flatnonzero(np.frombuffer(f.read(n), dtype=np.uint8))
                y, x = y0 + at // cols, x0 + at % cols
                if self.window is not None:
                    a, b, wide, high = self.window
                    kept = (x >= a) & (x < a + wide) & (y >= b) & (y < b + high)
                    at, y, x = at[kept], y[kept], x[kept]
                columns = [pa.array(y), pa.array(x)]
                for band in self.bands:
                    f.seek(HEAD + n + 8 * n * self.meta["bands"].index(band))
                    v = np.frombuffer(f.read(8 * n), dtype="<f8")[at]
                    columns.append(pa.array(v, mask=np.isnan(v)))
            yield pa.RecordBatch.from_arrays(columns, names=["y", "x", *self.bands])


class RasterBlocks(DataSource):
    """``spark.read.format("raster_blocks")``; options ``path``, ``bands`` (b1,b2..), ``window`` (column,row,columns,rows), ``together`` (blocks a task)."""

    @classmethod
    def name(cls):
        return "raster_blocks"

    def _meta(self):
        where, root = _opened(self.options["path"])
        with where.open_input_file(f"{root}/meta.json") as f:
            return json.loads(f.read())

    def _bands(self, meta):
        bands = [b.strip() for b in self.options.get("bands", ",".join(meta["bands"])).split(",") if b.strip()]
        if unknown := [b for b in bands if b not in meta["bands"]]:
            raise ValueError(f"no bands {unknown} in {meta['bands']}")
        return bands

    def schema(self):
        return ", ".join(["y long", "x long", *[f"`{b}` double" for b in self._bands(self._meta())]])

    def reader(self, schema):
        meta = self._meta()
        window = [int(v) for v in self.options["window"].split(",")] if self.options.get("window") else None
        return _Reader(self.options["path"], meta, self._bands(meta), window, int(self.options.get("together", "16")))


def read_blocks(spark: SparkSession, path: str, bands: list[str] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``(y, x, bands..)`` of the pixels in ``window`` (first column, first row, columns, rows); all of either where not named."""
    spark.dataSource.register(RasterBlocks)
    reader = spark.read.format("raster_blocks").option("path", path)
    if bands:
        reader = reader.option("bands", ",".join(bands))
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    return reader.load()
