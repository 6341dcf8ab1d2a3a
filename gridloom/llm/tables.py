"""Small helpers that the text operators share: reading, shared folders, exact checkpoints."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``.  Where that is unset, local mode takes a temporary
    folder of this machine and a cluster is refused: its executors would not see one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = getattr(spark, "_gridloom_shared", None) or tempfile.mkdtemp(prefix="spark-gridloom-")
        spark._gridloom_shared = folder
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and any
    executor can read it after another one is lost."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return placed_at(spark.read.schema(df.schema).parquet(path), path)


def placed_at(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads the files at ``path``, marked so that `drop` finds them."""
    df._gridloom_path = path
    return df


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables from `written` (or marked by `placed_at`); nothing that still reads them may be used again."""
    for df in tables:
        if path := getattr(df, "_gridloom_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver forget what no frame refers to any more: shuffle files and broadcasts
    of finished steps go with it, and a long job's driver stays small."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has ``most`` rows at most; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Names a row of a table of files; see ``numbered``.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``, which names a row for good: the file's path (as its
    md5) and the row's place in the file.  Splits, executors and readings do not
    move it, so a decision on rows can be taken in one reading and applied in
    another; ids may be null or repeated.

    ``docs`` is a table just read from files.  Other frames are written once
    and named by what was written: keep that frame for both readings.
    """
    name = F.struct(F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))).alias("file"), F.col("_metadata.row_index").alias("at")).alias(ROW)
    try:
        if "_metadata" not in docs.columns:
            return docs.select("*", name)
    except AnalysisException:  # no files below
        pass
    return written(docs.withColumn(ROW, F.struct(F.lit(None).cast("binary").alias("file"), F.monotonically_increasing_id().alias("at"))), "numbered")


def without(rows: DataFrame, gone: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` (from `numbered`) without those named in ``gone`` (a column ``ROW``), and without ``ROW``; up to ``most`` names are broadcast."""
    gone = written(gone.select(ROW).distinct(), "rows-to-go")
    return rows.join(small(gone, most), ROW, "left_anti").drop(ROW)


def with_text(df: DataFrame, text: str, kept: list[str]) -> tuple[DataFrame, list[str]]:
    """``(rows, path)``: ``rows._kept`` is the struct of columns ``kept``; ``path`` leads
    to the text in the record batch of ``rows``.  A text that stands in ``kept``
    already, as itself or as a field (``"row.text"``), is not sent twice."""
    names = text.split(".")
    held = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept")
    if names[0] in kept and df.select(text).dtypes[0][1] == "string":
        return df.select(held), ["_kept", *names]
    return df.select(held, F.col(text).cast("string").alias("_text")), ["_text"]


def texts_of(batch: pa.RecordBatch, path: list[str]) -> pa.Array:
    column = batch.column(path[0])
    return pc.struct_field(column, path[1:]) if path[1:] else column


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for this session: documents are
    long, and a worker holds a few batches of texts and ids at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
