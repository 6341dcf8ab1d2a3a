"""Corpus pipeline: five stages over ``documents``, each one of the text operators.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``.  All but the last return the columns of ``docs`` as they came.
Documents with null or repeated ids are rows like any other.  Stages that run
Python set the session's Arrow batches to 1,000 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, unigram
from gridloom.llm.near_texts import near_texts
from gridloom.llm.quality_rules import robust_outliers
from gridloom.llm.queries import tokenizer_file
from gridloom.llm.tables import ROW, numbered, table, text_batches, without, written
from gridloom.llm.toxicity import fit, score


def whole_rows(docs: DataFrame, *inputs: str) -> DataFrame:
    """The row as one column beside an operator's inputs, so that no name of a document can clash."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *inputs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or lie outside their group's robust ellipsoid."""
    text_batches(spark)
    return robust_outliers(whole_rows(docs, "lang", "source"), text_col="row.text", keep=["row"]).filter("kept").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored as toxic; fold 0 of 5 lends no labels."""
    text_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(whole_rows(docs), model, text_col="row.text", keep=["row"]).filter("predicted = 0").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the least by file and place; links are at
    Jaccard similarity 0.8 or more of five-word shingles."""
    text_batches(spark)
    rows = numbered(docs)
    found = near_texts(rows.select(ROW, "text"), id_col=ROW, size=5)
    return without(rows, found.filter(F.col(ROW) != F.col("component_id")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark passage."""
    rows = numbered(docs)
    return without(rows, decontamination.overlaps(rows.select(ROW, "text"), table(spark, sf_dir, "benchmark"), id_col=ROW, row_col=ROW))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text again."""
    text_batches(spark)
    file = tokenizer_file("piece_bpe_32k.model")
    coded = unigram.encode(docs, file, keep=["doc_id"], decoded=True)
    return coded.select("doc_id", "ids", "n_pieces", "ids_crc32", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can state neither the estimates, nor the classifier, nor the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
