"""The registered queries of the text operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_rotation, decontamination, line_dedup, merkle, token_store, unigram
from .periodic_runs import periodic_runs
from .quality_classifier import quality
from .quality_rules import robust_outliers
from .simhash import near_duplicates
from .tables import new_folder, table, text_batches
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filters import rule_table, url_filter

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def keep(fn):
        def run(spark, sf_dir):
            text_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_counts")
def op10(spark, sf_dir):
    """Tokens of every whole document by byte_bpe_50k.json; limit 512."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


@query("op6_quality_rules")
def op6(spark, sf_dir):
    """Base counts and the robust outlier verdict of every whole document."""
    out = robust_outliers(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


@query("op3_toxicity")
def op3(spark, sf_dir):
    """Toxicity of every whole document; fold 0 of 5 is held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0)


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    """Quality of every whole document; fold 2 of 4 is held out."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.7)


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    """SimHash of 4-word shingles; components of links of 4 bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).select("doc_id", "fingerprint", "component_id")


#: The query's rules: longest wins.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
SQL_8 = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r(rule_host, rule_path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, coalesce(max_by(action, length(rule_host || rule_path)), 'allow') AS verdict
FROM (SELECT p.*, row_number() OVER () AS k FROM p) q LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY k, page_id, host, path
"""


@query("op8_url_filters", SQL_8)
def op8(spark, sf_dir):
    """Every page's host, path, deciding rule and verdict."""
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


@query("op2_chat_rotation", chat_rotation.SQL)
def op2(spark, sf_dir):
    """Every conversation from each participant's side."""
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


@query("op1_decontamination", decontamination.SQL)
def op1(spark, sf_dir):
    """Documents that hold benchmark passages, with the items."""
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    """Every whole document encoded by piece_bpe_32k.model's pieces and decoded again."""
    file = tokenizer_file("piece_bpe_32k.model")
    coded = unigram.encode(table(spark, sf_dir, "documents"), file, keep=["doc_id"], decoded=True)
    return coded.select("doc_id", "n_pieces", "ids_crc32", "n_chars", "round_trip")


@query("op5_token_store")
def op5(spark, sf_dir):
    """Every whole document's ids written to a content-addressed store, read back and verified."""
    path = new_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_store.verify_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op11_line_dedup", line_dedup.SQL)
def op11(spark, sf_dir):
    """Lines of 20 code points or more that three documents hold stay in the largest document only."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), least=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark, sf_dir):
    """Every document's leaf, proof and the root that its row, altered where 3 divides the id's crc32, folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": merkle.tampered("doc_id", F.col("text"))})


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    """Runs of repeated words of every whole document, the longest one, and the text without repetitions."""
    found = periodic_runs(table(spark, sf_dir, "documents"), echo=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return top.select(
        "doc_id", "n_runs", F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"), F.floor(-1000 * F.col("top.l") / F.col("top.p")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
