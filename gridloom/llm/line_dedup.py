"""Line deduplication over a corpus, DataFrame functions only.

A line's key is hashed to 128 bits and the text stays where it is.  (hash,
document, position) rows are range-partitioned by hash and sorted by hash,
document (largest first) and position; one streaming pass over a hash's rows
keeps the first document's occurrences and drops the later ones.  Dropped
positions become a bitmap per document, and only bitmaps go back to the texts.

A line that very many documents hold would make one range as large as its
count.  Such hashes, fewer than ``HEAVY`` by construction, are found by a
frequency sketch, summed up by partial aggregates and met by broadcast
instead; both ways drop the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\f\r"
#: A hash of over 1 in ``SHARE`` rows is heavy.  The sketch of ``TRACKED`` counters errs by 3.5 / ``TRACKED`` of
#: all rows at most, so a heavy hash is estimated at over 1 in ``SHARE`` and under ``HEAVY`` hashes are.
SHARE, HEAVY, TRACKED = 2000, 5000, 16384
#: Lines in a word of a bitmap.
BITS = 64


def lowered(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(doc, text_hash, position, h1, h2)``: the key's hash of every line whose key has ``least`` code points or more."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(lowered(text), "\n", -1)).alias("position", "line"))
    keyed = lines.select("doc", "text_hash", "position", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.char_length("key") >= least)
    return keyed.select("doc", "text_hash", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def heavy_hashes(keys: DataFrame) -> DataFrame:
    """``(h1)``: under ``HEAVY`` rows, among them each hash that makes up over 1 in ``SHARE`` rows of ``keys``."""
    sketch = keys.agg(F.expr(f"approx_top_k(h1, {HEAVY}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    return sketch.select("n", F.explode("top").alias("top")).filter(F.col("top.count") * SHARE > F.col("n")).select(F.col("top.item").alias("h1")).distinct()


def _gone_light(keys: DataFrame) -> DataFrame:
    """Occurrences after a hash's first document where three documents or more hold it, by one pass over sorted ranges."""
    ranged = keys.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "position")
    run = Window.partitionBy("h1", "h2").orderBy(F.desc("doc"))
    last = F.last("doc").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = ranged.select("*", F.dense_rank().over(run).alias("nth"), last.alias("last"))
    return seen.filter((F.col("nth") > 2) | ((F.col("nth") == 2) & ~F.col("last").eqNullSafe(F.col("doc")))).select("doc", "text_hash", "position")


def _gone_heavy(keys: DataFrame) -> DataFrame:
    """The same for few hashes of any frequency: their first and last document and whether there is another come from partial aggregates."""
    ends = keys.groupBy("h1", "h2").agg(F.max("doc").alias("first"), F.when(~F.bool_or(F.col("doc").isNull()), F.min("doc")).alias("last"))
    other = ~F.col("doc").eqNullSafe(F.col("first")) & ~F.col("doc").eqNullSafe(F.col("last"))
    spread = keys.join(F.broadcast(ends), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("first").alias("first"), F.bool_or(other).alias("three")).filter("three")
    return keys.join(F.broadcast(spread), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "text_hash", "position")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """``(doc, text_hash, keep)``: a keep bitmap for every document that loses a line.

    A text is split at line feeds; a key is the line without blanks at both ends
    and with A-Z lower-cased.  A key of ``least`` code points or more that three
    documents hold loses its lines in all but the largest document.  ``keep``
    has a word of 64 lines per entry, ordered; a set bit is a line that stays
    and words that are not there keep all of theirs.  A bitmap belongs to each
    row of that id and text (``text_hash`` is its XXH64).  Rows that share an id
    are one document, null ids one document that comes before all others; null
    and empty texts have one empty line and lose nothing; other columns are
    ignored.
    """
    keys = written(line_keys(docs, id_col, text_col, least), "line-keys")
    heavy = written(heavy_hashes(keys), "heavy-lines")
    light = keys.join(F.broadcast(heavy), "h1", "left_anti")
    frequent = keys.join(F.broadcast(heavy), "h1", "left_semi")
    gone = _gone_light(light).union(_gone_heavy(frequent))
    bits = gone.withColumn("word", F.floor(F.col("position") / BITS).cast("int")).groupBy("doc", "text_hash", "word").agg(F.expr(f"bit_or(shiftleft(1L, cast(position % {BITS} AS int)))").alias("gone"))
    maps = bits.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("keep"))
    out = written(maps, "line-bitmaps")
    drop(keys, heavy)
    return out


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps: stretches between its words as they are, words by their bits; each line is touched once."""
    end = lambda w: (w["word"] + 1) * BITS

    def part(w: Column, k: Column) -> Column:
        begin = F.when(k > 0, end(F.get(keep, k - 1))).otherwise(0)
        bits = F.filter(F.slice(lines, w["word"] * BITS + 1, F.lit(BITS)), lambda _, j: F.getbit(w["keep"], j) == 1)
        return F.concat(F.slice(lines, begin + 1, w["word"] * BITS - begin), bits)

    tail = F.slice(lines, end(F.get(keep, F.size(keep) - 1)) + 1, F.size(lines))
    return F.concat(F.flatten(F.transform(keep, part)), tail)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """``docs`` with ``text_col`` rid of lines that repeat over documents (see `line_bitmaps`),
    and ``n_lines`` (before), ``n_dropped`` and ``keep`` (null where nothing goes); those three names replace columns of ``docs``."""
    maps = line_bitmaps(docs, id_col, text_col, least).select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep").alias("_keep"))
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(maps, F.col(f"row.{id_col}").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")), "left")
    lost = F.aggregate("_keep", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(F.bitwise_not(w["keep"])))
    fresh = {
        text_col: F.when(F.col("_keep").isNull(), text).otherwise(F.array_join(kept_lines(F.split(text, "\n", -1), F.col("_keep")), "\n")),
        "n_lines": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint"),
        "n_dropped": F.coalesce(lost, F.lit(0).cast("bigint")),
        "keep": F.col("_keep"),
    }
    same = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in fresh]
    return met.select(*same, *[v.alias(k) for k, v in fresh.items()])


SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
     many AS (SELECT key, max(doc_id) AS first FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     m AS (SELECT k.*, many.first IS NOT NULL AND doc_id <> many.first AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, cast(sum(gone::int) AS bigint) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
