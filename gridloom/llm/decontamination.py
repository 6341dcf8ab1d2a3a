"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

Words of both sides are hashed; fixed masks pick some positions of a window
and ignore the others; equal hashes of the picked words join a place in a
document with a place in a benchmark item; the words that each hit lines up
are compared, and a stretch of up to 20 words with at most 3 substitutions is
an overlap.  The masks leave no such stretch unhit (every choice of 3 of 20
positions is avoided by one of them at some offset); items of 11, 12 and 14
words have too few offsets for that and get one shorter mask more.

Windows of a benchmark that fits the byte bound are broadcast: a document's
places meet them inside their task, and only hits leave it.  A larger benchmark
meets them in a shuffled join of (row, place, key) alone, whose skewed keys Spark
splits; the hits' documents are then read again for the comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ROW, numbered, small, written

#: 1 is a position that counts.  Span 11, weight 6.
MASKS = ["11001000111", "11000101011", "11001100011"]
SPAN, WINDOW, WRONG = 11, 20, 3
#: Item lengths at which ``MASKS`` leave some stretch unhit, and the mask that closes them.
TIGHT, TIGHT_MASK = (11, 12, 14), "111111"
#: Windows (keys, items, places) and passages are broadcast up to so many bytes each, by their sizes counted before; larger ones are shuffled.
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashed(arr: Column) -> Column:
    return F.transform(arr, lambda w: F.xxhash64(w))


def key(arr: Column, at: Column, mask: str) -> Column:
    """Hash of the mask's words from 0-based position ``at``; masks differ by their seed."""
    picked = [F.get(arr, at + k) for k, c in enumerate(mask) if c == "1"]
    return F.xxhash64(F.lit(mask), *picked)


def item_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, passage)``: every item with a word, as its words."""
    return benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col).cast("string")).alias("passage")).filter(F.size("passage") > 0)


def item_windows(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(key, item, place)`` rows of all items, and the masks in use.

    Items shorter than the span are one window of all their words; each such
    length adds a mask of that many ones.  Items of a ``TIGHT`` length are keyed
    by ``TIGHT_MASK`` as well.
    """
    size = F.size("passage")
    lengths = [r[0] for r in items.filter((size < SPAN) | size.isin(*TIGHT)).select(size).distinct().collect()]  # a few numbers
    only = {"1" * n: [n] for n in sorted(lengths) if n < SPAN}  # masks for items of some lengths
    if tight := [n for n in lengths if n in TIGHT]:
        only[TIGHT_MASK] = only.get(TIGHT_MASK, []) + tight
    masks = MASKS + list(only)
    sides, hashes = [], items.withColumn("h", hashed(F.col("passage")))
    for m in masks:
        fit = hashes.filter(size.isin(*only[m])) if m in only else hashes.filter(size >= SPAN)
        at = fit.select("item", "h", F.explode(F.sequence(F.lit(0), F.size("h") - len(m))).alias("place"))
        sides.append(at.select(key(F.col("h"), F.col("place"), m).alias("key"), "item", "place"))
    return written(reduce(DataFrame.unionByName, sides).distinct(), "benchmark-windows"), masks


def _fits(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", row_col: str | None = None) -> DataFrame:
    """``(id_col, item_col, n_matched, n_window, first_word)``: contaminated documents and the items that they hold.

    A document holds an item when min(20, item length) consecutive words of
    both line up with at most 3 substitutions (none in items under 11 words,
    at most 15 % of a stretch under 20).  ``n_matched`` is the largest number
    of equal words in such a stretch, ``first_word`` the least document word at
    which the item would begin (0 for one cut off by the document's start).
    Rows of one id count as one document; a null id is one document, a null
    item id one item; null and empty texts hold nothing; other columns are
    ignored.  ``row_col`` names rows for good (`tables.numbered`), where the
    caller has such names; else they are made where a benchmark needs them.
    """
    items = written(item_words(benchmark, item_col, item_text), "items")
    side, masks = item_windows(items)
    least = min(map(len, masks))
    narrow = _fits(side, F.lit(64) + F.coalesce(F.length(F.col("item").cast("string")), F.lit(0)))
    if not narrow and row_col is None:
        docs, row_col = numbered(docs), ROW
    row = F.monotonically_increasing_id() if narrow else F.col(row_col)
    rows = docs.select(F.col(id_col).alias("doc"), row.alias("row"), words(F.col(text_col).cast("string")).alias("words"))
    hashes = rows.select("doc", "row", "words", hashed(F.col("words")).alias("h")).filter(F.size("h") >= least)
    places = hashes.select("doc", "row", "words", "h", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("at"))
    keyed = places.select("doc", "row", "words", "at", F.explode(F.array(*[F.when(F.col("at") + len(m) <= F.size("h"), key(F.col("h"), F.col("at"), m)) for m in masks])).alias("key"))
    begin = (F.col("at") - F.col("place")).alias("begin")
    # the words that line up with the longest item at most; hits of one alignment become one row (the aggregate
    # also keeps the comparison below out of the join)
    longest = items.agg(F.max(F.size("passage"))).first()[0] or 0
    aligned = F.slice("words", F.greatest(F.col("begin"), F.lit(0)) + 1, longest).alias("aligned")
    if narrow:
        hits = keyed.join(F.broadcast(side), "key").select("doc", "row", "words", "item", begin)
        lines = hits.select("doc", "row", "item", "begin", aligned).groupBy("doc", "row", "item", "begin").agg(F.first("aligned").alias("aligned"))
    else:
        hits = written(keyed.select("row", "at", "key").join(side, "key").select("row", "item", begin).distinct(), "hits")
        lines = rows.join(hits.hint("merge"), "row").select("doc", "row", "item", "begin", aligned)
    known = F.broadcast(items) if _fits(items, F.aggregate("passage", F.lit(32), lambda a, w: a + F.octet_length(w) + 8)) else items
    lines = lines.join(known.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of")))
    window = F.least(F.lit(WINDOW), F.size("passage"))
    cut = F.greatest(-F.col("begin"), F.lit(0))
    same = F.transform("passage", lambda w, k: F.when(k >= cut, F.coalesce((F.get("aligned", k - cut) == w).cast("int"), F.lit(0))).otherwise(0))
    lines = lines.select("doc", "item", window.alias("n_window"), F.greatest("begin", F.lit(0)).alias("first"), same.alias("same"))
    allowed = F.when(F.col("n_window") < SPAN, F.lit(0)).otherwise(F.floor(F.col("n_window") * WRONG / WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("n_window") + 1), lambda k: F.aggregate(F.slice("same", k, F.col("n_window")), F.lit(0), lambda a, x: a + x)))
    found = lines.withColumn("matched", best).filter(F.col("matched") >= F.col("n_window") - allowed)
    out = found.groupBy("doc", "item").agg(F.max("matched").cast("bigint").alias("n_matched"), F.max("n_window").cast("bigint").alias("n_window"), F.min("first").cast("bigint").alias("first_word"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_matched", "n_window", "first_word")


#: States the same without masks: of 20 words with 3 wrong, 5 right ones stand together, of shorter stretches 4.
SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS h FROM documents),
     i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS p FROM benchmark),
     n AS (SELECT DISTINCT cast(least(4, len(p)) AS bigint) AS n FROM i WHERE len(p) > 0),
     dw AS (SELECT doc_id, h, n, unnest(range(0, len(h) - n + 1)) AS a FROM d, n WHERE len(h) >= n),
     iw AS (SELECT item_id, p, n, unnest(range(0, len(p) - n + 1)) AS b FROM i, n WHERE n = least(4, len(p))),
     al AS (SELECT DISTINCT doc_id, h, item_id, p, a - b AS g, least({WINDOW}, len(p)) AS w FROM dw JOIN iw ON dw.n = iw.n AND array_to_string(h[a + 1:a + dw.n], ' ') = array_to_string(p[b + 1:b + iw.n], ' ')),
     same AS (SELECT doc_id, item_id, w, greatest(g, 0) AS f, list_transform(range(0, len(p)), lambda k: CASE WHEN g + k >= 0 AND h[g + k + 1] = p[k + 1] THEN 1 ELSE 0 END) AS e FROM al),
     best AS (SELECT *, list_max(list_transform(range(1, len(e) - w + 2), lambda k: list_sum(e[k:k + w - 1]))) AS m FROM same)
SELECT doc_id, item_id, cast(max(m) AS bigint) AS n_matched, cast(max(w) AS bigint) AS n_window, cast(min(f) AS bigint) AS first_word
FROM best WHERE m >= w - CASE WHEN w < {SPAN} THEN 0 ELSE floor(w * {WRONG} / {WINDOW}) END GROUP BY doc_id, item_id
"""
