"""Chat formatting: every participant in turn as the assistant.

For each participant of a conversation the dialogue is rendered with that
speaker as ``assistant``, all others as named users, and masks over what the
assistant says.  DataFrame functions only.

A row holds a segment of the dialogue: ``SEGMENT`` messages in the order of the
conversation.  Nearly every dialogue is one segment; a longer one is several,
each with its offset in the whole rendering, so that no dialogue, however long,
is gathered in one task and its segments put together are the whole.  Only
messages of longer dialogues are counted off: one sort by ranges and the counts
of each dialogue per range give places, without a window over a dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small, written

#: Messages of a segment.
SEGMENT = 1024
#: The marks of a rendered message.
BEGIN, USER, END = "<|im_start|>", "user name=", "<|im_end|>\n"


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``k``, each message's place in its conversation by turn, role, text."""
    by = [F.asc_nulls_first("conv"), "turn", "role", "say", "at"]  # the last deals equal messages over ranges
    ranged = written(rows.orderBy(*by).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("n")), "messages")
    counts = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("first"))
    before = F.sum("many").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("conv").alias("c"), F.col("range").alias("r"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    starts = small(written(starts, "starts"), 1_000_000)
    return ranged.join(starts, _same("conv", "c") & (F.col("range") == F.col("r"))).withColumn("k", F.col("n") + F.col("shift")).drop("c", "r", "shift", "n", "range")


def offsets(rows: DataFrame, instructions: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Characters before each segment: ``(c3, s3, shared)`` with every message as a user's,
    and ``(c4, s4, who, said)``, the speaker's messages before a segment that they speak
    in or after (a speaker's rendering differs by the head of their own messages only)."""
    head = F.length("role") + F.when(F.col("role").isin(*instructions), 0).otherwise(len(USER)) + len(BEGIN) + 1
    sums = rows.groupBy("conv", "segment", "role").agg(F.sum(head + F.length("say") + len(END)).alias("chars"), F.count(F.lit(1)).alias("many"))
    sums = written(sums, "segment-lengths")
    earlier = lambda *by: Window.partitionBy(*by).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.groupBy("conv", "segment").agg(F.sum("chars").alias("chars"))
    whole = whole.select(F.col("conv").alias("c3"), F.col("segment").alias("s3"), F.coalesce(F.sum("chars").over(earlier("conv")), F.lit(0)).alias("shared"))
    # every speaker and segment, also those without a message of theirs
    every = sums.select("conv", "segment").distinct().join(sums.select(F.col("conv").alias("c"), F.col("role").alias("who")).distinct(), _same("conv", "c"))
    own = every.join(sums.select(F.col("conv").alias("c5"), F.col("segment").alias("s5"), F.col("role").alias("r5"), "many"), _same("conv", "c5") & (F.col("segment") == F.col("s5")) & (F.col("who") == F.col("r5")), "left")
    own = own.select(F.col("conv").alias("c4"), F.col("segment").alias("s4"), "who", F.coalesce(F.sum("many").over(earlier("conv", "who")), F.lit(0)).alias("said"))
    return whole, own


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", instructions: tuple[str, ...] = ("system",)) -> DataFrame:
    """Rows ``(conv_id, speaker, segment, offset, n_messages, n_target, text, masks)``.

    One row per conversation, participant and segment of ``SEGMENT`` messages.
    ``text`` is the rendered segment and ``offset`` its first character's place
    in the participant's whole rendering; ``masks`` lists, in the same places,
    the character ranges ``start-end`` (end exclusive) that the assistant says,
    closing mark included, joined by commas; ``n_target`` counts those
    characters.  Roles in ``instructions`` are no participants: they are
    rendered as themselves and never masked.  A segment without the speaker has
    empty masks.

    Order of messages: turn, role, text.  A null role reads ``unknown``, a null
    text is empty, a null turn comes first (as turn -1); null conversation ids
    are one conversation; repeated rows are repeated messages; other columns are
    ignored; an empty table gives an empty result.
    """
    turn = F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-1))
    rows = df.select(F.col(conv_col).alias("conv"), turn.alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("say"), F.monotonically_increasing_id().alias("at"))
    long = written(rows.groupBy("conv").count().filter(F.col("count") > SEGMENT).select(F.col("conv").alias("c")), "long-conversations")
    hot = _same("conv", "c")
    kept = ["conv", "segment", "turn", "role", "say"]
    cut = rows.join(small(long, 1_000_000), hot, "left_anti").withColumn("segment", F.lit(0).cast("bigint")).select(kept)
    some = not long.isEmpty()
    if some:
        later = written(placed(rows.join(small(long, 1_000_000), hot, "left_semi")).withColumn("segment", F.floor(F.col("k") / SEGMENT).cast("bigint")).select(kept), "placed")
        cut = cut.union(later)
    segments = cut.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "say"))).alias("messages"))
    speakers = rows.filter(~F.col("role").isin(*instructions)).select(F.col("conv").alias("c2"), F.col("role").alias("speaker")).distinct()
    each = segments.join(speakers, _same("conv", "c2")).withColumn("offset", F.lit(0).cast("bigint"))
    if some:
        whole, own = offsets(later, instructions)
        each = each.join(whole, _same("conv", "c3") & (F.col("segment") == F.col("s3")), "left").join(own, _same("conv", "c4") & (F.col("segment") == F.col("s4")) & (F.col("speaker") == F.col("who")), "left")
        change = len("assistant") - len(USER) - F.length("speaker")
        each = each.withColumn("offset", F.coalesce(F.col("shared") + F.col("said") * change, F.lit(0)).cast("bigint"))

    def line(m):
        kind = F.when(m["role"] == F.col("speaker"), F.lit("assistant")).when(m["role"].isin(*instructions), m["role"]).otherwise(F.concat(F.lit(USER), m["role"]))
        return F.struct(F.concat(F.lit(BEGIN), kind, F.lit("\n")).alias("head"), F.concat(m["say"], F.lit(END)).alias("body"), (m["role"] == F.col("speaker")).alias("target"))

    each = each.withColumn("lines", F.transform("messages", line))
    start = F.struct(F.col("offset").alias("at"), F.array().cast("array<string>").alias("masks"), F.lit(0).cast("bigint").alias("n"))

    def walk(acc, x):
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
        return F.struct(b.cast("bigint").alias("at"), F.when(x["target"], F.concat(acc["masks"], F.array(span))).otherwise(acc["masks"]).alias("masks"), (acc["n"] + F.when(x["target"], F.length(x["body"])).otherwise(0)).cast("bigint").alias("n"))

    each = each.withColumn("spans", F.aggregate("lines", start, walk))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"])), "")
    return each.select(F.col("conv").alias(conv_col), "speaker", "segment", "offset", F.size("lines").cast("bigint").alias("n_messages"), F.col("spans.n").alias("n_target"), text.alias("text"), F.array_join("spans.masks", ",").alias("masks"))


SQL = f"""
WITH m AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS say FROM conversations),
     p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, say) - 1 AS k FROM m),
     s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM m WHERE role <> 'system'),
     r AS (SELECT p.*, s.speaker, '{BEGIN}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role ELSE '{USER}' || role END || chr(10) AS head, say || '<|im_end|>' || chr(10) AS body FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.c),
     o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT conv_id, speaker, cast(k // {SEGMENT} AS bigint) AS segment, cast(min(before) AS bigint) AS "offset", count(*) AS n_messages,
       cast(coalesce(sum(length(body)) FILTER (WHERE role = speaker), 0) AS bigint) AS n_target,
       string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(cast(before + length(head) AS bigint) || '-' || cast(before + length(head) + length(body) AS bigint), ',' ORDER BY k) FILTER (WHERE role = speaker), '') AS masks
FROM o GROUP BY conv_id, speaker, k // {SEGMENT}
"""
