"""URL filters: host-suffix and path-prefix expressions against a rule table.

Every URL is expanded into the expressions that a rule could be written as;
short hash prefixes of their digests meet the rules' in an equi join, the full
digest confirms, and the longest rule wins.  Expressions are limited, without
loss, to the numbers of host labels and the path lengths that the rule table has.

A small rule table has few kinds of expressions (labels x path lengths).  Each
kind is a column of the page and one broadcast join: pages never shuffle, so no
popular or missing URL can be a hot key.  With more kinds, or more rules than can
be broadcast, distinct (host, path) are expanded into rows, meet the rules in a
shuffled join, and the deciding rule is joined back.  Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule table up to this many rows (and ``BROADCAST_CHARS`` in all) is broadcast; a larger one is shuffled.
BROADCAST_RULES, BROADCAST_CHARS = 100_000, 20_000_000
#: Kinds of expressions (host labels x path lengths) up to which each is a column of its own.
MOST_KINDS = 24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for none."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for none."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """``(action, rule)`` rows; a rule is a host, then a path from its first ``/``."""
    return spark.createDataFrame([(a, r) for r, a in rules], "action string, rule string")


def url_filter(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``(id_col, host, path, rule, verdict)``.

    ``rules(rule, action)``: a rule fits its host and all subdomains where the
    URL's path starts with the rule's path.  The longest fitting rule decides;
    a rule written with both actions blocks.  URLs that no rule fits get
    ``default`` and a null rule.  A null URL, or one without ``://``, has empty
    host and path; null ids and repeated rows are kept; other columns are
    ignored; empty tables give empty results or defaults.
    """
    rules = rules.filter(F.col("rule").isNotNull() & F.col("action").isNotNull()).groupBy("rule").agg(F.max("action").alias("action"))
    cut = F.instr("rule", "/")
    rules = rules.select("rule", "action", F.when(cut > 0, F.substring(F.col("rule"), F.lit(1), cut - 1)).otherwise(F.col("rule")).alias("rule_host"), F.when(cut > 0, F.substring(F.col("rule"), cut, F.length("rule"))).otherwise("").alias("rule_path"))
    rules = rules.withColumn("digest", F.sha2(F.col("rule").cast("binary"), 256)).withColumn("short", F.substring("digest", 1, 8))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("rule")).alias("chars"), F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 1, sorted(shape["lengths"] or [0])
    fits = shape["n"] <= BROADCAST_RULES and (shape["chars"] or 0) <= BROADCAST_CHARS

    pages = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    best = _by_columns(pages, rules, labels, lengths) if fits and labels * len(lengths) <= MOST_KINDS else _by_rows(pages, rules, labels, lengths, fits)
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _has(full: str):
    return lambda rule: rule["digest"] == F.col(full)


def _by_columns(pages: DataFrame, rules: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """``pages`` with ``best``: a column and a broadcast join per kind of expression, nothing is exploded or shuffled."""
    # one row per short prefix, so that a join never repeats a page
    side = F.broadcast(rules.groupBy("short").agg(F.collect_list(F.struct("digest", F.length("rule").alias("size"), "rule", "action")).alias("rules")))
    parts, out, found = F.split("host", r"\."), pages, []
    for k in range(1, labels + 1):
        for n in lengths:
            name = f"{k}_{n}"
            text = F.concat(F.array_join(F.slice(parts, -k, k), "."), F.substring("path", 1, n) if n else F.lit(""))
            full = F.when((F.size(parts) >= k) & (F.length("path") >= n), _digest(text))
            out = out.withColumn(f"full_{name}", full)
            out = out.join(side.select(F.col("short").alias(f"short_{name}"), F.col("rules").alias(f"rules_{name}")), F.substring(f"full_{name}", 1, 8) == F.col(f"short_{name}"), "left")
            hit = F.get(F.filter(f"rules_{name}", _has(f"full_{name}")), F.lit(0))
            found.append(F.when(hit.isNotNull(), F.struct(hit["size"].alias("size"), hit["rule"].alias("rule"), hit["action"].alias("action"))))
    return out.withColumn("best", F.array_max(F.array_compact(F.array(*found))))


def _by_rows(pages: DataFrame, rules: DataFrame, labels: int, lengths: list[int], fits: bool) -> DataFrame:
    """``pages`` with ``best``: distinct (host, path) expanded into rows and joined with the rules."""
    parts = F.split("host", r"\.")
    first = F.greatest(F.size(parts) - labels + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(parts)), lambda k: F.array_join(F.slice(parts, k, labels), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = pages.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    keyed = expressions.select("host", "path", _digest(F.concat("suffix", "prefix")).alias("full")).withColumn("short", F.substring("full", 1, 8))
    side = rules.select("short", "digest", "rule", "action")
    hits = keyed.join(F.broadcast(side) if fits else side, "short").filter(F.col("full") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), F.col("rule"), F.col("action"))).alias("best"))
    return pages.join(best, ["host", "path"], "left")
