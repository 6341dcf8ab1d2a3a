"""Merkle manifest of a table, climbed by recursive queries.

Leaves of a group (a language) are ranked by one sort of all rows by ranges;
every 8 neighbours make a run whose hash is a node one level up, until a group
is one node, its subroot; the subroots make a last tree of the same kind.
Each level is a written table of runs.  A run row holds its nodes' digests
and the place of its own hash: the run and slot above it.

A recursive query then takes the leaves up, a run of 8 together in one row:
each step joins the run above, appends the digests of the siblings left and
right of the path, and folds every leaf's (perhaps tampered) hash with them.
Near the root all rows meet few runs.  Runs under which more than 1 in
``SHARE`` of the climbing rows pass are fewer than ``SHARE`` a level, as those
shares add up to 1; a second query climbs them by broadcast, while the first
one shuffles by run keys none of which is heavier than that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER, lowered
from .tables import drop, small, written

#: Nodes in a run; bytes of a digest.
FAN, BYTES = 8, 32
#: A run that more than 1 in so many climbing rows pass is met by broadcast.
SHARE = 512
#: The group that the subroots form.
TOP = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(c: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Digest of the concatenated texts, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``g`` (rank of its group among the groups, null first, from 0) and ``pos`` (rank by ``order`` in the group, from 0), written.

    One sort of all rows by ranges, however the groups are sized.  A partition
    reports its first place and count for each group in it; running sums over
    those reports, of which there are fewer than partitions and groups
    together, give what lies before it.
    """
    keys = [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order]]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows.select("*", F.shiftright("_at", 33).alias("_part")), "ranked")
    spans = rows.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a group is spread over neighbouring partitions: its rows here are one a partition
    run = Window.partitionBy(group).orderBy("_part")
    spans = spans.select("*", F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), (F.row_number().over(run) == 1).cast("bigint").alias("_new"))
    spans = spans.withColumn("_nth", F.sum("_new").over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(group))))
    spans = written(spans, "spans")
    parts = spans.groupBy("_part").agg(F.sum("_new").alias("_groups"))  # one row a partition
    parts = parts.select("_part", F.coalesce(F.sum("_groups").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    spans = spans.join(F.broadcast(parts), "_part").select(F.col("_part").alias("_p"), F.col(group).alias("_group"), "_first", "_before", (F.col("_earlier") + F.col("_nth") - 1).cast("bigint").alias("g"))
    spans = written(spans, "spans")
    met = rows.join(small(spans, 100_000), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    out = written(met.select(*df.columns, "g", (F.col("_at") - F.col("_first") + F.col("_before")).cast("bigint").alias("pos")), "placed")
    drop(rows, spans)
    return out


def run_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """``(levels, roots)`` over ``nodes(g, pos, hash, n, weight)``, ``n`` the group's number of nodes.

    A level is ``(g, level, run, nodes, hash, n, weight)``, written: ``nodes`` the
    digests in order, ``n`` the nodes of the group at that level, ``weight`` the sum
    of theirs.  ``roots`` is ``(g, hash, weight)``.
    """
    levels, roots, k = [], [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter("n = 1").select("g", "hash", "weight"))
        if most <= 1:
            return levels, reduce(DataFrame.union, roots)
        runs = nodes.filter("n > 1").groupBy("g", F.floor(F.col("pos") / FAN).alias("run")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("members"), F.first("n").alias("n"), F.sum("weight").alias("weight")
        )
        joined = F.aggregate("members", F.unhex(F.lit("")), lambda a, m: F.concat(a, m["hash"]))
        runs = runs.select("g", F.lit(k).alias("level"), "run", joined.alias("nodes"), "n", "weight").withColumn("hash", digest(as_text(F.col("nodes"))))
        levels.append(written(runs, "runs"))
        nodes = levels[-1].select("g", F.col("run").alias("pos"), "hash", F.ceil(F.col("n") / FAN).alias("n"), "weight")
        most, k = -(-most // FAN), k + 1


def above(g: Column, level: Column, pos: Column, n: Column, groups: int) -> list[Column]:
    """``up_g, up_level, up_run, up_slot``: where node ``pos`` of ``n`` on a level has its siblings; null for the root."""
    inner, outer = n > 1, (g != TOP) & F.lit(groups > 1)
    up = lambda a, b, name: F.when(inner, a).when(outer, b).cast("bigint").alias(name)
    return [up(g, F.lit(TOP), "up_g"), up(level, F.lit(0), "up_level"), up(F.floor(pos / FAN), F.floor(g / FAN), "up_run"), up(pos % FAN, g % FAN, "up_slot")]


#: One recursion: rows climb ``runs`` until the run above is not among them.
CLIMB = """
WITH RECURSIVE climb(g, run, leaves, path, subroot, up_g, up_level, up_run, up_slot, more) AS (
  SELECT g, run, leaves, path, subroot, up_g, up_level, up_run, up_slot, more FROM {start}
  UNION ALL
  SELECT c.g, c.run,
         transform(c.leaves, x -> named_struct('row', x.row, 'leaf', x.leaf, 'fold', unhex(sha2(concat(lower(hex(substring(r.nodes, 1, 32 * c.up_slot))), lower(hex(x.fold)), lower(hex(substring(r.nodes, 32 * c.up_slot + 33)))), 256)))),
         concat(c.path, substring(r.nodes, 1, 32 * c.up_slot), substring(r.nodes, 32 * c.up_slot + 33)),
         CASE WHEN r.g = -1 AND r.level = 0 THEN substring(r.nodes, 32 * c.up_slot + 1, 32) ELSE c.subroot END,
         r.up_g, r.up_level, r.up_run, r.up_slot, r.more
  FROM climb c JOIN {runs} r ON c.up_g = r.g AND c.up_level = r.level AND c.up_run = r.run
  WHERE c.more)
SELECT * FROM climb WHERE NOT more
"""


def climbed(start: DataFrame, runs: DataFrame, what: str) -> DataFrame:
    """Rows of ``start`` at the last of ``runs`` above them, written; ``more`` says whether the run above a row is among them."""
    spark = start.sparkSession
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, -1)  # one row a run of leaves and level
    try:
        return written(spark.sql(CLIMB, start=start, runs=runs), what)
    finally:
        spark.conf.set(ROW_LIMIT, before)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None) -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    A leaf is the hash of ``fields`` (``-`` if null, else byte count, ``:``, value).
    Leaves of a ``group_col`` ascend by id, then leaf hash; a null id or group comes
    first.  ``altered`` gives other expressions for some fields, as they stand
    when the proof is checked: ``folded_root`` is the root that the altered row
    and the original siblings give, ``verified`` whether it is the root.
    ``proof_sha256`` is the hash of the siblings on the way up.  Digests are
    lowercase hex.  Repeated rows are leaves of their own; an empty table has
    no rows; a group of one leaf has that leaf as subroot, and a table of one
    row has it as root with an empty proof.  Other columns are ignored.
    """
    altered = altered or {}
    leaf = digest(*[field(F.col(f"`{c}`")) for c in fields])
    other = digest(*[field(altered.get(c, F.col(f"`{c}`"))) for c in fields])
    leaves = written(docs.select(F.col(id_col).alias("row"), F.col(group_col).alias("grp"), leaf.alias("leaf"), other.alias("fold")), "leaves")
    placed = ranked(leaves, "grp", ["row", "leaf"])
    counts = written(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "counts")  # one row a group
    groups = counts.count()
    first = placed.groupBy("g", F.floor(F.col("pos") / FAN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "row", "leaf", "fold"))).alias("leaves"))
    first = written(first.join(small(counts, 100_000), "g").withColumn("nodes", F.aggregate("leaves", F.unhex(F.lit("")), lambda a, m: F.concat(a, m["leaf"]))), "leaf-runs")
    starting = first.count()
    drop(leaves, placed)

    # the tree of every group above its runs of leaves, then the tree of the subroots
    hashes = F.when(F.col("n") > 1, digest(as_text(F.col("nodes")))).otherwise(F.col("nodes"))
    levels, roots = run_tables(first.select("g", F.col("run").alias("pos"), hashes.alias("hash"), F.ceil(F.col("n") / FAN).alias("n"), F.lit(1).cast("bigint").alias("weight")))
    levels = [d.withColumn("level", F.col("level") + 1) for d in levels]
    roots = written(roots, "subroots")
    top, root = run_tables(roots.select(F.lit(TOP).cast("bigint").alias("g"), F.col("g").alias("pos"), "hash", F.lit(groups).cast("bigint").alias("n"), "weight"))
    root = (root.select("hash").first() or [b""])[0]
    runs = [d.select("g", "level", "run", "nodes", "weight", *above(F.col("g"), F.col("level") + 1, F.col("run"), F.ceil(F.col("n") / FAN), groups)) for d in levels + top]

    out = first.select("g", "run", F.transform("leaves", lambda x, k: F.struct(
        x["row"].alias("row"), x["leaf"].alias("leaf"),
        F.when(F.col("n") > 1, digest(as_text(F.substring("nodes", F.lit(1), BYTES * k)), as_text(x["fold"]), as_text(F.substring("nodes", BYTES * k + BYTES + 1, F.lit(BYTES * FAN))))).otherwise(x["fold"]).alias("fold"),
    )).alias("leaves"), F.unhex(F.lit("")).alias("path"), F.lit(None).cast("binary").alias("subroot"), *above(F.col("g"), F.lit(1), F.col("run"), F.ceil(F.col("n") / FAN), groups))
    if runs:
        tree = written(reduce(DataFrame.union, runs), "tree")
        heavy = F.col("weight") * SHARE > starting
        key = ["up_g", "up_level", "up_run"]
        for what, here in (("climb", ~heavy), ("climb-top", heavy)):
            side = tree.filter(here)
            # a row goes on where the run above it is on this side too; weights grow on the way up
            next_ = side.select(F.col("g").alias("up_g"), F.col("level").cast("bigint").alias("up_level"), F.col("run").alias("up_run"), F.lit(True).alias("more"))
            bounded = F.broadcast if what == "climb-top" else (lambda d: d)
            marked = written(side.join(bounded(next_), key, "left").select("g", "level", "run", "nodes", "up_g", "up_level", "up_run", "up_slot", F.coalesce("more", F.lit(False)).alias("more")), "marked")
            begin = out.drop("more").join(bounded(next_), key, "left").withColumn("more", F.coalesce("more", F.lit(False)))
            out = climbed(begin.select("g", "run", "leaves", "path", "subroot", "up_g", "up_level", "up_run", "up_slot", "more"), bounded(marked), what)
            drop(marked)
        drop(first, roots, tree, *levels, *top)
    each = out.select(F.posexplode("leaves").alias("k", "x"), "leaves", "path", "subroot")
    own = F.aggregate(F.filter("leaves", lambda _, j: j != F.col("k")), F.unhex(F.lit("")), lambda a, m: F.concat(a, m["leaf"]))
    root = F.lit(bytearray(root))
    return each.select(
        F.col("x.row").alias(id_col), as_text(F.col("x.leaf")).alias("leaf"), as_text(F.coalesce("subroot", root)).alias("subroot"), as_text(root).alias("root"),
        F.sha2(as_text(F.concat(own, "path")), 256).alias("proof_sha256"), as_text(F.col("x.fold")).alias("folded_root"), (F.col("x.fold") == root).alias("verified"),
    )


def tampered(id_col: str, text: Column, every: int = 3) -> Column:
    """``text`` with A-Z lower-cased where ``every`` divides the crc32 of the decimal id."""
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, lowered(text)).otherwise(text)


def _h(x: str) -> str:
    return f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"


#: crc32 of the id's digits, bit by bit; 3988292384 is its polynomial, reversed: a fixed value.
_TURN = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::varchar, (i // 8 + 1)::bigint, 1))::bigint) ELSE c END"
_CRC = f"xor(list_reduce(range(0, 8 * strlen(doc_id::varchar)), lambda c, i: xor(({_TURN}) >> 1, (({_TURN}) & 1) * 3988292384), 4294967295), 4294967295)"
_LOWER = f"CASE WHEN {_CRC} % {{every}} = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END".format(every=3)


def _tree(name: str) -> str:
    """Nodes of all levels over ``<name>0(g, pos, hash, n)``, and each node's siblings, as CTEs."""
    return f"""{name}(g, level, pos, hash, n) AS (SELECT g, 0, pos, hash, n FROM {name}0 UNION ALL SELECT g, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 8, n),
     {name}s AS MATERIALIZED (SELECT g, level, pos, n, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY g, level, pos // 8 ORDER BY pos))"""


def _climb(name: str, tree: str, start: str) -> str:
    return f"""{name}(doc_id, g, level, pos, fold, path) AS ({start} UNION ALL SELECT doc_id, c.g, c.level + 1, c.pos // 8, sha256(l || fold || r), path || l || r FROM {name} c JOIN {tree}s s ON s.g = c.g AND s.level = c.level AND s.pos = c.pos),
     {name}_end AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)"""


SQL = f"""
WITH RECURSIVE lf AS (SELECT doc_id, lang, sha256({" || ".join(map(_h, ["doc_id", "source", "lang", "n_chars", "text"]))}) AS leaf,
            sha256({" || ".join(map(_h, ["doc_id", "source", "lang", "n_chars"]))} || {_h("(" + _LOWER + ")")}) AS other FROM documents),
     ln AS (SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM lf),
     tr0 AS (SELECT g, pos, leaf AS hash, n FROM ln), {_tree("tr")},
     sub AS (SELECT g, hash FROM tr WHERE n = 1),
     tp0 AS (SELECT -1 AS g, g AS pos, hash, count(*) OVER () AS n FROM sub), {_tree("tp")},
     root AS (SELECT hash FROM tp WHERE n = 1),
     {_climb("c1", "tr", "SELECT doc_id, g, 0, pos, other, '' FROM ln")},
     {_climb("c2", "tp", "SELECT doc_id, -1, 0, g, fold, path FROM c1_end")}
SELECT ln.doc_id, leaf, sub.hash AS subroot, root.hash AS root, sha256(path) AS proof_sha256, fold AS folded_root, fold = root.hash AS verified
FROM ln JOIN sub USING (g) JOIN c2_end USING (doc_id) CROSS JOIN root
"""
