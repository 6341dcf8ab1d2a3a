"""Quality rules: base counts per text, then robust multivariate outliers.

Statistics of every document are vectors; per (language, source) the
minimum-covariance-determinant (MCD) location and scatter are estimated and
documents beyond a chi-square radius are rejected.

How it runs: one narrow pass gives the counts, written once.  Starts are
deterministic and see every row: medians and quartile widths from histograms,
then three shapes around them (none, spatial signs, squashed scores).
Concentration steps follow over the whole group.  One step is one aggregation:
rows fall into bins of their distance, each bin holds counts, sums and
products, and a unit's bins (some hundreds of rows, whatever its size) tell the
inner share's mean and scatter, the last bin in part.  After two steps the
start of least determinant goes on alone until the determinant rests.  Sums
combine in the tasks, so a group with a third of all rows is no hot key.

The scatter is regularised: a fixed diagonal (``TARGET``) is added, as most
rates are 0 in most texts and the plain determinant would be 0 as well.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, small, texts_of, tidy, with_text, written

#: ASCII white space between words, and the counted symbols.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]
SPAN = 8
#: Tables of one row a group are broadcast up to this many groups (a few MB), shuffled beyond it.
MOST_GROUPS = 20_000

#: The vector's parts and the root of what is added to each one's variance: a
#: scatter below it says that the group hardly varies, not that a small step is an outlier.
TARGET = {"word_length": 0.12, "symbols": 0.055, "dup_lines": 0.12, "repeats": 0.08, "capitals": 0.08}
DIM = len(TARGET)
RIDGE = np.diag([v * v for v in TARGET.values()])
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
#: A unit is what shares an estimate: a (language, source), or what pooled small ones.
UNIT = ["g1", "g2", "level"]
EDGES = 64  # bins of distance per factor e
CELLS = 512  # bins of a statistic per unit


def repeated(words: list[bytes], span: int = SPAN) -> int:
    """Words in windows of ``span`` words that occur twice or more, the first included."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mix = np.zeros(n, dtype=np.uint64)
    for k in range(span):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    if len(np.unique(mix)) == n:
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(span))))  # exact where hashes agree
    seen = Counter(windows)
    twice = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=n)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + span, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words), len(raw) - len(raw.translate(None, UPPER))


def count_table(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_kept`` (a struct of columns ``keep``) and the counts of each whole text; a null text has none of anything."""
    rows, path = with_text(df, text_col, df.columns if keep is None else keep)

    def run(batches):
        for batch in batches:
            got = np.array([counts_of(t.as_py()) for t in texts_of(batch, path)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), *[pa.array(got[:, k]) for k in range(len(COUNTS))]], names=["_kept", *COUNTS])

    return rows.mapInArrow(run, f"_kept {rows.schema['_kept'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def vector(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals):
    """Transformed statistics as columns: mean word length, symbols a word, repeated lines, repeated words, capitals a character, on log scales."""
    n = F.greatest(n_words, F.lit(1)).cast("double")
    return [F.log1p(word_chars / n), F.log1p(n_symbols / n), F.log1p(n_dup_lines / F.sqrt(n)), F.log1p(n_repeat_words / n), F.log1p(n_capitals / F.greatest(word_chars, F.lit(1)))]


def chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _distance(d: list[Column]) -> Column:
    """Squared Mahalanobis distance; ``d`` are the differences from the mean, the inverse stands in ``v*``."""
    return _total([(1 if i == j else 2) * d[i] * d[j] * F.col(f"v{i}_{j}") for i, j in PAIRS])


MEANS, INVERSE = [f"m{i}" for i in range(DIM)], [f"v{i}_{j}" for i, j in PAIRS]
ESTIMATE = ", ".join(["g1 string", "g2 string", "level int", "start int", "n bigint", "logdet double", "fell double", *[f"{c} double" for c in MEANS + INVERSE]])


def _estimate(key: tuple, start: int, n: float, mean: np.ndarray, cov: np.ndarray, before: float) -> tuple:
    cov = cov + RIDGE
    inv, logdet = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
    return (*key, start, int(n), logdet, before - logdet, *mean.tolist(), *[float(inv[i, j]) for i, j in PAIRS])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*UNIT, "start", "n", "logdet", "fell", *MEANS, *INVERSE])


def _key(pdf: pd.DataFrame) -> tuple:
    return pdf["g1"].iloc[0], pdf["g2"].iloc[0], int(pdf["level"].iloc[0])


def units(rows: DataFrame, least: int) -> DataFrame:
    """``(lang, source, g1, g2, level)`` of each group: level 2 is a group of its own;
    groups under ``least`` rows pool by language (1); what is under ``least`` even so
    pools as one (0), and where that is too few rows it has no unit.  Every row counts in one unit.
    """
    sizes = rows.groupBy("lang", "source").count()
    rest = sizes.filter(F.col("count") < least).groupBy(F.col("lang").alias("of")).agg(F.sum("count").alias("rest"))
    placed = sizes.join(rest, F.col("lang") == F.col("of"), "left")
    level = F.when(F.col("count") >= least, 2).when(F.col("rest") >= least, 1).otherwise(0).cast("int").alias("level")
    placed = written(placed.select("lang", "source", "count", level), "groups")
    lowest = placed.filter("level = 0").agg(F.sum("count").alias("n")).first()["n"] or 0
    if lowest < least:
        placed = placed.filter("level > 0")
    return placed.select("lang", "source", F.when(F.col("level") > 0, F.col("lang")).otherwise("").alias("g1"), F.when(F.col("level") > 1, F.col("source")).otherwise("").alias("g2"), "level")


def scales(rows: DataFrame) -> DataFrame:
    """Medians and quartile widths (as a normal's deviation) per unit, from histograms of every row."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(f"x{i}") * CELLS).cast("int").alias("cell")) for i in range(DIM)])).alias("c")
    counts = rows.select(*UNIT, cells).groupBy(*UNIT, "c.i", "c.cell").count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        for _, part in pdf.sort_values("cell").groupby("i", sort=True):
            upto, cell = part["count"].cumsum().to_numpy(), part["cell"].to_numpy() / CELLS
            low, mid, high = (cell[np.searchsorted(upto, q * upto[-1])] for q in (0.25, 0.5, 0.75))
            got += [mid, (high - low) / 1.349]
        return pd.DataFrame([(*_key(pdf), *got[::2], *got[1::2])], columns=[*UNIT, *MEANS, *[f"s{i}" for i in range(DIM)]])

    return counts.groupBy(*UNIT).applyInPandas(run, ", ".join(["g1 string", "g2 string", "level int", *[f"{c} double" for c in MEANS], *[f"s{i} double" for i in range(DIM)]]))


def starts(rows: DataFrame, scale: DataFrame) -> DataFrame:
    """Three estimates per unit around its medians: no correlation, that of spatial signs, that of squashed scores."""
    at = rows.join(scale, UNIT)
    for i in range(DIM):
        at = at.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}")) / F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") + float(RIDGE[i, i])))
    length = _total([F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)]) + 1e-12
    sums = [F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("len")).alias(f"a{i}_{j}") for i, j in PAIRS] + [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"b{i}_{j}") for i, j in PAIRS]
    held = [F.first(c).alias(c) for c in MEANS + [f"s{i}" for i in range(DIM)]]
    got = at.withColumn("len", length).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), *held, *sums)

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                key, mean, s = (r["g1"], r["g2"], r["level"]), np.array([r[c] for c in MEANS]), np.array([r[f"s{i}"] for i in range(DIM)])
                for k, side in enumerate(["", "a", "b"]):
                    shape = np.eye(DIM)
                    if side:
                        for i, j in PAIRS:
                            shape[i, j] = shape[j, i] = r[f"{side}{i}_{j}"]
                        d = np.sqrt(np.maximum(np.diag(shape), 1e-12))
                        shape = shape / np.outer(d, d)
                    rows.append(_estimate(key, k, r["n"], mean, shape * np.outer(s, s), np.inf))
            yield _frame(rows)

    return got.mapInPandas(run, ESTIMATE)


def concentrated(rows: DataFrame, est: DataFrame, share: float, choose: bool, grow: float = 1.0) -> DataFrame:
    """One concentration step of every unit and start; ``choose`` keeps the start of least determinant."""
    at = rows.join(est.withColumnRenamed("n", "n_unit"), UNIT)
    for i in range(DIM):
        at = at.withColumn(f"y{i}", F.col(f"x{i}") - F.col(f"m{i}"))
    at = at.withColumn("bin", F.floor(F.log1p(F.greatest(_distance([F.col(f"y{i}") for i in range(DIM)]), F.lit(0.0))) * EDGES).cast("int"))
    sums = [F.sum(f"y{i}").alias(f"s{i}") for i in range(DIM)] + [F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"q{i}_{j}") for i, j in PAIRS]
    bins = at.groupBy(*UNIT, "start", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("logdet").alias("logdet"), *[F.first(c).alias(c) for c in MEANS], *sums)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for start, part in pdf.groupby("start", sort=True):
            part = part.sort_values("bin")
            n = part["n"].to_numpy(float)
            weight = np.clip((share * n.sum() - (n.cumsum() - n)) / n, 0, 1)  # whole bins, and a part of the last
            m = weight @ n
            s = weight @ part[[f"s{i}" for i in range(DIM)]].to_numpy() / m
            q = weight @ part[[f"q{i}_{j}" for i, j in PAIRS]].to_numpy() / m
            cov = np.zeros((DIM, DIM))
            for (i, j), v in zip(PAIRS, q):
                cov[i, j] = cov[j, i] = v - s[i] * s[j]
            out.append(_estimate(_key(pdf), int(start), n.sum(), part[MEANS].iloc[0].to_numpy(float) + s, cov * grow, float(part["logdet"].iloc[0])))
        return _frame([min(out, key=lambda r: (r[5], r[3]))] if choose else out)

    return bins.groupBy(*UNIT).applyInPandas(run, ESTIMATE)


def robust_estimates(rows: DataFrame, share: float = 0.75, rest: float = 1e-3, most_steps: int = 60) -> DataFrame:
    """MCD location and inverse scatter per unit: ``(g1, g2, level, n, m*, v*)`` and the steps' ``logdet``.

    ``rows`` has the unit's columns (no nulls) and ``x0..x4``.  ``share`` of a
    unit's rows carry the estimate.  Steps go on until no unit's log determinant
    falls by more than ``rest``; not settling within ``most_steps`` raises.  The
    last step scales the scatter of the inner share to that of a whole normal
    sample.  No rows give no estimates.
    """
    old = written(starts(rows, small(written(scales(rows), "scales"), MOST_GROUPS)), "starts")
    est = small(old, 3 * MOST_GROUPS)
    for k in range(most_steps):
        table = written(concentrated(rows, est, share, choose=k > 0), "estimates")
        drop(old)
        old, fell = table, table.agg(F.max(F.abs("fell"))).first()[0]
        est = small(table, 3 * MOST_GROUPS)
        if k > 0 and (fell is None or fell <= rest):
            return written(concentrated(rows, est, share, choose=True, grow=_consistency(share)), "estimates")
    raise RuntimeError(f"the estimates did not settle in {most_steps} steps")


def _consistency(share: float) -> float:
    """Factor that makes the inner share's scatter consistent at the normal (by a fixed seeded draw)."""
    x = np.random.default_rng(1).standard_normal((200_000, DIM))
    d = (x * x).sum(1)
    return float(1 / x[d <= np.quantile(d, share)].var())


def robust_outliers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = 0.9999, keep: list[str] | None = None, least: int = 60) -> DataFrame:
    """One row per input row: kept columns (``id_col`` by default), the counts, ``base_failed``, ``distance2``, ``kept``.

    ``base_failed``: under 20 words, or over 30 % of words in repeated 8-word
    windows.  ``kept`` is false for those, and for vectors whose squared robust
    distance from their (language, source) exceeds the chi-square ``quantile``.
    Estimates are taken from rows that pass the base rules.  Groups under
    ``least`` rows share the estimate of their language's small groups, or of all
    small ones; under ``least`` rows even so, ``distance2`` is 0.  Null language
    or source is a group of its own; null text has no words (fails); null ids
    and repeated rows are kept as rows; an empty table gives an empty result.
    """
    keep = [id_col] if keep is None else keep
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in ((lang_col, "_lang"), (source_col, "_source"))]
    held = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("k")
    at = text_col if text_col.split(".")[0] in keep else "_t"
    slim = df.select(held, *named, *([F.col(text_col).cast("string").alias("_t")] if at == "_t" else []))
    counted = written(count_table(slim, "_t" if at == "_t" else f"k.{text_col}", ["k", "_lang", "_source"]), "counts")
    n = F.col("n_words")
    base = (n < 20) | (F.col("n_repeat_words") * 100 > n * 30)
    x = vector(*[F.col(c) for c in COUNTS])
    rows = counted.select("_kept.k", F.col("_kept._lang").alias("lang"), F.col("_kept._source").alias("source"), *COUNTS, base.alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    sound = rows.filter(~F.col("base_failed")).select("lang", "source", *[f"x{i}" for i in range(DIM)])
    groups = written(units(sound, least), "units")
    est = robust_estimates(sound.join(small(groups, MOST_GROUPS), ["lang", "source"]))
    tidy(df.sparkSession)
    judged = rows.join(small(written(groups.join(est, UNIT).select("lang", "source", *MEANS, *INVERSE), "judges"), MOST_GROUPS), ["lang", "source"], "left")
    d2 = F.greatest(F.coalesce(_distance([F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)]), F.lit(0.0)), F.lit(0.0))
    return judged.withColumn("distance2", d2).select("k.*", *COUNTS, "base_failed", "distance2", (~F.col("base_failed") & (F.col("distance2") <= chi2_quantile(quantile, DIM))).alias("kept"))
