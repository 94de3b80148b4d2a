"""Operator 6: quality rules by robust multivariate outliers, in DataFrame functions alone.

Minimum-covariance-determinant estimates are found per language and source by
concentration steps: from each of three fixed starts (spreads by medians,
covariances of hyperbolic tangents and of spatial signs), each step takes mean
and covariance of the half of the rows nearest to the last estimate, until the
determinant stands still; the smallest determinant is kept.  Rows whose robust
Mahalanobis distance is beyond a cutoff are rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import SPACE, written

SYMBOLS = "#*$%&|<>"
#: Transformed statistics, and the least spread that each is taken to have: where most documents have none of a statistic its
#: own spread is nil, and a floor of a few hundredths keeps one symbol or repeated line in a hundred words from being an outlier.
STATS = {"x0": 0.08, "x1": 0.10, "x2": 0.06, "x3": 0.12}
#: Median of the chi-square distribution with four degrees of freedom.
CHI_MEDIAN = 3.3567
#: Squared distance beyond which one in 100,000 rows of a normal distribution lies (chi-square with four degrees of freedom).
CUTOFF = 28.47
MIN_ROWS = 40
STARTS = 3
#: A start has settled when a step lowers its log determinant by no more.
SETTLED = 1e-3
#: Most languages with sources, and most bytes of their names, whose estimates are broadcast; beyond that rows are salted.
CELLS, CELL_BYTES, SALTS = 50_000, 8_000_000, 64


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, from the whole text of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.withColumn("_words", F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))
    cut = cut.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    windows = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("_words", 3, F.greatest(n, F.lit(1))).alias("c"))
    windows = F.slice(windows, 1, F.greatest(n - 2, F.lit(0)))
    hashed = F.transform(windows, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    cut = cut.withColumn("_sorted", F.sort_array(hashed))
    size = F.size("_sorted")
    beside = F.arrays_zip(F.slice("_sorted", 1, F.greatest(size - 1, F.lit(0))).alias("p"), F.slice("_sorted", 2, F.greatest(size - 1, F.lit(0))).alias("q"))
    equal = F.filter(beside, lambda x: x["p"]["h"] == x["q"]["h"])
    covered = F.flatten(F.transform(equal, lambda x: F.array(*(x[e]["i"] + k for e in ("p", "q") for k in (0, 1, 2)))))
    return cut.select(
        *docs.columns,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_repeat_words"),
    )


def _looked_up(rows: DataFrame, small: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Joins ``small``, one row per key, to ``rows``: broadcast where ``few``, else by salted keys, so that a hot key is split."""
    if few:
        return rows.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64("doc_id", *STATS), F.lit(SALTS)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(spread, [*on, "_salt"], how).drop("_salt")


def _consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is multiplied by, for four statistics."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - math.exp(-middle / 2) * (1 + middle / 2) < share else (low, middle)
    x = low / 2
    return share / (1 - math.exp(-x) * (1 + x + x * x / 2))


def _nearest(now: DataFrame, few: bool) -> DataFrame:
    """The estimate of the h = (n + p + 1) / 2 rows of least ``d2`` of each cell, h being rounded up to a percent of the n rows."""
    shares = [k / 100 for k in range(50, 101)]
    edges = now.groupBy("cell").agg(F.percentile_approx("d2", F.array(*map(F.lit, shares)), F.lit(2000)).alias("edges"), F.count("*").alias("n"))
    half = F.floor((F.col("n") + len(STATS) + 1) / 2)
    at = F.least(F.ceil(100 * half / F.col("n")) - 50, F.lit(50)).cast("int")
    edges = edges.select("cell", F.get("edges", at).alias("edge"), F.get(F.array(*(F.lit(_consistency(k)) for k in shares)), at).alias("factor"))
    return _estimate(_looked_up(now, edges, ["cell"], few), F.col("d2") <= F.col("edge"), F.col("factor"))


def _estimate(rows: DataFrame, inside: Column, factor: Column) -> DataFrame:
    """Mean, Cholesky factor and log determinant of the rows ``inside``, per cell; covariances are multiplied by ``factor``, spreads have a floor."""
    names = list(STATS)
    aggregates = [F.max(factor).alias("factor")]
    aggregates += [F.avg(F.when(inside, F.col(a))).alias(f"m_{a}") for a in names]
    for i, a in enumerate(names):
        for b in names[: i + 1]:
            aggregates.append(F.covar_pop(F.when(inside, F.col(a)), F.when(inside, F.col(b))).alias(f"c_{a}{b}"))
    made = rows.groupBy("cell").agg(*aggregates)
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            rest = F.coalesce(F.col(f"c_{a}{b}"), F.lit(0.0)) * F.col("factor")
            if a == b:
                rest = rest + STATS[a] ** 2
            for e in names[:j]:
                rest = rest - F.col(f"l_{a}{e}") * F.col(f"l_{b}{e}")
            made = made.withColumn(f"l_{a}{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}{b}"))
    logdet = 2 * sum(F.log(f"l_{a}{a}") for a in names)
    return made.select("cell", logdet.alias("logdet"), *(f"m_{a}" for a in names), *(f"l_{a}{b}" for i, a in enumerate(names) for b in names[: i + 1]))


def _distance(rows: DataFrame, estimate: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """Squared Mahalanobis distances ``d2`` of ``rows``, by forward substitution."""
    names = list(STATS)
    out = _looked_up(rows, estimate, ["cell"], few, how)
    total = F.lit(0.0)
    for i, a in enumerate(names):
        z = F.col(a) - F.col(f"m_{a}")
        for b in names[:i]:
            z = z - F.col(f"l_{a}{b}") * F.col(f"z_{b}")
        out = out.withColumn(f"z_{a}", z / F.col(f"l_{a}{a}"))
        total = total + F.col(f"z_{a}") * F.col(f"z_{a}")
    return out.select(*rows.columns, total.alias("d2"))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS, broadcast_cells: int = CELLS) -> DataFrame:
    """Base statistics and the verdict of every row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and distance (null where there is no
    estimate).

    Null or empty texts have no words and fail the base rules.  Null languages
    or sources are values of their own.  A language and source with fewer than
    ``min_rows`` rows that pass the base rules is judged by the estimate of all
    rows of its language, and by that of the corpus where the language has too
    few; if the corpus has too few, the base rules decide alone.  Repeated
    rows count each time.  An empty table gives no rows.  Quantiles use
    mergeable sketches, so no group gathers in one task.
    """
    base = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source")
    )
    base = base_statistics(base).drop("text")
    words = F.greatest("n_words", F.lit(1))
    base = (
        base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("x0", F.log(F.greatest(F.col("word_chars") / words, F.lit(0.5))))
        .withColumn("x1", F.sqrt(F.col("n_symbols") / words))
        .withColumn("x2", F.sqrt(F.col("n_dup_lines") / words))
        .withColumn("x3", F.sqrt(F.col("n_repeat_words") / words))
    )
    table = written(base, "statistics")
    passed = table.where(~F.col("base_failed"))
    by_source = written(passed.groupBy("lang", "source").agg(F.count("*").alias("n")), "sources")
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min(F.col("n") >= min_rows).alias("all_large"))
    own, lang, corpus = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]")
    large, spoken = F.col("n") >= min_rows, F.col("n_lang") >= min_rows
    # a source is judged by one cell; its rows also feed its language's and the corpus's where a small source needs those
    scarce = F.lit(not by_lang.where(~F.col("all_large") & ~spoken).isEmpty())
    feeds = F.filter(F.array(F.when(large, own), F.when(~F.col("all_large") & spoken, lang), F.when(scarce, corpus)), lambda c: c.isNotNull())
    cells = by_source.join(by_lang, "lang").select("lang", "source", F.when(large, own).when(spoken, lang).otherwise(corpus).alias("cell"), feeds.alias("feeds"))
    cells = written(cells, "cells")
    n_cells, n_bytes = cells.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("cell") * 2 + F.octet_length("lang") * 2 + F.octet_length("source")), F.lit(0))).first()
    few = n_cells <= broadcast_cells and n_bytes <= CELL_BYTES
    rows = _looked_up(passed, cells.select("lang", "source", "feeds"), ["lang", "source"], few)
    rows = written(rows.select("doc_id", F.explode("feeds").alias("cell"), *STATS), "vectors")
    cells = cells.drop("feeds")
    # start: medians, and spreads from median absolute deviations
    middle = rows.groupBy("cell").agg(*(F.percentile_approx(a, 0.5, 2000).alias(f"m_{a}") for a in STATS))
    off = _looked_up(rows, middle, ["cell"], few).groupBy("cell").agg(*(F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 2000).alias(f"s_{a}") for a in STATS))
    start = middle.join(off, "cell")
    # every start has cells of its own, named by its number before the cell's name
    z = {a: (F.col(a) - F.col(f"m_{a}")) / (1.4826 * F.col(f"s_{a}") + floor) for a, floor in STATS.items()}
    scaled = _looked_up(rows, start, ["cell"], few).select("doc_id", "cell", *(z[a].alias(a) for a in STATS), F.struct(*STATS).alias("raw"))
    norm = F.sqrt(sum(F.col(a) * F.col(a) for a in STATS))
    named = lambda k: F.concat(F.lit(str(k)), "cell").alias("cell")
    bent = scaled.select("doc_id", named(1), *(F.tanh(a).alias(a) for a in STATS))
    bent = bent.unionByName(scaled.select("doc_id", named(2), *((F.col(a) / F.greatest(norm, F.lit(1e-9))).alias(a) for a in STATS)))
    shapes = written(_estimate(bent, F.lit(True), F.lit(1.0)), "starts")
    few_starts = few and STARTS * n_cells <= broadcast_cells
    turned = scaled.withColumn("cell", F.explode(F.array(named(1), named(2))))
    now = scaled.select("doc_id", named(0), "raw.*", (norm * norm).alias("d2"))
    now = now.unionByName(_distance(turned, shapes, few_starts).select("doc_id", "cell", "raw.*", "d2"))
    every = rows.withColumn("cell", F.explode(F.array(*(named(k) for k in range(STARTS)))))
    moving = written(_nearest(now, few_starts), "estimate")
    settled = []
    while True:  # ends, since each start that goes on falls by more than SETTLED, and the floors bound it
        after = _nearest(_distance(every, moving, few_starts, "inner"), few_starts)
        both = moving.select("cell", F.struct(*moving.columns).alias("old")).join(after.select("cell", F.struct(*after.columns).alias("new")), "cell")
        falls = F.col("new.logdet") < F.col("old.logdet") - SETTLED
        both = written(both.select(falls.alias("falls"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e")), "estimate")
        settled.append(both.where("not coalesce(falls, false)").select("e.*"))
        if both.where("falls").isEmpty():
            break
        moving = both.where("falls").select("e.*")
    found = reduce(DataFrame.unionByName, settled)
    least = found.groupBy(F.substring("cell", 2, 1 << 30).alias("name")).agg(F.min(F.struct("logdet", *(c for c in found.columns if c != "logdet"))).alias("e"))
    estimate = written(least.select("name", "e.*").drop("cell", "logdet").withColumnRenamed("name", "cell"), "estimate")
    now = _distance(rows, estimate, few)
    scale = now.groupBy("cell").agg(F.greatest(F.percentile_approx("d2", 0.5, 2000) / CHI_MEDIAN, F.lit(1.0)).alias("scale"), F.count("*").alias("n"))
    scale = scale.where(F.col("n") >= min_rows)
    judged = _looked_up(table, cells, ["lang", "source"], few, "left").drop("lang", "source")
    judged = _looked_up(_distance(judged, estimate, few), scale, ["cell"], few, "left")
    distance = F.sqrt(F.col("d2") / F.col("scale"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(distance * distance <= cutoff, F.lit(True))).alias("kept"),
        distance.alias("distance"),
    )
