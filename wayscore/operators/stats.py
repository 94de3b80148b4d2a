"""Threshold tests: two groups of a score, compared feature by feature.

Input frames have a score and numeric features.  Everything up to the test
statistics is aggregation; values are first added up per distinct value, so
ranks need windows over slices of the distinct values alone.  Only the p-values, one
per (threshold, feature), are computed in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.functions.numeric import cliffs_label, cohens_label
from wayscore.functions.special import SHAPIRO_MOST, score_sums, square_sum, with_shapiro
from wayscore.operators.ranks import below, exact_quantiles

THRESHOLDS = (0.25, 0.5, 0.75, 1.0)


def tall(frame: DataFrame, features: list[str], thresholds=THRESHOLDS, score: str = "score") -> DataFrame:
    """One row per (threshold, feature, row): value and success; null scores and values are left out."""
    cuts = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features)))
    rows = frame.where(F.col(score).isNotNull()).select(F.col(score).alias("_s"), cells.alias("c"))
    rows = rows.select("_s", "c.feature", F.nanvl("c.value", F.lit(None).cast("double")).alias("value")).where("value is not null")
    return rows.select(cuts.alias("threshold"), "feature", "value", "_s").withColumn("success", F.col("_s") >= F.col("threshold")).drop("_s")


def threshold_sizes(frame: DataFrame, thresholds=THRESHOLDS, score: str = "score") -> DataFrame:
    cuts = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    rows = frame.select(F.col(score).alias("_s"), cuts.alias("threshold"))
    return rows.groupBy("threshold").agg(F.count_if(F.col("_s") >= F.col("threshold")).alias("n_success"), F.count_if(F.col("_s") < F.col("threshold")).alias("n_failure"))


def moments(rows: DataFrame) -> DataFrame:
    """Counts, means and sample variances of both sides, per (threshold, feature)."""
    made = []
    for side, inside in (("s", F.col("success")), ("f", ~F.col("success"))):
        value = F.when(inside, F.col("value"))
        made += [F.count(value).alias(f"n_{side}"), F.avg(value).alias(f"mean_{side}"), F.var_samp(value).alias(f"var_{side}")]
    return rows.groupBy("threshold", "feature").agg(*made)


def mann_whitney(rows: DataFrame) -> DataFrame:
    """U of the success side, the tie term, and Cliff's delta of (failure, success)."""
    each = rows.groupBy("threshold", "feature", "value").agg(F.count_if("success").alias("s"), F.count_if(~F.col("success")).alias("f"))
    each = below(each, ["threshold", "feature"], "value", ["f"]).withColumnRenamed("below_f", "below")
    t = (F.col("s") + F.col("f")).cast("double")
    made = each.groupBy("threshold", "feature").agg(
        F.sum(F.col("s") * (F.col("below") + F.col("f") / 2.0)).alias("u"),
        F.sum(t * t * t - t).alias("tie_term"),
        F.sum("s").alias("n_s"),
        F.sum("f").alias("n_f"),
    )
    made = made.where("n_s > 0 and n_f > 0")
    delta = 1 - 2 * F.col("u") / (F.col("n_s") * F.col("n_f"))
    return made.withColumn("delta", delta).withColumn("delta_size", cliffs_label(delta))


def welch(rows: DataFrame) -> DataFrame:
    """Welch's t of (success, failure) and its degrees of freedom; null where a side has fewer than two values."""
    m = moments(rows).where("n_s > 1 and n_f > 1")
    a, b = F.col("var_s") / F.col("n_s"), F.col("var_f") / F.col("n_f")
    return m.select(
        "threshold",
        "feature",
        F.try_divide(F.col("mean_s") - F.col("mean_f"), F.sqrt(a + b)).alias("t"),
        F.try_divide((a + b) * (a + b), a * a / (F.col("n_s") - 1) + b * b / (F.col("n_f") - 1)).alias("df"),
    )


def cohens_d(rows: DataFrame) -> DataFrame:
    """Difference of means of (success, failure) over the pooled deviation; zero for small or constant sides."""
    m = moments(rows).where("n_s > 0 and n_f > 0")
    n1, n2 = F.col("n_s"), F.col("n_f")
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("var_s") + (n2 - 1) * F.col("var_f"), n1 + n2 - 2))
    d = F.when((n1 > 1) & (n2 > 1), F.try_divide(F.col("mean_s") - F.col("mean_f"), pooled))
    d = F.coalesce(d, F.lit(0.0))
    return m.select("threshold", "feature", "n_s", "n_f", d.alias("d"), cohens_label(d).alias("d_size"))


def shapiro(rows: DataFrame) -> DataFrame:
    """n, W and z of Shapiro and Wilk of each side with more than 11 values that aren't all one, by sums over distinct values."""
    keys = ["threshold", "feature", "success"]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("spread")).where("n > 11 and spread > 0")
    each = below(rows.groupBy(*keys, "value").agg(F.count("*").alias("c")), keys, "value", ["c"]).withColumnRenamed("below_c", "below")
    each = each.join(F.broadcast(whole), keys).withColumn("x", F.col("value") - F.col("mean"))
    n = F.col("n")
    ends = [F.max(F.when((F.col("below") < r) & (r <= F.col("below") + F.col("c")), F.col("x"))).alias(e) for e, r in (("x1", F.lit(1)), ("x2", F.lit(2)), ("y2", n - 1), ("y1", n))]
    made = each.groupBy(*keys, "n", "spread").agg(F.sum(F.col("x") * score_sums(F.col("below"), F.col("c"), n)).alias("dot"), *ends)
    return with_shapiro(made.withColumn("square", square_sum(n))).select(*keys, "n", "w", "z")


def normality(rows: DataFrame) -> DataFrame:
    """Shapiro-Wilk p of each side; ``approximate`` where a side has more than 5000 values, beyond the formula's range.

    Sides of at most 11 values have a formula of their own; constant ones and those of fewer than three values have p 1.
    """
    import pandas as pd

    from wayscore.functions.special import normal_tail, shapiro_p

    keys, types = ["threshold", "feature", "success"], "threshold double, feature string, success boolean"
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("value") < F.max("value")).alias("varied"))
    few = rows.join(sizes.where("n <= 11 or not varied").groupBy(*keys).agg(F.max("varied").alias("varied")), keys)
    # a constant side is told by two of its values
    few = few.groupBy(*keys, "value").agg(F.least(F.count("*"), F.lit(11)).alias("c")).select(*keys, F.explode(F.array_repeat("value", F.col("c").cast("int"))).alias("value"))

    def test(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, shapiro_p(frame["value"]))], columns=[*keys, "p"])

    def tails(frames):
        for f in frames:
            yield f[keys].assign(p=[1.0 if pd.isna(z) else normal_tail(z) for z in f["z"]])

    tested = few.groupBy(*keys).applyInPandas(test, f"{types}, p double")
    tested = tested.unionByName(shapiro(rows).select(*keys, "z").mapInPandas(tails, f"{types}, p double"))
    return sizes.drop("varied").join(tested, keys, "left").withColumn("approximate", F.col("n") > SHAPIRO_MOST)


def p_values(rows: DataFrame) -> DataFrame:
    """Two-sided p of Mann-Whitney and Welch per (threshold, feature)."""
    import pandas as pd

    from wayscore.functions.special import mann_whitney_p, t_two_sided

    both = mann_whitney(rows).join(welch(rows), ["threshold", "feature"], "left")

    def add(frames):
        for f in frames:
            u = [mann_whitney_p(float(r.u), int(r.n_s), int(r.n_f), float(r.tie_term)) for r in f.itertuples()]
            t = [None if pd.isna(r.t) or pd.isna(r.df) else t_two_sided(float(r.t), float(r.df)) for r in f.itertuples()]
            yield f[["threshold", "feature"]].assign(p_mann_whitney=u, p_welch=t)

    return both.mapInPandas(add, "threshold double, feature string, p_mann_whitney double, p_welch double")


def all_tests(frame: DataFrame, features: list[str], thresholds=THRESHOLDS, score: str = "score") -> DataFrame:
    """Every test of every feature at every threshold; an empty frame gives no rows."""
    rows = tall(frame, features, thresholds, score)
    keys = ["threshold", "feature"]
    normal = normality(rows).groupBy(*keys).agg(F.max(F.when(F.col("success"), F.col("p"))).alias("normal_success"), F.max(F.when(~F.col("success"), F.col("p"))).alias("normal_failure"))
    return mann_whitney(rows).join(welch(rows), keys, "left").join(cohens_d(rows).drop("n_s", "n_f"), keys, "left").join(p_values(rows), keys, "left").join(normal, keys, "left")


# What features are called in tables.
LABELS = {"real_len": "Vulnerable Path Length", "n_files": "Number of Files per Path", "input_tokens": "Number of Input Tokens", "n_lines": "Number of Input Lines",
          "realPathLen": "Vulnerable Path Length", "numInputFiles": "Number of Files per Path", "numInputTokens": "Number of Input Tokens", "numInputLines": "Number of Input Lines"}


def presented(tests: DataFrame, thresholds=THRESHOLDS, labels: dict[str, str] | None = None) -> DataFrame:
    """Rows are features, by their labels if given; per threshold, in numeric order, columns t<threshold>_p and t<threshold>_delta."""
    from wayscore.functions.numeric import shown_effect, shown_p

    name = F.col("feature")
    if labels:
        name = F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[name], name)
    cells = tests.select(name.alias("feature"), "threshold", shown_p(F.col("p_mann_whitney")).alias("p"), shown_effect(F.col("delta"), F.col("delta_size")).alias("delta"))
    made = []
    for t in sorted(thresholds):
        made += [F.max(F.when(F.col("threshold") == t, F.col(c))).alias(f"t{t:g}_{c}") for c in ("p", "delta")]
    return cells.groupBy("feature").agg(*made).orderBy("feature")


def nested(tests: DataFrame) -> DataFrame:
    """All tests as one JSON object: threshold to feature to wilcoxon_p, delta and mag, one row."""
    effect = F.struct(F.col("p_mann_whitney").alias("wilcoxon_p"), F.col("delta"), F.col("delta_size").alias("mag"))
    per = tests.groupBy("threshold").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("feature", effect)))).alias("features"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("threshold", "features"))), lambda x: F.concat(F.lit('"'), x["threshold"].cast("string"), F.lit('": '), x["features"]))
    return per.agg(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("value"))


def loaded(texts: DataFrame, p_key: str = "wilcoxon_p", delta_key: str = "delta", size_key: str = "mag") -> DataFrame:
    """Tests from texts (value) that hold threshold to feature to values, as JSON or as a Python literal: threshold, feature, p_mann_whitney, delta, delta_size.

    Thresholds and features are whatever the texts name.  A value that is missing,
    None or not a number is null; a text of another shape is an error.
    """
    # words of a literal outside of quotes become JSON's
    raw = plain = F.col("value")
    for word, json in (("None", "null"), ("nan", "null"), ("NaN", "null"), ("True", "true"), ("False", "false")):
        plain = F.regexp_replace(plain, rf"(?<![\w'\"]){word}(?![\w'\"])", json)
    plain = F.regexp_replace(plain, r",\s*([}\]])", "$1")
    shape = "map<string,map<string,map<string,string>>>"
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    found = F.coalesce(F.from_json(plain, shape, options), F.raise_error(F.concat(F.lit("not a table of tests: "), F.left(raw, F.lit(80)))).cast(shape))
    rows = texts.select(F.explode(found).alias("threshold", "features")).select("threshold", F.explode("features").alias("feature", "v"))
    number = lambda k: F.nanvl(F.col("v")[k].try_cast("double"), F.lit(None).cast("double"))
    return rows.select(F.col("threshold").cast("double").alias("threshold"), "feature", number(p_key).alias("p_mann_whitney"), number(delta_key).alias("delta"), F.lower(F.col("v")[size_key]).alias("delta_size"))


def presented_texts(texts: DataFrame, labels: dict[str, str] | None = None, **keys: str) -> DataFrame:
    """``presented`` of the tests in ``texts``, with a column pair for every threshold that they name."""
    tests = loaded(texts, **keys)
    thresholds = [r.threshold for r in tests.select("threshold").distinct().orderBy("threshold").collect()]
    return presented(tests, thresholds, LABELS if labels is None else labels)


def quantiles(frame: DataFrame, features: list[str], threshold: float, score: str = "score") -> DataFrame:
    """Box summary of each side of a threshold; a null score counts as zero."""
    filled = frame.withColumn(score, F.coalesce(score, F.lit(0.0)))
    rows = tall(filled, features, (threshold,), score)
    each = rows.groupBy("feature", "success", "value").agg(F.count("*").alias("c"))
    made = exact_quantiles(each, ["feature", "success"], "value", "c", (0.0, 0.25, 0.5, 0.75, 1.0))
    return made.select("feature", "success", "n", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "middle", "q3", "high"))))


def histogram(frame: DataFrame, feature: str, low: float, high: float, bins: int) -> DataFrame:
    made = frame.select(F.width_bucket(F.col(feature).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin"))
    return made.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


#: Cells to a bandwidth; a value's weight goes to the two cells beside it.
CELLS = 32
REACH = 9  # bandwidths beyond which a kernel adds nothing


def density(frame: DataFrame, features: list[str], threshold: float, score: str = "score", points: int = 100) -> DataFrame:
    """The density of each side of a threshold at ``points`` places from its least to its largest value: feature, success, point, at, density.

    Gaussian kernels of Scott's bandwidth, n ** -0.2 sample deviations.  Values
    are first dealt to cells of a 32nd of that, so the work beyond them goes by
    occupied cells; the error is below a part in a thousand of the peak.  A null
    score counts as zero, null values are left out.  A side without spread is one
    point of density one.
    """
    filled = frame.withColumn(score, F.coalesce(score, F.lit(0.0)))
    rows = tall(filled, features, (threshold,), score)
    keys = ["feature", "success"]
    shape = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_samp("value").alias("deviation"))
    shape = shape.select(*keys, "n", "low", "high", (F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("deviation")).alias("h"))
    spread = shape.where("low < high").withColumns({"cell": F.col("h") / CELLS, "step": (F.col("high") - F.col("low")) / (points - 1)})
    each = rows.groupBy(*keys, "value").agg(F.count("*").alias("c")).join(F.broadcast(spread), keys)
    each = each.withColumn("place", (F.col("value") - F.col("low")) / F.col("cell"))
    left = F.floor("place")
    share = F.col("place") - left
    beside = F.explode(F.array(F.struct(left.alias("b"), (F.col("c") * (1 - share)).alias("w")), F.struct((left + 1).alias("b"), (F.col("c") * share).alias("w"))))
    cells = each.select(*keys, beside.alias("x")).groupBy(*keys, "x.b").agg(F.sum("x.w").alias("w")).join(F.broadcast(spread), keys)
    off = F.col("b") * F.col("cell")  # from the least value
    first, last = F.greatest(F.ceil((off - REACH * F.col("h")) / F.col("step")), F.lit(0)), F.least(F.floor((off + REACH * F.col("h")) / F.col("step")), F.lit(points - 1))
    near = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    u = (F.col("point") * F.col("step") - off) / F.col("h")
    sums = near.groupBy(*keys, "point").agg(F.sum(F.col("w") * F.exp(-u * u / 2)).alias("sum"))
    grid = spread.withColumn("point", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
    curve = grid.join(sums, [*keys, "point"], "left").select(
        *keys, "point", (F.col("low") + F.col("point") * F.col("step")).alias("at"), (F.coalesce("sum", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density")
    )
    return curve.unionByName(shape.where("low = high").select(*keys, F.lit(0).cast("bigint").alias("point"), F.col("low").alias("at"), F.lit(1.0).alias("density")))


def auc(frame: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from mid-ranks, and Brier score, of a 0/1 label and a probability; of each group of ``by`` if given."""
    keys = by or []
    each = frame.groupBy(*keys, F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("s"), F.count_if(F.col(label) == 0).alias("f"))
    each = below(each.where("v is not null"), keys, "v", ["f"]).withColumnRenamed("below_f", "below")
    return each.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("s") * (F.col("below") + F.col("f") / 2.0)), (F.sum("s") * F.sum("f")).cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("s") * F.pow(F.col("v") - 1, F.lit(2)) + F.col("f") * F.col("v") * F.col("v")), F.sum(F.col("s") + F.col("f")).cast("double")).alias("brier"),
    )
