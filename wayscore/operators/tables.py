"""Summary tables over results: per model, per weakness class, per prompt type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions.numeric import matthews, number, ratio
from wayscore.operators.ranks import exact_quantiles


def _rate(hit: str, inside: Column) -> Column:
    return F.avg(F.when(inside, F.coalesce(F.col(hit).cast("double"), F.lit(0.0))))


def overlapping() -> Column:
    return (F.col("nor") > 0) | (F.col("overlap_nodes") > 0)


def model_summary(frame: DataFrame, prompt: str = "llmpath") -> DataFrame:
    """Medians of both ratios and mean end hits (over rows with overlap) of each model, for one prompt."""
    some = overlapping()
    hit = lambda c: F.when(some, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("nor", "lcnr"))))
    rows = frame.where(F.col("prompt") == prompt).select("model", both.alias("m"), hit("source_hit").alias("source"), hit("sink_hit").alias("sink"), some.alias("some"))
    # one row per distinct value, from which counts, means and medians follow
    each = rows.groupBy("model", "m.measure", "m.value").agg(F.count("*").alias("c"), F.count_if("some").alias("c_some"), F.sum("source").alias("source"), F.sum("sink").alias("sink"))
    middle = exact_quantiles(each, ["model", "measure"], "value", "c", (0.5,)).groupBy("model")
    middle = middle.agg(*(F.max(F.when(F.col("measure") == c, F.get("q", F.lit(0)))).alias(f"median_{c}") for c in ("nor", "lcnr")))
    found = each.where("measure = 'nor'").groupBy("model").agg(
        F.sum("c").alias("runs"),
        F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum(F.when(F.col("value").isNotNull(), F.col("c")))).alias("mean_nor"),
        F.try_divide(F.sum("source"), F.sum("c_some")).alias("source_rate"),
        F.try_divide(F.sum("sink"), F.sum("c_some")).alias("sink_rate"),
    )
    made = found.join(F.broadcast(middle), "model", "left")
    made = made.select("model", "runs", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median_nor", "median_lcnr", "mean_nor", "source_rate", "sink_rate")))
    return made.orderBy(F.desc("median_nor"), F.desc("median_lcnr"), F.desc("source_rate"), F.desc("sink_rate"), "model")


def by_tag(frame: DataFrame, tags: Column, targets: list, measures: dict[str, Column], medians: dict[str, Column] | None = None) -> DataFrame:
    """Aggregates and medians per target tag, as rows of measures and one column per tag; groups overlap, and empty ones are null.

    Medians are exact, from distinct values that are dealt over many tasks.
    """
    wanted = frame.sparkSession.createDataFrame([(t,) for t in targets], ["tag"])
    hit = frame.withColumn("tag", F.explode(F.array_intersect(tags, F.array(*map(F.lit, targets)))))
    made = F.broadcast(wanted)
    if measures:
        made = made.join(hit.groupBy("tag").agg(*(c.cast("double").alias(n) for n, c in measures.items())), "tag", "left")
    tall = made.select("tag", F.explode(F.create_map(*(x for n in measures for x in (F.lit(n), F.col(n))))).alias("measure", "value")) if measures else None
    if medians:
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), c.cast("double").alias("value")) for n, c in medians.items())))
        each = hit.select("tag", cells.alias("m")).groupBy("tag", "m.measure", "m.value").agg(F.count("*").alias("c"))
        middle = exact_quantiles(each, ["tag", "measure"], "value", "c", (0.5,)).select("tag", "measure", F.get("q", F.lit(0)).alias("value"))
        every = F.broadcast(wanted.select("tag", F.explode(F.array(*map(F.lit, medians))).alias("measure"))).join(middle, ["tag", "measure"], "left")
        tall = every if tall is None else tall.unionByName(every)
    return tall.groupBy("measure").pivot("tag", targets).agg(F.first("value"))


def weakness_table(frame: DataFrame, targets: tuple[int, ...] = (22, 20, 94, 502)) -> DataFrame:
    """Median ratios and end-hit means of results with column cwes, per weakness class."""
    some = overlapping()
    measures = {"source_rate": _rate("source_hit", some), "sink_rate": _rate("sink_hit", some)}
    return by_tag(frame, F.col("cwes"), list(targets), measures, {"median_nor": F.col("nor"), "median_lcnr": F.col("lcnr")})


def confusion(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and metrics of columns actual and predicted (0/1) per group; zero denominators give zero."""
    actual, predicted = number(F.col("actual")).cast("int"), number(F.col("predicted")).cast("int")
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    counts = [F.count_if((actual == a) & (predicted == p)).alias(n) for n, (a, p) in cells.items()]
    made = frame.groupBy(*keys).agg(*counts) if keys else frame.agg(*counts)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return made.withColumns(
        {"fpr": ratio(fp, fp + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "mcc": matthews(tp, tn, fp, fn)}
    )


def prompt_comparison(frame: DataFrame, reference: str, models: list[str] | None = None, prompts: list[str] | None = None) -> DataFrame:
    """Confusion metrics per (model, prompt), with what the reference prompt has more of false positives; blank for itself."""
    made = confusion(frame, ["model", "prompt"])
    for column, wanted in (("model", models), ("prompt", prompts)):
        if wanted is not None:
            made = made.where(F.col(column).isin(wanted))
    base = made.where(F.col("prompt") == reference).select("model", F.col("fp").alias("_fp"), F.col("fpr").alias("_fpr"))
    other = F.col("prompt") != reference
    out = made.join(base, "model", "left").withColumns(
        {"delta_fp": F.when(other, F.col("_fp") - F.col("fp")), "delta_fpr": F.when(other, F.col("_fpr") - F.col("fpr"))}
    )
    ranks = []
    for column, wanted in (("model", models), ("prompt", prompts)):
        listed = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
        ranks += [F.when(F.array_position(listed, F.col(column)) > 0, F.array_position(listed, F.col(column))).otherwise(1 << 30), F.col(column)]
    return out.drop("_fp", "_fpr").orderBy(*ranks)


def single_file_positives(frame: DataFrame, models: list[str]) -> DataFrame:
    return frame.where(F.col("model").isin(models) & (F.col("n_files") == 1))


def binary_summary(frame: DataFrame) -> DataFrame:
    """Counts, accuracy and false-positive rate over a whole frame."""
    made = confusion(frame, [])
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return made.select(total.alias("total"), "tp", "tn", "fp", "fn", ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), "fpr")
