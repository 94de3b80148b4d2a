"""Reduction of matches to the best one of each run, and of runs to one row per case, prompt and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayscore.functions.numeric import unsentinel
from wayscore.operators.nodes import intervals_meet
from wayscore.operators.runs import finding_arrays, path_arrays, walk


def best_match(matches: DataFrame) -> DataFrame:
    """Highest ratio of each run; of equal ones the first in (finding, path) order."""
    order = F.struct("nor", -F.col("op_idx"), -F.col("path_ord"))
    kept = ["path_ord", "op_idx", "nor", "overlap_nodes", "real_len", "out_len", "source_hit", "sink_hit"]
    return matches.groupBy("run_id").agg(F.max_by(F.struct(*kept), order).alias("b")).select("run_id", *(F.col(f"b.{c}").alias(c) for c in kept))


def best_run(found: DataFrame) -> DataFrame:
    """Longest share of each run; of equal ones the first in (path, finding) order."""
    order = F.struct("lcnr", -F.col("path_ord"), -F.col("op_idx"))
    kept = ["lcnr", "lcs_len", "lcs_real_len", "lcs_out_len"]
    return found.groupBy("run_id").agg(F.max_by(F.struct(*kept), order).alias("b")).select("run_id", *(F.col(f"b.{c}").alias(c) for c in kept))


def median_lengths(runs: DataFrame, paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Exact medians of the path lengths of each run's case and output, zero where there is none; paths and findings as arrays of nodes."""
    r = paths.groupBy("case_id").agg(F.median(F.size("real")).alias("real_median"))
    p = findings.groupBy("run_id").agg(F.median(F.size("pred")).alias("out_median"))
    joined = runs.join(r, "case_id", "left").join(p, "run_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("real_median", "out_median")})


def _scored(runs: DataFrame, paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Best match and longest share of each run with a match, in one pass over its (path, finding) arrays."""
    files = lambda nodes: F.array_distinct(F.transform(nodes, lambda x: x["file"]))
    # findings meet paths that share a file with them; a pair that shares several counts at the first of them
    left = runs.select("run_id", "case_id").join(findings, "run_id").withColumn("pred_files", files("pred")).withColumn("file", F.explode("pred_files"))
    right = paths.withColumn("real_files", files("real")).withColumn("file", F.explode("real_files"))
    met = left.join(right, ["case_id", "file"]).where(F.get(F.array_intersect("pred_files", "real_files"), F.lit(0)) == F.col("file"))
    meets = lambda r, p: F.coalesce((r["file"] == p["file"]) & intervals_meet(r["start_line"], r["end_line"], p["start_line"], p["end_line"]), F.lit(False))
    # positions of reference nodes that a predicted node meets, and the first of those with its first predicted node
    hit = F.filter(F.sequence(F.lit(0), F.size("real") - 1), lambda i: F.exists("pred", lambda p: meets(F.get("real", i), p)))
    met = met.withColumn("hits", hit).where(F.size("hits") > 0)
    guarded = F.filter("hits", lambda i: F.get("real", i)["start_line"] >= 0)
    met = met.withColumn("guarded", guarded).withColumn("i", F.get("hits", F.lit(0)))
    first = F.array_position(F.transform("pred", lambda p: meets(F.get("real", F.col("i")), p)), True) - 1
    met = met.withColumn("j", first).withColumn("w", walk(F.col("real"), F.col("pred"), F.col("i"), F.col("j")))
    n_real, n_pred, n = F.size("real").cast("bigint"), F.size("pred").cast("bigint"), F.size("guarded").cast("bigint")
    index = lambda at: F.get("real", at)["node_idx"]
    met = met.select(
        "run_id",
        "path_ord",
        "op_idx",
        F.when(n > 0, F.struct((n / n_real).alias("nor"), n.alias("overlap_nodes"), n_real.alias("real_len"), n_pred.alias("out_len"),
            (index(F.get("guarded", F.lit(0))) == 0).alias("source_hit"), (index(F.element_at("guarded", -1)) == n_real - 1).alias("sink_hit"), F.sort_array("pred_files").alias("out_files"))).alias("match"),
        F.struct(((F.col("w.i") - F.col("i")) / n_real).alias("lcnr"), (F.col("w.i") - F.col("i")).cast("bigint").alias("lcs_len"), n_real.alias("lcs_real_len"), n_pred.alias("lcs_out_len")).alias("run"),
    )
    return met.groupBy("run_id").agg(
        F.max_by("match", F.when(F.col("match").isNotNull(), F.struct("match.nor", -F.col("op_idx"), -F.col("path_ord")))).alias("m"),
        F.max_by("run", F.struct("run.lcnr", -F.col("path_ord"), -F.col("op_idx"))).alias("r"),
    )


def results(runs: DataFrame, real: DataFrame, pred: DataFrame) -> DataFrame:
    """One row per run: its columns and best match, with the files of the matched finding; runs without a match get zeros, median lengths and no files."""
    paths, findings = path_arrays(real), finding_arrays(pred)
    joined = median_lengths(runs, paths, findings).join(_scored(runs, paths, findings), "run_id", "left")
    joined = joined.select(*runs.columns, "real_median", "out_median", "m.*", "r.*")
    zero = {c: unsentinel(F.coalesce(F.col(c), F.lit(-1))) for c in ("nor", "overlap_nodes", "lcnr", "lcs_len")}
    lengths = {
        "real_len": F.coalesce(F.col("real_len").cast("double"), "real_median"),
        "out_len": F.coalesce(F.col("out_len").cast("double"), "out_median"),
        "lcs_real_len": F.coalesce(F.col("lcs_real_len").cast("double"), "real_median"),
        "lcs_out_len": F.coalesce(F.col("lcs_out_len").cast("double"), "out_median"),
    }
    hits = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("source_hit", "sink_hit")}
    files = F.coalesce("out_files", F.array().cast("array<string>"))
    return joined.withColumns(zero | lengths | hits | {"out_files": files, "n_out_files": F.size(files).cast("bigint")}).drop("real_median", "out_median")


def one_per_group(frame: DataFrame, group: list[str], ties: list[str]) -> DataFrame:
    """The row of each group with the highest ratio, nulls last; ``ties`` order what is equal."""
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_last("nor"), *ties)
    return frame.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
