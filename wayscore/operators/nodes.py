"""Matching of predicted nodes to reference nodes by file and line interval.

Frames: real (case_id, path_ord, node_idx, file, start_line, end_line), pred
(run_id, op_idx, node_idx, file, start_line, end_line), runs (run_id,
case_id).  All joins are equi joins with a range residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("run_id", "path_ord", "op_idx")


def intervals_meet(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return ~((a2 < b1) | (b2 < a1))


def dedupe_nodes(nodes: DataFrame, path: list[str]) -> DataFrame:
    """First occurrence of each (file, start, end) of a path, numbered anew; a null end is the start."""
    filled = nodes.withColumn("end_line", F.coalesce("end_line", "start_line"))
    first = Window.partitionBy(*path, "file", "start_line", "end_line").orderBy("node_idx")
    kept = filled.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("node_idx", F.row_number().over(Window.partitionBy(*path).orderBy("node_idx")) - 1)


def overlap_pairs(pred: DataFrame, real: DataFrame, runs: DataFrame, guard: bool = True, bucket: int | None = None) -> DataFrame:
    """Node pairs that share a file and overlap in lines: run_id, case_id, path_ord, op_idx, real_idx, pred_idx.

    ``guard`` leaves out reference nodes with a negative start.  ``bucket``
    adds a line bucket to the key, for files with very many nodes.
    """
    p = pred.join(runs.select("run_id", "case_id"), "run_id").select(
        "run_id", "case_id", "op_idx", F.col("node_idx").alias("pred_idx"), "file", F.col("start_line").alias("p1"), F.col("end_line").alias("p2")
    )
    r = real.select("case_id", "path_ord", F.col("node_idx").alias("real_idx"), "file", F.col("start_line").alias("r1"), F.col("end_line").alias("r2"))
    if guard:
        r = r.where("r1 >= 0")
    keys = ["case_id", "file"]
    if bucket:
        def spread(x1, x2):
            low = F.floor(F.least(x1, x2) / bucket)
            return F.explode(F.sequence(low, F.greatest(low, F.floor(F.greatest(x1, x2) / bucket))))

        p, r = p.withColumn("_b", spread(F.col("p1"), F.col("p2"))), r.withColumn("_b", spread(F.col("r1"), F.col("r2")))
        keys.append("_b")
    met = p.join(r, keys).where(intervals_meet(F.col("r1"), F.col("r2"), F.col("p1"), F.col("p2")))
    met = met.select("run_id", "case_id", "path_ord", "op_idx", "real_idx", "pred_idx")
    return met.distinct() if bucket else met


def line_pairs(pred_lines: DataFrame, real: DataFrame, runs: DataFrame) -> DataFrame:
    """Reported lines that fall into reference nodes: run_id, case_id, path_ord, real_idx, file, line."""
    p = pred_lines.join(runs.select("run_id", "case_id"), "run_id")
    r = real.select("case_id", "path_ord", F.col("node_idx").alias("real_idx"), "file", "start_line", "end_line")
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    return p.join(r, ["case_id", "file"]).where(inside).select("run_id", "case_id", "path_ord", "real_idx", "file", "line")


def path_lengths(real: DataFrame) -> DataFrame:
    return real.groupBy("case_id", "path_ord").agg(F.count("*").alias("real_len"))


def pair_matches(pairs: DataFrame, real: DataFrame, pred: DataFrame) -> DataFrame:
    """Per (run, path, finding) with a match: overlap, lengths, ratio, end hits and all files of the predicted path."""
    found = pairs.groupBy("run_id", "case_id", "path_ord", "op_idx").agg(
        F.count_distinct("real_idx").alias("overlap_nodes"), F.min("real_idx").alias("first_idx"), F.max("real_idx").alias("last_idx")
    )
    shape = pred.groupBy("run_id", "op_idx").agg(F.count("*").alias("out_len"), F.sort_array(F.collect_set("file")).alias("out_files"))
    joined = found.join(path_lengths(real), ["case_id", "path_ord"]).join(shape, ["run_id", "op_idx"])
    return joined.select(
        "run_id",
        "case_id",
        "path_ord",
        "op_idx",
        "overlap_nodes",
        "real_len",
        "out_len",
        "out_files",
        (F.col("overlap_nodes") / F.col("real_len")).alias("nor"),
        (F.col("first_idx") == 0).alias("source_hit"),
        (F.col("last_idx") == F.col("real_len") - 1).alias("sink_hit"),
    )


def line_matches(pred_lines: DataFrame, real: DataFrame, runs: DataFrame) -> DataFrame:
    """Line-form matches per (run, path), over deduplicated reference nodes."""
    clean = dedupe_nodes(real, ["case_id", "path_ord"])
    found = line_pairs(pred_lines, clean, runs).groupBy("run_id", "case_id", "path_ord").agg(
        F.count_distinct("real_idx").alias("overlap_nodes"), F.sort_array(F.collect_set("file")).alias("matched_files")
    )
    files = pred_lines.groupBy("run_id").agg(F.count_distinct("file").alias("out_files_total"))
    joined = found.join(path_lengths(clean), ["case_id", "path_ord"]).join(files, "run_id")
    return joined.withColumn("nor", F.col("overlap_nodes") / F.col("real_len"))
