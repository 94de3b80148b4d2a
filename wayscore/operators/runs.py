"""Contiguous runs: how far a predicted path follows a reference path without a gap."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wayscore.operators.nodes import intervals_meet, overlap_pairs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


def _meets(r: Column, p: Column) -> Column:
    return (r["file"] == p["file"]) & intervals_meet(r["start_line"], r["end_line"], p["start_line"], p["end_line"])


def walk(real: Column, pred: Column, i: Column, j: Column) -> Column:
    """From matching (i, j): each predicted node takes one or more successive reference nodes; the first that takes none ends the run."""
    state = F.struct(i.cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("done"))

    def step(s, p):
        rest = F.slice(real, s["i"].cast("int") + 1, F.greatest(F.size(real), F.lit(1)))
        stop = F.array_position(F.transform(rest, lambda r: F.coalesce(_meets(r, p), F.lit(False))), False)
        k = F.when(stop > 0, stop - 1).otherwise(F.size(rest).cast("bigint"))
        over = s["done"] | (k == 0)
        return F.struct(
            F.when(over, s["i"]).otherwise(s["i"] + k).alias("i"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), over.alias("done")
        )

    return F.aggregate(F.slice(pred, j.cast("int") + 1, F.greatest(F.size(pred), F.lit(1))), state, step)


def _arrays(nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    node = F.struct("node_idx", "file", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))
    return nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(node)).alias(name))


def path_arrays(real: DataFrame) -> DataFrame:
    return _arrays(real, ["case_id", "path_ord"], "real")


def finding_arrays(pred: DataFrame) -> DataFrame:
    return _arrays(pred, ["run_id", "op_idx"], "pred")


def contiguous_runs(pred: DataFrame, real: DataFrame, runs: DataFrame) -> DataFrame:
    """The earliest run of every (run, path, finding) with a match.

    Returns run_id, case_id, path_ord, op_idx, lcs_len, real_start, real_end,
    out_start, out_end, lcs_real_len, lcs_out_len, lcnr.  Earliest, not
    longest: the run with the smallest (reference, predicted) start.
    """
    seeds = overlap_pairs(pred, real, runs, guard=False).groupBy("run_id", "case_id", "path_ord", "op_idx")
    return _walked(seeds.agg(F.min(F.struct("real_idx", "pred_idx")).alias("seed")), pred, real)


def _ends(of_r, of_p, n_real, n_pred):
    """Of the matching pairs of nodes of many pairs of paths: pair, reference index, end of the run in the reference, predicted index, predicted nodes taken.

    ``of_r`` and ``of_p`` are the nodes of all pairs end to end: file as a number below nil
    where nothing can meet it, first and last line.  All pairs take a step together, from
    their last predicted nodes back; ``end[i]`` is where a run that stands at reference
    node i ends if the next predicted node is the one at hand.  What is found comes node by node.
    """
    import numpy as np

    order = np.argsort(-n_pred, kind="stable")  # pairs that have a node left come first
    n_real, n_pred, first_r, first_p = (x[order] for x in (n_real, n_pred, np.cumsum(n_real) - n_real, np.cumsum(n_pred) - n_pred))
    # each reference path is followed by a node that is never met
    room = n_real + 1
    begin = np.cumsum(room) - room
    pair = np.repeat(np.arange(len(room)), room)
    here = np.arange(len(pair))
    inside = here - begin[pair] < n_real[pair]
    file_r, low_r, high_r = (np.zeros(len(pair), dtype=np.int64) for _ in range(3))
    for to, nodes in zip((file_r, low_r, high_r), of_r, strict=True):
        to[inside] = nodes[(first_r[pair] + here - begin[pair])[inside]]
    file_r[~inside] = -1
    end, taken = here.copy(), np.zeros(len(here), dtype=np.int64)
    for back in range(1, n_pred.max(initial=0) + 1):
        live = int(np.searchsorted(-n_pred, -back, side="right"))
        n = int(begin[live - 1] + room[live - 1])
        file_p, low_p, high_p = (x[(first_p + n_pred)[:live] - back][pair[:n]] for x in of_p)
        meets = (file_p >= 0) & (file_p == file_r[:n]) & (high_p >= low_r[:n]) & (high_r[:n] >= low_p)
        stop = np.minimum.accumulate(np.where(meets, n, here[:n])[::-1])[::-1]  # the first node from each on that isn't met
        end[:n], taken[:n] = np.where(meets, end[stop], here[:n]), np.where(meets, taken[stop] + 1, 0)
        at = np.flatnonzero(meets)
        own = pair[at]
        yield order[own], at - begin[own], end[at] - begin[own], n_pred[own] - back, taken[at]


def _walked_at_once(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def nodes(column):
        flat = column.flatten()
        lines = [flat.field(k) for k in ("start_line", "end_line")]
        known = flat.field("file").is_valid().to_numpy(zero_copy_only=False)
        for x in lines:
            known = known & x.is_valid().to_numpy(zero_copy_only=False)
        return flat.field("file"), known, [x.fill_null(0).to_numpy(zero_copy_only=False) for x in lines], np.diff(np.asarray(column.offsets)).astype(np.int64)

    def made(batch, found, n_real, n_pred):
        row, start, end, out, taken = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, n_real, n_pred = batch.select(range(4)).take(pa.array(row)), n_real[row], n_pred[row]
        columns = [end - start, start, end - 1, out, out + taken - 1, n_real, n_pred, (end - start) / n_real]
        return pa.RecordBatch.from_arrays([*keys.columns, *map(pa.array, columns)], [*keys.schema.names, *RUN])

    for batch in batches:
        if not batch.num_rows:
            continue
        (files_r, known_r, lines_r, n_real), (files_p, known_p, lines_p, n_pred) = nodes(batch.column(4)), nodes(batch.column(5))
        codes = pa.chunked_array([files_r, files_p]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        codes = np.where(np.concatenate([known_r, known_p]), codes, -1)
        of_r, of_p = (codes[: len(known_r)], *lines_r), (codes[len(known_r) :], *lines_p)
        at_r, at_p = (np.concatenate([[0], np.cumsum(n)]) for n in (n_real, n_pred))
        # pairs go in blocks of NODES reference nodes and what the last path has beyond them; rows leave as soon as there are as many
        cuts = np.flatnonzero(np.diff(at_r[:-1] // NODES, prepend=-1))
        for i, k in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            found, n = [], 0
            for row, *run in _ends([x[at_r[i] : at_r[k]] for x in of_r], [x[at_p[i] : at_p[k]] for x in of_p], n_real[i:k], n_pred[i:k]):
                found.append((row + i, *run))
                n += len(row)
                if n >= NODES:
                    yield made(batch, found, n_real, n_pred)
                    found, n = [], 0
            if n:
                yield made(batch, found, n_real, n_pred)


NODES = 1 << 16
RUN = ("lcs_len", "real_start", "real_end", "out_start", "out_end", "lcs_real_len", "lcs_out_len", "lcnr")


def all_runs(pred: DataFrame, real: DataFrame, runs: DataFrame, min_len: int = 1) -> DataFrame:
    """The runs from every matching pair of nodes that take at least ``min_len`` reference nodes, as ``contiguous_runs`` returns them.

    Findings meet the paths that share a file; a programme that steps through many of these pairs together gives all of their runs.
    """
    # a pair that shares several files counts at the first of them; no node without a file is met
    files = lambda nodes: F.array_distinct(F.array_compact(F.transform(nodes, lambda x: x["file"])))
    bare = lambda nodes: F.transform(nodes, lambda x: F.struct(x["file"].alias("file"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    left = finding_arrays(pred).join(runs.select("run_id", "case_id").distinct(), "run_id").withColumn("file", F.explode(files("pred"))).withColumn("pred", bare("pred"))
    right = path_arrays(real).withColumn("file", F.explode(files("real"))).withColumn("real", bare("real"))
    met = left.join(right, ["case_id", "file"]).where(F.get(F.array_intersect(files("pred"), files("real")), F.lit(0)) == F.col("file"))
    both = met.select("run_id", "case_id", "path_ord", "op_idx", "real", "pred")
    schema = StructType([*both.schema.fields[:4], *(StructField(c, DoubleType() if c == "lcnr" else LongType()) for c in RUN)])
    return both.mapInArrow(_walked_at_once, schema).where(F.col("lcs_len") >= min_len)


def longest_runs(pred: DataFrame, real: DataFrame, runs: DataFrame) -> DataFrame:
    """The longest run of every (run, path, finding) with a match; of equal ones the earliest."""
    found = all_runs(pred, real, runs)
    keys = ["run_id", "case_id", "path_ord", "op_idx"]
    rest = [c for c in found.columns if c not in keys]
    best = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("lcs_len", -F.col("real_start"), -F.col("out_start"))).alias("b"))
    return best.select(*keys, "b.*")


def _walked(seeds: DataFrame, pred: DataFrame, real: DataFrame) -> DataFrame:
    both = seeds.join(path_arrays(real), ["case_id", "path_ord"]).join(finding_arrays(pred), ["run_id", "op_idx"])
    i, j = F.col("seed.real_idx"), F.col("seed.pred_idx")
    walked = both.withColumn("w", walk(F.col("real"), F.col("pred"), i, j))
    length = F.col("w.i") - i
    return walked.select(
        "run_id",
        "case_id",
        "path_ord",
        "op_idx",
        length.cast("bigint").alias("lcs_len"),
        i.cast("bigint").alias("real_start"),
        (F.col("w.i") - 1).cast("bigint").alias("real_end"),
        j.cast("bigint").alias("out_start"),
        (j + F.col("w.n") - 1).cast("bigint").alias("out_end"),
        F.size("real").cast("bigint").alias("lcs_real_len"),
        F.size("pred").cast("bigint").alias("lcs_out_len"),
        (length / F.size("real")).alias("lcnr"),
    )


def without_overlaps(found: DataFrame) -> DataFrame:
    """Greedy choice by length of runs whose reference and predicted ranges are unused, per (run, path, finding).

    Of equally long ones the first by predicted and then reference start is taken.
    """
    keys = ["run_id", "case_id", "path_ord", "op_idx"]
    rest = [c for c in found.columns if c not in keys]
    order = F.struct((-F.col("lcs_len")).alias("o1"), F.col("out_start").alias("o2"), F.col("real_start").alias("o3"), F.struct(*rest).alias("r"))
    listed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("all"))
    runs = F.transform("all", lambda x: x["r"])
    apart = lambda x, y, a, b: (x[b] < y[a]) | (x[a] > y[b])

    def choose(kept, x):
        clash = F.exists(kept, lambda y: ~apart(x, y, "real_start", "real_end") | ~apart(x, y, "out_start", "out_end"))
        return F.when(clash, kept).otherwise(F.array_append(kept, x))

    chosen = F.aggregate(runs, F.slice(runs, 1, 1), choose)
    return listed.select(*keys, F.explode(chosen).alias("r")).select(*keys, "r.*")
