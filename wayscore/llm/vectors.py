"""Operator 3: near-duplicate embeddings by cross-polytope hashing.

Tight groups are first drawn into balls: vectors within a quarter turn's share
of a representative such that any two of them are linked (half the link
angle), so links within a ball are counted and not enumerated.  Cross-polytope
hashes after fast Hadamard rotations, probed in several buckets a table, then
bring balls together, and every candidate is verified with exact cosines in
double precision; sums of angles decide whole balls at a time, and only what
they leave open is compared vector by vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import connected_components, small_batches, written

#: Buckets of a table for each vector, so that chance meetings stay as many for each vector at any size.
SPARSE = 64


def hashes_for(rows: int, width: int) -> tuple[int, int]:
    """How many hashes of 2 * ``width`` values are concatenated, and the values that the last of them is folded to."""
    hashes = 1
    while (2 * width) ** hashes < SPARSE * max(rows, 2):
        hashes += 1
    return hashes, -(-SPARSE * max(rows, 2) // (2 * width) ** (hashes - 1))


def tables_for(hashes: int, fold: int | None, width: int) -> tuple[int, int]:
    """Tables and probes; a folded hash counts as the part of a whole one that it tells apart."""
    whole = hashes - 1 + (math.log(fold, 2 * width) if fold else 1)
    return math.ceil(8 * 1.6 ** (whole - 2)), max(3, round(2 * whole))


def _rotations(width: int, count: int, seed: int):
    import numpy as np

    signs = np.random.default_rng([seed, width, count]).choice([-1.0, 1.0], size=(count, 3, width))

    def hadamard(x):
        n, step = x.shape[1], 1
        while step < n:
            y, z = x.reshape(len(x), n // (2 * step), 2, step), np.empty((len(x), n // (2 * step), 2, step))
            np.add(y[:, :, 0], y[:, :, 1], out=z[:, :, 0])
            np.subtract(y[:, :, 0], y[:, :, 1], out=z[:, :, 1])
            x, step = z.reshape(len(x), n), step * 2
        return x

    def rotate(x, k):
        for s in signs[k]:
            x = hadamard(x * s)
        return x

    return rotate


def _width(d: int) -> int:
    return max(2, 1 << (d - 1).bit_length())


def _codes(x, hashes: int, tables: int, probes: int, seed: int, fold: int | None = None):
    """Bucket codes of unit vectors ``x``: an int64 array (rows, tables, probes); the last hash is taken modulo ``fold``."""
    import numpy as np

    rows, d = x.shape
    width = _width(d)
    padded = np.zeros((rows, width))
    padded[:, :d] = x
    rotate = _rotations(width, hashes * tables, seed)
    out = np.empty((rows, tables, probes), dtype=np.int64)
    near = min(4, width)
    at = np.arange(rows)
    for t in range(tables):
        picks, costs = [], []
        for h in range(hashes):
            y = rotate(padded, t * hashes + h)
            size = np.abs(y)
            top = np.argpartition(-size, near - 1, axis=1)[:, :near]
            order = np.argsort(-size[at[:, None], top], axis=1, kind="stable")
            top = np.take_along_axis(top, order, axis=1)
            value = np.take_along_axis(y, top, axis=1)
            picks.append(2 * top + (value < 0))
            big = np.abs(value)
            costs.append((big[:, :1] - big) / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-300))
        # all choices of one or two places away from the best, cheapest first
        combos = [(0,) * hashes]
        for h in range(hashes):
            combos += [tuple(j if g == h else 0 for g in range(hashes)) for j in range(1, near)]
            combos += [tuple(1 if g in (h, o) else 0 for g in range(hashes)) for o in range(h)]
        cost = np.stack([sum(costs[h][:, c[h]] ** 2 for h in range(hashes)) for c in combos], axis=1)
        chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code = np.zeros((rows, len(combos)), dtype=np.int64)
        for h in range(hashes):
            value = np.stack([picks[h][:, c[h]] for c in combos], axis=1)
            code = code * (2 * width) + (value % fold if fold and h == hashes - 1 else value)
        code = np.take_along_axis(code, chosen, axis=1)
        if chosen.shape[1] < probes:
            code = np.concatenate([code, np.repeat(code[:, :1], probes - chosen.shape[1], axis=1)], axis=1)
        out[:, t] = (code * np.int64(1024) + t) * np.int64(4096) + np.int64(d)
    return out


def _by_width(lists):
    """Positions of the vectors of each length, with their matrix."""
    import numpy as np

    lengths = np.array([len(v) for v in lists], dtype=np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.array([lists[i] for i in at], dtype=np.float64).reshape(len(at), d)


def _units(rounds: int, ball_hashes: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, vectors, keys = [], [], []
            raw = batch.column(1).to_pylist()
            usable = [i for i, v in enumerate(raw) if v and None not in v]
            names = batch.column(0).to_pylist()
            for at, x in _by_width([raw[i] for i in usable]):
                peak = np.abs(x).max(axis=1)
                good = np.isfinite(x).all(axis=1) & (peak > 0)
                at, x = at[good], x[good] / peak[good, None]
                if not len(at):
                    continue
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                ids += [names[usable[i]] for i in at]
                vectors += list(x)
                keys += list(_codes(x, ball_hashes, rounds, 1, seed + 1)[:, :, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))],
                ["vec_id", "v", "keys"],
            )

    return run


def _cosines(batches: Iterator) -> Iterator:
    """(a, va, b, vb, ...) -> (a, b, cosine); both vectors have unit length."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        va, vb = batch.column(1), batch.column(3)
        n = len(batch)
        cos = np.zeros(n)
        if n:
            la, lb = np.diff(np.asarray(va.offsets)), np.diff(np.asarray(vb.offsets))
            a, b = np.asarray(va.flatten()), np.asarray(vb.flatten())
            starts_a, starts_b = np.cumsum(la) - la, np.cumsum(lb) - lb
            for d in np.unique(la):
                at = np.flatnonzero((la == d) & (lb == d))
                x, y = a[starts_a[at, None] + np.arange(d)], b[starts_b[at, None] + np.arange(d)]
                cos[at] = np.einsum("ij,ij->i", x, y)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.clip(cos, -1, 1))], ["a", "b", "cosine"])


def _buckets(total: int, hashes: int | None, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rep, raw = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for at, x in _by_width(raw):
                width = _width(x.shape[1])
                k, fold = (hashes, None) if hashes else hashes_for(total, width)
                codes = _codes(x, k, *tables_for(k, fold, width), seed, fold).reshape(len(at), -1)
                pairs = np.unique(np.stack([codes.ravel(), np.repeat(rep[at], codes.shape[1])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["code", "rep"])

    return run


def _cosine_of(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosines of ``pairs`` (a, b); left: (a, va), right: (b, vb)."""
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "va", "b", "vb")
    return rows.mapInArrow(_cosines, "a bigint, b bigint, cosine double")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, hashes: int | None = None, ball_rounds: int = 4, seed: int = 7) -> DataFrame:
    """Links between vectors whose cosine is at least ``cosine``, as counts and components.

    Returns vec_id, n_links, component_id, kept, one row per input row.

    Null, empty or zero vectors and those with null or non-finite components
    are linked with nothing, as are vectors of different lengths with each
    other and rows without a vec_id (component null, kept).  Rows repeated
    under one vec_id count as one vector: of its rows that can be linked, the one
    that is least in order of components.
    Labels and other columns are ignored.  An empty table gives no rows.  The
    number of buckets of a table grows in proportion to the row count, and the
    tables with its logarithm, so buckets stay small and recall doesn't fall;
    no bucket is capped.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    link = math.acos(cosine)
    tight = math.cos(link / 2 - 1e-6)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))
    named = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    units = written(named.mapInArrow(_units(ball_rounds, 3, seed), "vec_id bigint, v array<double>, keys array<bigint>"), "units")
    total = units.count()

    # balls: in each round, vectors that still stand alone join the largest ball that shares their key
    ball = units.select("vec_id", F.col("vec_id").alias("rep"))
    v_a, v_b = units.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), units.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    for r in range(ball_rounds):
        sizes = ball.groupBy("rep").agg(F.count("*").alias("n"))
        keyed = units.select(F.col("vec_id").alias("rep"), F.get("keys", F.lit(r)).alias("key")).join(sizes, "rep")
        heads = keyed.groupBy("key").agg(F.max(F.struct("n", (-F.col("rep")).alias("m"))).alias("h"), F.count("*").alias("c")).where("c > 1")
        joining = keyed.where("n = 1").join(heads.select("key", (-F.col("h.m")).alias("b")), "key").where("rep <> b")
        near = _cosine_of(joining.select(F.col("rep").alias("a"), "b"), v_a, v_b).where(F.col("cosine") >= tight)
        moved = near.select(F.col("a").alias("vec_id"), F.col("b").alias("to"))
        ball = written(ball.join(moved, "vec_id", "left").select("vec_id", F.coalesce("to", "rep").alias("rep")), "balls")

    away = ball.where("vec_id <> rep")
    spread = _cosine_of(away.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")), v_a, v_b)
    radius = spread.groupBy(F.col("b").alias("rep")).agg(F.max(F.acos("cosine")).alias("radius"))
    sizes = ball.groupBy("rep").agg(F.count("*").alias("n"))
    heads = written(sizes.join(radius, "rep", "left").select("rep", "n", F.coalesce("radius", F.lit(0.0)).alias("radius")), "heads")

    placed = units.join(ball, "vec_id").select("rep", "v")
    buckets = written(placed.mapInArrow(_buckets(total, hashes, seed), "code bigint, rep bigint").distinct(), "buckets")
    one, two = buckets.select("code", F.col("rep").alias("a")), buckets.select("code", F.col("rep").alias("b"))
    pairs = one.join(two, "code").where("a < b").select("a", "b").distinct()
    met = _cosine_of(pairs, v_a, v_b)
    met = met.join(heads.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("radius").alias("r_a")), "a")
    met = met.join(heads.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("radius").alias("r_b")), "b")
    angle, slack = F.acos("cosine"), F.col("r_a") + F.col("r_b")
    kind = (
        F.when(slack == 0, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
        .when(angle + slack <= link - 1e-7, "all")
        .when(angle - slack > link + 1e-7, "none")
        .otherwise("some")
    )
    met = written(met.withColumn("kind", kind).where("kind <> 'none'"), "met")

    both = met.select("a", "b", "n_b", "r_b", "kind").union(met.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"), F.col("r_a").alias("r_b"), "kind"))
    whole = both.where("kind = 'all'").groupBy(F.col("a").alias("rep")).agg(F.sum("n_b").alias("whole"))
    # balls that are neither wholly linked nor wholly apart: each vector against the other ball
    single = ball.select(F.col("vec_id").alias("x"), F.col("rep").alias("a"))
    facing = both.where("kind = 'some'").join(single, "a").select("x", "b", "n_b", "r_b")
    told = _cosine_of(facing.select(F.col("x").alias("a"), "b"), v_a, v_b).select(F.col("a").alias("x"), "b", "cosine")
    told = told.join(heads.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("radius").alias("r_b")), "b")
    told = told.withColumn(
        "kind",
        F.when(F.col("r_b") == 0, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
        .when(F.acos("cosine") + F.col("r_b") <= link - 1e-7, "all")
        .when(F.acos("cosine") - F.col("r_b") > link + 1e-7, "none")
        .otherwise("some"),
    )
    told = written(told.where("kind <> 'none'"), "told")
    open_ = told.where("kind = 'some'").join(ball.select(F.col("vec_id").alias("y"), F.col("rep").alias("b")), "b")
    single_links = _cosine_of(open_.select(F.col("x").alias("a"), F.col("y").alias("b")), v_a, v_b).where(F.col("cosine") >= cosine)
    single_links = written(single_links.select(F.col("a").alias("x"), F.col("b").alias("y")), "links")
    extra = told.where("kind = 'all'").select("x", F.col("n_b").alias("c")).union(single_links.select("x", F.lit(1).cast("bigint").alias("c")))
    extra = extra.groupBy(F.col("x").alias("vec_id")).agg(F.sum("c").alias("extra"))

    home = ball.select(F.col("vec_id").alias("x"), F.col("rep").alias("a"))
    edges = met.where("kind = 'all'").select("a", "b")
    edges = edges.union(told.where("kind = 'all'").join(home, "x").select("a", "b"))
    edges = edges.union(single_links.join(home, "x").join(home.select(F.col("x").alias("y"), F.col("a").alias("b")), "y").select("a", "b"))
    # each ball's smallest vec_id is tied to it, so that components go by the smallest of all
    lows = ball.groupBy("rep").agg(F.min("vec_id").alias("low"))
    label = connected_components(edges.union(lows.where("low < rep").select(F.col("low").alias("a"), F.col("rep").alias("b"))))
    of_ball = sizes.join(whole, "rep", "left").join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of_ball = of_ball.select("rep", (F.col("n") - 1 + F.coalesce("whole", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component_id"))
    counted = ball.join(of_ball, "rep").join(extra, "vec_id", "left").select("vec_id", (F.col("links") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id")
    return (
        rows.select("vec_id")
        .join(counted, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
