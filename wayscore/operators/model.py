"""Predictive power of features for failure, by penalised logistic regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.operators.stats import auc


def _sums(y: Column, x: list[Column], w: list[float], tag: str) -> list[Column]:
    """Loss, gradient and the upper half of the Gram matrix at coefficients ``w`` (the intercept first), as aggregates."""
    margin = sum((F.lit(float(b)) * f for b, f in zip(w[1:], x)), F.lit(float(w[0])))
    loss = F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - y * margin
    p = 1 / (1 + F.exp(-margin))
    ones = [F.lit(1.0), *x]
    made = [F.sum(loss).alias(f"{tag}_loss")]
    made += [F.sum((p - y) * f).alias(f"{tag}_g{i}") for i, f in enumerate(ones)]
    made += [F.sum(p * (1 - p) * f * g).alias(f"{tag}_h{i}_{j}") for i, f in enumerate(ones) for j, g in enumerate(ones) if i <= j]
    return made


class _Fit:
    """One threshold's Newton steps; a step that raises the loss is halved."""

    def __init__(self, k: int, penalty: float):
        import numpy as np

        self.k, self.penalty = k, penalty
        self.kept, self.trial, self.move = None, np.zeros(k + 1), None
        self.loss, self.slope, self.done = float("inf"), float("inf"), False

    def take(self, row, tag: str, n: int, tolerance: float) -> None:
        import numpy as np

        free = np.append(0.0, np.full(self.k, self.penalty))
        loss = row[f"{tag}_loss"] + (free * self.trial**2).sum() / 2
        g = np.array([row[f"{tag}_g{i}"] for i in range(self.k + 1)]) + free * self.trial
        slope = abs(g).max() / n
        if self.kept is not None and loss > self.loss + 1e-12 * abs(self.loss) and slope > tolerance:
            self.move = self.move / 2
            self.trial = self.kept + self.move
            self.done = abs(self.move).max() < 1e-14
            return
        self.kept, self.loss, self.slope = self.trial, loss, slope
        if slope <= tolerance:
            self.done = True
            return
        gram = np.zeros((self.k + 1, self.k + 1))
        for i in range(self.k + 1):
            for j in range(i, self.k + 1):
                gram[i, j] = gram[j, i] = row[f"{tag}_h{i}_{j}"]
        self.move = -np.linalg.solve(gram + np.diag(free + 1e-12), g)
        self.trial = self.kept + self.move


def predictive_power(frame: DataFrame, features: list[str], thresholds=(0.25, 0.5, 0.75, 1.0), score: str = "score", most_steps: int = 2000, tolerance: float = 1e-10) -> DataFrame:
    """Per threshold: rows, AUC, Brier score and coefficients of a model of ``score < threshold``.

    Rows with a null are left out.  Features are scaled to unit population
    deviation (a constant one is left alone); the penalty is L2 with weight
    one on the whole loss, and the intercept is free.  A threshold with one
    class alone has nulls.  Missing columns are an error.

    All thresholds step together: a pass over the rows is one aggregate of the
    sums that Newton's method needs, until the gradient of each mean loss is
    within ``tolerance``.
    """
    if missing := [c for c in [score, *features] if c not in frame.columns]:
        raise ValueError(f"missing columns: {missing}")
    clean = frame.select(F.col(score).cast("double").alias("_s"), *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features))).dropna().persist()
    try:
        named = [f"_x{i}" for i in range(len(features))]
        shape = clean.agg(F.count("*").alias("n"), *(F.count_if(F.col("_s") < float(t)).alias(f"y{i}") for i, t in enumerate(thresholds)), *(F.avg(c).alias(f"m{c}") for c in named), *(F.stddev_pop(c).alias(f"d{c}") for c in named)).first()
        x = [(F.col(c) - F.lit(shape[f"m{c}"])) / F.lit(shape[f"d{c}"] or 1.0) for c in named]
        fits = {i: _Fit(len(features), 1.0) for i in range(len(thresholds)) if 0 < shape[f"y{i}"] < shape.n}
        of = lambda i: (F.col("_s") < float(thresholds[i])).cast("double")
        for _ in range(most_steps):
            live = [i for i, f in fits.items() if not f.done]
            if not live:
                break
            row = clean.agg(*(c for i in live for c in _sums(of(i), x, list(fits[i].trial), f"t{i}"))).first()
            for i in live:
                fits[i].take(row, f"t{i}", shape.n, tolerance)
        else:
            raise RuntimeError(f"coefficients did not settle in {most_steps} steps: gradients {[f.slope for f in fits.values()]}")
        told = {}
        if fits:
            margin = lambda w: sum((F.lit(float(b)) * f for b, f in zip(w[1:], x)), F.lit(float(w[0])))
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), of(i).alias("y"), (1 / (1 + F.exp(-margin(f.kept)))).alias("p")) for i, f in fits.items())))
            told = {r.i: r for r in auc(clean.select(cells.alias("c")).select("c.*"), "y", "p", ["i"]).collect()}
    finally:
        clean.unpersist()
    out = []
    for i, t in enumerate(thresholds):
        if i in fits:
            out.append((float(t), int(shape.n), told[i].auc, told[i].brier, *map(float, fits[i].kept[1:])))
        else:
            out.append((float(t), int(shape.n), None, None, *[None] * len(features)))
    schema = "threshold double, n bigint, auc double, brier double, " + ", ".join(f"coef_{f} double" for f in features)
    return frame.sparkSession.createDataFrame(out, schema)
