"""Operator 2: document rates that mix domains to target weights.

A classifier trained on the labels table gives each document posteriors over
domains.  Nonnegative rates near one are then fitted so that the expected
tokens of each domain meet their targets: projected gradient on the least
squares, in the metric of the domains' Gram matrix.  Each step is one pass
over a compact table; only sums per domain reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore.llm.common import fitted, small_batches, written
from wayscore.llm.features import as_arrays, featurizer, labelled_vectors

DOMAINS = ("poor", "toxic", "clean")
#: Weights of the domains, and what each domain may have at most of its own tokens.
WEIGHTS = {"poor": 0.01, "toxic": 0.05, "clean": 0.94}
PER_CLASS = 1500


def domain_of(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """Index into DOMAINS: poor quality first, then toxicity."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when(F.col(quality) == 1, 2)


def softmax_model(x, y, share, steps: int = 150, decay: float = 1e-4) -> dict:
    """A softmax model of the domains by accelerated gradients, with ``share`` as the domains' prior."""
    import numpy as np

    k = len(DOMAINS)
    if not len(y):
        return {"w": None}
    seen = np.bincount(y, minlength=k).astype(float)
    mean = x.mean(axis=0)
    sd = np.sqrt(np.maximum((x * x).mean(axis=0) - mean * mean, 0)) + np.float32(0.01)
    x -= mean
    x /= sd * np.float32(np.sqrt(x.shape[1]) / 4)
    target = np.eye(k, dtype=np.float32)[y]
    # the largest singular value, by power steps, sets the rate
    v = np.ones((x.shape[1], 1), dtype=np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + np.float32(1e-30)
    rate = np.float32(3.5 * len(x) / (float(np.linalg.norm(x @ v)) ** 2 * 1.1 + len(x)))
    w, bias = np.zeros((x.shape[1], k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    w_step, bias_step = np.zeros_like(w), np.zeros_like(bias)
    for step in range(steps):
        on = np.float32(step / (step + 3))
        at, bias_at = w + on * w_step, bias + on * bias_step
        p = _softmax(x @ at + bias_at) - target
        new, bias_new = at - rate * (x.T @ p / np.float32(len(x)) + np.float32(decay) * at), bias_at - rate * p.mean(axis=0)
        w_step, w, bias_step, bias = new - w, new, bias_new - bias, bias_new
    w = w / (sd * np.float32(np.sqrt(x.shape[1]) / 4))[:, None]
    share = np.asarray(share, dtype=float)
    prior = np.log(np.where(share > 0, share, 1e-9) / max(share.sum(), 1e-9)) - np.log(np.where(seen > 0, seen, 1e-9) / seen.sum())
    return {"w": w, "bias": bias - mean @ w + np.where(seen > 0, prior, -50.0)}


def _softmax(p):
    import numpy as np

    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_posteriors(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> bytes:
    """The pickled softmax model, fitted in one task on at most ``per_class`` labelled rows of each domain, with their true shares as prior."""
    known = labels.select("doc_id", domain_of().alias("domain")).where("domain is not null")
    counts = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row for each domain at most
    share = [counts.get(i, 0) for i in range(len(DOMAINS))]

    def run(table):
        return softmax_model(*as_arrays(table), share)

    return fitted(labelled_vectors(docs, known, F.col("domain"), len(DOMAINS), per_class), run)


def _posteriors(model):
    def run(batches: Iterator) -> Iterator:
        import pickle

        import numpy as np
        import pyarrow as pa

        m = pickle.loads(model.value)
        features = featurizer()
        k = len(DOMAINS)
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            p = np.full((len(made), k), 1.0 / k)
            if m["w"] is not None and made:
                p = _softmax(np.stack([f.astype(np.float32) for f, _ in made]).astype(float) @ m["w"] + m["bias"])
            tokens = pa.array([n for _, n in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "tokens", "posteriors"])

    return run


def _rates(history, most, tokens, p):
    """Rates after the steps in ``history``: r <- r - P step, projected on 0 to ``most``, steps being measured per token."""
    import numpy as np

    r = np.ones(len(tokens))
    for step in history:
        r = np.clip(r - p @ step, 0.0, most)
    return np.where(tokens > 0, r, 1.0)


def _columns(batch):
    import numpy as np

    tokens = np.asarray(batch.column("tokens"), dtype=float)
    return tokens, np.asarray(batch.column("posteriors").flatten(), dtype=float).reshape(len(tokens), len(DOMAINS))


def _sums(history, most):
    """Expected tokens by domain, and the token-weighted Gram matrix of the documents whose rate isn't at a bound."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        k = len(DOMAINS)
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            tokens, p = _columns(batch)
            rate = _rates(history, most, tokens, p)
            total += (rate * tokens) @ p
            free = (rate > 0) & ((rate < most) | (not history))
            square += (p * (tokens * free)[:, None]).T @ p
        flat = np.concatenate([total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "s"])

    return run


def _final(history, most):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rate = _rates(history, most, *_columns(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    return run


def mixed(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, headroom: float = 1.02, most: float | None = None, steps: int = 60, tolerance: float = 1e-4, training: DataFrame | None = None
) -> tuple[DataFrame, dict]:
    """Fits one rate per row of ``docs``, from 0 to ``most`` (no bound where None).

    Returns the rates (doc_id, tokens, p_<domain> for each domain, rate) and a
    report: the token ``target`` of each domain, what the rates have
    ``reached``, the ``residual`` as a share of the targets, the number of
    ``steps``, and ``met``, whether the residual is within ``tolerance``.

    The targets are ``weights`` times a token budget: ``headroom`` times what
    the last domain can give at its weight (the scarcest one where that has
    next to nothing).  With ``most`` given, a domain's target is at most what
    ``most`` of each document gives, and the last domain's what it has left
    once the others are thinned.  A rate is the expected number of copies
    of the document.

    Null or blank texts have no tokens and keep the rate one.  Repeated rows
    count as often as they stand there; null doc_ids take part.  With no
    usable labels, posteriors are uniform.  An empty table gives no rows.
    Other columns are ignored.
    """
    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit_posteriors(docs if training is None else training, labels))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(rows.mapInArrow(_posteriors(model), "doc_id bigint, tokens bigint, posteriors array<double>"), "posteriors")
    k = len(DOMAINS)
    bound = np.inf if most is None else float(most)

    def totals(history):
        sums = table.mapInArrow(_sums(history, bound), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        flat = np.zeros(k + k * k)
        for r in sums:
            flat[r.i] = r.s
        return flat[:k], flat[k:].reshape(k, k)

    now, square = totals([])
    want = np.array([weights[d] for d in DOMAINS])
    want = want / want.sum()
    ample = now > 1e-3 * max(now.sum(), 1e-300)
    budget = headroom * min((now[i] / want[i] for i in range(k) if ample[i] and want[i] > 0), default=0.0)
    if ample[-1] and want[-1] > 0:  # the clean part sets the budget, others are thinned or repeated
        budget = headroom * now[-1] / want[-1]
    first = now

    def targets():
        """With ``most``, the last domain's tokens fall with those of others that are thinned, and the budget with them."""
        if most is None:
            return budget * want
        held = min(budget, now[-1] / want[-1]) if ample[-1] and want[-1] > 0 else budget
        return np.minimum(held * want, bound * first)

    target = targets()
    size = max(target.sum(), 1e-300)
    largest = max(np.linalg.eigvalsh(square)[-1], 1e-300)
    # scaled by the Gram matrix of the free documents a step is short of nothing but the bounds; where it gains too little,
    # a plain gradient step, which always gains short of the least squares, goes before the next scaled one
    history: list = []
    tried, scaled, left = 0, True, np.abs(now - target).sum()
    while left > tolerance * size and tried < steps:
        residual = now - target
        step = np.linalg.pinv(square + 1e-9 * np.trace(square) * np.eye(k), hermitian=True) @ residual if scaled else residual / largest
        before, tried = (now, square, target, left), tried + 1
        now, square = totals([*history, step])
        target = targets()
        left = np.abs(now - target).sum()
        if left < before[-1] * (0.9 if scaled else 1 - 1e-4):
            history, scaled = [*history, step], True
        elif scaled:
            (now, square, target, left), scaled = before, False
        else:
            now, square, target, left = before
            break  # the least squares are reached; the targets are out of reach
    residual = float(np.abs(now - target).sum() / size) if target.sum() else 0.0
    report = {"target": dict(zip(DOMAINS, target)), "reached": dict(zip(DOMAINS, now)), "residual": residual, "steps": tried, "met": residual <= tolerance}
    out = table.mapInArrow(_final(history, bound), "doc_id bigint, tokens bigint, posteriors array<double>, rate double")
    return out.select("doc_id", "tokens", *(F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate"), report


def mix(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rates of ``mixed``; a warning gives the residual where they miss the targets."""
    rates, report = mixed(docs, labels, **params)
    if not report["met"]:
        warnings.warn(f"the rates miss their token targets by {report['residual']:.3g} of them: {report}", stacklevel=2)
    return rates


def kept_by_rate(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of ``docs`` that one draw at their rates keeps, at most one copy each.

    The draw is a hash of doc_id, so it is the same when run again; a rate of
    one or more always keeps the row, so rates should be fitted with ``most``
    = 1.  Rows without a doc_id stay; a doc_id repeated with several rates is
    drawn at the least of them.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    gone = rates.where("doc_id is not null").where(draw >= F.col("rate")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
