import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscore.functions import special
from wayscore.operators import model, stats


def frame(spark, n=60):
    rng = random.Random(3)
    return spark.createDataFrame([((rng.random()), float(rng.randint(0, 5)), 1.0) for _ in range(n)], "score double, a double, b double")


def test_delta_and_u_match_all_pairs(spark):
    f = frame(spark)
    rows = f.collect()
    got = {r.threshold: r for r in stats.mann_whitney(stats.tall(f, ["a"], (0.25, 0.5))).collect()}
    for t, r in got.items():
        s, x = [q.a for q in rows if q.score >= t], [q.a for q in rows if q.score < t]
        u = sum((p > q) + (p == q) / 2 for p in s for q in x)
        assert r.u == u and math.isclose(r.delta, 1 - 2 * u / (len(s) * len(x)))


def test_constant_feature_and_nulls(spark):
    f = frame(spark).union(spark.createDataFrame([(None, 1.0, 1.0), (0.1, None, 1.0)], "score double, a double, b double"))
    d = {r.feature: r for r in stats.cohens_d(stats.tall(f, ["a", "b"], (0.5,))).collect()}
    assert d["b"].d == 0.0 and d["b"].d_size == "negligible"
    assert stats.all_tests(f.limit(0), ["a"]).count() == 0


def test_tail_probabilities():
    # worked values from published tables
    assert math.isclose(special.t_two_sided(2.228, 10), 0.05, abs_tol=2e-4)
    assert math.isclose(special.mann_whitney_p(0, 3, 3, 0), 0.1)
    assert math.isclose(special.mann_whitney_p(2, 4, 5, 0), 2 * 4 / 126)
    assert math.isclose(special.normal_tail(1.959964), 0.025, abs_tol=1e-6)
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert math.isclose(special.shapiro_p(weights), 0.0067, abs_tol=1e-3)
    assert special.shapiro_p([1, 1, 1]) == 1.0


def test_predictive_power(spark):
    got = {r.threshold: r for r in model.predictive_power(frame(spark), ["a", "b"], (0.0, 0.5)).collect()}
    assert got[0.0].auc is None and 0 <= got[0.5].auc <= 1 and abs(got[0.5].coef_b) < 1e-6
    assert all(r.n == 0 and r.auc is None for r in model.predictive_power(frame(spark).limit(0), ["a"]).collect())


def test_coefficients_are_optimal_and_steps_are_halved(spark):
    """The gradient of the penalised loss is nil, also where classes are all but separated and plain steps overshoot."""
    rng = random.Random(8)
    rows = [(rng.random(), rng.gauss(0, 1), 10.0 ** rng.uniform(-3, 6)) for _ in range(400)]
    rows += [(0.1 if (a := rng.uniform(-1, 1)) > 0.9 else 0.99, a * 1e4, a) for _ in range(300)]
    f = spark.createDataFrame(rows, "score double, a double, b double")
    for r in model.predictive_power(f, ["a", "b"], (0.25, 0.5, 0.75, 0.97)).collect():
        x = np.array([q[1:] for q in rows])
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        y = np.array([q[0] < r.threshold for q in rows], dtype=float)
        w = np.array([r.coef_a, r.coef_b])
        low, high = -50.0, 50.0
        for _ in range(200):  # the intercept is where the residuals add up to nil
            b = (low + high) / 2
            low, high = (b, high) if (1 / (1 + np.exp(-(x @ w + b))) - y).sum() < 0 else (low, b)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert np.abs(x.T @ (p - y) + w).max() < 1e-6
        pairs = [(p[i] > p[j]) + (p[i] == p[j]) / 2 for i in np.flatnonzero(y == 1)[:60] for j in np.flatnonzero(y == 0)]
        assert math.isclose(r.brier, ((p - y) ** 2).mean(), rel_tol=1e-9) and (len(pairs) == 0 or 0 <= r.auc <= 1)


def test_score_sums_in_closed_form(spark):
    rng = random.Random(1)
    rows = [(n, 0, n) for n in (12, 130, 256, 257, 1000, 60_000)]
    for n in (12, 70, 128, 129, 193, 1000, 60_000):
        for _ in range(25):
            b = rng.randrange(n)
            rows.append((n, b, min(n - b, rng.choice([1, 2, 64, 65, 200, n]))))
    df = spark.createDataFrame(rows, "n bigint, b bigint, c bigint")
    got = df.select("*", special.score_sums(F.col("b"), F.col("c"), F.col("n")).alias("s"), special.square_sum(F.col("n")).alias("q")).collect()
    for r in got:
        m = [special.normal_quantile((i - 0.375) / (r.n + 0.25)) for i in range(r.b + 1, r.b + r.c + 1)]
        assert abs(r.s - math.fsum(m)) <= 1e-11 * max(1, math.fsum(map(abs, m)))
        if r.c == r.n:
            assert math.isclose(r.q, math.fsum(v * v for v in m), rel_tol=1e-11)
    # half of 10^8 equal values are one row; their scores add up to minus the density in the middle
    half = spark.range(1).select(special.score_sums(F.lit(0), F.lit(5 * 10**7), F.lit(10**8)).alias("s")).first().s
    assert math.isclose(half, -(10**8 + 0.25) / math.sqrt(2 * math.pi), rel_tol=1e-7)


def test_normality_at_all_sizes(spark):
    """One way for 12 values and for 6000, equal to the list of values wherever its formula holds."""
    rng = random.Random(4)
    sizes = (1, 2, 3, 5, 11, 12, 40, 300, 4999, 6000)
    draw = {"gauss": lambda: rng.gauss(5, 2), "ties": lambda: float(rng.randint(0, 3)), "same": lambda: 7.0}
    values = {(float(n), k): [f() for _ in range(n)] for n in sizes for k, f in draw.items()}
    rows = spark.createDataFrame([(t, k, x, True) for (t, k), v in values.items() for x in v], "threshold double, feature string, value double, success boolean")
    got = {(r.threshold, r.feature): r for r in stats.normality(rows).collect()}
    assert set(got) == set(values)
    for key, v in values.items():
        assert got[key].approximate == (len(v) > 5000) and got[key].n == len(v)
        if len(v) <= 5000:
            assert math.isclose(got[key].p, special.shapiro_p(v), rel_tol=1e-6, abs_tol=1e-12), key
    assert got[6000.0, "gauss"].p > 0.001 and got[6000.0, "ties"].p < 1e-6 and got[6000.0, "same"].p == 1.0


def test_density_against_the_kernel_sum(spark):
    rng = random.Random(2)
    rows = [(0.9, rng.gauss(0, 1), 1.0) for _ in range(300)] + [(None, float(rng.randint(0, 9)), None) for _ in range(50)] + [(0.8, 40.0, 1.0)]
    f = spark.createDataFrame(rows, "score double, a double, b double")
    got = stats.density(f, ["a", "b"], 0.5, points=50).collect()
    for success, inside in ((True, lambda s: (s or 0) >= 0.5), (False, lambda s: (s or 0) < 0.5)):
        v = np.array([q[1] for q in rows if inside(q[0])])
        h = len(v) ** -0.2 * v.std(ddof=1)
        curve = sorted((r.point, r["at"], r.density) for r in got if r.feature == "a" and r.success == success)
        assert [p for p, _, _ in curve] == list(range(50)) and math.isclose(curve[0][1], v.min()) and math.isclose(curve[-1][1], v.max())
        true = [np.exp(-(((x - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)) for _, x, _ in curve]
        assert np.abs(np.array(true) - [d for _, _, d in curve]).max() < 1e-3 * max(true)
    assert [(r.point, r["at"], r.density) for r in got if r.feature == "b"] == [(0, 1.0, 1.0)]
    assert stats.density(f.limit(0), ["a"], 0.5).count() == 0


def test_tables_of_tests_are_loaded(spark):
    """JSON, a Python literal and what the tests themselves give, with thresholds that are known from the text alone."""
    value = {"0.5": {"realPathLen": {"wilcoxon_p": 0.0123, "delta": -0.4, "mag": "Medium"}, "it's": {"wilcoxon_p": None, "delta": float("nan"), "mag": "None"}}, "1": {"numInputFiles": {"delta": 0.1, "mag": "negligible"}}, "0.25": {}}
    clean = {t: {f: {k: None if v != v else v for k, v in x.items()} for f, x in fs.items()} for t, fs in value.items()}
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    made = [sorted(map(tuple, stats.loaded(texts(t)).collect()), key=str) for t in (json.dumps(clean), repr(value), json.dumps(clean, indent=2))]
    assert made[0] == made[1] == made[2] == sorted([(0.5, "realPathLen", 0.0123, -0.4, "medium"), (0.5, "it's", None, None, "none"), (1.0, "numInputFiles", None, 0.1, "negligible")], key=str)
    shown = {r.feature: r.asDict() for r in stats.presented_texts(texts(repr(value))).collect()}
    assert shown["Vulnerable Path Length"] == {"feature": "Vulnerable Path Length", "t0.5_p": "0.012", "t0.5_delta": "0.40 (M)", "t1_p": None, "t1_delta": None}
    assert shown["Number of Files per Path"]["t1_delta"] == "0.10 (N)" and shown["it's"]["t0.5_p"] == ""
    tests = stats.all_tests(frame(spark), ["a", "b"], (0.25, 0.5))
    again = {(r.threshold, r.feature): r for r in stats.loaded(stats.nested(tests)).collect()}
    for r in tests.collect():
        assert (again[r.threshold, r.feature].p_mann_whitney, again[r.threshold, r.feature].delta, again[r.threshold, r.feature].delta_size) == (r.p_mann_whitney, r.delta, r.delta_size)
    with pytest.raises(Exception, match="not a table of tests"):
        stats.loaded(texts("[1")).collect()


def test_exact_p_of_few_against_very_many():
    """The exact way goes by the smaller tail: a small side costs little however many values the other has."""
    from itertools import combinations

    for n1, n2 in ((1, 4), (2, 5), (3, 6), (4, 4)):
        us = [sum(x) - n1 * (n1 + 1) // 2 for x in combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            big = max(u, n1 * n2 - u)
            assert math.isclose(special.mann_whitney_p(u, n1, n2, 0), min(1.0, 2 * sum(x >= big for x in us) / len(us)))
    assert math.isclose(special.mann_whitney_p(0, 1, 10**9, 0), 2 / (10**9 + 1))
    assert math.isclose(special.mann_whitney_p(3 * 10**6, 6, 10**6, 0), 1.0, rel_tol=1e-5)
