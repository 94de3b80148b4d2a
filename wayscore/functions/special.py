"""Tail probabilities and the Shapiro-Wilk test (Royston 1995), from published formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Royston's approximation holds for samples of 3 to 5000 values.
SHAPIRO_MOST = 5000


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        term = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


#: Longest tail of the exact distribution that is counted; a longer one is that of at least half a million values, where the normal one is as good.
EXACT_MOST = 2_000_000


def mann_whitney_p(u: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided p of U; exact for a sample of at most eight values and no ties unless its tail is very long, else normal with corrections.

    tie_term is the sum of t**3 - t over groups of equal values.
    """
    big = max(u, n1 * n2 - u)
    few, many = min(n1, n2), max(n1, n2)
    # with very many values on the other side the exact tail is long, unless it is as short as that of a rare result
    if few <= 8 and tie_term == 0 and n1 * n2 - math.ceil(big) <= EXACT_MOST:
        top = n1 * n2 - math.ceil(big)  # by symmetry, the chance of at most so many
        ways = [1] + [0] * top
        for i in range(1, few + 1):  # Gaussian binomial coefficient, factor by factor
            for k in range(top, many + i - 1, -1):
                ways[k] -= ways[k - many - i]
            for k in range(i, top + 1):
                ways[k] += ways[k - i]
        return min(1.0, 2 * sum(ways) / math.comb(few + many, few))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1))))
    return min(1.0, 2 * normal_tail((big - n1 * n2 / 2 - 0.5) / sd)) if sd else 1.0


# Wichura's rational approximations of the normal quantile (AS 241), lowest power first.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _over(parts: tuple, x: Column) -> Column:
    made = []
    for coefficients in parts:
        total = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            total = total * x + c
        made.append(total)
    return made[0] / made[1]


def _quantile(q: Column, r: Column) -> Column:
    """The normal quantile of q + 1/2; r is the root of minus the logarithm of its distance to the nearer end."""
    tail = F.when(r <= 5, _over(NEAR, r - 1.6)).otherwise(_over(FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _over(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def _root(p: Column) -> Column:
    return F.sqrt(-F.log(F.least(p, 1 - p)))


def normal_score(rank: Column, n: Column) -> Column:
    """The normal quantile of (rank - 0.375) / (n + 0.25)."""
    p = (rank - 0.375) / (n + 0.25)
    return _quantile(p - 0.5, _root(p))


def _scores(ranks: Column, n: Column) -> Column:
    """As ``normal_score`` for an array of ranks; each step names what the next one uses often."""
    shares = F.transform(ranks, lambda i: (i - 0.375) / (n + 0.25))
    return F.transform(F.transform(shares, lambda p: F.struct((p - 0.5).alias("q"), _root(p).alias("r"))), lambda x: _quantile(x["q"], x["r"]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


#: Ranks that are added up one by one, at each end of a sample and in a short range.
SHORT = 64


def _slopes(ranks: Column, n: Column) -> Column:
    """(z, s) of half ranks: the score and its slope by rank; its density is 1 / s by rank."""
    root = math.sqrt(2 * math.pi)
    return F.transform(_scores(ranks, n), lambda z: F.struct(z.alias("z"), (root * F.exp(z * z / 2) / (n + 0.25)).alias("s")))


def score_sums(below: Column, count: Column, n: Column) -> Column:
    """The sum of the normal scores of the ranks ``below`` + 1 to ``below`` + ``count`` of ``n``, whatever their number.

    Ranks near the ends and short ranges are added up; a longer range is the
    integral between its outer half ranks, a difference of densities, less the
    corrections of the midpoint rule up to the third derivative.
    """
    below, count, n = (c.cast("bigint") for c in (below, count, n))
    low, high = below + 1, below + count
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(F.least(a, b), b)).otherwise(none)
    first, last = F.greatest(low, F.lit(SHORT + 1).cast("bigint")), F.least(high, n - SHORT)
    long = last - first >= SHORT
    ends = F.concat(run(low, F.least(high, F.lit(SHORT).cast("bigint"))), run(F.greatest(low, n - SHORT + 1, F.lit(SHORT + 1).cast("bigint")), high))
    single = F.when(count <= SHORT, run(low, high)).when(long, ends).otherwise(F.concat(ends, run(first, last)))
    halves = F.when(long & (count > SHORT), F.array(first - 0.5, last + 0.5)).otherwise(F.array().cast("array<double>"))
    parts = F.transform(_slopes(halves, n), lambda x: F.struct((1 / x["s"]).alias("d"), (x["s"] / 24 - x["s"] * x["s"] * x["s"] * (1 + 2 * x["z"] * x["z"]) * 7 / 5760).alias("c")))
    at = lambda i, f: F.coalesce(F.get(parts, F.lit(i))[f], F.lit(0.0))
    inner = at(0, "d") - at(1, "d") - (at(1, "c") - at(0, "c"))
    return F.when(count == 1, normal_score(low, n)).otherwise(_total(_scores(single, n)) + inner)


def square_sum(n: Column) -> Column:
    """The sum of the squares of all normal scores of ``n`` ranks: ends one by one, the rest by its integral."""
    n = n.cast("bigint")
    ends = lambda k: 2 * _total(F.transform(_scores(F.sequence(F.lit(1).cast("bigint"), k), n), lambda m: m * m))
    x = F.get(_slopes(F.array(F.lit(SHORT + 0.5)), n), F.lit(0))
    z, s = x["z"], x["s"]
    # the derivatives are odd, so both ends count alike
    inner = n - 2 * SHORT + 2 * z / s + z * s / 6 - s * s * s * (8 * z + 4 * z * z * z) * 7 / 2880
    return F.when(n <= 4 * SHORT, ends(F.least(n, F.lit(4 * SHORT)).cast("bigint")) / 2).otherwise(ends(F.lit(SHORT).cast("bigint")) + inner)


def with_shapiro(sums: DataFrame) -> DataFrame:
    """Adds Royston's W (w) and its normal score (z) to rows of more than 11 values each.

    ``sums`` has n, square and dot (of m*m and m*x over the normal scores m), the
    two values at each end (x1, x2, y2, y1) and the squared deviations (spread).
    """
    n, u = F.col("n"), 1 / F.sqrt("n")
    poly = lambda first, *cs: first + sum((F.lit(c) * F.pow(u, F.lit(i + 1)) for i, c in enumerate(cs)), F.lit(0.0))
    out = sums.withColumns({f"_m{i}": -normal_score(F.lit(i), n) for i in (1, 2)}).withColumn("_ln", F.log(n))
    # fixed values: Royston's polynomials for the two outermost weights, then for mean and deviation of log(1 - W)
    out = out.withColumns(
        {
            "_a1": poly(F.col("_m1") / F.sqrt("square"), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056),
            "_a2": poly(F.col("_m2") / F.sqrt("square"), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633),
        }
    )
    out = out.withColumn("_phi", F.expr("(square - 2 * _m1 * _m1 - 2 * _m2 * _m2) / (1 - 2 * _a1 * _a1 - 2 * _a2 * _a2)"))
    out = out.withColumn("_sum", F.expr("(dot - _m1 * (y1 - x1) - _m2 * (y2 - x2)) / sqrt(_phi) + _a1 * (y1 - x1) + _a2 * (y2 - x2)"))
    out = out.withColumn("w", F.expr("least(1.0D, _sum * _sum / spread)"))
    z = F.expr("(ln(nullif(1 - w, 0.0D)) - (-1.5861D - 0.31082D * _ln - 0.083751D * _ln * _ln + 0.0038915D * _ln * _ln * _ln)) / exp(-0.4803D - 0.082676D * _ln + 0.0030302D * _ln * _ln)")
    return out.withColumn("z", z).drop("_m1", "_m2", "_ln", "_a1", "_a2", "_phi", "_sum")


def shapiro_p(values) -> float | None:
    """p of normality; 1 for fewer than three or constant values, None beyond the range of the approximation."""
    x = sorted(map(float, values))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0
    if n > SHAPIRO_MOST:
        return None
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square = math.fsum(v * v for v in m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        # fixed values: Royston's polynomials for the two outermost weights
        last = m[-1] / math.sqrt(square) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n > 5:
            second = m[-2] / math.sqrt(square) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *(v / math.sqrt(phi) for v in m[2:-2]), second, last]
        else:
            phi = (square - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    mean = math.fsum(x) / n
    w = min(1.0, math.fsum(p * q for p, q in zip(a, x)) ** 2 / math.fsum((v - mean) ** 2 for v in x))
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(g - math.log(1 - w)) if g > math.log(1 - w) else 1e9
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        ln = math.log(n)
        y = math.log(1 - w)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return normal_tail((y - mu) / sd)
