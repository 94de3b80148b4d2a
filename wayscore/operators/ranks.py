"""Ranks of values within groups, dealt over many tasks however large a group is.

A group's distinct values are cut at approximate quantiles into slices; counts
run within a slice in a window, and from slice to slice over one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a group.
SLICES = 128


def below(each: DataFrame, keys: list[str], value: str, counts: list[str], slices: int = SLICES) -> DataFrame:
    """Adds below_<count> for each of ``counts``: its sum over the smaller values of the same group.

    ``each`` has one row per (keys, value); there are few groups, values are
    not null.
    """
    cuts = each.groupBy(*keys).agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], 1000).alias("_cuts"))
    if keys:
        rows = each.join(F.broadcast(cuts), keys)
    else:
        rows = each.withColumn("_cuts", cuts.scalar())
    rows = rows.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    parts = rows.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"_sum_{c}") for c in counts))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_slice", *(F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in counts))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})
    rows = rows.join(F.broadcast(parts), [*keys, "_slice"])
    rows = rows.withColumns({f"below_{c}": F.col(f"below_{c}") + F.col(f"_before_{c}") for c in counts})
    return rows.drop("_slice", *(f"_before_{c}" for c in counts))


def exact_quantiles(each: DataFrame, keys: list[str], value: str, count: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, n, q): the quantiles of a group by linear interpolation between its values, from one row per (keys, value)."""
    rows = below(each.where(F.col(value).isNotNull()), keys, value, [count])
    sizes = each.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(count).alias("n"))
    rows = rows.join(F.broadcast(sizes), keys)
    made = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("n") - 1)
        for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            inside = (F.col(f"below_{count}") <= rank) & (rank < F.col(f"below_{count}") + F.col(count))
            made.append(F.max(F.when(inside, F.col(value))).alias(f"{name}_{i}"))
    found = rows.groupBy(*keys, "n").agg(*made)
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    q = F.array(*(F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * (x - F.floor(x)) for i, x in enumerate(at)))
    return found.select(*keys, "n", q.alias("q"))
