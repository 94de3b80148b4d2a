"""Arithmetic expressions: lenient casts, safe ratios, confusion metrics, bins and effect labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(c.cast("string").try_cast("double"), F.lit(None).cast("double")), F.lit(default))


def unsentinel(c: Column) -> Column:
    """-1 stands for a missing measure; it counts as zero."""
    return F.when(c == -1, F.lit(0.0)).otherwise(c.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def bin_left(c: Column) -> Column:
    """Left-closed bins [0, .25) [.25, .75) [.75, 1]."""
    return F.when(c < 0, None).when(c < 0.25, "low").when(c < 0.75, "partial").when(c <= 1, "high")


def bin_right(c: Column) -> Column:
    """Right-closed bins [0, .25] (.25, .75] (.75, 1]."""
    return F.when(c < 0, None).when(c <= 0.25, "low").when(c <= 0.75, "partial").when(c <= 1, "high")


def effect_label(size: Column, small: float, medium: float, large: float) -> Column:
    at = F.abs(size)
    return F.when(at < small, "negligible").when(at < medium, "small").when(at < large, "medium").otherwise("large")


def cliffs_label(delta: Column) -> Column:
    return effect_label(delta, 0.147, 0.33, 0.474)


def cohens_label(d: Column) -> Column:
    return effect_label(d, 0.2, 0.5, 0.8)


def shown_p(p: Column) -> Column:
    """Two significant digits without trailing zeros; empty for null."""
    text = F.format_string("%.2g", p)
    plain = F.when(text.contains("e"), text).when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(p.isNull(), "").otherwise(F.regexp_replace(plain, r"\.?0+e", "e"))


def shown_effect(size: Column, label: Column, absolute: bool = True) -> Column:
    value = F.abs(size) if absolute else size
    return F.when(size.isNull(), "").otherwise(F.concat(F.format_string("%.2f", value), F.lit(" ("), F.upper(F.substring(label, 1, 1)), F.lit(")")))
