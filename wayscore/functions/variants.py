"""Fields of VARIANT values, with the truth of their contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, name: str, kind: str = "variant") -> Column:
    """A field of an object; null where it is missing, a null VARIANT where it is null."""
    return F.try_variant_get(value, f"$.{name}", kind)


def shown(value: Column) -> Column:
    """A value as text: scalars as they are, lists and objects as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.nullif(F.to_json(value), F.lit("null")))


def says(value: Column) -> Column:
    """Whether a value is there and says something: not null, false, zero or empty."""
    kind, text = F.schema_of_variant(value), shown(value)
    number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    nothing = (kind == "VOID") | (kind == "STRING") & (text == "") | (kind == "BOOLEAN") & (text == "false") | (kind == "OBJECT<>") | kind.startswith("ARRAY") & (text == "[]") | number & (text.try_cast("double") == 0)
    return ~F.coalesce(nothing, F.lit(True))


def first_that_says(*values: Column) -> Column:
    """The first value that says something, else null."""
    return F.coalesce(*(F.when(says(v), v) for v in values))
