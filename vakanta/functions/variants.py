"""Reading fields of a landed item, whose JSON types are not fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def with_fields(df: DataFrame, item: str, names: list[str]) -> DataFrame:
    """Add fields of an object as columns of their own, all read in one pass over it; null for other items.

    The generator makes the optimizer keep them as they are. Otherwise each filter on a derived column would be
    pushed down with every field it uses looked up again.
    """
    fields = F.try_variant_get(item, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")
    return df.select("*", F.explode_outer(F.array(fields)).alias("__fields")).select("*", "__fields.*").drop("__fields")


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def type_name(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, OBJECT<...>, ARRAY<...>; null for a field that is not there."""
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(type_name(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(type_name(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(type_name(value).startswith("ARRAY"), F.lit(False))


# JSON text of the values that count as missing.
EMPTY = ["null", '""', "0", "0.0", "-0.0", "false", "{}", "[]"]


def is_set(value: Column) -> Column:
    """False for a missing field, null, "", 0, false, [] and {}.

    Written with one reference to the value: filters on it are pushed down with the value spelled out.
    """
    return ~F.coalesce(F.to_json(value), F.lit("null")).isin(EMPTY)


def first_set(*values: Column) -> Column:
    """First value for which ``is_set`` holds, else null."""
    return F.coalesce(*[F.when(is_set(v), v) for v in values])
