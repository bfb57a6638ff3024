"""One row per array element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list[str], array: Column | str, name: str) -> DataFrame:
    """``keep`` and one row per element; none for null or empty arrays.

    A plain explode makes the optimizer test the array's size below the projection that computes it, which
    computes the array twice and spells intermediate columns out inside lambdas. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


WEIGHT = "__vacancies"


def counted(df: DataFrame) -> Column:
    """Number of vacancies: rows, or the sum of ``WEIGHT`` where rows stand for several."""
    return F.sum(WEIGHT) if WEIGHT in df.columns else F.count("*")


def weight_of(df: DataFrame) -> list[str]:
    return [WEIGHT] if WEIGHT in df.columns else []


def compacted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of the columns with their number of vacancies; reports on them give the same as on all rows."""
    return df.groupBy(*columns).agg(counted(df).alias(WEIGHT))
