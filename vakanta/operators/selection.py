"""Filters, order and duplicates of the vacancy table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakanta import settings as S


def recent(df: DataFrame, as_of: dt.date | str, days: int = S.DAYS_WINDOW, column: str = "posted_date") -> DataFrame:
    """Rows posted in the last ``days`` days; later dates stay, missing ones go. A plain column test, so it is
    pushed to the scan."""
    first_day = F.date_sub(F.lit(as_of).cast("date"), days)
    return df.where(F.col(column) >= first_day)


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row, by ``order``, of each case-insensitive key; null counts as ''.

    Spark keeps one row per key in every map task before the shuffle (window group limit), so a key held by
    a third of the rows sends at most one row per task.
    """
    key = [F.lower(F.coalesce(F.col(k), F.lit(""))) for k in keys]
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def export_order(df: DataFrame, ingest_order: list[str] | None = None) -> DataFrame:
    """Presentation order: title, company, date, all descending, missing ones last; ties in ingest order."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).desc() for c in ("job_title", "company", "posted_date")]
    return df.orderBy(*text, *(ingest_order or []))
