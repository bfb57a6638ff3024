"""Joins to tables whose size is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size of a stored table as rows: its texts by their lengths, other columns and the row itself by fixed sizes."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    lengths = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in texts), F.lit(0))
    found = df.agg(F.count("*").alias("n"), F.sum(lengths).alias("b")).first()
    return found["n"] * (16 * len(df.columns) + 16) + (found["b"] or 0)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, stored already, marked for broadcasting if it is measured to fit ``BROADCAST_BYTES``.

    Otherwise the planner shuffles it, and adaptive execution splits the hot keys of the other side.
    """
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df
