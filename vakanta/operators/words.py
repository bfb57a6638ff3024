"""Words of the skill columns, compared between two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import words
from vakanta.operators.reports import with_level_label
from vakanta.operators.rows import WEIGHT, each, weight_of


def word_counts(df: DataFrame, column: str, levels: list[str] = S.COMPARED_LEVELS) -> DataFrame:
    """One row per word with its number of occurrences at each level."""
    kept = with_level_label(df).where(F.col("experience_level").isin(levels))
    exploded = each(kept, ["experience_level", *weight_of(df)], words(F.col(column)), "word")
    one = F.col(WEIGHT) if weight_of(df) else F.lit(1).cast("long")
    of_level = [F.sum(F.when(F.col("experience_level") == x, one).otherwise(0)).alias(x) for x in levels]
    return exploded.groupBy("word").agg(*of_level)


def repeated_words(
    df: DataFrame, column: str = "hard_skills", top_n: int = S.TOP_WORDS, levels: list[str] = S.COMPARED_LEVELS
) -> DataFrame:
    """Top words of the first level, then those of the second not yet listed, one row per word and level.

    ``position`` is the place in that list. Only the two top lists, of ``top_n`` rows each, are joined and
    numbered; the vocabulary itself stays distributed.
    """
    first, second = levels
    counts = word_counts(df, column, levels)

    def top(level: str) -> DataFrame:
        listed = counts.where(F.col(level) > 0).orderBy(F.desc(level), "word").limit(top_n)
        place = F.row_number().over(W.orderBy(F.desc(level), F.col("word")))
        return listed.withColumn(f"{level}_rank", place)

    both = top(first).join(top(second), ["word", first, second], "full")
    order = W.orderBy(F.asc_nulls_last(f"{first}_rank"), F.col(f"{second}_rank"))
    listed = both.withColumn("position", F.row_number().over(order)).withColumn("total", F.col(first) + F.col(second))
    rows = listed.unpivot(["position", "word", "total"], [first, second], "level", "count")
    share = F.when(F.col("total") > 0, F.col("count") * 100 / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("position", "word", "level", "count", "total", share.alias("share_pct"))
