"""Counts by level, search term, month, skill, city and state.

Every report first aggregates (with partial sums before the shuffle) and only then ranks or shares, so no task
ever holds the rows of one level, term or city. Ties are ordered by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.dates import month_start
from vakanta.functions.levels import level_label
from vakanta.functions.skills import skill_list
from vakanta.operators.rows import counted, each, weight_of


def with_level_label(df: DataFrame) -> DataFrame:
    """``experience_level`` as the reports use it; 'unknown' throughout if there is no such column."""
    has_level = "experience_level" in df.columns
    return df.withColumn("experience_level", level_label(F.col("experience_level")) if has_level else F.lit("unknown"))


def at_level(df: DataFrame, level: str | None) -> DataFrame:
    """Rows of one level, without regard to case; all rows for None."""
    return df if level is None else df.where(F.lower("experience_level") == level.strip().lower())


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group with their rank; each task keeps no more than ``n`` before the shuffle."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def experience_distribution(df: DataFrame) -> DataFrame:
    """Vacancies and percentage per level."""
    counts = with_level_label(df).groupBy("experience_level").agg(counted(df).alias("vacancies"))
    total = F.sum("vacancies").over(W.partitionBy())
    return counts.withColumn("share_pct", F.col("vacancies") * 100 / total).orderBy(
        F.desc("vacancies"), "experience_level"
    )


def search_term_distribution(df: DataFrame) -> DataFrame:
    counts = df.where(F.col("search_term").isNotNull()).groupBy("search_term").agg(counted(df).alias("vacancies"))
    return counts.orderBy(F.desc("vacancies"), "search_term")


def search_term_by_level(df: DataFrame) -> DataFrame:
    rows = with_level_label(df).where(F.col("search_term").isNotNull())
    counts = rows.groupBy("experience_level", "search_term").agg(counted(df).alias("vacancies"))
    return counts.orderBy("experience_level", F.desc("vacancies"), "search_term")


def monthly_dynamics(df: DataFrame) -> DataFrame:
    """Vacancies per month, over all levels (``scope`` all) and per level; months without any are absent.

    The grand rows are summed from the per-level counts, so the table itself is aggregated once.
    """
    dated = with_level_label(df).withColumn("month", month_start(F.col("posted_date").try_cast("date")))
    counts = (
        dated.where(F.col("month").isNotNull())
        .groupBy("month", "experience_level")
        .agg(counted(df).alias("vacancies"))
        .withColumn("line", F.explode(F.array(F.lit("all"), F.concat(F.lit("level: "), "experience_level"))))
    )
    lines = counts.groupBy("month", "line").agg(F.sum("vacancies").alias("vacancies"))
    return lines.orderBy("line", "month")


def top_skills_by_level(df: DataFrame, column: str = "hard_skills", top_n: int = S.TOP_SKILLS) -> DataFrame:
    """Most frequent skills of each level."""
    skills = each(with_level_label(df), ["experience_level", *weight_of(df)], skill_list(F.col(column)), "skill")
    counts = skills.groupBy("experience_level", "skill").agg(counted(df).alias("vacancies"))
    return top_per_group(counts, ["experience_level"], [F.desc("vacancies"), F.col("skill")], top_n)


def top_values(df: DataFrame, column: str, top_n: int) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(counted(df).alias("vacancies"))
    return counts.orderBy(F.desc("vacancies"), column).limit(top_n)


def city_distribution(df: DataFrame, top_n: int = S.TOP_CITIES) -> DataFrame:
    return top_values(df, "city", top_n)


def state_distribution(df: DataFrame, top_n: int = S.TOP_STATES) -> DataFrame:
    return top_values(df, "state", top_n)


def geo_by_level(
    df: DataFrame,
    levels: list[str] = S.COMPARED_LEVELS,
    top_cities: int = S.TOP_CITIES,
    top_states: int = S.TOP_STATES,
) -> DataFrame:
    """Top cities and top states of each level; a level without vacancies gives no rows."""
    kept = df.withColumn("level", F.lower("experience_level")).where(F.col("level").isin(levels))

    def top(column: str, n: int) -> DataFrame:
        counts = kept.where(F.col(column).isNotNull()).groupBy("level", column).agg(counted(df).alias("vacancies"))
        ranked = top_per_group(counts, ["level"], [F.desc("vacancies"), F.col(column)], n)
        return ranked.select("level", F.lit(column).alias("kind"), F.col(column).alias("name"), "rank", "vacancies")

    return top("city", top_cities).unionByName(top("state", top_states))
