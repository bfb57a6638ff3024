"""City counts with coordinates, and upkeep of the coordinate table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.places import normalize_city
from vakanta.operators.reports import at_level
from vakanta.operators.rows import counted

CACHE_ORDER = ["cache_row", "Latitude", "Longitude"]


def city_stats(df: DataFrame, level: str | None = None, merge_variants: bool = False) -> DataFrame:
    """``City, Vacancies``: counted by the city as written, then named in normal form.

    Spellings of one city stay separate rows unless ``merge_variants`` is set.
    """
    counts = at_level(df, level).where(F.col("city").isNotNull()).groupBy("city").agg(counted(df).alias("Vacancies"))
    named = counts.select(normalize_city(F.col("city")).alias("City"), "Vacancies")
    return named.groupBy("City").agg(F.sum("Vacancies").alias("Vacancies")) if merge_variants else named


def city_stats_by_scope(df: DataFrame, levels: list[str] = S.COMPARED_LEVELS) -> DataFrame:
    """City counts for all vacancies and for each level, from one pass over the table."""
    counts = (
        df.where(F.col("city").isNotNull())
        .groupBy("city", F.lower("experience_level").alias("level"))
        .agg(counted(df).alias("n"))
    )
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("level").isin(levels), F.col("level"))))
    by_scope = counts.select("city", "n", F.explode(scopes).alias("scope"))
    return (
        by_scope.groupBy("scope", "city")
        .agg(F.sum("n").alias("Vacancies"))
        .select("scope", normalize_city(F.col("city")).alias("City"), "Vacancies")
    )


def known_cities(cache: DataFrame) -> DataFrame:
    """Coordinates by normalised city name; the first row of a city counts."""
    named = cache.withColumn("City", normalize_city(F.col("City")))
    order = [c for c in CACHE_ORDER if c in named.columns]
    kept = named.withColumn("__rn", F.row_number().over(W.partitionBy("City").orderBy(*order))).where("__rn = 1")
    return kept.select("City", "Latitude", "Longitude")


def with_coordinates(stats: DataFrame, cache: DataFrame) -> DataFrame:
    """Cities that have coordinates. Both sides are one row per city; Spark picks the join by their size."""
    located = known_cities(cache).dropna(subset=["Latitude", "Longitude"])
    return stats.join(located, "City", "inner")


def cities_without_coordinates(stats: DataFrame, cache: DataFrame) -> DataFrame:
    return stats.select("City").distinct().join(known_cities(cache), "City", "left_anti").orderBy("City")


def coverage(stats: DataFrame, cache: DataFrame) -> DataFrame:
    """Numbers of all, cached and new cities, in one row."""
    marks = (
        stats.select("City", F.lit(1).alias("seen"), F.lit(0).alias("cached"))
        .unionByName(known_cities(cache).select("City", F.lit(0).alias("seen"), F.lit(1).alias("cached")))
        .groupBy("City")
        .agg(F.max("seen").alias("seen"), F.max("cached").alias("cached"))
    )
    return marks.agg(
        F.count_if(F.col("seen") == 1).alias("all_cities"),
        F.count_if(F.col("cached") == 1).alias("cached_cities"),
        F.count_if((F.col("seen") == 1) & (F.col("cached") == 0)).alias("new_cities"),
    )


def updated_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """Cached rows, then newly found ones, one row per city; a found coordinate of exactly 0 does not count."""
    usable = (F.col("Latitude") != 0) & (F.col("Longitude") != 0)
    added = found.where(usable).select("City", "Latitude", "Longitude", F.lit(1).alias("cache_row"))
    rows = known_cities(cache).withColumn("cache_row", F.lit(0)).unionByName(added)
    located = rows.dropna(subset=["Latitude", "Longitude"])
    kept = located.withColumn("__rn", F.row_number().over(W.partitionBy("City").orderBy(*CACHE_ORDER)))
    return kept.where("__rn = 1").select("City", "Latitude", "Longitude")
