"""All reports on the vacancy table. Each is a DataFrame of its own; none is computed before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.dates import month_start
from vakanta.operators import clusters, geography, reports, words
from vakanta.operators.rows import WEIGHT, compacted
from vakanta.session import checkpointed
from vakanta.sources import sinks, tables


PLACE_COLUMNS = ["experience_level", "search_term", "posted_date", "city", "state"]
SKILL_COLUMNS = ["hard_skills", "soft_skills"]


def compact_table(df: DataFrame) -> DataFrame:
    """The vacancy table as counts of what the reports look at, from one pass: places and dates, each skill column, titles.

    A row belongs to one of these sets and has nulls in the columns of the others. Every report leaves out nulls of its own
    column, so reports run on one set each; ``of_set`` gives it.
    """
    labelled = reports.with_level_label(df).withColumn("posted_date", month_start(F.col("posted_date").try_cast("date")))
    sets = {name: ["experience_level", *columns] for name, columns in SETS.items()}
    columns = list(dict.fromkeys(c for used in sets.values() for c in used))
    parts = [
        F.struct(F.lit(name).alias("set"), *[(F.col(c) if c in used else F.lit(None).cast("string")).cast("string").alias(c) for c in columns])
        for name, used in sets.items()
    ]
    each_set = labelled.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return compacted(each_set, ["set", *columns])


SETS = {"places": PLACE_COLUMNS[1:], "hard_skills": ["hard_skills"], "soft_skills": ["soft_skills"], "titles": ["search_term", "job_title"]}


def of_set(compact: DataFrame, name: str) -> DataFrame:
    found = compact.where(F.col("set") == name).select("experience_level", *SETS[name], WEIGHT)
    return found.withColumn("posted_date", F.col("posted_date").cast("date")) if "posted_date" in SETS[name] else found


def market_reports(df: DataFrame, compact: DataFrame | None = None) -> dict[str, DataFrame]:
    """Distributions, months, skills, places and words of a vacancy table, or of what ``compact_table`` made of it."""
    labelled = reports.with_level_label(df) if compact is None else of_set(compact, "places")
    hard, soft = (labelled if compact is None else of_set(compact, c) for c in SKILL_COLUMNS)
    return {
        "experience_distribution": reports.experience_distribution(labelled),
        "search_term_distribution": reports.search_term_distribution(labelled),
        "search_term_by_level": reports.search_term_by_level(labelled),
        "monthly_dynamics": reports.monthly_dynamics(labelled),
        "top_hard_skills": reports.top_skills_by_level(hard, "hard_skills"),
        "top_soft_skills": reports.top_skills_by_level(soft, "soft_skills"),
        "city_distribution": reports.city_distribution(labelled),
        "state_distribution": reports.state_distribution(labelled),
        "geo_by_level": reports.geo_by_level(labelled),
        "repeated_hard_skill_words": words.repeated_words(hard, "hard_skills"),
        "repeated_soft_skill_words": words.repeated_words(soft, "soft_skills"),
    }


def cluster_reports(df: DataFrame, compact: DataFrame | None = None) -> dict[str, DataFrame]:
    """Title clusters per level and search term, and skill clusters. Runs the clustering."""
    labelled = reports.with_level_label(df)
    titles = clusters.title_clusters(labelled if compact is None else of_set(compact, "titles"))
    out = {
        "title_cluster_groups": titles.groups,
        "title_cluster_sizes": titles.sizes,
        "title_cluster_terms": titles.terms,
        "title_cluster_examples": titles.examples,
    }
    for column in ("hard_skills", "soft_skills"):
        labels = clusters.skill_clusters(labelled if compact is None else of_set(compact, column), column)
        if labels is not None:
            out[f"{column}_clusters"] = labels
            out[f"{column}_clusters_shown"] = clusters.shown_skills(labels)
    return out


def geo_reports(df: DataFrame, cache: DataFrame, levels: list[str] = S.COMPARED_LEVELS) -> dict[str, DataFrame]:
    """City counts with coordinates for all vacancies and each level, and what the coordinate table lacks."""
    stats = geography.city_stats_by_scope(df, levels)
    everything = stats.where("scope = 'all'")
    return {
        "city_coordinates": geography.with_coordinates(stats, cache),
        "cities_without_coordinates": geography.cities_without_coordinates(everything, cache),
        "geo_coverage": geography.coverage(everything, cache),
    }


def run_analytics(spark: SparkSession, vacancies_path: str, geocache_path: str, out_path: str) -> dict[str, str]:
    """Write every report under ``out_path``; returns report name to path. The vacancy table is scanned once."""
    df = tables.read_vacancies(spark, vacancies_path)
    cache = tables.read_geocache(spark, geocache_path)
    compact = checkpointed(compact_table(df))
    found = {**market_reports(df, compact), **geo_reports(of_set(compact, "places"), cache), **cluster_reports(df, compact)}
    return sinks.write_reports(found, out_path)
