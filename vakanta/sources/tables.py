"""The vacancy table as the reports read it, and the table of city coordinates."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import filled, strip, title_case


def as_analysis_table(df: DataFrame) -> DataFrame:
    """Empty strings become null and ``posted_date`` a date; unreadable dates become null."""
    columns = {name: filled(F.col(f"`{name}`")) for name, kind in df.dtypes if kind == "string"}
    if "posted_date" in df.columns:
        columns["posted_date"] = F.col("posted_date").cast("string").try_cast("date")
    return df.withColumns(columns)


def read_vacancies(spark: SparkSession, path: str) -> DataFrame:
    return as_analysis_table(spark.read.parquet(path))


def as_geocache(df: DataFrame) -> DataFrame:
    """Stripped, title-cased city names; rows without both coordinates are dropped."""
    return df.dropna(subset=["Latitude", "Longitude"]).withColumn("City", title_case(strip(F.col("City"))))


def read_geocache(spark: SparkSession, path: str) -> DataFrame:
    """City coordinates from CSV with each row's place in ``cache_row``; an empty table if the path does not exist.

    A place is file, block and row: rows of a block are read in order by one task, so the order of places does not depend
    on how files are dealt to tasks.
    """
    try:
        rows = spark.read.schema(S.GEO_SCHEMA).option("header", True).csv(os.fspath(path))
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        return as_geocache(rows.withColumn("cache_row", place))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], S.GEO_SCHEMA + ", cache_row struct<file:string,block:bigint,row:bigint>")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary table: ``pattern, label``, from Parquet, or CSV with a header where the path ends so."""
    schema = "pattern string, label string"
    return spark.read.csv(path, schema, header=True) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)
