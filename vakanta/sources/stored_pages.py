"""Stored web pages: a directory of ``<key>.html`` files, a table ``page_key, html``, or such a table laid out for joins.

A laid-out table holds one page per key, in buckets by key. Joins to it by key move the keys alone: its pages are read where
they lie, and none has to be told apart from repeats.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text without undecodable bytes, with plain line feeds."""
    text = content.map(lambda b: bytes(b).decode("utf-8", "ignore"))
    return text.str.replace("\r\n", "\n", regex=False).str.replace("\r", "\n", regex=False)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("page_key"), _decoded("content").alias("html"))


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_key string, html string").parquet(path)


ONE_PER_KEY = {"one_row_per_key": True}
BUCKET_BYTES = 256 << 20


def is_laid_out(pages: DataFrame) -> bool:
    """Does the table promise one row per ``page_key``, in buckets by it?"""
    return bool(pages.schema["page_key"].metadata.get("one_row_per_key"))


def _in_buckets(pages: DataFrame, buckets: int) -> DataFrame:
    """One row per key, where the key's bucket is written: pages move once, and repeats are told apart where they arrive."""
    return pages.select("page_key", "html").repartition(buckets, "page_key").groupBy("page_key").agg(F.min("html").alias("html"))


def lay_out(pages: DataFrame, path: str, buckets: int | None = None, longer_than: int | None = None) -> DataFrame:
    """Write ``page_key, html`` to the new folder ``path``, one row per key, in sorted buckets by key; returns the table.

    Of several pages of a key the smallest text stays, as ``pages.one_per_key`` takes it; pages not ``longer_than`` so many characters
    are left out first. Rows without a key are left out. ``buckets`` is by default one for each ``BUCKET_BYTES`` of pages, and
    one for each shuffle partition at least (Spark moves tables of fewer buckets than that). Pages move once here, and in no join after.
    """
    spark = pages.sparkSession
    usable = pages.where(F.col("page_key").isNotNull())
    usable = usable if longer_than is None else usable.where(F.length("html") > longer_than)
    if buckets is None:
        size = usable.agg(F.sum(F.octet_length("html").cast("long")).alias("b")).first()["b"] or 0
        buckets = max(-(-size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = _in_buckets(usable, buckets)
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}.layout")
    once.write.bucketBy(buckets, "page_key").sortBy("page_key").option("path", path).format("parquet").saveAsTable(_table_name(path))
    return read_laid_out(spark, path)


def _table_name(path: str) -> str:
    return f"pages_{hashlib.md5(path.encode()).hexdigest()}"


def read_laid_out(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``lay_out`` wrote, in this session or an earlier one."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{path}.layout").first()["buckets"]
        spark.sql(
            f"create table if not exists {name} (page_key string, html string) using parquet "
            f"clustered by (page_key) sorted by (page_key) into {buckets} buckets location '{path}'"
        )
    return spark.table(name).select(F.col("page_key").alias("page_key", metadata=ONE_PER_KEY), "html")


def compact_page_files(spark: SparkSession, path: str, table_path: str) -> DataFrame:
    """Turn a directory of small files into a laid-out table, to be read instead of it from then on."""
    return lay_out(read_page_files(spark, path), table_path)
