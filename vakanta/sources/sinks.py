"""Writers. Each writes to a path of its own, never to one it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanta import settings as S


def write_vacancies(df: DataFrame, path: str) -> str:
    """The vacancy table, partitioned by posting month. The ingest order stays for later ordered reads.

    Rows are gathered by month before they are written, months of much data into several files of even size.
    """
    order = [c for c in ("term_rank", "page", "pos") if c in df.columns]
    out = df.select(*S.VACANCY_COLUMNS, *order).withColumnRenamed("description_full", "description")
    out = out.withColumn("posted_month", F.date_format("posted_date", "yyyy-MM"))
    out.hint("rebalance", "posted_month").write.mode("overwrite").partitionBy("posted_month").parquet(path)
    return path


def write_rejects(rejects: DataFrame, path: str) -> str:
    """JSON lines of ``error`` and ``item``."""
    rejects.select(F.to_json(F.struct("error", "item")).alias("value")).write.mode("overwrite").text(path)
    return path


def write_geocache(df: DataFrame, path: str) -> str:
    """City coordinates as CSV with a header, in the order of names: rows with both coordinates, one per city.

    Of several rows of a city the first by ``cache_row``, where there is one, or by its numbers counts.
    """
    order = [c for c in ("cache_row", "Latitude", "Longitude") if c in df.columns]
    first = F.row_number().over(Window.partitionBy("City").orderBy(*order))
    located = df.where(F.col("City").isNotNull()).dropna(subset=["Latitude", "Longitude"]).withColumn("__rn", first)
    located.where("__rn = 1").orderBy("City").select("City", "Latitude", "Longitude").write.mode("overwrite").option("header", True).csv(path)
    return path


def write_reports(reports: dict[str, DataFrame], path: str, file_format: str = "parquet") -> dict[str, str]:
    """One directory per report."""
    written = {}
    for name, report in reports.items():
        written[name] = f"{path}/{name}"
        writer = report.write.mode("overwrite")
        (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(written[name])
    return written
