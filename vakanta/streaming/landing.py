"""Landed result pages as they arrive. Item fields need no other rows, so they are read from a stream by the
functions that the batch job uses; the staged table they end in is what ``plans.etl.finish_etl`` starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vakanta import settings as S
from vakanta.plans.etl import staged_items
from vakanta.sources.landing import CORRUPT, LANDING_SCHEMA, items


def stream_items(spark: SparkSession, path: str, terms: list[str] = S.SEARCH_TERMS) -> DataFrame:
    reader = spark.readStream.schema(f"{LANDING_SCHEMA}, {CORRUPT} string").option("multiLine", True)
    envelopes = reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return staged_items(items(envelopes, terms))


def stage_stream(stream: DataFrame, staged_path: str, checkpoint_path: str, once: bool = False) -> StreamingQuery:
    """Append to the staged table; ``once`` stops when all files present have been read."""
    writer = stream.writeStream.format("parquet").partitionBy("rejected").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if once else writer).start(staged_path)
