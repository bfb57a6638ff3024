"""Landed result pages of the vacancy search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanta import settings as S

CORRUPT = "_corrupt_record"
LANDING_SCHEMA = f"{S.ENVELOPE_SCHEMA}, search_term string, page int"


def items(envelopes: DataFrame, terms: list[str] = S.SEARCH_TERMS) -> DataFrame:
    """One row per item of ``stellenangebote`` or, where that is missing or empty, of ``jobs``.

    ``term_rank``, ``page`` and ``pos`` together give the order in which items were found; result pages of
    other terms are left out. Where the envelopes have the text of unreadable files, each gives one row.
    """
    listed = F.when(F.size("stellenangebote") > 0, F.col("stellenangebote")).otherwise(F.col("jobs"))
    rank = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("search_term"))
    known = envelopes.where(F.col("search_term").isin(terms)).withColumn("term_rank", rank)
    if CORRUPT not in envelopes.columns:
        return known.select("search_term", "term_rank", "page", F.posexplode(listed).alias("pos", "item"))
    broken = F.col(CORRUPT).isNotNull()
    quoted = F.to_json(F.array(CORRUPT))  # a list of one text; without its brackets, JSON of the text
    text = F.parse_json(F.substr(quoted, F.lit(2), F.length(quoted) - 2))
    error = F.when(broken, F.lit("file is not readable JSON")).alias("file_error")
    return known.select(
        "search_term", "term_rank", "page", error, F.posexplode(F.when(broken, F.array(text)).otherwise(listed)).alias("pos", "item")
    )


def write_compacted(envelopes: DataFrame, path: str) -> str:
    """Result pages (``search_term, page, value``) as a compacted landing: folders by term, a line for each page.

    A line is the page's number, a tab, and the text of the envelope, whose line breaks (white space in JSON) become spaces. The
    number of files follows the tasks, not the pages.
    """
    number = F.coalesce(F.col("page").cast("string"), F.lit(""))
    line = F.concat(number, F.lit("\t"), F.regexp_replace(F.coalesce("value", F.lit("")), "[\r\n]", " ")).alias("value")
    envelopes.select("search_term", line).write.partitionBy("search_term").text(path)
    return path


def _read_compacted(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of a compacted landing, as the JSON reader gives them."""
    lines = spark.read.schema("value string, search_term string").text(path)
    cut = F.instr("value", "\t")
    text = F.substr("value", cut + 1)
    envelope = F.from_json(text, f"{S.ENVELOPE_SCHEMA}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    page = F.substr("value", F.lit(1), cut - 1).try_cast("int").alias("page")
    # the generator keeps the envelope a column of its own; in projections it could be parsed once per use
    return lines.where(F.trim(text) != "").select("search_term", page, F.explode(F.array(envelope)).alias("envelope")).select("search_term", "page", "envelope.*")


def read_landing(
    spark: SparkSession, path: str, terms: list[str] = S.SEARCH_TERMS, one_envelope_per_line: bool = False, compacted: bool = False
) -> DataFrame:
    """Items under ``path/search_term=.../page=.../*.json``; only directories of the given terms are read.

    A file holds one envelope, or one per line (splittable). A ``compacted`` landing, as ``write_compacted`` makes it, has no folders of
    pages: many pages share a file. A file or line that is no JSON gives one row: its text as the item, and ``file_error``.
    """
    if compacted:
        return items(_read_compacted(spark, path), terms)
    reader = spark.read.schema(f"{LANDING_SCHEMA}, {CORRUPT} string").option("multiLine", not one_envelope_per_line)
    return items(reader.option("columnNameOfCorruptRecord", CORRUPT).json(path), terms)
