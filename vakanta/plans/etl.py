"""Landed vacancies and stored pages to the normalised vacancy table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions import levels, skills
from vakanta.functions import variants as V
from vakanta.functions.dates import posting_date
from vakanta.functions.places import location_text, with_location_fields
from vakanta.functions.text import filled, first_filled, strip
from vakanta.functions.titles import job_url, page_key
from vakanta.operators.pages import attach_sections, page_sections, sections_json, wanted_pages
from vakanta.operators.selection import export_order, first_wins, recent
from vakanta.session import checkpointed
from vakanta.sources import landing, sinks

INGEST_ORDER = ["term_rank", "page", "pos"]
ITEM_FIELDS = [
    "titel", "beruf", "berufsbezeichnung", "arbeitgeber", "refnr", "arbeitsort", "aktuelleVeroeffentlichungsdatum",
    "veroeffentlichtAm", "modifikationsTimestamp", "entgelt", "salary", "befristung", "angebotsart",
]
DEDUP_KEYS = ["job_title", "company", "location"]


def item_fields(items: DataFrame) -> DataFrame:
    """Columns of each landed item, plus ``reject_reason`` where a text field holds something else.

    Row by row, so it serves batch and stream alike. Date, location and pay may have any type.
    """
    item = F.col("item")
    values = {
        "titel": F.col("titel"),
        "beruf": V.first_set(F.col("beruf"), F.col("berufsbezeichnung")),
        "arbeitgeber": F.col("arbeitgeber"),
        "refnr": F.col("refnr"),
    }
    staged = V.with_fields(items, "item", ITEM_FIELDS).withColumns({f"__{n}": v for n, v in values.items()})
    staged = staged.withColumns(
        {
            "__posted": V.first_set(
                F.col("aktuelleVeroeffentlichungsdatum"), F.col("veroeffentlichtAm"), F.col("modifikationsTimestamp")
            ),
            "__place": F.col("arbeitsort"),
            "__salary": V.first_set(F.col("entgelt"), F.col("salary")),
            "__contract": V.first_set(F.col("befristung"), F.col("angebotsart")),
        }
    ).drop(*ITEM_FIELDS)
    reason = F.coalesce(
        *([F.col("file_error")] if "file_error" in items.columns else []),
        F.when(~V.is_object(item), F.lit("item is not an object")),
        *[
            F.when(V.is_set(F.col(f"__{name}")) & ~V.is_string(F.col(f"__{name}")), F.lit(f"{name} is not a string"))
            for name in values
        ],
    )

    def cleaned(name: str):
        value = F.col(f"__{name}")
        return F.when(V.is_string(value), strip(V.text(value))).otherwise("")

    out = staged.withColumns(
        {
            "reject_reason": reason,
            "job_title": cleaned("titel"),
            "beruf": cleaned("beruf"),
            "company": cleaned("arbeitgeber"),
            "refnr": F.when(V.is_string(F.col("__refnr")), filled(V.text(F.col("__refnr")))),
            "posted_date": F.when(V.is_string(F.col("__posted")), posting_date(V.text(F.col("__posted")))),
            "location": location_text(F.col("__place")),
            "salary": V.text(F.col("__salary")),
            "contract_type": V.text(F.col("__contract")),
        }
    )
    return out.drop("file_error", "__posted", "__place", "__salary", "__contract", *[f"__{name}" for name in values])


def split_rejects(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without the raw item, and rejects as ``error, item``."""
    good = fields.where(F.col("reject_reason").isNull()).drop("item", "reject_reason")
    bad = fields.where(F.col("reject_reason").isNotNull())
    return good, bad.select(F.col("reject_reason").alias("error"), "item")


def unique_recent(fields: DataFrame, as_of: dt.date | str, days: int = S.DAYS_WINDOW) -> DataFrame:
    """Date window, then first-wins by title, company and place.

    Both need item fields only, so they run before any page text is attached.
    """
    return first_wins(recent(fields, as_of, days), DEDUP_KEYS, INGEST_ORDER)


def describe(vacancies: DataFrame, normalized_at: dt.datetime | str) -> DataFrame:
    """Description, skills and level of vacancies with attached sections; the 26 output columns and the ingest order."""
    page_text = first_filled(F.col("html_full"), F.col("raw_text"))
    described = with_location_fields(vacancies).withColumns(
        {
            "job_url": job_url(F.col("refnr")),
            "description_full": F.coalesce(page_text, F.lit("")),
            "description_sections_json": sections_json(F.col("sections")),
            "description_sections_text": F.coalesce("sections_text", F.lit("")),
            "work_experience": levels.level_from_title(F.col("job_title")),
            "__beruf": filled(F.col("beruf")).isNotNull(),
            "__page": page_text.isNotNull(),
        }
    )
    lowered = described.withColumns(
        {
            "__lc": F.lower("description_full"),
            "__level_text": F.lower(first_filled(F.col("description_sections_text"), F.col("description_full"))),
        }
    )
    wanted = F.col("work_experience").isNull() & F.col("__level_text").isNotNull()
    scored = levels.with_semantic_level(lowered, "__level_text", "__semantic", wanted)
    level = first_filled(
        F.col("work_experience"), levels.normalize_level_name(F.col("__semantic")), F.lit("Mid")
    )
    return scored.select(
        *INGEST_ORDER,
        "search_term",
        "job_title",
        "beruf",
        "job_url",
        "company",
        "posted_date",
        "location",
        "index",
        "city",
        "state",
        "country",
        "address",
        "description_full",
        "description_sections_json",
        "description_sections_text",
        F.when(F.col("__beruf") & F.col("__page"), "API+Website")
        .when(F.col("__beruf"), "API")
        .when(F.col("__page"), "Website")
        .otherwise("None")
        .alias("description_source"),
        "html_quality",
        "html_filename",
        "salary",
        "contract_type",
        skills.skill_string(F.col("__lc"), S.HARD_SKILLS).alias("hard_skills"),
        skills.skill_string(F.col("__lc"), S.SOFT_SKILLS).alias("soft_skills"),
        "work_experience",
        levels.level_class(level).alias("experience_level"),
        F.lit(S.SOURCE_NAME).alias("source"),
        F.lit(normalized_at).cast("timestamp").alias("normalized_at"),
    )


def normalise(
    items: DataFrame,
    pages: DataFrame,
    ext_pages: DataFrame,
    as_of: dt.date | str,
    normalized_at: dt.datetime | str,
    days: int = S.DAYS_WINDOW,
) -> DataFrame:
    """The whole job, from items (``search_term, term_rank, page, pos, item``) to vacancies.

    Vacancies whose page cannot be read are left out; ``with_pages`` tells them.
    """
    good, _ = split_rejects(item_fields(items))
    return describe(readable(with_pages(unique_recent(good, as_of, days), pages, ext_pages)), normalized_at)


def with_pages(kept: DataFrame, pages: DataFrame, ext_pages: DataFrame, lookup: Column | None = None) -> DataFrame:
    """Kept vacancies with the sections of their pages; ``refused`` marks those whose page cannot be read.

    Vacancies are cut down first and written once, narrow as they are; their keys then decide which pages are parsed.
    ``lookup`` may narrow that to the vacancies whose page matters.
    """
    kept = checkpointed(kept)
    keys = wanted_pages(kept if lookup is None else kept.where(lookup))
    return attach_sections(kept, page_sections(pages, ext_pages, keys=keys))


def readable(attached: DataFrame) -> DataFrame:
    return attached.where(~F.col("refused"))


def experience_levels(
    items: DataFrame, pages: DataFrame, ext_pages: DataFrame, as_of: dt.date | str, days: int = S.DAYS_WINDOW
) -> DataFrame:
    """``experience_level`` of each vacancy alone: pages are parsed only where the title gives no level."""
    good, _ = split_rejects(item_fields(items))
    untold = levels.level_from_title(F.col("job_title")).isNull()
    attached = with_pages(unique_recent(good, as_of, days), pages, ext_pages, untold)
    return describe(readable(attached), dt.datetime(1970, 1, 1)).select("experience_level")


def staged_items(items: DataFrame) -> DataFrame:
    """Item fields as a storable table; the raw item is kept, as JSON text, for rejected ones only."""
    fields = item_fields(items)
    rejected = F.col("reject_reason").isNotNull()
    return fields.withColumn("item", F.when(rejected, F.to_json("item"))).withColumn("rejected", rejected)


STAGED_SCHEMA = (
    "search_term string, term_rank long, page int, pos int, item string, reject_reason string, job_title string, "
    "beruf string, company string, refnr string, posted_date date, location string, salary string, "
    "contract_type string, rejected boolean"
)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED_SCHEMA).parquet(path)


def finish_etl(
    staged: DataFrame,
    pages: DataFrame,
    ext_pages: DataFrame,
    out_path: str,
    as_of: dt.date | str,
    normalized_at: dt.datetime | str,
    days: int = S.DAYS_WINDOW,
) -> str | None:
    """Write rejects and the vacancy table of a staged table; returns the table's path, None if it is empty."""
    bad = staged.where("rejected").select(F.col("reject_reason").alias("error"), F.parse_json("item").alias("item"))
    good = staged.where("not rejected").drop("item", "reject_reason", "rejected")
    if recent(good, as_of, days).isEmpty():
        sinks.write_rejects(bad, f"{out_path}/rejects")
        return None
    attached = with_pages(unique_recent(good, as_of, days), pages, ext_pages)
    fields = F.struct("job_title", "company", "location", "refnr", "page_key")
    unread = attached.withColumn("page_key", page_key(F.col("refnr"))).where("refused").select(
        F.lit("page cannot be read").alias("error"), F.parse_json(F.to_json(fields)).alias("item")
    )
    sinks.write_rejects(bad.unionByName(unread), f"{out_path}/rejects")
    return sinks.write_vacancies(describe(readable(attached), normalized_at), f"{out_path}/vacancies")


def run_etl(
    spark: SparkSession,
    landing_path: str,
    pages: DataFrame,
    ext_pages: DataFrame,
    out_path: str,
    as_of: dt.date | str,
    normalized_at: dt.datetime | str,
    terms: list[str] = S.SEARCH_TERMS,
    days: int = S.DAYS_WINDOW,
) -> str | None:
    """The whole job from landed files. JSON is parsed once, into a staged table that both outputs are made from."""
    staged_path = f"{out_path}/staged_items"
    staged = staged_items(landing.read_landing(spark, landing_path, terms))
    staged.write.mode("overwrite").partitionBy("rejected").parquet(staged_path)
    return finish_etl(read_staged(spark, staged_path), pages, ext_pages, out_path, as_of, normalized_at, days)


def exported(vacancies: DataFrame) -> DataFrame:
    """The table in presentation order under its exported column names."""
    ordered = export_order(vacancies, [c for c in INGEST_ORDER if c in vacancies.columns])
    return ordered.select(*S.VACANCY_COLUMNS).withColumnRenamed("description_full", "description")
