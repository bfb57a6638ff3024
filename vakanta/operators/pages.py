"""Stored pages to text sections, table to table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import contains_any, filled, is_blank, strip, strip_colons
from vakanta.functions.titles import page_key
from vakanta.operators.html_tree import read_page
from vakanta.session import checkpointed
from vakanta.sources.stored_pages import is_laid_out

_BLOCK = "array<struct<title:string,text:string>>"
PARSED_SCHEMA = f"page_key string, raw_text string, link string, header_blocks {_BLOCK}, strong_blocks {_BLOCK}, refused boolean"
SECTION_COLUMNS = [
    "html_full", "sections", "sections_text", "raw_text", "html_quality", "html_filename", "refused",
]


def parse_pages(
    pages: DataFrame, titles: list[str] = S.SECTION_TITLES, link_id: str = S.EXTERNAL_LINK_ID
) -> DataFrame:
    """One Arrow pass over ``page_key, html``: text, partner link and titled blocks. No shuffle.

    ``refused`` marks pages that the parser cannot read.
    """
    body_tags = set(S.SECTION_BODY_TAGS)
    block = pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())]))
    schema = pa.schema(
        [
            ("page_key", pa.string()),
            ("raw_text", pa.string()),
            ("link", pa.string()),
            ("header_blocks", block),
            ("strong_blocks", block),
            ("refused", pa.bool_()),
        ]
    )

    def parse(batches):
        for batch in batches:
            rows = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append({"page_key": key, **read_page(html or "", link_id, titles, body_tags)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_key", "html").mapInArrow(parse, PARSED_SCHEMA)


def with_colon_sections(
    df: DataFrame, text: Column, out: str = "colon_blocks", titles: list[str] = S.SECTION_TITLES
) -> DataFrame:
    """Add the blocks opened by title lines; null where ``text`` is null.

    A title line ends in a colon and contains one of the titles, without case, outer space and trailing colons.
    Works inside each row: the positions of the title lines cut the array of lines into slices. Text
    before the first title and titles without text give no block.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    # bare lines are made once each, not for each of the titles
    bare = F.transform("__lines", lambda line: F.when(line.endswith(":"), strip_colons(F.lower(line))))
    staged = df.withColumn("__lines", lines).withColumn(
        "__at", F.array_compact(F.transform(bare, lambda line, i: F.when(contains_any(line, titles), i + 1)))
    )

    def block(at: Column, i: Column) -> Column:
        following = F.coalesce(F.try_element_at("__at", i + 2), F.size("__lines") + 1)
        return F.struct(
            strip_colons(F.element_at("__lines", at)).alias("title"),
            F.array_join(F.slice("__lines", at + 1, following - at - 1), "\n").alias("text"),
        )

    blocks = F.filter(F.transform("__at", block), lambda b: b["text"] != "")
    return staged.withColumn(out, blocks).drop("__lines", "__at")


def last_text_per_title(blocks: Column) -> Column:
    """Each title once, at its first place, with its last text."""
    titles = F.array_distinct(F.transform(blocks, lambda b: b["title"]))
    return F.when(F.size(titles) == F.size(blocks), blocks).otherwise(_told_apart(blocks))


def _told_apart(blocks: Column) -> Column:
    """The same for blocks that repeat titles: sorted by title and place, a title's first block has its place and its last the text."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["title"] == b["title"], F.lit(False))

    placed = F.transform(blocks, lambda b, i: F.struct(b["title"].alias("title"), i.alias("i"), b["text"].alias("text")))
    merged = F.transform(
        F.array(F.sort_array(placed)),
        lambda ps: F.zip_with(
            F.filter(ps, lambda p, i: ~same(F.get(ps, i - 1), p)),
            F.filter(ps, lambda p, i: ~same(F.get(ps, i + 1), p)),
            lambda first, last: F.struct(first["i"].alias("i"), first["title"].alias("title"), last["text"].alias("text")),
        ),
    )
    return F.transform(F.sort_array(F.element_at(merged, 1)), lambda b: F.struct(b["title"].alias("title"), b["text"].alias("text")))


def render_sections(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["title"], F.lit(":\n"), b["text"])), "\n\n")


def sections_json(sections: Column) -> Column:
    """JSON object in section order, with a space after ':' and ','; '' if there are no sections."""

    def quoted(listed: Column) -> Column:
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    lists = F.transform(sections, lambda s: F.struct(F.to_json(F.array(s["title"])).alias("title"), F.to_json(F.array(s["text"])).alias("text")))
    members = F.transform(lists, lambda s: F.concat(quoted(s["title"]), F.lit(": "), quoted(s["text"])))
    body = F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))
    return F.when(F.coalesce(F.size(sections), F.lit(0)) > 0, body).otherwise("")


def one_per_key(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The pages of the given keys (``page_key``, distinct), one per key: of several the smallest text counts.

    A laid-out table has one already; only the keys move to its buckets then.
    """
    wanted = pages.join(keys, "page_key", "left_semi")
    return wanted if is_laid_out(pages) else wanted.groupBy("page_key").agg(F.min("html").alias("html"))


def external_texts(ext_pages: DataFrame, links: DataFrame, min_length: int | None = None) -> DataFrame:
    """The linked partner pages as ``ext_key, ext_text``; empty pages, and those not above ``min_length``, do not count."""
    usable = ext_pages.where(F.length("html") > (0 if min_length is None else min_length))
    return parse_pages(one_per_key(usable, links.withColumnRenamed("ext_key", "page_key"))).select(
        F.col("page_key").alias("ext_key"), F.col("raw_text").alias("ext_text")
    )


def page_sections(
    pages: DataFrame,
    ext_pages: DataFrame,
    min_external_length: int | None = None,
    keys: DataFrame | None = None,
    titles: list[str] = S.SECTION_TITLES,
    link_id: str = S.EXTERNAL_LINK_ID,
) -> DataFrame:
    """One row per page key: sections, rendered text, raw text, quality, file name.

    With ``keys`` (``page_key``, distinct) only their pages are read, one per key: the others are left out on the scan's
    side of the parser. Without, every row of ``pages`` is parsed where it is scanned. Parsed pages are written once;
    the partner pages that they link to, and no others, are parsed next, and only linked pages are joined to them.
    """
    wanted = pages if keys is None else one_per_key(pages, keys)
    parsed = checkpointed(parse_pages(wanted, titles, link_id).withColumn("ext_key", page_key(F.col("link"))))
    linked = parsed.where(F.col("ext_key").isNotNull())
    found = external_texts(ext_pages, linked.select("ext_key").distinct(), min_external_length)
    joined = linked.join(found, "ext_key", "left")
    plain = parsed.where(F.col("ext_key").isNull()).withColumn("ext_text", F.lit(None).cast("string"))
    parsed = plain.unionByName(joined)

    external = F.col("ext_text").isNotNull()
    tag_blocks = F.when(F.size("header_blocks") > 0, F.col("header_blocks")).otherwise(
        last_text_per_title(F.col("strong_blocks"))
    )
    staged = parsed.withColumn("__tag", F.when(~external, tag_blocks))
    staged = with_colon_sections(staged, F.when(F.size("__tag") == 0, F.col("raw_text")), titles=titles)
    blocks = F.coalesce(F.when(F.size("__tag") > 0, F.col("__tag")), last_text_per_title(F.col("colon_blocks")))
    staged = staged.withColumn("__blocks", blocks).withColumn(
        "html_quality",
        F.when(external, "external")
        .when(F.size("__blocks") > 0, "structured")
        .when(~is_blank(F.col("raw_text")), "unstructured")
        .otherwise("empty"),
    )
    structured = F.col("html_quality") == "structured"
    staged = staged.withColumn("__rendered", F.when(structured, render_sections(F.col("__blocks"))))
    return staged.select(
        "page_key",
        F.col("__rendered").alias("html_full"),
        F.when(structured, last_text_per_title(F.col("__blocks"))).alias("sections"),
        F.col("__rendered").alias("sections_text"),
        F.when(external, F.col("ext_text"))
        .when(structured, F.col("raw_text"))
        .when(F.col("html_quality") == "unstructured", strip(F.col("raw_text")))
        .alias("raw_text"),
        "html_quality",
        F.when(external, F.col("ext_key")).otherwise(F.col("page_key")).alias("html_filename"),
        "refused",
    )


def wanted_pages(vacancies: DataFrame, refnr: str = "refnr") -> DataFrame:
    """``page_key`` of the vacancies that have a number, each once."""
    return vacancies.where(filled(F.col(refnr)).isNotNull()).select(page_key(F.col(refnr)).alias("page_key")).distinct()


def attach_sections(vacancies: DataFrame, sections: DataFrame, refnr: str = "refnr") -> DataFrame:
    """Left join of vacancies to their page sections by the key of the reference number.

    Vacancies without a number match nothing; they get spread-out keys that no page has, so they do not
    meet in one task. A number held by very many vacancies is split by adaptive execution.
    """
    missing = filled(F.col(refnr)).isNull()
    spread = F.concat(F.lit("?"), F.pmod(F.xxhash64(*vacancies.columns), F.lit(4096)))
    keyed = vacancies.withColumn("page_key", F.when(missing, spread).otherwise(page_key(F.col(refnr))))
    joined = keyed.join(sections, "page_key", "left")
    return joined.withColumns(
        {
            "html_quality": F.coalesce("html_quality", F.lit("empty")),
            "refused": F.coalesce("refused", F.lit(False)),
            "html_filename": F.when(missing, F.lit("")).otherwise(F.coalesce("html_filename", "page_key")),
        }
    ).drop("page_key")
