"""Locations: raw field to text, text to five fields, city names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions import variants as V
from vakanta.functions.text import SPACE, strip, title_case

LOCATION_FIELDS = ["index", "city", "state", "country", "address"]


def _object_text(value: Column) -> Column:
    """The string-valued parts in fixed order; parts of other types are left out, empty ones stay."""
    parts = [V.field(value, name) for name in S.LOCATION_PARTS]
    return F.concat_ws(", ", *[F.when(V.is_string(p), strip(V.text(p))) for p in parts])


def _scalar_text(value: Column) -> Column:
    word = F.when(V.type_name(value) == "BOOLEAN", F.initcap(V.text(value))).otherwise(V.text(value))
    return strip(F.coalesce(word, F.lit("")))


def location_text(value: Column) -> Column:
    """One location string from a string, an object, or the first element of a list of either, lists in lists included.

    The brackets in front of a list's JSON text tell how deep its first element lies.
    """
    is_list = V.is_array(value)
    depth = F.length(F.regexp_extract(F.to_json(F.when(is_list, value)), r"^\[+", 0))
    inner = F.try_variant_get(value, F.concat(F.lit("$"), F.repeat(F.lit("[0]"), depth)), "variant")
    chain = F.when(V.is_object(value), _object_text(value))
    chain = chain.when(is_list & V.is_object(inner), _object_text(inner)).when(is_list, _scalar_text(inner))
    return chain.otherwise(_scalar_text(value))


def _is_address(p: Column, suffixes: list[str]) -> Column:
    numbered = p.rlike("[0-9]") & p.rlike(f"[{S.ADDRESS_LETTERS}]")
    suffix = "|".join(s.replace(".", r"\.") for s in suffixes)
    return numbered | F.lower(p).rlike(f"({suffix})\\z")


def with_location_fields(
    df: DataFrame,
    location: str = "location",
    states: list[str] = S.GERMAN_STATES,
    city_states: list[str] = S.CITY_STATES,
    country: str = S.COUNTRY,
    suffixes: list[str] = S.STREET_SUFFIXES,
) -> DataFrame:
    """Add ``index, city, state, country, address`` read from the comma-separated location.

    Each field is the first part that passes its test; the city is the first part whose value is none of
    the found ones. The tests exclude each other, so no running state is needed. Three projections keep the
    split array from being computed once per field.
    """

    def first(test) -> Column:
        return F.try_element_at(F.filter("__parts", test), F.lit(1))

    split = F.filter(F.transform(F.split(F.col(location), ","), strip), lambda p: p != "")
    found = ["__index", "__state", "__country", "__address"]
    staged = (
        df.withColumn("__all", split)
        .withColumns(
            {
                "__parts": F.filter("__all", lambda p: F.lower(p) != "null"),
                "__open_end": F.lower(F.try_element_at("__all", F.lit(-1))) == "null",
            }
        )
        .withColumns(
            {
                "__index": first(lambda p: p.rlike(r"^\p{Nd}{5}\z")),
                "__state": first(lambda p: F.lower(p).isin(states)),
                "__country": first(lambda p: F.lower(p) == country),
                "__address": first(lambda p: _is_address(p, suffixes)),
            }
        )
        .withColumn("__found", F.array_compact(F.array(*found)))
        .withColumn("__city", first(lambda p: ~F.array_contains("__found", p)))
    )
    city_state = F.lower("__state").isin(city_states)
    unknown = F.lit(S.UNKNOWN)
    return staged.withColumns(
        {
            "index": F.coalesce("__index", unknown),
            "city": F.coalesce(F.when(city_state, F.col("__state")), F.col("__city"), unknown),
            "state": F.coalesce("__state", unknown),
            "country": F.coalesce("__country", unknown),
            "address": F.coalesce(F.when(~F.coalesce("__open_end", F.lit(False)), F.col("__address")), unknown),
        }
    ).drop("__all", "__parts", "__open_end", "__found", "__city", *found)


def normalize_city(c: Column, strip_result: bool = False) -> Column:
    """Lower-case, drop parentheses, commas to spaces, collapse spaces, title case; null gives ''.

    A space left by a removed parenthesis stays unless ``strip_result`` is set.
    """
    name = F.regexp_replace(F.lower(strip(c)), r"\([^\n)]*\)", "")
    name = F.regexp_replace(F.replace(name, F.lit(","), F.lit(" ")), f"{SPACE}+", " ")
    name = strip(name) if strip_result else name
    return title_case(F.coalesce(name, F.lit("")))
