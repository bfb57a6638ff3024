"""Job titles: page key, job link, cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import filled, strip, unicode_regex


def page_key(c: Column) -> Column:
    """File-safe key of a reference number or a link."""
    return F.concat(F.regexp_replace(c, r"[^A-Za-z0-9\-]", "_"), F.lit(".html"))


def job_url(refnr: Column, prefix: str = S.JOB_URL_PREFIX) -> Column:
    return F.coalesce(F.concat(F.lit(prefix), filled(refnr)), F.lit(""))


def clean_title(c: Column, noise: list[str] = S.TITLE_NOISE) -> Column:
    """Title in lower case without noise words, parentheses and punctuation; null gives ''."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for pattern in [*noise, r"\([^)]*\)", r"[^\w\s]", r"\s+"]:
        out = F.regexp_replace(out, unicode_regex(pattern), " ")
    return strip(out)
