"""Experience levels from titles and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import contains_any, is_blank, matches, strip

def _first_match(lowered: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern, in the order given, that matches."""
    chain = None
    for pattern, label in patterns:
        hit = matches(lowered, pattern)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain


def level_by_first_match(lowered: Column, patterns=S.LEVEL_PATTERNS) -> Column:
    return F.lower(_first_match(lowered, patterns))


def level_by_last_match(lowered: Column, patterns=S.LEVEL_PATTERNS) -> Column:
    return F.lower(_first_match(lowered, patterns[::-1]))


def level_by_highest_match(lowered: Column, patterns=S.LEVEL_PATTERNS, order=S.LEVEL_ORDER) -> Column:
    return _first_match(lowered, sorted(patterns, key=lambda p: -order.index(p[1])))


def level_from_title(
    title: Column,
    entry: list[str] = S.TITLE_ENTRY_KEYWORDS,
    advanced: list[str] = S.TITLE_ADVANCED_KEYWORDS,
    lead: list[str] = S.TITLE_LEAD_KEYWORDS,
) -> Column:
    """Junior on any entry keyword; else Lead or Senior on an advanced one; else null."""
    t = F.lower(title)
    return (
        F.when(contains_any(t, entry), "Junior")
        .when(contains_any(t, advanced), F.when(contains_any(t, lead), "Lead").otherwise("Senior"))
    )


def normalize_level_name(c: Column, names: dict[str, list[str]] = S.LEVEL_ALIASES) -> Column:
    name = F.lower(strip(c))
    chain = F
    for level, aliases in names.items():
        chain = chain.when(name.isin(aliases), F.lit(level))
    return chain.otherwise(F.lit(""))


def level_class(level: Column, classes: dict[str, str] = S.LEVEL_CLASSES) -> Column:
    """entry or advanced; advanced where the level is none of the known ones."""
    entry = [name for name, group in classes.items() if group == "entry"]
    return F.when(level.isin(entry), "entry").otherwise("advanced")


def level_label(c: Column) -> Column:
    """Label used by the reports: lower case, stripped, 'unknown' for null."""
    return F.lower(strip(F.coalesce(c, F.lit("unknown"))))


def _points(lowered: Column, keywords: dict[str, int]) -> Column:
    return reduce(
        lambda total, kw: total + F.when(F.contains(lowered, F.lit(kw[0])), kw[1]).otherwise(0),
        keywords.items(),
        F.lit(0),
    )


def with_semantic_level(
    df: DataFrame,
    lowered: str,
    out: str = "semantic_level",
    wanted: Column | None = None,
    keep_scores: bool = False,
    patterns: list[tuple[str, str]] = S.LEVEL_PATTERNS,
    signals: dict[str, dict[str, int]] = S.LEVEL_SIGNALS,
    boosts: list[tuple[list[str], dict[str, int]]] = S.LEVEL_BOOSTS,
    training: tuple[str, int] = (S.TRAINING_WORD, S.TRAINING_BOOST),
) -> DataFrame:
    """Level of a lower-cased text: first matching expression, else the highest weighted keyword score.

    Scores are columns of their own so that each text is scanned once. Rows where ``wanted`` is false are
    not scored and get null. ``signals`` has the four levels, in the order that decides equal scores; ``training`` adds
    its points to junior where lead and senior have none.
    """
    text = F.col(lowered)
    need = F.lit(True) if wanted is None else wanted
    scores = {level: f"score_{level}" for level in signals}

    points = {level: _points(text, keywords) for level, keywords in signals.items()}
    for phrases, extra in boosts:
        hit = contains_any(text, phrases)
        for level, amount in extra.items():
            points[level] = points[level] + F.when(hit, amount).otherwise(0)
    staged = df.withColumn("__need", F.coalesce(need, F.lit(False))).withColumns(
        {name: F.when(F.col("__need"), points[level]) for level, name in scores.items()}
    )
    untrained = (F.col(scores["lead"]) == 0) & (F.col(scores["senior"]) == 0)
    boost = F.when(F.contains(text, F.lit(training[0])) & untrained, training[1]).otherwise(0)
    staged = staged.withColumn(scores["junior"], F.col(scores["junior"]) + boost)

    best = F.greatest(*scores.values())
    strongest = F.when(best == 0, F.lit("mid"))
    for level, name in scores.items():
        strongest = strongest.when(F.col(name) == best, F.lit(level))
    chain = F.coalesce(F.when(is_blank(text), F.lit("mid")), level_by_first_match(text, patterns), strongest)
    staged = staged.withColumn(out, F.when(F.col("__need"), chain)).drop("__need")
    return staged if keep_scores else staged.drop(*scores.values())
