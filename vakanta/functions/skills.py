"""Skill tags of a text by a dictionary of expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import matches, strip

def _hits(lowered: Column, dictionary: list[tuple[str, str]]) -> list[Column]:
    """One nullable label per distinct label, in code-point order."""
    by_label: dict[str, Column] = {}
    for pattern, label in dictionary:
        hit = matches(lowered, pattern)
        by_label[label] = by_label[label] | hit if label in by_label else hit
    return [F.when(by_label[label], F.lit(label)) for label in sorted(by_label)]


def skill_string(lowered: Column, dictionary=S.HARD_SKILLS) -> Column:
    """Sorted distinct labels joined by ', '; '' if none. The text must be lower-cased."""
    return F.concat_ws(", ", *_hits(lowered, dictionary))


def skill_array(lowered: Column, dictionary=S.HARD_SKILLS) -> Column:
    return F.array_compact(F.array(*_hits(lowered, dictionary)))


def skill_list(c: Column, min_length: int = 1) -> Column:
    """Split a joined skill string; parts shorter than ``min_length`` are dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: F.length(s) >= min_length)
