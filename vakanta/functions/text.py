"""Unicode text helpers.

Java's ``\\w``, ``\\b``, ``\\s`` and ``\\d`` differ from the Unicode meaning needed here (letters, numbers and
underscore; combining marks are not word characters), so every pattern is written with explicit classes.
"""

from __future__ import annotations

import re
from re import _parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD = f"[{_WORD}]"
SPACE = f"[{_SPACE}]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def unicode_regex(pattern: str) -> str:
    """Spell out ``\\b \\w \\s \\d`` of a dictionary pattern as explicit Unicode classes."""
    inside = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i + 1]
            if esc == "b" and not in_class:
                out.append(BOUNDARY)
            elif esc in inside:
                out.append(inside[esc] if in_class else f"[{inside[esc]}]")
            else:
                out.append(ch + esc)
            i += 2
            continue
        if ch in "[]":
            in_class = ch == "["
        out.append(ch)
        i += 1
    return "".join(out)


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` removes plain spaces only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def strip_colons(c: Column) -> Column:
    return F.regexp_replace(c, r":+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{_SPACE}]")


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else null."""
    return F.coalesce(*[filled(c) for c in cols])


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, so ``frankfurt-höchst`` gives ``Frankfurt-Höchst``."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def words(c: Column, min_length: int = 3) -> Column:
    """All runs of at least ``min_length`` word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}{{{min_length},}}"), F.lit(0))


def contains_any(c: Column, fragments: list[str]) -> Column:
    hit = F.lit(False)
    for i, fragment in enumerate(fragments):
        hit = F.contains(c, F.lit(fragment)) if i == 0 else hit | F.contains(c, F.lit(fragment))
    return hit


def required_literals(pattern: str, least: int = 2) -> list[str] | None:
    """Literals one of which every match of the expression contains, read off the expression; null if none can be told.

    A run of plain characters is required; a group requires what it holds; alternatives require one of all theirs. Of
    several such sets that with the longest shortest member is taken. Where case is ignored (in all or in a group), nothing is required.
    """

    def of(tree) -> list[str] | None:
        sets, run = [], ""
        for kind, value in [*tree, (None, None)]:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
                continue
            if run:
                sets.append([run])
                run = ""
            if name == "SUBPATTERN":
                sets.append(None if value[1] & re.IGNORECASE else of(value[-1]))
            elif name == "BRANCH":
                branches = [of(branch) for branch in value[1]]
                sets.append(None if None in branches else [x for branch in branches for x in branch])
            elif name.endswith("_REPEAT") and value[0] > 0:
                sets.append(of(value[2]))
        usable = [found for found in sets if found and min(map(len, found)) >= least]
        return max(usable, key=lambda found: min(map(len, found)), default=None)

    try:
        tree = sre.parse(pattern)
        return None if tree.state.flags & re.IGNORECASE else of(tree)
    except re.error:  # an expression only the other engine reads
        return None


def matches(lowered: Column, pattern: str) -> Column:
    """Does the lower-cased text match?

    A substring scan for the literals that the expression requires costs far less and rules out nearly all texts before
    the expression runs.
    """
    found = lowered.rlike(unicode_regex(pattern))
    literals = required_literals(pattern)
    return contains_any(lowered, literals) & found if literals else found
