"""What every match of an expression must contain: whole words in sequence, or a part of a word.

Words are runs of letters, numbers and underscores in a lower-cased text. An expression is spelt out as the sequences it may
match: known characters, word borders, and gaps where anything may stand. In each a word that begins and ends at a border or
another character is whole; one that touches a gap, or an end without border, is open there.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import product
from re import _parser as sre

BORDER = object()
GAP = object()
MOST_VARIANTS = 64
MOST_WORDS = 3


@dataclass(frozen=True, order=True)
class Anchor:
    """Consecutive whole words joined by blanks, or, if ``part``, a piece of one word."""

    text: str
    part: bool


class _Unreadable(Exception):
    """Nothing can be told of the expression."""


def is_word(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def _variants(tree) -> list[list]:
    out: list[list] = [[]]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            step = [[chr(value)]]
        elif name == "AT":
            step = [[GAP if "NON_BOUNDARY" in str(value) else BORDER]]
        elif name == "SUBPATTERN":
            if value[1] & re.IGNORECASE:
                raise _Unreadable
            step = _variants(value[-1])
        elif name == "ATOMIC_GROUP":
            step = _variants(value)
        elif name == "BRANCH":
            step = [v for branch in value[1] for v in _variants(branch)]
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            step = [[chr(v)] for _, v in value]
        elif name == "IN" and all(str(v) == "CATEGORY_SPACE" for _, v in value):
            step = [[" "]]  # whichever it is, no part of a word
        elif name.endswith("_REPEAT"):
            least, most, inner = value
            once = _variants(inner) if least or most == 1 else []
            step = ([] if least else [[]]) + once if most == 1 else [[*v, GAP] for v in once] if least else [[GAP]]
        elif name in ("ASSERT", "ASSERT_NOT"):
            step = [[]]
        else:
            step = [[GAP]]
        if len(out) * len(step) > MOST_VARIANTS:
            raise _Unreadable
        out = [a + b for a, b in product(out, step)]
    return out


def _runs(items: list) -> list[list[tuple[str, bool, bool]]]:
    """Runs of words with nothing unknown between them: (word, open on the left, open on the right)."""
    runs, words, word, left = [], [], "", True
    for item in [*items, GAP]:
        if isinstance(item, str) and is_word(item):
            word += item
            continue
        if word:
            words.append((word, left, item is GAP))
            word = ""
        left = item is GAP
        if item is GAP:
            runs.append(words)
            words = []
    return runs


def _anchor(items: list) -> Anchor | None:
    whole, parts = [], []
    for words in _runs(items):
        for i in range(len(words)):
            if words[i][1] or words[i][2]:
                parts.append(words[i][0])
                continue
            for j in range(i, min(i + MOST_WORDS, len(words))):
                if words[j][1] or words[j][2]:
                    break
                whole.append([w for w, _, _ in words[i : j + 1]])
    if whole:
        return Anchor(" ".join(max(whole, key=lambda ws: (len(ws), sum(map(len, ws)), ws))), False)
    return Anchor(max(parts, key=lambda p: (len(p), p)), True) if parts else None


def anchors(pattern: str) -> list[Anchor] | None:
    """One anchor for each sequence that the expression may match, so that a text with a match has one of them.

    None where a sequence has no word, case is ignored, or only another engine reads the expression.
    """
    try:
        tree = sre.parse(pattern)
        if tree.state.flags & re.IGNORECASE:
            return None
        found = [_anchor(v) for v in _variants(tree)]
    except (re.error, _Unreadable, OverflowError, RecursionError):
        return None
    return None if None in found else sorted(set(found))
