"""Dictionary tables against running every expression on every text."""

import random
import re

import pytest

from vakanta import settings as S
from vakanta.functions import skills
from vakanta.functions.anchors import Anchor, anchors
from vakanta.operators.dictionary import candidates, dictionary_tags, inverted
from pyspark.sql import functions as F

CASES = [
    (r"\bpower bi\b", [Anchor("power bi", False)]),
    (r"\bder\b|\bdie\b", [Anchor("der", False), Anchor("die", False)]),
    (r"\b(of|von) ?the\b", [Anchor("of the", False), Anchor("ofthe", False), Anchor("von the", False), Anchor("vonthe", False)]),
    (r"sql", [Anchor("sql", True)]),
    (r"\bprozess", [Anchor("prozess", True)]),
    (r"\bno\s?sql\b", [Anchor("no sql", False), Anchor("nosql", False)]),
    (r"\bno\s+sql\b", [Anchor("no", False)]),
    (r"c\+\+", [Anchor("c", True)]),
    (r"\bc\+\+", [Anchor("c", False)]),
    (r"\bmake\.com\b", [Anchor("make com", False)]),
    (r"\ba b c d\b", [Anchor("b c d", False)]),
    (r"\w+ing\b", [Anchor("ing", True)]),
    (r"(?i)sql", None),
    (r"[0-9]+", None),
    (r"a*", None),
    (r"\p{L}x", None),
    (r"(?:a|b|c|d)(?:a|b|c|d)(?:a|b|c|d)(?:a|b|c|d)", None),
    (r"\b(?:x|[0-9])\b", None),
    (r"^senior\b", [Anchor("senior", False)]),
    (r"foo(?!bar)baz", [Anchor("foobaz", True)]),
]


@pytest.mark.parametrize(("pattern", "want"), CASES)
def test_anchors(pattern, want):
    assert anchors(pattern) == want


def test_every_match_has_an_anchor():
    """Random texts and expressions: a text that matches holds an anchor."""
    chance = random.Random(2)
    atoms = [r"\b", "a", "b", "ab", " ", "-", "(?:a|bb)", "b?", "a+", "[ab]", r"\w", ".", "(?:b a)?", "é", "_"]
    for _ in range(4000):
        pattern = "".join(chance.choice(atoms) for _ in range(chance.randint(1, 6)))
        found = anchors(pattern)
        for _ in range(5):
            text = "".join(chance.choice("ab é_- ") for _ in range(chance.randint(0, 12)))
            if found is not None and re.search(pattern, text):
                words = re.findall(r"\w+", text)
                runs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words))}
                assert any(any(a.text in w for w in words) if a.part else a.text in runs for a in found), (pattern, text, found)


def test_default_dictionary_gives_the_same_tags(spark):
    texts = [
        "Python, Spark und No SQL; Teamarbeit", "POWER BI, power-bi, powerbi", "pysql sql-server", "", None, "make.com n8n", "ßcrum scrum", "make.com n8n",
        "Change Management, change  management", "python " * 5000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    for dictionary in (S.HARD_SKILLS, S.SOFT_SKILLS):
        table = spark.createDataFrame([*dictionary, (None, "x"), ("x", None), dictionary[0]], "pattern string, label string")
        found = {r["k"]: r["tags"] for r in dictionary_tags(docs, "text", table, ["k"]).collect()}
        want = docs.select("k", skills.skill_string(F.lower(F.coalesce("text", F.lit(""))), dictionary).alias("tags"))
        assert found == {r["k"]: r["tags"] for r in want.collect()}


def test_dictionary_without_rows_and_entries_without_words(spark):
    docs = spark.createDataFrame([(1, "Room 12"), (1, "Room 12"), (2, None), (None, "x")], "k int, text string")
    none = spark.createDataFrame([], "pattern string, label string")
    assert sorted(r["tags"] for r in dictionary_tags(docs, "text", none, ["k"]).collect()) == [""] * 4
    rest = spark.createDataFrame([("[0-9]+", "number"), ("(?i)ROOM", "room"), ("^$", "empty")], "pattern string, label string")
    assert sorted((str(r["k"]), r["tags"]) for r in dictionary_tags(docs, "text", rest, ["k"]).collect()) == [
        ("1", "number, room"), ("1", "number, room"), ("2", "empty"), ("None", ""),
    ]
    assert dictionary_tags(docs.limit(0), "text", rest, ["k"]).count() == 0


def test_cost_follows_hits(spark):
    """Ten thousand entries call for as many candidates as texts have their words, and no more."""
    table = spark.range(10_000).selectExpr(r"concat('\\bitem', id, ' sold\\b') as pattern", "concat('L', id) as label")
    docs = spark.createDataFrame([(i, f"an item{i} sold and item{i + 1} kept".encode()) for i in range(50)], "k int, text binary")
    texts = docs.selectExpr("unhex(md5(text)) as id", "cast(text as string) as lowered")
    entries, filed = inverted(table)
    assert candidates(texts, filed).count() == 50 and entries.where("not anchored").count() == 0
    found = dictionary_tags(docs.selectExpr("k", "cast(text as string) as text"), "text", table, ["k"]).collect()
    assert all(r["tags"] == f"L{r['k']}" for r in found) and len(found) == 50
