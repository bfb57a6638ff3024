import re

import pytest
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions import levels, places, skills, text, titles
from vakanta.functions.dates import is_unread, posting_date


def test_location_text(values):
    given = [
        None, '"  Köln "', '{"ort":"Köln","plz":"50667","land":"Deutschland"}', '{"plz":"50667","ort":null,"region":""}',
        '[{"ort":"A"},{"ort":"B"}]', "[]", "12", "true", '["x, y"]', "null",
    ]
    expected = ["", "Köln", "50667, Köln, Deutschland", "50667, ", "A", "", "12", "True", "x, y", ""]
    assert values(given, lambda c: places.location_text(F.parse_json(c))) == expected


U = "Unknown"


@pytest.mark.parametrize(
    ("location", "fields"),
    [
        ("", (U, U, U, U, U)),
        ("null", (U, U, U, U, U)),
        (None, (U, U, U, U, U)),
        ("80331, München, Bayern, Deutschland, Marienplatz 1", ("80331", "München", "Bayern", "Deutschland", "Marienplatz 1")),
        ("10115, Berlin, Mitte, Berlin, Deutschland", ("10115", "Berlin", "Berlin", "Deutschland", U)),
        ("27568, Bremerhaven, Bremen, Deutschland", ("27568", "Bremen", "Bremen", "Deutschland", U)),
        ("Zeil 5, Frankfurt, null", (U, "Frankfurt", U, U, U)),
        ("Musterweg, Köln", (U, "Köln", U, U, "Musterweg")),
        ("80331, 80333, Bayern", ("80331", "80333", "Bayern", U, U)),
        ("Deutschland", (U, U, U, "Deutschland", U)),
    ],
)
def test_location_fields(spark, location, fields):
    df = places.with_location_fields(spark.createDataFrame([(location,)], "location string"))
    assert tuple(df.select(*places.LOCATION_FIELDS).first()) == fields


def test_normalize_city(values):
    given = ["Berlin (DE)", " frankfurt-höchst ", "Halle, Saale", None, "o'hara"]
    assert values(given, places.normalize_city) == ["Berlin ", "Frankfurt-Höchst", "Halle Saale", "", "O'Hara"]
    assert values(given[:1], lambda c: places.normalize_city(c, strip_result=True)) == ["Berlin"]


def test_level_from_title(values):
    given = [
        "International Sales Manager", "Senior Associate", "Teamleiter Vertrieb", "Projektleiter IT", "Sales Israel",
        "Data Analyst", " ", None,
    ]
    expected = ["Junior", "Junior", "Lead", "Senior", "Senior", None, None, None]
    assert values(given, levels.level_from_title) == expected


TEXTS = {
    "Senior Manager, junior team": "junior",
    "Durchführung von Projekten": "lead",
    "Verantwortung für Budget": "lead",
    "Mehrjährige Erfahrung im Vertrieb": "senior",
    "Ausbildung im Büro": "junior",
    "Erste Erfahrungen mit Prozessen": "mid",
    "Teamfähigkeit und Ausbildung": "lead",
    "hello": "mid",
    "  ": "mid",
}


def test_semantic_level(spark):
    df = spark.createDataFrame([(t, t.lower()) for t in TEXTS], "t string, lc string")
    assert {r["t"]: r["semantic_level"] for r in levels.with_semantic_level(df, "lc").collect()} == TEXTS


def test_last_and_highest_match(values):
    given = ["senior manager, junior team", "hello"]
    assert values(given, levels.level_by_last_match) == ["lead", None]
    assert values(given, levels.level_by_highest_match) == ["Lead", None]
    assert values(given, levels.level_by_first_match) == ["junior", None]


def test_level_names(values):
    given = ["entry", " Middle ", "EXPERTE", "principal", "x", "", None]
    assert values(given, levels.normalize_level_name) == ["Junior", "Mid", "Senior", "Lead", "", "", ""]
    assert values(["Junior", "Mid", "Senior", "Lead", "?"], levels.level_class) == [
        "entry", "entry", "advanced", "advanced", "advanced",
    ]


def test_skill_strings(values):
    given = ["python, spark und no sql; teamarbeit", "pysql sqlä", "power bi, low-code"]
    assert values(given, skills.skill_string) == ["NoSQL, Python, SQL, Spark", "", "Low-Code, Power BI"]
    assert values(given[:1], lambda c: skills.skill_string(c, S.SOFT_SKILLS)) == ["Teamwork"]


@pytest.mark.parametrize("dictionary", [S.HARD_SKILLS, S.SOFT_SKILLS])
def test_fragments_never_hide_a_match(dictionary):
    """Every spelling an expression accepts contains one of the label's fragments."""
    samples = (
        "python tensorflow pytorch torch scikit-learn scikitlearn keras mlops azure aws gcp kubernetes k8s docker sql "
        "no sql nosql spark nlp llm large language model uipath automation anywhere blue prism rpa process mining celonis "
        "bpmn six sigma lean jira confluence scrum kanban excel power bi powerbi sap agile change management "
        "digitalisierung strategie consulting low-code lowcode no-code nocode make.com n8n communication kommunikation "
        "teamwork teamarbeit leadership führung fuehrung problem-solving problemsolving problemlösung ownership "
        "verantwortung stakeholder collaboration zusammenarbeit analytical analytisch self-organized selforganized "
        "selbstständig"
    )
    for pattern, label in dictionary:
        hits = [m.group() for m in re.finditer(pattern, samples)]
        assert hits, pattern
        literals = text.required_literals(pattern)
        assert literals and all(any(f in h for f in literals) for h in hits), label


def test_own_dictionaries_with_known_labels(values):
    """The guard belongs to the expression: a known label with another expression finds what that one says."""
    given = ["we use py3 and profi work"]
    assert values(given, lambda c: skills.skill_string(c, [(r"\bpy3\b", "Python")])) == ["Python"]
    assert values(given, lambda c: levels.level_by_first_match(c, [(r"\bprofi\b", "Senior")])) == ["senior"]
    assert values(given, lambda c: levels.level_by_highest_match(c, [(r"\bp\w*\b", "Lead")])) == ["Lead"]


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"\bpython\b", ["python"]), (r"\b(kubernetes|k8s)\b", ["ubernetes", "8s"]), (r"\bno ?sql\b", ["sql"]),
        (r"(abc)?x+\d", None), (r"abc|\w+", None), (r"(?:ab)+cde", ["cde"]), (r"[ab]cd?", None), ("(*x", None), (r"make\.com", ["make.com"]),
    ],
)
def test_required_literals(pattern, literals):
    assert text.required_literals(pattern) == literals


@pytest.mark.parametrize(("pattern", "literals"), [(r"(?i)\bPower BI\b", None), (r"(?i:SQL)", None), (r"(?i:SQL) server", [" server"]), (r"(?s)abc.", ["abc"])])
def test_required_literals_of_expressions_that_ignore_case(values, pattern, literals):
    assert text.required_literals(pattern) == literals
    assert values(["we use power bi and sql server abc.", "none"], lambda c: text.matches(c, pattern)) == [True, False]


def test_own_dictionaries_that_ignore_case(values):
    given = ["sql and power bi for a profi"]
    assert values(given, lambda c: skills.skill_string(c, [(r"(?i)\bPower BI\b", "BI"), (r"(?i:SQL)", "SQL")])) == ["BI, SQL"]
    assert values(given, lambda c: levels.level_by_first_match(c, [(r"(?i)\bPROFI\b", "Senior")])) == ["senior"]


def test_own_keyword_lists(values):
    given = ["chef de cuisine", "apprenti", "boss"]
    found = values(given, lambda c: levels.level_from_title(c, ["apprenti"], ["chef", "boss"], ["boss"]))
    assert found == ["Senior", "Junior", "Lead"]
    assert values(["ENTRY", "x1"], lambda c: levels.normalize_level_name(c, {"Low": ["x1"]})) == ["", "Low"]
    assert values(["Low", "High"], lambda c: levels.level_class(c, {"Low": "entry"})) == ["entry", "advanced"]


def test_own_signals_and_places(spark):
    df = spark.createDataFrame([("alpha beta beta",), ("gamma training",)], "t string")
    scores = {"lead": {"alpha": 1}, "senior": {"beta": 9}, "mid": {}, "junior": {"gamma": 1}}
    rows = levels.with_semantic_level(df, "t", patterns=[("zzz", "Lead")], signals=scores, boosts=[(["beta"], {"lead": 20})], training=("training", 5), keep_scores=True)
    assert [(r["semantic_level"], r["score_lead"], r["score_junior"]) for r in rows.collect()] == [("lead", 21, 0), ("junior", 0, 6)]
    place = spark.createDataFrame([("1010, Wien, Graben 3 Hof, Österreich",)], "location string")
    found = places.with_location_fields(place, states=["wien"], city_states=["wien"], country="österreich", suffixes=["hof"]).first()
    assert (found["city"], found["state"], found["country"], found["address"]) == ("Wien", "Wien", "Österreich", "Graben 3 Hof")


def test_nested_location_lists(spark):
    given = ['[["Köln"]]', '[[{"ort":"Bonn"}], "x"]', "[[]]", '[[[[" A "]]]]', "[null]", "5", "[" * 30 + '"deep"' + "]" * 30, '"[[x"']
    df = spark.createDataFrame(list(enumerate(given)), "i int, j string").selectExpr("i", "parse_json(j) as v")
    found = df.select("i", places.location_text(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == ["Köln", "Bonn", "", "A", "", "5", "deep", "[[x"]


def test_month_names(values):
    given = ["15. Januar 2025", "March 3, 2025", "3 Mär 2025", "Mon, 03 Feb 2025 10:00:00 Z", "1st of May 2024", "5 Foo 2025", "Dezember 2025"]
    expected = ["2025-01-15", "2025-03-03", None, "2025-02-03", "2024-05-01", None, None]
    assert values(given, lambda c: posting_date(c).cast("string")) == expected
    assert values(["x", " ", None, "2025-01-01"], is_unread) == [True, False, False, False]


def test_clean_title(values):
    given = ["Senior Data Engineer (m/w/d) – Remote", None, "Größe (x) jr. home  office"]
    assert values(given, titles.clean_title) == ["data engineer", "", "größe"]


def test_words(values):
    assert values(["Power BI, SQL, Low-Code, n8n"], text.words) == [["power", "sql", "low", "code", "n8n"]]


def test_page_key(values):
    assert values(["10000-12_A/b"], titles.page_key) == ["10000-12_A_b.html"]


def test_posting_date(values):
    given = ["2025-01-15T23:30:00+02:00", "2025-02-30", "15.01.2025", "05.01.2025", "20250115", "x", None]
    expected = ["2025-01-15", None, "2025-01-15", "2025-05-01", "2025-01-15", None, None]
    assert values(given, lambda c: posting_date(c).cast("string")) == expected


def test_marks_and_borders_follow_unicode(values):
    """A combining mark ends a word; an umlaut does not."""
    assert values(["sqlä", "sql̈ x"], lambda c: text.matches(c, r"\bsql\b")) == [False, True]
