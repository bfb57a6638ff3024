import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.operators import html_tree, pages
from vakanta.operators.html_tree import read_page

LINK = f'<a id="{S.EXTERNAL_LINK_ID}" href=" https://p.example/1 ">x</a>'
EXT_KEY = "https___p_example_1.html"

CASES = {
    "h2": (
        "<h2>Ihre Aufgaben:</h2><p>Python</p><ul><li>SQL</li></ul><span>x</span><p>lost</p>",
        "structured", "Ihre Aufgaben::\nPython\nSQL", '{"Ihre Aufgaben:": "Python\\nSQL"}',
    ),
    "strong": (
        "<p><strong>Ihr Profil</strong></p><p>Scrum</p>", "structured", "Ihr Profil:\nScrum", '{"Ihr Profil": "Scrum"}',
    ),
    "colon": (
        "<div>Intro</div><div>Aufgaben:</div><div>A</div><div>Profil:</div><div>B</div>",
        "structured", "Aufgaben:\nA\n\nProfil:\nB", '{"Aufgaben": "A", "Profil": "B"}',
    ),
    "twice": (
        "<h2>Profil</h2><p>A</p><h2>Profil</h2><p>B</p>", "structured", "Profil:\nA\n\nProfil:\nB", '{"Profil": "B"}',
    ),
    "plain": ("<p>just text</p>", "unstructured", None, ""),
    "empty": ("", "empty", None, ""),
    "linked": (LINK + "<h2>Profil</h2><p>A</p>", "external", None, ""),
    "deadlink": (LINK.replace("/1", "/2") + "<h2>Profil</h2><p>A</p>", "structured", "Profil:\nA", '{"Profil": "A"}'),
}


@pytest.fixture(scope="module")
def sections(spark):
    stored = spark.createDataFrame([(f"{k}.html", v[0]) for k, v in CASES.items()], S.PAGE_SCHEMA)
    ext = spark.createDataFrame([(EXT_KEY, "<p>Partner <b>Python</b></p>")], S.PAGE_SCHEMA)
    return pages.page_sections(stored, ext)


@pytest.mark.parametrize("name", CASES)
def test_sections(sections, name):
    _, quality, rendered, json = CASES[name]
    row = sections.where(F.col("page_key") == f"{name}.html").withColumn("json", pages.sections_json(F.col("sections"))).first()
    assert (row["html_quality"], row["sections_text"], row["json"]) == (quality, rendered, json)
    assert row["html_filename"] == (EXT_KEY if name == "linked" else f"{name}.html")
    if name == "linked":
        assert row["raw_text"] == "Partner \nPython"


def test_short_partner_pages_can_be_left_out(spark):
    stored = spark.createDataFrame([("a.html", LINK)], S.PAGE_SCHEMA)
    ext = spark.createDataFrame([(EXT_KEY, "<p>kurz</p>")], S.PAGE_SCHEMA)
    found = pages.page_sections(stored, ext, S.MIN_EXTERNAL_CHARS).first()
    assert (found["html_quality"], found["html_filename"]) == ("unstructured", "a.html")


def test_missing_number_and_missing_page(spark, sections):
    rows = spark.createDataFrame([("h2", 1), (None, 2), ("", 3), ("nope", 4)], "refnr string, i int")
    got = {r["i"]: (r["html_quality"], r["html_filename"]) for r in pages.attach_sections(rows, sections).collect()}
    assert got == {1: ("structured", "h2.html"), 2: ("empty", ""), 3: ("empty", ""), 4: ("empty", "nope.html")}


def read(html):
    return read_page(html, S.EXTERNAL_LINK_ID, S.SECTION_TITLES, set(S.SECTION_BODY_TAGS))


def test_hidden_text_and_unclosed_tags():
    page = read("<!DOCTYPE html><style>p{}</style><script>var t='</p>';</script><!-- c --><p>a<b>b<br>c<p>d &amp; e")
    assert page["raw_text"] == "a\nb\nc\nd & e"


def test_character_data_counts_and_refused_pages_are_marked():
    assert read("<p>a</p><![CDATA[ b <i> ]]><p>c</p>")["raw_text"] == "a\n b <i> \nc"
    assert read("<![x y]><p>a</p>")["refused"] and not read("<p>a</p>")["refused"]


def test_last_text_per_title_keeps_first_places(spark):
    blocks = [("B", "1"), ("A", "2"), ("B", "3"), ("C", "4"), ("A", "5")]
    df = spark.createDataFrame([(blocks,), ([],), (None,)], "b array<struct<title:string,text:string>>")
    got = [r["x"] for r in df.select(pages.last_text_per_title(F.col("b")).alias("x")).collect()]
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[("B", "3"), ("A", "5"), ("C", "4")], [], None]


def test_deeply_nested_page():
    assert read("<div>" * 20000 + "x")["raw_text"] == "x"


def test_link_is_of_the_first_anchor_with_the_id():
    assert read(f'<a id="{S.EXTERNAL_LINK_ID}">x</a>' + LINK)["link"] is None


def test_heading_text_is_joined_without_spaces():
    assert read("<h3>Ihr <b>Profil</b></h3><div>x</div>")["header_blocks"] == [{"title": "IhrProfil", "text": "x"}]


MARKUP = [
    "<p>", "</p>", "<div class=\"a b\" data-z='1'>", "</div>", "<h2>", "</h2>", "<H3 title=\"x>y\">", "</h3>", "<strong>", "</strong>", "<br>", "<br/>",
    "<ul><li>", "</li></ul>", "Profil", "Ihre Aufgaben:", "a & b", "&amp;", "&lt", "&#65", " ", "\n", " < ", "<!-- <p>Profil</p> -->", "<!-->", "<!-- a -- b -->",
    "<!DOCTYPE html>", "<![CDATA[ b <i> ]]>", "<![x y]>", "<script>var t='</p>';</script>", "<script src=\"x\">a<b</script>", "<style>", "<title>t</title>",
    "<textarea> x </textarea>", "<pre>  ", "</pre>", "<template>", "</template>", "<plaintext>", LINK, LINK.upper(), "<a href=x>", "<p class = \"x\">", "<p a=\"b\"c>",
    "<p class='", "\"", "<p", "</ p>", "<é>",
]


def test_plain_markup_is_read_as_the_standard_parser_reads_it(monkeypatch):
    """Random pages, well-formed or not: those read by the standard parser alone are the same. Common markup never reaches it."""
    chance = random.Random(3)
    made = ["".join(chance.choices(MARKUP, k=chance.randint(1, 14))) for _ in range(20_000)]
    found = [read(html) for html in made]
    with monkeypatch.context() as patch:
        patch.setattr(html_tree, "PLAIN", re.compile("(?!)"))
        assert [read(html) for html in made] == found
    seen = []
    monkeypatch.setattr(html_tree.PageReader, "feed", lambda self, text: seen.append(text))
    common = "<html lang=\"de\"><body class='x y'><h2 id=\"t\">Profil</h2><p>A &amp; B<br/>C</p></body></html>"
    assert read(common)["header_blocks"] == [{"title": "Profil", "text": "A & B\nC"}] and not seen


def test_many_titles_are_told_apart_by_sorting(spark):
    """A page of 20000 headings, each title twice: time grows with the sort, not with the square."""
    blocks = [(f"Profil {i % 10_000}", str(i)) for i in range(20_000)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<title:string,text:string>>").repartition(1)
    began = time.monotonic()
    found = df.select(pages.last_text_per_title(F.col("b")).alias("x")).first()["x"]
    assert [tuple(x) for x in found] == [(f"Profil {i}", str(i + 10_000)) for i in range(10_000)]
    assert time.monotonic() - began < 60
