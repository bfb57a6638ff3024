import json

import pytest
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.plans import etl
from vakanta.operators.pages import one_per_key, page_sections, parse_pages
from vakanta.plans.analytics import compact_table, geo_reports, market_reports, of_set, run_analytics
from vakanta.sources import landing, sinks, stored_pages, tables
from vakanta.streaming.landing import stage_stream, stream_items

AS_OF, NOW = "2025-12-31", "2025-12-31 10:00:00"


def item(n, **more):
    base = {
        "refnr": f"10000-{n}_S/x", "titel": f"Junior Analyst {n}", "beruf": "Analyst", "arbeitgeber": "Firma",
        "arbeitsort": {"plz": "50667", "ort": "Köln", "land": "Deutschland"}, "aktuelleVeroeffentlichungsdatum": "2025-12-01",
    }
    return {**base, **more}


def land(root, term, page, envelope):
    folder = root / f"search_term={term.replace('/', '%2F')}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "result.json").write_text(json.dumps(envelope, ensure_ascii=False, indent=1), encoding="utf-8")


@pytest.fixture
def landed(tmp_path):
    root = tmp_path / "landing"
    land(root, S.SEARCH_TERMS[8], 1, {"stellenangebote": [item(1, arbeitgeber="FIRMA"), item(2), item(3, titel={"x": 1})]})
    land(root, S.SEARCH_TERMS[0], 1, {"stellenangebote": [], "jobs": [item(1), "text", item(4, titel=None, refnr=7)]})
    land(root, S.SEARCH_TERMS[0], 2, {"jobs": [item(5, titel="Head of X", refnr=None, aktuelleVeroeffentlichungsdatum="2024-01-01")]})
    land(root, "Unbekannt", 1, {"jobs": [item(9)]})
    return root


@pytest.fixture
def stored(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    page = "<h2>Ihr Profil</h2>\r\n<p>Python und Teamarbeit</p>".encode() + b"\xff"
    (folder / "10000-1_S_x.html").write_bytes(page)
    return folder


def test_landing_order_and_fallback(spark, landed):
    got = landing.read_landing(spark, str(landed)).orderBy(*etl.INGEST_ORDER).collect()
    assert [(r["term_rank"], r["page"], r["pos"]) for r in got] == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 0), (9, 1, 0), (9, 1, 1), (9, 1, 2)]


def test_whole_job(spark, tmp_path, landed, stored):
    pages = stored_pages.compact_page_files(spark, str(stored), str(tmp_path / "page_table"))
    none = spark.createDataFrame([], S.PAGE_SCHEMA)
    out = etl.run_etl(spark, str(landed), pages, none, str(tmp_path / "out"), AS_OF, NOW)
    rows = spark.read.parquet(out).drop("posted_month")
    got = {r["job_title"]: r for r in rows.collect()}
    assert set(got) == {"Junior Analyst 1", "Junior Analyst 2"}
    first = got["Junior Analyst 1"]
    assert (first["search_term"], first["company"]) == (S.SEARCH_TERMS[0], "Firma")
    assert (first["hard_skills"], first["soft_skills"], first["html_quality"]) == ("Python", "Teamwork", "structured")
    assert (first["experience_level"], first["work_experience"], first["city"]) == ("entry", "Junior", "Köln")
    assert first["description_sections_json"] == '{"Ihr Profil": "Python und Teamarbeit"}'
    rejects = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/rejects")).collect()]
    assert sorted(r["error"] for r in rejects) == ["item is not an object", "refnr is not a string", "titel is not a string"]
    assert {"x": 1} in [r["item"]["titel"] for r in rejects if isinstance(r["item"], dict)]

    exported = etl.exported(rows.withColumnRenamed("description", "description_full"))
    assert exported.columns == ["description" if c == "description_full" else c for c in S.VACANCY_COLUMNS]
    assert [r["job_title"] for r in exported.collect()] == ["Junior Analyst 2", "Junior Analyst 1"]

    written = run_analytics(spark, out, str(tmp_path / "no_cache.csv"), str(tmp_path / "reports"))
    assert spark.read.parquet(written["experience_distribution"]).first()["vacancies"] == 2
    assert spark.read.parquet(written["title_cluster_groups"]).where("status = 'insufficient data'").count() == 2  # one per term


def test_unreadable_files_and_pages_are_rejects(spark, tmp_path, landed, stored):
    folder = landed / f"search_term={S.SEARCH_TERMS[0]}" / "page=3"
    folder.mkdir()
    (folder / "result.json").write_text('{"jobs": [{"titel": "cut', encoding="utf-8")
    bad_page = "<![x y]><p>lost</p>"
    rows = [("10000-1_S_x.html", bad_page), ("10000-2_S_x.html", "<p>b</p>"), ("10000-2_S_x.html", "<p>a</p>"), ("other.html", "<p>c</p>")]
    pages = spark.createDataFrame(rows, S.PAGE_SCHEMA)
    none = spark.createDataFrame([], S.PAGE_SCHEMA)
    out = etl.run_etl(spark, str(landed), pages, none, str(tmp_path / "out"), AS_OF, NOW)
    got = [(r["job_title"], r["description"]) for r in spark.read.parquet(out).collect()]
    assert got == [("Junior Analyst 2", "a")]  # a key that is stored twice gives one vacancy
    rejects = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/rejects")).collect()]
    by_error = {r["error"]: r["item"] for r in rejects}
    assert by_error["file is not readable JSON"] == '{"jobs": [{"titel": "cut'
    assert by_error["page cannot be read"]["job_title"] == "Junior Analyst 1"
    assert len(rejects) == 5


def test_only_wanted_pages_are_parsed(spark):
    """The semi-join lies below the parser, and the page table is scanned once."""
    pages = spark.range(100).selectExpr("concat(id, '.html') as page_key", "concat('<p>', id, '</p>') as html")
    keys = spark.createDataFrame([("3.html",)], "page_key string")
    plan = parse_pages(one_per_key(pages, keys))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftSemi") and plan.count("MapInArrow") == 1
    got = page_sections(pages, spark.createDataFrame([], S.PAGE_SCHEMA), keys=keys).collect()
    assert [(r["page_key"], r["raw_text"]) for r in got] == [("3.html", "3")]


def test_compact_table_gives_the_same_reports(spark):
    rows = [("entry", "T", "a", "2025-01-02", "Berlin", None, "SQL, Python", "Teamwork"), ("Entry ", "T", "a", "2025-01-09", "Berlin", "B", "SQL", None)] * 3
    rows += [(None, None, None, None, None, None, None, None), ("advanced", "U", "b", "2025-02-01", "Bonn", "N", "SQL", "")]
    names = ["experience_level", "search_term", "job_title", "posted_date", "city", "state", "hard_skills", "soft_skills"]
    df = tables.as_analysis_table(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    compact = compact_table(df).cache()
    for name, report in market_reports(df).items():
        same = market_reports(df, compact)[name]
        assert sorted(map(repr, report.collect())) == sorted(map(repr, same.collect())), name
    cache = spark.createDataFrame([("Berlin", 1.0, 2.0)], S.GEO_SCHEMA)
    from vakanta.operators.reports import with_level_label

    for name, report in geo_reports(with_level_label(df), cache).items():
        same = geo_reports(of_set(compact, "places"), cache)[name]
        assert sorted(map(repr, report.collect())) == sorted(map(repr, same.collect())), name


def test_nothing_is_written_without_vacancies(spark, tmp_path, landed):
    none = spark.createDataFrame([], S.PAGE_SCHEMA)
    assert etl.run_etl(spark, str(landed), none, none, str(tmp_path / "out"), "2030-01-01", NOW) is None
    assert not (tmp_path / "out/vacancies").exists()


def test_stream_of_landed_files_gives_the_same_table(spark, tmp_path, landed):
    query = stage_stream(stream_items(spark, str(landed)), str(tmp_path / "staged"), str(tmp_path / "state"), once=True)
    assert query.awaitTermination(120)
    columns = ["search_term", "page", "pos", "job_title", "reject_reason", "item"]
    streamed = etl.read_staged(spark, str(tmp_path / "staged")).select(columns)
    batch = etl.staged_items(landing.read_landing(spark, str(landed))).select(columns)
    assert streamed.count() == batch.count() == 7
    assert streamed.exceptAll(batch).isEmpty()


def test_page_files(spark, stored):
    row = stored_pages.read_page_files(spark, str(stored)).first()
    assert tuple(row) == ("10000-1_S_x.html", "<h2>Ihr Profil</h2>\n<p>Python und Teamarbeit</p>")


def test_geocache_files(spark, tmp_path):
    assert tables.read_geocache(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "geo.csv").write_text("City,Latitude,Longitude\n köln ,50.9,7.0\nulm,,1.0\nköln,1.0,1.0\n", encoding="utf-8")
    cache = tables.read_geocache(spark, str(tmp_path / "geo.csv"))
    assert [(r["City"], r["Latitude"]) for r in cache.orderBy("cache_row").collect()] == [("Köln", 50.9), ("Köln", 1.0)]
    path = sinks.write_geocache(cache, str(tmp_path / "new.csv"))
    assert [(r["City"], r["Latitude"]) for r in tables.read_geocache(spark, path).collect()] == [("Köln", 50.9)]


def test_empty_strings_become_null_for_reports(spark):
    df = spark.createDataFrame([("", "2025-02-30", "None")], "hard_skills string, posted_date string, description_source string")
    assert tuple(tables.as_analysis_table(df).first()) == (None, None, "None")


def test_semantic_level_of_text_without_title_level(spark):
    rows = spark.createDataFrame([("Analyst", None), ("Analyst", "Führung und Leitung")], "job_title string, raw_text string")
    rows = rows.selectExpr(
        "*", "1 term_rank", "1 page", "1 pos", "'t' search_term", "'' beruf", "'' company", "date'2025-01-01' posted_date",
        "'' location", "'r' refnr", "cast(null as string) salary", "cast(null as string) contract_type",
        "cast(null as string) html_full", "cast(null as string) sections_text",
        "cast(null as array<struct<title:string,text:string>>) sections", "'unstructured' html_quality", "'f' html_filename",
    )
    got = {r["description_full"]: r["experience_level"] for r in etl.describe(rows, NOW).collect()}
    assert got == {"": "entry", "Führung und Leitung": "advanced"}
    assert etl.describe(rows, NOW).select(F.count_distinct("normalized_at")).first()[0] == 1


def test_compacted_landing_reads_like_one_file_per_page(spark, tmp_path):
    texts = {
        (S.SEARCH_TERMS[0], 1): json.dumps({"stellenangebote": [item(1), item(2)], "jobs": [item(3)]}, indent=1),
        (S.SEARCH_TERMS[0], 2): json.dumps({"stellenangebote": [], "jobs": ["tab\there", 7]}),
        (S.SEARCH_TERMS[0], 7): json.dumps({"jobs": [item(4)]})[:-2],
        (S.SEARCH_TERMS[8], 3): json.dumps({"jobs": 5}),
        (S.SEARCH_TERMS[8], 4): "{}",
        (S.SEARCH_TERMS[8], 5): " ",
        (S.SEARCH_TERMS[8], 6): "not JSON\tat all",
        ("Unbekannt", 1): json.dumps({"jobs": [item(9)]}),
    }
    texts |= {(S.SEARCH_TERMS[8], page): json.dumps({"jobs": [item(page)]}) for page in range(100, 300)}
    for (term, page), text in texts.items():
        folder = tmp_path / "files" / f"search_term={term.replace('/', '%2F')}" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "result.json").write_text(text.replace("\n", " "), encoding="utf-8")
    rows = spark.createDataFrame([(*k, v) for k, v in texts.items()], "search_term string, page int, value string")
    path = landing.write_compacted(rows.coalesce(2), str(tmp_path / "compacted"))

    def read(found):
        columns = ["search_term", "term_rank", "page", "pos", F.to_json("item").alias("item"), F.col("file_error").alias("error")]
        return sorted(map(str, found.select(*columns).collect()))

    want = read(landing.read_landing(spark, str(tmp_path / "files"), one_envelope_per_line=True))
    assert read(landing.read_landing(spark, path, compacted=True)) == want
    assert len(list((tmp_path / "compacted").rglob("part-*"))) <= 2 * 3  # files of tasks and terms, not of pages
