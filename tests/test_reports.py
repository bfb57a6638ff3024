import datetime as dt

from pyspark.sql import functions as F

from vakanta.operators import geography, reports, selection, words
from vakanta.plans.analytics import geo_reports
from vakanta.sources import tables


def test_level_shares(spark):
    df = spark.createDataFrame([(" Entry",), ("entry",), (None,), ("ADVANCED",)], "experience_level string")
    got = [tuple(r) for r in reports.experience_distribution(df).collect()]
    assert got == [("entry", 2, 50.0), ("advanced", 1, 25.0), ("unknown", 1, 25.0)]
    assert reports.experience_distribution(df.select(F.lit(1).alias("x"))).first()["experience_level"] == "unknown"


def test_recent_window(spark):
    days = ["2024-12-31", "2024-12-30", None, "2026-01-05"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("posted_date"))
    kept = {r[0] for r in selection.recent(df, "2025-12-31").collect()}
    assert kept == {dt.date(2024, 12, 31), dt.date(2026, 1, 5)}


def test_first_wins(spark):
    rows = [("A", "x", None, 2, "second"), ("a", "X", "", 1, "first"), ("b", "x", "", 3, "other")]
    df = spark.createDataFrame(rows, "t string, c string, l string, term_rank int, name string")
    assert {r["name"] for r in selection.first_wins(df, ["t", "c", "l"], ["term_rank"]).collect()} == {"first", "other"}


def test_first_wins_trims_each_key_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), "id")
    plan = selection.first_wins(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_months_without_vacancies_are_absent(spark):
    df = spark.createDataFrame([("2025-01-10", "entry"), ("2025-03-01", "entry"), ("x", "entry")], "posted_date string, experience_level string")
    got = [(str(r["month"]), r["line"], r["vacancies"]) for r in reports.monthly_dynamics(df).collect()]
    assert got == [("2025-01-01", "all", 1), ("2025-03-01", "all", 1), ("2025-01-01", "level: entry", 1), ("2025-03-01", "level: entry", 1)]


def test_word_comparison(spark):
    rows = [("entry", "SQL, SQL"), ("advanced", "SQL"), ("advanced", "Rust"), ("other", "Perl")]
    df = spark.createDataFrame(rows, "experience_level string, hard_skills string")
    got = [tuple(r) for r in words.repeated_words(df).orderBy("position", F.desc("level")).collect()]
    assert [g[:5] for g in got] == [
        (1, "sql", "entry", 2, 3), (1, "sql", "advanced", 1, 3), (2, "rust", "entry", 0, 1), (2, "rust", "advanced", 1, 1),
    ]
    assert words.repeated_words(df.where("false")).count() == 0


def test_city_variants_stay_apart_unless_merged(spark):
    df = spark.createDataFrame([("berlin", "entry")] * 2 + [("Berlin", "Entry"), (None, "entry")], "city string, experience_level string")
    cache = spark.createDataFrame([("Berlin", 52.5, 13.4)], "City string, Latitude double, Longitude double")
    got = geography.with_coordinates(geography.city_stats(df), cache).collect()
    assert sorted((r["City"], r["Vacancies"]) for r in got) == [("Berlin", 1), ("Berlin", 2)]
    assert geography.city_stats(df, merge_variants=True).first()["Vacancies"] == 3
    assert sum(r["Vacancies"] for r in geography.city_stats(df, "ENTRY").collect()) == 3


def test_geo_reports(spark):
    df = spark.createDataFrame([("Köln", "entry"), ("Ulm", "advanced")], "city string, experience_level string")
    cache = spark.createDataFrame([("köln", 50.9, 7.0)], "City string, Latitude double, Longitude double")
    found = geo_reports(df, cache)
    assert {(r["scope"], r["City"]) for r in found["city_coordinates"].collect()} == {("all", "Köln"), ("entry", "Köln")}
    assert [r[0] for r in found["cities_without_coordinates"].collect()] == ["Ulm"]
    assert tuple(found["geo_coverage"].first()) == (2, 1, 1)


def test_cache_update(spark):
    schema = "City string, Latitude double, Longitude double"
    cache = spark.createDataFrame([("Köln", 1.0, 2.0), ("KÖLN", 9.0, 9.0), ("Ulm", None, 1.0)], schema)
    found = spark.createDataFrame([("Köln", 5.0, 5.0), ("Bonn", 3.0, 4.0), ("Null", 0.0, 4.0)], schema)
    got = {tuple(r) for r in geography.updated_cache(tables.as_geocache(cache), found).collect()}
    assert got == {("Köln", 1.0, 2.0), ("Bonn", 3.0, 4.0)}


def test_reports_read_only_their_columns(spark, tmp_path):
    df = spark.range(10).selectExpr("'entry' as experience_level", "'x' as description", "date'2025-01-01' as posted_date")
    df.write.parquet(str(tmp_path / "v"))
    table = tables.read_vacancies(spark, str(tmp_path / "v"))
    plan = reports.experience_distribution(table)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<experience_level:string>" in plan
    pushed = selection.recent(spark.read.parquet(str(tmp_path / "v")), "2025-06-01")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(posted_date" in pushed
