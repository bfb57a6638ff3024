"""Page tables in buckets: one row per key, and joins that move keys alone."""

import re

from vakanta.operators import pages
from vakanta.sources import stored_pages

ROWS = [(f"k{i % 40}", f"<p>{'x' * (i % 7)}{i}</p>") for i in range(200)] + [("k1", ""), ("k2", None), (None, "<p>lost</p>"), ("only-empty", ""), ("only-null", None)]


def exchanges(df):
    """Inputs of the plan's shuffles and broadcasts."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) \w*Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_same_pages_as_from_a_plain_table(spark, tmp_path):
    given = spark.createDataFrame(ROWS, "page_key string, html string").repartition(5)
    laid = stored_pages.lay_out(given, str(tmp_path / "pages"), buckets=8)
    assert stored_pages.is_laid_out(laid) and not stored_pages.is_laid_out(given)
    keys = given.select("page_key").dropna().distinct()
    as_rows = lambda df: sorted((r["page_key"], r["html"]) for r in df.collect())
    assert as_rows(laid) == as_rows(pages.one_per_key(given, keys)) == as_rows(pages.one_per_key(laid, keys))
    some = keys.where("page_key like 'k1%'")
    plain, fast = pages.page_sections(given, given.limit(0), keys=some), pages.page_sections(laid, given.limit(0), keys=some)
    assert sorted(map(str, plain.collect())) == sorted(map(str, fast.collect()))


def test_no_page_moves_in_a_join(spark, tmp_path):
    given = spark.createDataFrame(ROWS, "page_key string, html string")
    laid = stored_pages.lay_out(given, str(tmp_path / "pages"), buckets=8)
    keys = given.select("page_key").dropna().distinct()
    for limit in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            moved = exchanges(pages.parse_pages(pages.one_per_key(laid.where("length(html) > 0"), keys)))
            plain = exchanges(pages.parse_pages(pages.one_per_key(given, keys)))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert moved and not any("html" in x for x in moved)
        assert any("html" in x for x in plain)


def test_short_pages_are_left_out_first_and_tables_are_read_again(spark, tmp_path):
    path = str(tmp_path / "pages")
    stored_pages.lay_out(spark.createDataFrame(ROWS, "page_key string, html string"), path, longer_than=0)
    spark.sql(f"drop table {stored_pages._table_name(path)}")  # as a session that does not know it
    again = stored_pages.read_laid_out(spark, path)
    found = {r["page_key"]: r["html"] for r in again.collect()}
    assert len(found) == 40 and found["k1"] == "<p>x1</p>" or found["k1"] == min(h for k, h in ROWS if k == "k1" and h)
    assert stored_pages.lay_out(again.limit(0), str(tmp_path / "none")).count() == 0


def test_pages_move_once_to_their_buckets(spark):
    rows = [(f"k{i % 7}", f"text {i}") for i in range(50)]
    found = stored_pages._in_buckets(spark.createDataFrame(rows, "page_key string, html string"), 8)
    assert {r["page_key"]: r["html"] for r in found.collect()} == {f"k{k}": min(t for q, t in rows if q == f"k{k}") for k in range(7)}
    assert found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("Exchange hashpartitioning") == 1
