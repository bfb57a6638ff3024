"""The corpus pipeline stage by stage, and the expected SQL of the corpus queries."""

import os

import pytest

import corpus_pipeline
from checks.compare import compare, database
from tests.llm.test_operators import check_packing, masked
from tests.llm.test_similar import brute_kept
from vakanta.llm import language, packing, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_expected_sql(spark, name):
    ok, note = compare(spark, database(SF_DIR), queries.QUERIES[name], queries.ORACLE[name], SF_DIR)
    assert ok, note


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        kept.append(([tuple(r) for r in docs.collect()], [r for r in after.collect()]))
        if number < 3:
            assert after.columns == docs.columns
        docs = after
    for before, after in kept[:2]:
        assert set(map(tuple, after)) <= set(before) and len(set(map(tuple, after))) == len(after)
    gone = {r[0] for r in kept[0][0]} - {r[0] for r in kept[0][1]}
    clean = {r[0] for r in kept[0][0] if r[1] and any(c.isalpha() for c in r[1])}
    assert len(gone & clean) <= 0.01 * len(clean)
    assert sorted(r[0] for r in kept[1][1]) == brute_kept([(r[0], r[1]) for r in kept[1][0]])
    assert sorted((r["doc_id"], r["text"]) for r in kept[2][1]) == sorted((r[0], masked(r[1])) for r in kept[2][0])
    check_packing(kept[3][1], [(r[0], len(r[1].split()) + 1) for r in kept[3][0]], packing.CAPACITIES)


def test_run_gives_the_rows_of_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.columns == ["doc_id", "piece", "piece_start", "piece_tokens", "pack", "bin", "bin_offset", "capacity", "row", "bin_tokens"]
    assert found.count() > 0


def test_rejects_texts_without_letters(spark):
    rows = [(1, "the house of the rising sun", "en", "s", 27), (2, "12 34", "en", "s", 5), (3, None, "en", "s", 0), (4, "la maison de la rue", "fr", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.language_id(spark, docs, SF_DIR)
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 4]
    assert language.UNKNOWN == "und"
