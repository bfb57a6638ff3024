"""Every component of near duplicates keeps a row, whatever rows share its key."""

from vakanta.llm import simhash

A, B, C = ("alpha beta gamma delta", "one two three four five six", "rot gelb blau schwarz")


def test_rows_of_one_key_with_unrelated_texts(spark):
    rows = [(5, A), (5, B), (7, B), (5, C), (5, C), (None, C), (None, "no key has this text"), (None, "no key has this text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, simhash.keep_first(docs).collect()), key=str)
    assert found == sorted([(5, A), (5, B), (5, C), (None, "no key has this text")], key=str)
