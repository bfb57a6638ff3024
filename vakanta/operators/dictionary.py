"""Tags of texts by a dictionary that is a table: expressions and labels, any number of them.

The dictionary is inverted. Each expression is filed under the words that its matches must contain; texts give their words, and
a hash join finds the few expressions worth running on each text. Words of which an expression names only a part are
looked up once in the vocabulary of the texts. Expressions that require no word at all run on every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanta.functions.anchors import anchors
from vakanta.functions.text import WORD, unicode_regex
from vakanta.operators.lookup import broadcast_if_small
from vakanta.operators.rows import each
from vakanta.session import checkpointed

GRAM = 3
REST_AT_ONCE = 200


def inverted(dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entry, expression, label, anchored`` of a dictionary ``pattern, label``, and ``entry, anchor, part, n_words``.

    Entries that are not ``anchored`` are in the first table alone. Rows with a null pattern or label do not count, repeats once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = batch.column(0).to_pylist()
            found = [anchors(p) for p in patterns]
            columns = [batch.column(0), batch.column(1), pa.array([unicode_regex(p) for p in patterns], pa.string()), pa.array([f is not None for f in found])]
            for part in (False, True):
                columns.append(pa.array([[a.text for a in f or [] if a.part == part] for f in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, ["pattern", "label", "expression", "anchored", "whole", "parts"])

    rows = dictionary.select("pattern", "label").dropna().distinct()
    schema = "pattern string, label string, expression string, anchored boolean, whole array<string>, parts array<string>"
    entries = checkpointed(rows.mapInArrow(read, schema).withColumn("entry", F.xxhash64("pattern", "label")))
    filed = each(entries, ["entry"], "whole", "anchor").withColumn("part", F.lit(False))
    filed = filed.union(each(entries, ["entry"], "parts", "anchor").withColumn("part", F.lit(True)))
    return entries.drop("whole", "parts"), checkpointed(filed.withColumn("n_words", F.size(F.split("anchor", " "))))


def _words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"{WORD}+"), F.lit(0))


def _sequences(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``id, anchor``: the distinct runs of words of each text, of the given lengths."""

    def runs(n: int) -> Column:
        if n == 1:
            return F.col("__words")
        starts = F.slice("__words", 1, F.greatest(F.size("__words") - (n - 1), F.lit(0)))
        return F.transform(starts, lambda word, i: F.concat_ws(" ", word, *[F.get("__words", i + j) for j in range(1, n)]))

    worded = each(texts, ["id"], F.array(_words(F.col("lowered"))), "__words")
    return each(worded, ["id"], F.array_distinct(F.concat(*[runs(n) for n in sizes])), "anchor")


def _grams(word: Column, size: int) -> Column:
    """Pieces of ``size`` characters; the whole word, if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda at: F.substr(word, at, F.lit(size))))


def _known_parts(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``entry, anchor``: words of the texts that hold a part that an entry asks for. Only the vocabulary is searched."""
    vocabulary = _sequences(texts, [1]).select("anchor").distinct()
    size = F.least(F.length("part_text"), F.lit(GRAM))
    wanted = parts.select("entry", F.col("anchor").alias("part_text")).withColumn("gram", F.substr("part_text", F.lit(1), size))
    pieces = each(vocabulary, ["anchor"], F.array_distinct(F.flatten(F.array(*[_grams(F.col("anchor"), n) for n in range(1, GRAM + 1)]))), "gram")
    return pieces.join(broadcast_if_small(checkpointed(wanted)), "gram").where(F.contains("anchor", F.col("part_text"))).select("entry", "anchor").distinct()


def candidates(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """``id, entry``, distinct: what the words of the texts ``id, lowered`` call for.

    The inverted dictionary is broadcast if it is measured to fit; else the join is by hash of the words, and adaptive
    execution splits words that very many texts have.
    """
    whole = filed.where("not part")
    sizes = sorted(r["n_words"] for r in whole.select("n_words").distinct().collect())  # three at most
    found = []
    if sizes:
        asked = broadcast_if_small(checkpointed(whole.select("entry", "anchor")))
        found.append(_sequences(texts, sizes).join(asked, "anchor").select("id", "entry"))
    parts = checkpointed(filed.where("part"))
    if not parts.isEmpty():
        words = broadcast_if_small(checkpointed(_known_parts(texts, parts)))
        found.append(_sequences(texts, [1]).join(words, "anchor").select("id", "entry"))
    if not found:
        return texts.selectExpr("id", "0L as entry").limit(0)
    both = found[0] if len(found) == 1 else found[0].union(found[1])
    return both.distinct()


def dictionary_tags(
    docs: DataFrame, text: str, dictionary: DataFrame, keep: list[str], out: str = "tags", separator: str = ", "
) -> DataFrame:
    """``keep`` and the sorted distinct labels of all entries that match the lower-cased text, joined; '' if none or no text.

    ``dictionary`` has ``pattern`` (as ``skills.skill_string`` takes them) and ``label``. Copies of a text are searched once. Each text
    moves once, to meet its candidates; the number of expressions run follows the number of anchors found.
    """
    entries, filed = inverted(dictionary)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    rows = docs.select(*keep, lowered.alias("lowered")).withColumn("id", F.unhex(F.md5("lowered")))
    texts = rows.select("id", "lowered")
    known = broadcast_if_small(entries.select("entry", "expression", "label"))
    asked = candidates(texts, filed).join(known, "entry")
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("expression", "label")).alias("asked"))
    # one row per text leaves each map task; the aggregate does not hold more than one text of a group
    once = texts.groupBy("id").agg(F.first("lowered").alias("lowered"))
    hit = F.filter("asked", lambda e: F.rlike(F.col("lowered"), e["expression"]))
    labels = once.join(asked, "id").select("id", F.transform(hit, lambda e: e["label"]).alias("labels"))

    rest = entries.where("not anchored").select("expression", "label").collect()  # those that every text must meet
    for at in range(0, len(rest), REST_AT_ONCE):
        part = rest[at : at + REST_AT_ONCE]
        hits = F.array_compact(F.array(*[F.when(F.col("lowered").rlike(r["expression"]), F.lit(r["label"])) for r in part]))
        labels = labels.union(once.select("id", hits.alias("labels")))
    tagged = labels.groupBy("id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))), separator).alias(out))
    joined = rows.drop("lowered").join(checkpointed(tagged), "id", "left")
    return joined.select(*keep, F.coalesce(out, F.lit("")).alias(out))
