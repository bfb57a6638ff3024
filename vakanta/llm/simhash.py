"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at most two bits agree on at least two
whole blocks, so every such pair meets under one of the six keys made of two blocks, where its distance is verified.
A key that more than ``CROWD`` fingerprints share is not joined with itself: each of its fingerprints names itself and the
32 values one bit away outside the key's blocks as centres. Fingerprints with a common centre are at most two bits
apart, pairs two bits apart have a common centre, and a centre has at most 33 of them, so linking all to the smallest
gives the same components without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed, free_name
from vakanta.llm.components import connected

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
BLOCK_BITS = 16
BLOCKS = 4
CROWD = 16
MARK_BITS = 1 << 26


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Unsigned SimHash of a whole text; 0 without words.

    A-Z is lower-cased; words are runs without ASCII white space; texts with fewer words than a shingle are one shingle.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    width = min(words, len(found))
    shingles = map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))
    total = len(found) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=total)
    for i in range(0, total, 1 << 15):  # bits are spread to bytes in short runs
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): one row per row; ``fp`` holds the unsigned fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t.as_py(), words) for t in batch.column(1)]
            signed = [f - (1 << 64) if f >> 63 else f for f in fps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["key", "fp"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "key long, fp long")


def _block(fp: Column, number: int) -> Column:
    return F.shiftrightunsigned(fp, number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: verified links between the distinct values of ``fp``, enough for the components of distance 2."""
    keys = [
        F.struct(
            F.lit(number).alias("pair"),
            F.shiftleft(_block(F.col("fp"), high), BLOCK_BITS).bitwiseOR(_block(F.col("fp"), low)).alias("bits"),
        )
        for number, (low, high) in enumerate(combinations(range(BLOCKS), 2))
    ]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.bits")
    shared = keyed.groupBy("pair", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    met = checkpointed(keyed.join(shared, ["pair", "bits"]))
    few = met.filter(F.col("n") <= CROWD)
    near = (
        few.select("pair", "bits", F.col("fp").alias("a"))
        .join(few.select("pair", "bits", F.col("fp").alias("b")), ["pair", "bits"])
        .filter((F.col("a") < F.col("b")) & (_bits_apart(F.col("a"), F.col("b")) <= MAX_BITS))
        .select("a", "b")
    )
    free = []
    for low, high in combinations(range(BLOCKS), 2):
        rest = [x for x in range(BLOCKS) if x not in (low, high)]
        flips = [1 << (x * BLOCK_BITS + i) for x in rest for i in range(BLOCK_BITS)]
        free.append(F.lit([0, *[f - (1 << 64) if f >> 63 else f for f in flips]]))
    centres = F.transform(F.element_at(F.array(*free), F.col("pair") + 1), lambda flip: F.col("fp").bitwiseXOR(flip))
    balls = (
        met.filter(F.col("n") > CROWD)
        .select("fp", F.explode(centres).alias("centre"))
        .groupBy("centre")
        .agg(F.collect_set("fp").alias("members"))
        .filter(F.size("members") > 1)
    )
    stars = (
        balls.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter((F.col("a") < F.col("b")) & (_bits_apart(F.col("a"), F.col("b")) <= MAX_BITS))
        .select("a", "b")
    )
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of at most two differing bits, one row per row.

    Copies are one fingerprint and are never expanded. Null and empty texts, and those of white space only, have
    fingerprint zero. Rows without a key are kept; a component of such rows alone has the null id. Repeated rows keep a
    row each. Other columns are ignored. An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, key, text, words))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("key").alias("head")))
    roots = connected(links(classes.select("fp")))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("head").alias("component_id"))
    of_class = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select(F.col("key").alias(key), "fp", "component_id")


def row_id(key: str, text: str) -> Column:
    """A digest of key and text; null differs from the empty text."""
    whole = F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("t"), F.col(text).cast("string")), F.lit("n")))
    return F.unhex(F.md5(whole.cast("binary")))


def with_row_id(docs: DataFrame, key: str, text: str, name: str = "__row") -> DataFrame:
    """One row for each pair of key and text, with a digest of both as ``name``; of repeats that with the smallest hash.

    Spark cuts repeats to one row in every map task (window group limit), before any text moves.
    """
    tie = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind])
    copy = free_name(docs, "__copy")
    rows = docs.withColumn(name, row_id(key, text))
    return rows.withColumn(copy, F.row_number().over(Window.partitionBy(name).orderBy(tie))).filter(F.col(copy) == 1).drop(copy)


def row_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, text) of every row, ``row`` as in ``with_row_id``."""
    return docs.select(F.col(key).cast("long").alias("key"), row_id(key, text).alias("row"), F.col(text).cast("string").alias("text"))


def head() -> Column:
    """What the first row of a group is chosen by: rows with a key first, the smallest key, a digest of key and text."""
    return F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "row")).alias("head")


def _place(row: Column) -> tuple[Column, Column]:
    """Word of a bitmap of ``MARK_BITS`` bits, and the bit in it, for a digest."""
    at = F.pmod(F.xxhash64(row), F.lit(MARK_BITS))
    return F.floor(at / 64).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def marked(docs: DataFrame, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose digest ``name`` may be among those of ``rows``, and those for which it is not. None of them move.

    The digests of ``rows`` are marked in a bitmap that every executor holds, at most 2^20 words whatever the table's size.
    """
    word, bit, held = (free_name(docs, x) for x in ("__word", "__bit", "__held"))
    of, one = _place(F.col(rows.columns[0]))
    words = checkpointed(rows.select(of.alias(word), one.alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(held)))
    of, one = _place(F.col(name))
    tested = docs.withColumn(word, of).join(F.broadcast(words), word, "left").withColumn(held, F.coalesce(F.col(held).bitwiseAND(one) != 0, F.lit(False)))
    return tested.filter(F.col(held)).select(*docs.columns), tested.filter(~F.col(held)).select(*docs.columns)


def first_rows(docs: DataFrame, classes: DataFrame, roots: DataFrame, key: str, text: str) -> DataFrame:
    """The rows that head a component: ``classes`` (node, head), ``roots`` (node, root) of the linked nodes.

    Digests tell which rows go or have repeats; only those, and the few that share a place of the bitmap with them, move with their texts.
    """
    grouped = classes.select("node", "head").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    name, held = free_name(docs, "__row"), free_name(docs, "__n")
    chosen = checkpointed(grouped.groupBy("root").agg(F.min("head").alias("head")).select(F.col("head.row").alias(name)))
    named = docs.withColumn(name, row_id(key, text))
    counted = named.groupBy(name).agg(F.count("*").alias(held))
    single = counted.filter(F.col(held) == 1).join(chosen, name, "left_semi")
    unsettled, settled = marked(named, counted.select(name).join(single, name, "left_anti"), name)
    # rows are chosen by their digests before copies are told apart, so that only chosen texts meet in the window
    met = unsettled.join(chosen, name, "left_semi").drop(name)
    return settled.select(*docs.columns).union(with_row_id(met, key, text, name).select(*docs.columns))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component of near duplicates, with all columns as they are.

    It is the row of the smallest key; rows without a key come last; among rows of that key in the component a digest of
    key and text decides. Rows of one key with unrelated texts belong to different components, and each component keeps
    a row. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [text_fingerprint(t.as_py(), words) for t in batch.column(2)]
            signed = pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], ["key", "row", "node"])

    hashed = row_ids(docs, key, text).mapInArrow(run, "key long, row binary, node long")
    classes = checkpointed(hashed.groupBy("node").agg(head()))
    roots = connected(links(classes.select(F.col("node").alias("fp"))))
    return first_rows(docs, classes, roots, key, text)
