"""Near duplicates by shingle similarity, and which row of a component is kept."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vakanta.llm import similar

SCHEMA = "doc_id long, text string, lang string"
SMALL = "/root/testdata/sf0.01"


def shingle_set(text):
    found = (text or "").encode().lower().split()
    width = min(5, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1)) if found else frozenset()


def brute_kept(data):
    """Smallest key of each component of texts with a Jaccard similarity of 0.8 or more; all pairs that share a shingle."""
    least = {}
    for key, text in data:
        s = shingle_set(text)
        least[s] = min(key, least.get(s, key))
    group, holders = {s: s for s in least}, {}

    def top(x):
        while group[x] is not x:
            x = group[x]
        return x

    for s in least:
        common = {}
        for x in s:
            for other in holders.get(x, []):
                common[other] = common.get(other, 0) + 1
            holders.setdefault(x, []).append(s)
        for other, n in common.items():
            if 5 * n >= 4 * (len(s) + len(other) - n):
                group[top(other)] = top(s)
    kept = {}
    for s, key in least.items():
        kept[top(s)] = min(key, kept.get(top(s), key))
    return sorted(kept.values())


def kept_keys(found):
    return sorted(r["doc_id"] for r in found.select("doc_id").collect())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stage_takes_similarity_of_five_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    found = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert found.columns == docs.columns
    assert kept_keys(found) == want


def test_near_copies_in_crowded_buckets(spark):
    chance = random.Random(5)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(6))
    data = []
    for base in range(3):
        text = [word() for _ in range(200)]
        for i in range(60):  # from one to nine changed words: around the bound against each other
            own = list(text)
            for at in chance.sample(range(200), chance.randint(1, 9)):
                own[at] = word()
            data.append((base * 100 + i, " ".join(own)))
    data += [(900, "One two THREE"), (901, "one two three"), (902, None), (903, " \n"), (904, "one two four")]
    docs = spark.createDataFrame([(k, t, "en") for k, t in data], SCHEMA)
    assert kept_keys(similar.keep_first(docs)) == brute_kept(data)
    assert similar.keep_first(docs.limit(0)).count() == 0


def test_crowd_of_a_thousand_near_copies_with_outliers(spark):
    """Members that no leader links: twins of far copies, short extracts of each other, and a chain that leads away."""
    chance = random.Random(11)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    data = []

    def add(text):
        data.append((len(data), " ".join(text)))

    for _ in range(400):
        own = list(base)
        for at in chance.sample(range(150), chance.randint(0, 6)):
            own[at] = word()
        add(own)
    for _ in range(30):  # far from the base, alike in pairs
        own = list(base)
        for at in chance.sample(range(150), 8):
            own[at] = word()
        add(own)
        twin = list(own)
        twin[chance.randrange(150)] = word()
        add(twin)
    for start in range(0, 30, 2):  # extracts, alike to their neighbours and no longer to the base
        add(base[start : start + 105])
    chain = list(base)
    for at in range(0, 150, 6):
        chain[at] = word()
        add(chain)
    chance.shuffle(data)
    docs = spark.createDataFrame([(k, t, "en") for k, t in data], SCHEMA)
    assert kept_keys(similar.keep_first(docs)) == brute_kept(data)


def test_clashing_columns_null_keys_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, ""), (3, "x " * 20_000), (3, "y z"), (4, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__row", "__copy", "row", "node", "crowd", "at", "kind", "n", "s"):
        docs = docs.withColumn(name, F.lit("mine"))
    found = similar.keep_first(docs.repartition(3))
    assert found.columns == docs.columns
    kept = found.collect()
    assert sorted((r["doc_id"], (r["text"] or "")[:3]) for r in kept) == [(1, "a b"), (2, ""), (3, "x x"), (3, "y z")]
    assert all(r["__row"] == r["__copy"] == r["node"] == "mine" for r in kept)


def test_stars_need_no_further_step(spark, monkeypatch):
    """Links that are stars already are seen to be so; others take steps until they are."""
    from vakanta.llm import components

    steps = []
    step = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: steps.append(1) or step(edges))

    def found(edges):
        steps.clear()
        rows = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
        return sorted((r["node"], r["root"]) for r in rows)

    assert found([(1, 2), (1, 3), (1, 3), (5, 9)]) == [(2, 1), (3, 1), (9, 5)] and not steps
    assert found([]) == [] and not steps
    assert found([(1, 3), (2, 3), (3, 4), (6, 8), (7, 8)]) == [(2, 1), (3, 1), (4, 1), (7, 6), (8, 6)] and steps
    assert found([(i, i + 1) for i in range(20)]) == [(i, 0) for i in range(1, 21)]


@pytest.mark.parametrize("bits", [1, 1 << 26])
def test_only_texts_of_repeats_and_copies_move(spark, monkeypatch, bits):
    """Rows alone in their component, or at its head, are told by their digests; a full bitmap gives the same rows."""
    from vakanta.llm import simhash

    monkeypatch.setattr(simhash, "MARK_BITS", bits)
    told = []
    apart = simhash.with_row_id
    monkeypatch.setattr(simhash, "with_row_id", lambda docs, *names: told.append(docs.count()) or apart(docs, *names))
    data = [(i, f"text {i} of words that stand in no other one {i}") for i in range(200)]
    data += [(7, data[7][1]), (300, data[9][1]), (2, data[9][1]), (None, data[9][1]), (2, None), (5, ""), (301, " ")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("__word", "__bit", "__held", "__n")})
    found = similar.keep_first(docs)
    assert found.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"] or "") for r in found.collect())
    want = [(i, t) for i, t in data[:200] if i != 9] + [(2, data[9][1]), (2, "")]
    assert kept == sorted(want)
    assert told[0] <= 4 if bits > 1 else told[0] >= 200


def test_sketches_never_differ_more_than_sets():
    import numpy as np

    chance = np.random.default_rng(4)
    for size in (1, 40, 300, 5000):
        whole = np.unique(chance.integers(0, 1 << 64, size, dtype=np.uint64))
        one, other = (np.unique(np.concatenate([chance.permutation(whole)[: size - size // 8], chance.integers(0, 1 << 64, n, dtype=np.uint64)])) for n in (3, 9))
        apart = np.bitwise_xor(similar.sketch(one), similar.sketch(other))
        assert len(apart) == similar.SKETCH_WORDS
        assert sum(int(x).bit_count() for x in apart.view("<u8")) <= len(np.setxor1d(one, other))
        assert not similar.sketch(one[:0]).any()


def test_leaders_meet_few_members_that_are_not_alike(spark, monkeypatch):
    """A crowd whose members mostly link to nobody: sketches settle their pairs, and few rounds are needed."""
    told = []
    verified = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, sets: told.append(pairs.count()) or verified(pairs, sets))
    chance = random.Random(17)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    data = []
    for i in range(250):
        own = list(base)
        for at in chance.sample(range(200), 3 if i < 20 else 8):
            own[at] = word()
        data.append((i, " ".join(own)))
    docs = spark.createDataFrame([(k, t, "en") for k, t in data], SCHEMA)
    assert kept_keys(similar.keep_first(docs)) == brute_kept(data)
    assert len(told) <= 6 and sum(told[1:]) <= 2000, told
