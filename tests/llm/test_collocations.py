"""Collocations against brute force: odd texts, ties, several shards, few cells, and the double array itself."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vakanta.llm import collocations as C

SF_DIR = "/root/testdata/sf0.001"


def brute_words(text):
    folded = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    return [re.findall("[^ \t]+", piece) for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded)]


def brute(data, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in data:
        for ws in brute_words(text):
            n[lang or "und"] += len(ws)
            for size in (1, 2, 3):
                f.update((lang or "und", tuple(ws[i : i + size])) for i in range(len(ws) - size + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in found.items():
        if any(lang == other and len(longer) > len(ws) and ws in (longer[:2], longer[1:]) and 100 * b >= percent * a for (other, longer), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, items in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(items)[:top], 1)
    )


def made(seed=3, rows=120):
    chance = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "é", "Straße", "x-y", "😀", "nul\0l", "iİ", "a"]
    join = [" ", " ", " ", "  ", "\t", ", ", ".", "!", "\n", "\x0b", " ", "\xa0"]
    text = lambda n: "".join(chance.choice(words[: chance.choice((3, 12))]) + chance.choice(join) for _ in range(n))
    return [(chance.choice(["en", "en", "de", None, "und"]), text(chance.randint(0, 60))) for _ in range(rows)] + [
        ("en", None), (None, None), ("fr", ""), ("en", " . , "), ("en", "the of " * 9000), ("de", "solo"),
    ]


def frame(spark, data):
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "lang string, text string, doc_id long")
    return docs.withColumns({c: F.lit("other") for c in ("phrase", "n", "a", "score", "shard", "number", "level")}).repartition(4)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("more", [{}, {"shard_phrases": 7}, {"bits": 3}])
def test_as_brute_force(spark, more):
    data = made()
    assert rows(C.collocations(frame(spark, data), **more)) == brute(data)


def test_ties_and_lists_cut_at_their_length(spark):
    data = [("en", f"w{i:02} v{i:02}. w{i:02} v{i:02}") for i in range(30)] * 3
    found = rows(C.collocations(frame(spark, data), least=5, top=4))
    assert [r[2] for r in found] == ["w00 v00", "w01 v01", "w02 v02", "w03 v03"] and found == brute(data, least=5, top=4)


def test_empty_table_and_too_few(spark):
    docs = frame(spark, [("en", "one two three")] * 9)
    assert rows(C.collocations(docs)) == [] and rows(C.collocations(docs.limit(0))) == []


def test_full_cells_lose_no_frequent_phrase(spark):
    data = made(8)
    counts, _ = C.phrase_counts(frame(spark, data), bits=3)
    found = {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()}
    want = Counter()
    for lang, text in data:
        for ws in brute_words(text):
            for size in (2, 3):
                want.update((lang or "und", " ".join(ws[i : i + size])) for i in range(len(ws) - size + 1))
    assert {k: n for k, n in found.items() if " " in k[1]} == {k: n for k, n in want.items() if k in found}
    assert all(k in found for k, n in want.items() if n >= 10)


def test_double_array_holds_its_phrases_and_no_other():
    chance = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    phrases = sorted({" ".join(chance.choice(words) for _ in range(chance.randint(1, 3))) for _ in range(900)})
    langs = [chance.choice(["a", "b"]) for _ in phrases]
    rows = list(zip(langs, phrases, strict=True))
    parts = [rows[:500], rows[500:]]  # two tries of different words
    tries = C.Tries(C.Trie.from_bytes(C.Trie.build(*zip(*part, strict=True)).to_bytes()) for part in parts)
    known = {row: (i, n) for i, part in enumerate(parts) for n, row in enumerate(part)}
    for lang in ("a", "b", "c"):
        tokens = [chance.choice([*words, "strange", "."]).encode() for _ in range(3000)]
        want = Counter()
        for i in range(len(tokens)):
            for n in (1, 2, 3):
                number = known.get((lang, b" ".join(tokens[i : i + n]).decode())) if i + n <= len(tokens) else None
                want.update([number] if number is not None else [])
        got = Counter((i, n) for i, accepted in tries.walk(lang, tokens) for n in accepted.tolist())
        assert got == want


def test_very_long_texts_are_cut_between_pieces_only(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 50)
    data = made(5, 30)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for x, _ in data]), pa.array([t or "" for _, t in data])], ["lang", "text"])
    got, want = Counter(), Counter()
    for lang, tokens in C.chunks([batch]):
        for piece in b" ".join(tokens).split(b"."):
            got[lang, tuple(piece.split())] += 1
    for lang, text in data:
        want.update((lang or "und", tuple(w.encode() for w in ws)) for ws in brute_words(text))
    drop = lambda c: {k: n for k, n in c.items() if k[1]}
    assert drop(got) == drop(want)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    data = [(r["lang"], r["text"]) for r in docs.collect()]
    assert rows(C.collocations(docs)) == brute(data)


def test_cells_follow_the_hashes_met():
    """Sums are those of a table of all cells, whatever the merges, and what is held follows the hashes."""
    import numpy as np

    chance = np.random.default_rng(3)
    cells, want = C.Cells(20, 10), np.zeros(2 << 20, dtype=np.int64)
    for _ in range(30):
        hashes, n = np.unique(chance.integers(0, 1 << 64, 3000, dtype=np.uint64) & np.uint64(0xFFF0000000FF), return_counts=True)
        cells.add(hashes, n)
        for at in C._places(hashes, 20):
            np.add.at(want, at, np.minimum(n, 10))
    assert cells.held <= 30 * 3000 and not hasattr(cells, "counts")
    got = np.zeros(2 << 20, dtype=np.int64)
    for _, chunk, at, counts in cells.packed(1):
        got[chunk * C.CELL_CHUNK + np.frombuffer(at, dtype="<u2").astype(np.int64)] += np.frombuffer(counts, dtype=np.uint8)
    assert (got <= 10).all() and (got == np.minimum(want, 10)).all()
    assert not list(cells.packed(1))


def test_phrases_found_everywhere_are_not_named_by_every_task(spark, monkeypatch):
    """Later parts of the rows leave out what earlier ones have named; with room for no hash, or few, results stay."""
    data = [("en", " ".join(f"w{(i * 7 + k) % 20:02}" for k in range(30)) + f" own{i}") for i in range(1000)] + made(4)
    docs = frame(spark, data).repartition(16)
    want, told = brute(data), []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: told.append((name, keep(df, name))) or told[-1][1])
    for room in (1 << 21, 20, 0):
        monkeypatch.setattr(C, "KNOWN_HASHES", room, raising=False)
        assert rows(C.collocations(docs)) == want
        pairs = [r for name, df in told if name == "phrase-pairs" for r in df.filter("level = 0").collect()]
        assert room < 1 << 21 or len(pairs) <= 3 * len({(r["lang"], r["phrase"]) for r in pairs}), len(pairs)
        told.clear()


def test_places_are_packed_by_their_gaps():
    import numpy as np

    chance = np.random.default_rng(6)
    for size in (1, 2, 40, 3000, 65536):
        at = np.sort(chance.choice(1 << 16, size, replace=False))
        raw = C._gaps(at)
        assert C._from_gaps(raw).tolist() == at.tolist()
        assert len(raw) <= 2 * size + 1 and (size < 3000 or len(raw) < 1.1 * size)
    edge = np.array([0, 1, 255, 256, 510, 766, 65535])
    assert C._from_gaps(C._gaps(edge)).tolist() == edge.tolist() and C._from_gaps(C._gaps(edge[:4])).tolist() == [0, 1, 255, 256]


def test_counts_are_added_up_over_tasks_and_widths(spark):
    data = [("en", "a b " * n) for n in (40, 300, 70_000)] + [("de", "a b. " * 300), ("de", "c")]
    docs = spark.createDataFrame(data, "lang string, text string").repartition(5)
    counts, totals = C.phrase_counts(docs)
    found = {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()}
    assert found["en", "a"] == 70_340 and found["en", "a b"] == 70_340 and found["en", "b a"] == 70_337 and found["de", "a b"] == 300
    assert sorted(map(tuple, totals.collect())) == [("de", 601), ("en", 140_680)]


def test_words_spelt_like_another_language(spark):
    data = [("und", "de de de. de und"), ("de", "und und und. und de"), ("de", "de de. und und de")] * 12
    assert rows(C.collocations(frame(spark, data).coalesce(1))) == brute(data)


def test_texts_are_turned_into_words_once_however_many_tries(spark, monkeypatch):
    """The counting pass reads texts once, and a position is walked in the trie of its first two words only."""
    data = made(6, 200)
    passes = []
    counted = C._counted
    monkeypatch.setattr(C, "_counted", lambda *args: passes.append(1) or counted(*args))
    assert rows(C.collocations(frame(spark, data), shard_phrases=60)) == brute(data)
    assert len(passes) == 1

    block, walked = C.Block(5), []
    block.add("en", [b"a", b"b", b"c", C.MARK, b"a"])
    block.add("de", [b"a", b"b"])

    class Empty(C.Trie):
        def walk(self, states, at, own, numbers):
            walked.extend(at.tolist())
            return iter(())

    empty = lambda shard: Empty.from_bytes(C.Trie.build(["en", "de"], ["a", "a"]).to_bytes())
    found = list(block.counted(empty))
    assert sorted(walked) == [0, 1, 6]  # a b, b c, a b
    assert sum(int(n.sum()) for _, _, n in found) == 3  # a three times, in the trie of the word of its language


def test_blocks_of_few_tokens_and_shared_bits_of_cells_give_the_same(spark, monkeypatch):
    data = made(9)
    for name, value in (("HELD_TOKENS", 50), ("FULL_BITS", 17)):
        monkeypatch.setattr(C, name, value, raising=False)
    assert rows(C.collocations(frame(spark, data), bits=20, shard_phrases=20)) == brute(data)


def test_cells_beyond_the_bits_that_are_sent(spark, monkeypatch):
    """Many more cells than bits: what is full stays full, and the bitmap is no larger."""
    import numpy as np

    monkeypatch.setattr(C, "FULL_BITS", 17, raising=False)
    chance = np.random.default_rng(2)
    hashes = np.unique(chance.integers(0, 1 << 64, 4000, dtype=np.uint64))
    counts = np.where(np.arange(len(hashes)) % 4 == 0, 10, 1)
    for bits in (16, 17, 20, 32):
        cells = C.Cells(bits, 10)
        cells.add(hashes, counts)
        packed = [b for b in cells.batches(2)]
        df = spark.createDataFrame([r for b in packed for r in map(tuple, zip(*(c.to_pylist() for c in b.columns), strict=True))], C.PACKED)
        bitmap = C._full_cells(df, bits, 10)[2]
        assert len(bitmap) == (2 << min(bits, 17)) // 8
        held = C.Full(bits, bitmap).holds(hashes)
        assert held[counts == 10].all() and held[counts == 1].mean() < 0.01
