"""Personal data: the rules against plain expressions, what the trees add, and odd texts."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from vakanta.llm import boosting, pii

SF_DIR = "/root/testdata/sf0.01"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def fits(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [[m.span() for m in re.finditer(p, text or "") if fits(k, m.group())] for k, p in PLAIN.items()]


ODD = [
    "", " ", "a@b.c@d.e", "x@y", "@", "@@a.b", "a@-.-", "a@b..c", "A%+b@c.d.", "é@b.c", "ä.b@c.de@f.gh", "a@b@c.d",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.001.0.0", "1.2.3", "11.22.33.44 1.1.1.1", "9" * 4000 + ".1.1.1", "1.1.1." + "9" * 4000,
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "4111111111111111 99", "4" * 19, "0" * 16, "0" * 25,
    "+1 (017) 555-7713", "+1", "+12", "+123", "++1 234 567 89", "+1 2345678901234567", "+1.2.3.4.5.6.7.8", "+49 89 1234567) ", "😀+1 (017) 555-7713",
    "tel +1 (017) 555-7713 4111 1111 1111 1111 10.0.0.1 me@example.com",
]


@pytest.mark.parametrize("text", ODD)
def test_rules_on_odd_texts(text):
    assert pii.rule_spans(text) == brute(text)


def test_rules_on_mixed_texts():
    chance = random.Random(9)
    parts = ["a", "@", ".", "b.c", "1", "22", "255", " ", "-", "+", "(", ")", "4111", "é", "\n", "0"]
    for _ in range(4000):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(1, 30)))
        assert pii.rule_spans(text) == brute(text), text


@pytest.fixture(scope="module")
def trained(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return docs, pii.train(docs)


def test_query_keeps_the_rules_on_the_whole_table(trained):
    docs, finder = trained
    for r in pii.find(docs.withColumns({c: F.lit("other") for c in ("key", "spans", "base", "n_ip")}), finder).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = brute(r["text"])
        base = [f"{k}:{s}:{e}" for k, spans in zip(PLAIN, want, strict=True) for s, e in spans]
        assert r["base"] == ",".join(base) and [r[f"n_{k}"] for k in PLAIN] == list(map(len, want))
        every = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(every)
        order = [(list(PLAIN).index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in every)]
        assert order == sorted(order)
        added = sorted((s, e) for k, s, e in order if f"{list(PLAIN)[k]}:{s}:{e}" not in base)
        taken = [s for spans in want for s in spans]
        assert all(b[0] >= a[1] for a, b in zip(added, added[1:], strict=False))
        assert all(e <= x or s >= y for s, e in added for x, y in taken)
        for s, e in [*taken, *added]:
            assert r["text"][s:e] not in r["redacted"] or r["text"].count(r["text"][s:e]) > 1


def test_trees_find_hidden_data_in_texts_they_never_saw(trained):
    """Data spoilt in contexts of texts apart from the sample; plain texts and numbers stay."""
    docs, finder = trained
    chance = random.Random(5)
    words = [w for r in docs.limit(300).collect() if r["text"] for w in r["text"].split()[:30] if w.isalpha()]
    caught, total = 0, 0
    for i in range(400):
        kind = i % 4
        plain = [
            f"{chance.choice(words)}.{chance.randint(1, 99)}@mail{chance.randint(1, 9)}.example.com", ".".join(str(chance.randint(1, 255)) for _ in range(4)),
            "4111111111111111", f"+1 ({chance.randint(100, 999)}) 555-{chance.randint(1000, 9999)}",
        ][kind]
        hidden = pii.spoilt(kind, plain, chance)
        before = " ".join(chance.choice(words) for _ in range(9)) + " "
        text = before + hidden + " " + " ".join(chance.choice(words) for _ in range(9))
        rules, added = finder.spans(text)
        covered = set()
        for s, e in [(s, e) for _, s, e in added] + [x for spans in rules for x in spans]:
            covered |= set(range(s, e))
        inside = [j for j in range(len(before), len(before) + len(hidden)) if text[j].isalnum()]
        total += 1
        caught += sum(j in covered for j in inside) >= 0.9 * len(inside)
    assert caught / total > 0.7, caught / total
    clean = [" ".join(chance.choice(words) for _ in range(40)) + f" {chance.randint(1900, 2030)} and {chance.randint(1, 99)}, version 3.0" for _ in range(200)]
    assert sum(bool(finder.spans(t)[1]) for t in clean) <= 2


def test_odd_rows_and_empty_tables(spark, trained):
    _, finder = trained
    data = [(1, None), (2, ""), (None, "me@example.com"), (3, "x" * 300_000), (3, "12 " * 40_000), (4, "me@example.com"), (4, "me@example.com")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df, finder).collect() if r["doc_id"] != 3}
    assert found[1]["spans"] == "" and found[2]["spans"] == "" and found[None]["redacted"] == "[email]" and found[4]["n_email"] == 1
    assert pii.find(df, finder).count() == len(data)
    none = pii.train(df.limit(0))
    assert none.models == {} and pii.find(df.limit(0), none).count() == 0
    assert pii.find(df, none).filter("n_email = 1").count() == 3


def test_model_is_the_same_however_rows_are_dealt(trained):
    docs, finder = trained
    again = pii.train(docs.repartition(7))
    assert {k: b for k, (_, b) in again.models.items()} == {k: b for k, (_, b) in finder.models.items()}


def test_boosting_learns_and_thresholds_are_calibrated():
    chance = random.Random(1)
    x = [[chance.random(), chance.random(), chance.random()] for _ in range(1500)]
    y = [int((a > 0.5) != (b > 0.5)) for a, b, _ in x]
    model = boosting.fit(x[:1000], y[:1000])
    margins = model.margins(x[1000:])
    assert sum((m > 0) == bool(label) for m, label in zip(margins, y[1000:], strict=True)) > 480
    bound = boosting.threshold(margins, y[1000:], 0.95)
    chosen = [label for m, label in zip(margins, y[1000:], strict=True) if m >= bound]
    assert sum(chosen) / len(chosen) >= 0.95 and len(chosen) > 200
    steps, chances = boosting.isotonic([1, 2, 3, 4], [0, 1, 0, 1])
    assert chances == sorted(chances) and boosting.threshold([1.0], [1], 0.9) == float("inf")


def test_models_and_thresholds_are_fitted_on_all_examples(spark, monkeypatch):
    """More examples than any fixed bound of a task, many of them repeated: as the trees and threshold of all in memory."""
    from xxhash import xxh3_64_intdigest

    chance = random.Random(3)
    texts = []
    for i in range(2600):
        name, host = "".join(chance.choice("abcdefgh") for _ in range(chance.randint(3, 9))), f"host{chance.randint(1, 99)}.example.org"
        texts.append(f"write to {name}{i}@{host}, call +1 ({chance.randint(100, 999)}) 555-{i:04d} or see {i}-{chance.randint(1, 9999)}/{chance.randint(10**6, 10**7)} now {i}")
    texts += texts[:500] + [None, ""]
    for name, value in (("HELD_EXAMPLES", 100), ("KEPT_EXAMPLES", 700)):
        monkeypatch.setattr(pii, name, value)
    for name, value in (("TASK_ROWS", 2000), ("MOST_PARTS", 2), ("KEPT_ROUNDS", 15)):
        monkeypatch.setattr(boosting, name, value)
    finder = pii.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    taught = {(kind, label, xxh3_64_intdigest(name.encode()) >> 1): x for t in texts for kind, label, name, x in pii.examples(t or "")}
    assert set(finder.models) == {0, 3}
    for kind, (model, bound) in finder.models.items():
        own = [(label, h % 4 == 0, x) for (k, label, h), x in taught.items() if k == kind]
        assert sum(label for label, _, _ in own) > 3 * 2000
        want = boosting.fit([x for _, apart, x in own if not apart], [label for label, apart, _ in own if not apart])
        assert model.start == want.start and [list(c) for c in model.cuts] == [list(c) for c in want.cuts]
        assert all((a == b).all() for one, other in zip(model.trees, want.trees, strict=True) for a, b in zip(one, other, strict=True))
        margins = want.margins([x for _, apart, x in own if apart])
        assert bound == boosting.threshold(margins, [label for label, apart, _ in own if apart], pii.CHANCE, least_rows=5)
