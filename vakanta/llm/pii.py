"""Personal data: fixed rules, and further spans found by boosted trees over the candidates of generous generators.

Generators propose overlapping spans with loose expressions. Trees judge a span by its format (digits, groups, separators, check
sum) and its context (characters and trigger words around it). They learn from the corpus itself: spans of the rules are
positive, and so are spoilt copies of them in the same context (signs replaced by words, prefixes lost), which no rule
accepts; candidates apart from all rules are negative. Trees are fitted on three quarters of all examples; thresholds come from
chances calibrated on the rest. Of overlapping spans the likeliest stays, and none may touch a span of a rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanta.llm import boosting
from vakanta.llm.common import plain_text, stored

KINDS = ("email", "ip", "card", "phone")
HELD_EXAMPLES = 1 << 13
KEPT_EXAMPLES = 1 << 17
CHANCE = 0.95
CONTEXT = 32

# The rules.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits: if the run's first digit leads to none, no later one does
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Loose forms: an at sign or a word for it between two runs of visible characters; runs of digits and separators.
SIGNS = ("@", " at ", "(at", "[at", "{at", "( at", "[ at", "(AT", "[AT")
SIGN = re.compile(r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?| at |@")
VISIBLE = r"[^\s<>()\[\]{},;:\"'@]"
NAME_END = re.compile(VISIBLE + "*\\Z")
HOST = re.compile(VISIBLE + r"{1,80}(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot )" + VISIBLE + "{1,40}){0,4}")
DIGIT = re.compile("[0-9]")
LOOSE_NUMBER = re.compile(r"[+(]?[0-9](?:(?:[\[({]\.[\])}]|[ ().:/_-]{1,3})?[0-9])*")
GROUP = re.compile(r"[0-9]+")
TRIGGERS = (
    re.compile(r"mail|contact|kontakt|correo|courriel|@", re.I),
    re.compile(r"\bip\b|host|server|address|adresse|login", re.I),
    re.compile(r"card|karte|carte|tarjeta|visa|master|iban|konto|pay", re.I),
    re.compile(r"tel|phone|fon|call|fax|mobil|handy|m[oó]vil|appel", re.I),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def rule_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping; matches that fail a test are passed over, not tried again."""
    emails, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            emails.append((start, end))
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of all proposals; those of one kind may overlap."""
    for m in SIGN.finditer(text) if any(sign in text for sign in SIGNS) else ():
        name, host = NAME_END.search(text[max(0, m.start() - 64) : m.start()]), HOST.match(text, m.end())
        if name and name.group() and host and (m.group() != " at " or "." in host.group()[1:-1] or " dot " in host.group()):
            start, end = m.start() - len(name.group()), host.end()
            yield 0, start, end
            cut = len(text[start:end].rstrip(".!?*#%$&-_|"))
            if m.end() - start < cut < end - start:
                yield 0, start, start + cut
    if not DIGIT.search(text):
        return
    for m in LOOSE_NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = list(GROUP.finditer(text, m.start(), m.end()))
        digits = [g.end() - g.start() for g in groups]
        for i in range(len(groups)):
            total = 0
            for j in range(i, min(i + 8, len(groups))):
                total += digits[j]
                if total > 19:
                    break
                start, end = groups[i].start(), groups[j].end()
                if start > m.start() and text[start - 1] in "+(":
                    start -= 1
                if start > m.start() and text[start - 1] == "+":
                    start -= 1
                if j - i == 3 and total >= 4:
                    yield 1, start, end
                if total >= 12:
                    yield 2, start, end
                if 7 <= total <= 15:
                    yield 3, start, end


def _class(ch: str) -> int:
    return 0 if not ch or ch.isspace() else 1 if ch.isdigit() else 2 if ch.isalpha() else 3


def features(kind: int, text: str, start: int, end: int, before: str, after: str) -> list[float]:
    """Numbers that describe the span ``text[start:end]`` and what stands around it."""
    span = text[start:end]
    groups = GROUP.findall(span)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    tail = re.split(r"\.|dot", span)[-1].strip(" )]}")
    seps = {ch for ch in span if not ch.isalnum()}
    return [
        len(span), len(digits), sum(ch.isalpha() for ch in span), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        float(span[:1] == "+"), float(span[:2] == "00" and len(digits) > 8), span.count("("), span.count("."), span.count("-"), span.count(" "), len(seps),
        max((int(g[:6]) for g in groups), default=0), float(luhn(digits)) if digits else -1, len(set(digits)),
        float("@" in span), float(re.search(r"\Wat\W", span, re.I) is not None), float(re.search(r"\Wdot\W|\[\.\]|\(\.\)", span, re.I) is not None),
        len(tail), float(tail.isalpha()), float(tail.islower()),
        _class(before[-1:]), _class(after[:1]), _class(before[-2:-1]), _class(after[1:2]),
        float(TRIGGERS[kind].search(before) is not None),
        sum(ch.isdigit() for ch in before), sum(ch.isdigit() for ch in after), sum(ch in "|,;\t" for ch in before + after),
    ]


def spoilt(kind: int, span: str, chance: Random) -> str:
    """The same datum as people hide or mistype it."""
    if kind == 0:
        at = chance.choice([" (at) ", "(at)", " [at] ", "[at]", " at "])
        dot = chance.choice([" (dot) ", "(dot)", " [dot] ", "[.]", ".", " dot "])
        name, _, host = span.rpartition("@")
        head, _, tail = host.rpartition(".")
        return f"{name}{at}{head}{dot}{tail}"
    if kind == 1:
        return span.replace(".", chance.choice(["[.]", "(.)", " . ", "-", ":", "_"]))
    if kind == 2:
        d, sep = _digits(span), chance.choice([".", "/", "_", "  ", " - "])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    bare = span.removeprefix("+")
    return chance.choice(["00" + bare, bare, "(+" + bare.replace(" ", ") ", 1), bare.replace(" ", "-"), bare.replace(" ", "/").replace("(", "").replace(")", "")])


def joined(rules: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The spans of all kinds, overlapping ones as one."""
    taken: list[tuple[int, int]] = []
    for start, end in sorted(s for spans in rules for s in spans):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], end))
        else:
            taken.append((start, end))
    return taken


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Does any of the ascending, disjoint spans meet start to end?"""
    at = bisect_left(spans, (start, -1))
    return (at < len(spans) and spans[at][0] < end) or (at > 0 and spans[at - 1][1] > start)


def examples(text: str) -> Iterator[tuple[int, int, str, list[float]]]:
    """(kind, label, name, features): what the text teaches. ``name`` is span and context: equal ones teach the same."""
    rules = rule_spans(text)
    taken = joined(rules)
    for kind, spans in enumerate(rules):
        for start, end in spans:
            before, after, span = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT], text[start:end]
            name = f"{before}\0{span}\0{after}"
            yield kind, 1, name, features(kind, text, start, end, before, after)
            for i in range(2):
                other = spoilt(kind, span, Random(f"{i}{name}"))
                yield kind, 1, f"{before}\0{other}\0{after}", features(kind, other, 0, len(other), before, after)
                # a spoilt span cut wrongly is not the datum
                cut = other[: max(1, len(other) // 2)]
                yield kind, 0, f"{before}\0{cut}\0{after}", features(kind, cut, 0, len(cut), before, other[len(cut) :] + after)
    for kind, start, end in candidates(text):
        if not _overlaps(taken, start, end):
            before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
            yield kind, 0, f"{before}\0{text[start:end]}\0{after}", features(kind, text, start, end, before, after)


class Finder:
    """Rules, models and thresholds: all that a worker needs."""

    def __init__(self, models: dict[int, tuple[boosting.Boosted, float]]):
        self.models = models

    def spans(self, text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
        """Spans of the rules by kind, and (kind, start, end) of those that the trees add."""
        rules = rule_spans(text)
        taken = joined(rules)
        added: list[tuple[float, int, int, int]] = []
        held: list[tuple[int, int, int]] = []

        def judge():
            for kind in {h[0] for h in held}:
                model, bound = self.models[kind]
                part = [h for h in held if h[0] == kind]
                x = [features(kind, text, s, e, text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]) for _, s, e in part]
                for (_, s, e), margin in zip(part, model.margins(x).tolist(), strict=True):
                    if margin >= bound:
                        added.append((-round(margin, 6), s - e, s, kind))
            held.clear()

        for kind, start, end in candidates(text):
            if kind in self.models and self.models[kind][1] < float("inf") and not _overlaps(taken, start, end):
                held.append((kind, start, end))
                if len(held) == 4096:
                    judge()
        judge()
        kept: list[tuple[int, int]] = []
        out = []
        for _, size, start, kind in sorted(added):
            end = start - size
            if not _overlaps(kept, start, end):
                kept.insert(bisect_left(kept, (start, end)), (start, end))
                out.append((kind, start, end))
        return rules, sorted(out)


def all_examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, label, h, x): what all texts teach; equal spans in equal contexts, of hash ``h``, are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        met: set[tuple[int, int, int]] = set()  # what a task has met lately is not handed on again
        out: list[tuple] = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "label", "h", "x"])

        for batch in batches:
            for t in batch.column(0):
                for kind, label, name, x in examples(t.as_py()):
                    row = kind, label, xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) >> 1
                    if row not in met:
                        met.add(row)
                        out.append((*row, [int(v) for v in x]))
                    if len(out) == HELD_EXAMPLES:
                        yield made()
                        out.clear()
                    if len(met) == KEPT_EXAMPLES:
                        met.clear()
        if out:
            yield made()

    seen = docs.select(plain_text(text).alias("text")).mapInArrow(run, "kind int, label int, h long, x array<int>")
    return seen.groupBy("kind", "label", "h").agg(F.first("x").alias("x"))


def train(docs: DataFrame, text: str = "text", chance: float = CHANCE) -> Finder:
    """Fit trees on the examples of all texts but every fourth, and thresholds on those.

    Equal spans in equal contexts count once. A kind with too few positive examples gets no model and adds nothing. An empty table
    gives rules alone.
    """
    rows = stored(all_examples(docs, text), "personal-data-examples")
    apart = F.pmod("h", F.lit(4)) == 0
    taught = rows.groupBy("kind").agg(F.sum(F.when(~apart, F.col("label"))).alias("fitted"), F.sum(F.when(apart, F.col("label"))).alias("apart"))
    kinds = [r["kind"] for r in taught.filter("fitted >= 20 and apart >= 5").collect()]
    usable = rows.filter(F.col("kind").isin(kinds))
    models = boosting.fit_all(usable.filter(~apart))
    bounds = boosting.thresholds(usable.filter(apart), models, chance, least_rows=5)
    return Finder({kind: (model, bounds[kind]) for kind, model in models.items()})


def find(docs: DataFrame, finder: Finder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans, redacted): one row per row, wherever the text lies.

    Counts and ``base`` (kind:start:end by kind, then start, comma-joined; code points, end exclusive) are of the rules;
    ``spans`` has the added ones too. In ``redacted`` every span is its kind in square brackets; overlapping spans
    become one, named after the first. Null texts are empty; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                content = t.as_py()
                rules, added = finder.spans(content)
                base = [(kind, *s) for kind, spans in enumerate(rules) for s in spans]
                every = sorted(base + added)
                shown = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in part) for part in (base, every)]
                out.append([*(len(spans) for spans in rules), *shown, redacted(content, every)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), plain_text(text).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return narrow.mapInArrow(run, f"key long, {counts}, base string, spans string, redacted string").withColumnRenamed("key", key)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, end = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind]}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])
