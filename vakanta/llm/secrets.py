"""Secret scans over a ledger of blobs: every version of a text is addressed by its content and scanned once per rule version.

``scan`` finds the (blob, rule version) pairs that the ledger does not hold yet, scans only those, and joins all findings,
old and new, back to every path. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed, plain_text


@dataclass(frozen=True)
class Rule:
    """``least`` is the number of characters that group ``group`` of a match must have."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        import hashlib

        text = f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}"
        return f"{self.kind}@{hashlib.sha256(text.encode()).hexdigest()[:16]}"


# The three kinds in the order in which equal starts are listed.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

FINDING = "blob string, version string, kind string, place int, start long, stop long"


def content_address(text: Column) -> Column:
    """SHA-256 of the text; null counts as the empty text."""
    return F.sha2(text.cast("binary"), 256)


def _matches(text: Column, rule: Rule) -> Column:
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))


def _measures(text: Column, found: Column, rule: Rule) -> Column:
    """Per match: characters since the match before, characters of the match, and whether it is long enough."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    sizes = F.transform(found, F.char_length)
    judged = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    whole = F.transform(judged, lambda m: F.char_length(m) >= rule.least)
    return F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("size"), whole.alias("fits"))


def unseen_blobs(paths: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(blob, path, todo): the blobs with rule versions that the ledger (blob, version) does not hold, and one path of each."""
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    if ledger is None:
        # not a constant: the optimizer would else scan every copy of a text before copies are told apart
        return blobs.withColumn("todo", F.when(F.col("blob").isNotNull(), wanted))
    known = ledger.filter(F.col("version").isin([r.version for r in rules]))
    known = known.groupBy("blob").agg(F.collect_set("version").alias("done"))
    todo = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(known, "blob", "left").select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0)


def find(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, version, kind, place, start, stop) of (blob, text, todo); code points, stop exclusive.

    A blob may come in several equal rows; it is counted once. Lengths between and of matches are taken in the row, where
    the text is, and added up by a window over the matches of one blob and rule, so a text with very many matches costs in
    proportion to them.
    """
    asked = [F.array_contains("todo", r.version) for r in rules]
    raw = blobs.select(
        "blob", "text", *[F.when(a, _matches(F.col("text"), r)).alias(f"m{i}") for i, (a, r) in enumerate(zip(asked, rules, strict=True))]
    )
    some = [F.size(f"m{i}") > 0 for i in range(len(rules))]
    hit = some[0]
    for s in some[1:]:
        hit = hit | s
    measured = raw.filter(hit).select(
        "blob", *[F.when(s, _measures(F.col("text"), F.col(f"m{i}"), r)).alias(f"s{i}") for i, (s, r) in enumerate(zip(some, rules, strict=True))]
    )
    each = [
        F.struct(F.lit(i).alias("place"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(f"s{i}").alias("spans"))
        for i, r in enumerate(rules)
    ]
    by_rule = measured.select("blob", F.explode(F.array(*each)).alias("r")).select("blob", "r.*").filter("spans is not null")
    once = by_rule.groupBy("blob", "place", "kind", "version").agg(F.first("spans").alias("spans"))
    spans = once.select("blob", "place", "kind", "version", F.posexplode("spans").alias("i", "m")).select(
        "blob", "place", "kind", "version", "i", "m.gap", "m.size", "m.fits"
    )
    so_far = Window.partitionBy("blob", "place", "kind", "version").orderBy("i")
    stop = F.sum((F.col("gap") + F.col("size")).cast("long")).over(so_far)
    return (
        spans.withColumn("stop", stop)
        .filter("fits")
        .select("blob", "version", "kind", "place", (F.col("stop") - F.col("size")).alias("start"), "stop")
    )


@dataclass
class Scan:
    """paths (path, blob); ledger (blob, version) and findings (blob, version, kind, place, start, stop) as they now stand."""

    paths: DataFrame
    ledger: DataFrame
    findings: DataFrame


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rules=RULES,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
) -> Scan:
    """Scan what is new in ``docs`` and return the state to keep for the next run.

    Null texts are empty blobs. Paths may be null or repeat, with equal or different texts; each row keeps its blob.
    Other columns are ignored; an empty table gives empty frames. Text moves once, by path and blob, so that a
    group of copies of any size is spread; only one row of each new blob is scanned.
    """
    paths = docs.select(F.col(key).cast("string").alias("path"), content_address(plain_text(text)).alias("blob"))
    new = unseen_blobs(paths, rules, ledger)
    texts = docs.select(F.col(key).cast("string").alias("p"), plain_text(text).alias("text")).withColumn(
        "b", content_address(F.col("text"))
    )
    chosen = texts.join(new, F.col("p").eqNullSafe(F.col("path")) & (F.col("b") == F.col("blob")))
    fresh = checkpointed(find(chosen.select("blob", "text", "todo"), rules))
    pairs = new.select("blob", F.explode("todo").alias("version"))
    if ledger is not None:
        pairs = ledger.select("blob", "version").union(pairs)
    if findings is not None:
        fresh = findings.select(*fresh.columns).union(fresh)
    return Scan(paths, pairs, fresh)


def listed(findings: DataFrame, rules=RULES) -> DataFrame:
    """(blob, n_<kind>..., places, spans): the findings of the rules' present versions, one row per blob that has any.

    ``places`` are structs (start, place, stop) in order of start, then rule; ``spans`` joins kind:start:stop by commas.
    """
    names = F.array(*[F.lit(r.kind) for r in rules])
    now = findings.filter(F.col("version").isin([r.version for r in rules]))
    counts = [F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules]
    sorted_places = F.array_sort(F.collect_list(F.struct("start", "place", "stop"))).alias("places")
    one = lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return now.groupBy("blob").agg(*counts, sorted_places).withColumn("spans", F.array_join(F.transform("places", one), ","))


def report(done: Scan, rules=RULES) -> DataFrame:
    """(path, blob, n_<kind>..., spans): one row for every row scanned, zero and empty where nothing was found.

    The list of blobs is written first: a join of two stored sides lets adaptive execution split a blob with many paths.
    """
    counts = [f"n_{r.kind}" for r in rules]
    found = checkpointed(listed(done.findings, rules).drop("places"))
    joined = done.paths.join(found, "blob", "left")
    return joined.select(
        "path", "blob", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("spans", F.lit("")).alias("spans")
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """All rows and columns, with every finding's span replaced by ``mask``; spans that touch or overlap become one mask.

    Rows without findings keep their text untouched, null included; ``n_chars``, where there is one, follows the text.
    """
    done = scan(docs, key, text, rules)
    found = checkpointed(listed(done.findings, rules).select("blob", "places"))
    where = done.paths.join(found, "blob").select("path", "blob", "places").dropDuplicates(["path", "blob"])
    t = F.col(text)
    # the end of all spans up to each, so that what lies between spans is cut out only where nothing covers it
    n = F.size("__places")
    ends = F.aggregate(
        "__places",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out")),
        lambda s, p: F.when(
            (p["start"] > s["end"]) | (F.size(s["out"]) == 0),
            F.struct(
                F.greatest(s["end"], p["stop"]).alias("end"),
                F.concat(s["out"], F.array(F.substr(t, (s["end"] + 1).cast("int"), (p["start"] - s["end"]).cast("int")), F.lit(mask))).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["end"], p["stop"]).alias("end"), s["out"].alias("out"))),
    )
    masked = F.concat(F.array_join(ends["out"], ""), F.substr(t, (ends["end"] + 1).cast("int")))
    joined = docs.withColumn("__blob", content_address(plain_text(text))).join(
        where.select(F.col("path").alias("__path"), F.col("blob").alias("__of"), F.col("places").alias("__places")),
        F.col(key).cast("string").eqNullSafe(F.col("__path")) & (F.col("__blob") == F.col("__of")),
        "left",
    )
    out = joined.withColumn(text, F.when(n > 0, masked).otherwise(t))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(n > 0, F.char_length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
