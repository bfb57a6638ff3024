"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests; DataFrame functions only.

A sketch is an array of cells (n, k, c): a digest adds itself to three cells, one in each third of the array, counting
up ``n`` and flipping ``k`` by itself and ``c`` by its check. Sketches of one size subtract cell by cell; what two
texts share cancels. Peeling takes digests out of cells that hold exactly one until nothing is left, and so recovers
which digests only one side has. Where that fails, the digests are split by hash into many small tables of ``TABLE``
expected digests; a small table that fails again is built twice as large, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import part_of, plain_text, sort_key, split_points

PARAGRAPH = r"[^\n]{1,128}\n?|\n"
BASE_CELLS = 12
TABLE = 8
RETRY_CELLS = (18, 36, 72, 144, 288)
BUCKET_ROWS = 128
MAX_BUCKETS = 4096
CHECK_SEED = 77
CELL = "struct<n:bigint,k:bigint,c:bigint>"


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: runs of up to 128 characters of a line, with the line's end."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK_SEED))


def _cells_of(key: Column, cells: int) -> list[Column]:
    """The cell in each third; the hash differs with the size, so a retry deals anew."""
    third = cells // 3
    h = F.xxhash64(key, F.lit(cells))
    return [(F.pmod(F.shiftrightunsigned(h, 21 * r), F.lit(third).cast("long")) + r * third).cast("int") for r in range(3)]


def _entries(keys: Column, cells: int) -> Column:
    def one(key):
        at = _cells_of(key, cells)
        return F.struct(key.alias("k"), _check(key).alias("c"), *[a.alias(f"i{r}") for r, a in enumerate(at)])

    return F.transform(keys, one)


def _empty_cell() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("n"), zero.alias("k"), zero.alias("c"))


def sketch(keys: Column, cells: int) -> Column:
    """Cells of an array of distinct digests."""
    third = cells // 3

    def cell(entries, j):
        mine = F.filter(entries, lambda e: F.when(j < third, e["i0"]).when(j < 2 * third, e["i1"]).otherwise(e["i2"]) == j)
        return F.aggregate(
            mine,
            _empty_cell(),
            lambda s, e: F.struct(
                (s["n"] + 1).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c")
            ),
        )

    # entries are made once, as the single element of an outer array
    made = F.transform(F.array(_entries(keys, cells)), lambda es: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: cell(es, j)))
    return F.element_at(made, 1)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(
        left,
        right,
        lambda a, b: F.struct(
            (a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c")
        ),
    )


def peel(difference: Column, cells: int) -> Column:
    """struct(ok, only_left, only_right): digests recovered from a subtracted sketch; ``ok`` if every cell came out empty.

    Each round takes all single digests at once. A sketch of few cells is done within as many rounds as it has cells.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(difference.cast(f"array<{CELL}>").alias("d"), none.alias("l"), none.alias("r"), F.lit(False).alias("done"))

    def singles(d, sign):
        one = F.filter(d, lambda x: (x["n"] == sign) & (x["c"] == _check(x["k"])))
        return F.array_distinct(F.transform(one, lambda x: x["k"]))

    def taken(d, left, right):
        out = F.concat(
            F.transform(_entries(left, cells), lambda e: F.struct(F.lit(1).cast("long").alias("n"), *[e[x].alias(x) for x in ("k", "c", "i0", "i1", "i2")])),
            F.transform(_entries(right, cells), lambda e: F.struct(F.lit(-1).cast("long").alias("n"), *[e[x].alias(x) for x in ("k", "c", "i0", "i1", "i2")])),
        )
        less = lambda x, j, es: F.aggregate(
            F.filter(es, lambda e: (e["i0"] == j) | (e["i1"] == j) | (e["i2"] == j)),
            x,
            lambda s, e: F.struct(
                (s["n"] - e["n"]).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c")
            ),
        )
        return F.element_at(F.transform(F.array(out), lambda es: F.transform(d, lambda x, j: less(x, j, es))), 1)

    def step(s, _):
        found = F.element_at(
            F.transform(
                F.array(F.struct(singles(s["d"], 1).alias("l"), singles(s["d"], -1).alias("r"))),
                lambda f: F.when(
                    (F.size(f["l"]) == 0) & (F.size(f["r"]) == 0),
                    F.struct(s["d"].alias("d"), s["l"].alias("l"), s["r"].alias("r"), F.lit(True).alias("done")),
                ).otherwise(
                    F.struct(
                        taken(s["d"], f["l"], f["r"]).alias("d"),
                        F.concat(s["l"], f["l"]).alias("l"),
                        F.concat(s["r"], f["r"]).alias("r"),
                        F.lit(False).alias("done"),
                    )
                ),
            ),
            1,
        )
        return F.when(s["done"], s).otherwise(found)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(cells, 24))), start, step)
    clean = F.transform(
        F.array(end),
        lambda s: F.struct(
            F.forall(s["d"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)).alias("ok"),
            s["l"].alias("only_left"),
            s["r"].alias("only_right"),
        ),
    )
    return F.element_at(clean, 1)


def recovered(left: Column, right: Column, cells: int) -> Column:
    """What peeling recovers from two arrays of digests, each sketched in that many cells."""
    return peel(subtract(sketch(left, cells), sketch(right, cells)), cells)


def as_text(cells: Column) -> Column:
    """A sketch as hexadecimal text: per cell 8 digits of the count, 16 of the digests, 16 of the checks."""
    pad = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(pad(c["n"], 8), pad(c["k"], 16), pad(c["c"], 16))), "")


def retried(tables: DataFrame) -> DataFrame:
    """Adds ``p``, what is recovered from the digests ``l`` and ``r`` of each row, at the first size that succeeds.

    A table that none of the sizes resolves is expected about once in 10^11; it is then compared directly.
    """
    found = tables.withColumn("p", recovered(F.col("l"), F.col("r"), RETRY_CELLS[0]))
    for cells in RETRY_CELLS[1:]:
        found = found.withColumn("p", F.when(F.col("p.ok"), F.col("p")).otherwise(recovered(F.col("l"), F.col("r"), cells)))
    plain = F.struct(F.lit(True).alias("ok"), F.array_except("l", "r").alias("only_left"), F.array_except("r", "l").alias("only_right"))
    return found.withColumn("p", F.when(F.col("p.ok"), F.col("p")).otherwise(plain))


def with_next_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, place, id, text, next_text): each row with the text of the next in descending order of keys.

    After the last row comes the first. Null keys are last, rows that repeat a key follow each other by their texts, null
    texts are empty. Rows are dealt once, into ranges of keys of about ``BUCKET_ROWS`` rows (more above ``MAX_BUCKETS``
    ranges); only the first text of each range is read again, for the range before it.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), sort_key(key).alias("key"), plain_text(text).alias("text"))
    total = docs.count()
    points = split_points(rows, "key", min(MAX_BUCKETS, -(-total // BUCKET_ROWS))) if total else []
    placed = rows.withColumn("bucket", -part_of(F.col("key"), points))  # ascending in the order wanted
    order = Window.partitionBy("bucket").orderBy(F.desc("key"), "text")
    dealt = placed.repartition("bucket")
    numbered = dealt.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    # one row for each range: at most MAX_BUCKETS
    tops = placed.groupBy("bucket").agg(F.max("key").alias("key"))
    ring = Window.orderBy("bucket")
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = tops.select("bucket", F.coalesce(F.lead("key").over(ring), F.first("key").over(every)).alias("key"))
    heads = rows.join(F.broadcast(after), "key").groupBy("bucket").agg(F.min("text").alias("head"))
    joined = numbered.join(heads, "bucket")
    return joined.select("bucket", "place", "id", "text", F.coalesce("next_text", "head").alias("next_text"))


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness to each other and to the next text's.

    Rows: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its
    last ``floor(n_chars / 2)`` code points replaced by as many of the next text's first, or all it has. Likeness is the
    share of paragraph digests that both have among those that either has, from the counts of the sketches and what
    peeling their difference recovers; 1 for two texts without any.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    base = with_next_text(docs, key, text).select(
        "*", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited")
    )
    keys = base.select(
        "bucket", "place", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *[digests(F.col(c)).alias(a) for c, a in (("text", "mine"), ("edited", "edit"), ("next_text", "next"))],
    )
    cells = keys.select("*", *[sketch(F.col(a), BASE_CELLS).alias(f"s_{a}") for a in ("mine", "edit", "next")])
    tried = cells.select(
        "*",
        peel(subtract(F.col("s_mine"), F.col("s_edit")), BASE_CELLS).alias("p_edit"),
        peel(subtract(F.col("s_mine"), F.col("s_next")), BASE_CELLS).alias("p_next"),
    )
    told = F.struct(
        "id", "n_chars", "edited_sha256", as_text(F.col("s_mine")).alias("fingerprint"), as_text(F.col("s_edit")).alias("edited_fingerprint"),
        *[F.size(a).alias(f"n_{a}") for a in ("mine", "edit", "next")],
        *[F.when(F.col(f"p_{a}.ok"), F.size(f"p_{a}.only_left")).alias(f"l_{a}") for a in ("edit", "next")],
        *[F.when(F.col(f"p_{a}.ok"), F.size(f"p_{a}.only_right")).alias(f"r_{a}") for a in ("edit", "next")],
    )
    # a row of its own carries what is known; rows for pairs that are to be tried again carry their digests only
    again = [
        F.when(
            ~F.col(f"p_{a}.ok"),
            F.struct(F.lit(number).alias("pair"), F.col("mine").alias("l"), F.col(a).alias("r"), F.lit(None).alias("told")),
        )
        for number, a in ((1, "edit"), (2, "next"))
    ]
    none = F.lit(None).cast("array<bigint>")
    known = F.struct(F.lit(0).alias("pair"), none.alias("l"), none.alias("r"), told.alias("told"))
    parts = tried.select("bucket", "place", F.explode(F.array(known, *again)).alias("x")).filter("x is not null")
    parts = parts.select("bucket", "place", "x.*")
    return _likenesses(parts, key)


def _likenesses(parts: DataFrame, key: str) -> DataFrame:
    """Finish pairs by small tables; everything stays in the partition of its bucket."""
    within = ["bucket", "place", "pair"]
    one = F.struct(F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("boolean").alias("is_left"))
    signed = F.concat(
        F.transform("l", lambda k: F.struct(k.alias("k"), F.lit(True).alias("is_left"))),
        F.transform("r", lambda k: F.struct(k.alias("k"), F.lit(False).alias("is_left"))),
    )
    tables = F.greatest(F.ceil((F.size("l") + F.size("r")) / TABLE), F.lit(1)).cast("long")
    elements = F.when(F.col("pair") == 0, F.array(one)).otherwise(signed)
    each = parts.select(*within, "told", F.when(F.col("pair") != 0, tables).alias("tables"), F.explode(elements).alias("e"))
    each = each.select(
        *within, "told", F.coalesce(F.pmod(F.xxhash64("e.k", F.lit(5)), F.col("tables")), F.lit(0)).alias("table"), "e.k", "e.is_left"
    )
    small = each.groupBy(*within, "table").agg(
        F.collect_list(F.when(F.col("is_left"), F.col("k"))).alias("l"),
        F.collect_list(F.when(~F.col("is_left"), F.col("k"))).alias("r"),
        F.first("told", ignorenulls=True).alias("told"),
    )
    found = retried(small)
    sums = [
        F.sum(F.when(F.col("pair") == number, F.size(f"p.only_{side}"))).alias(f"{side[0]}{number}")
        for number in (1, 2)
        for side in ("left", "right")
    ]
    row = found.groupBy("bucket", "place").agg(F.first("told", ignorenulls=True).alias("t"), *sums)

    def near(a, number):
        left, right = F.coalesce(f"t.l_{a}", f"l{number}"), F.coalesce(f"t.r_{a}", f"r{number}")
        union = F.col("t.n_mine") + right
        return F.when(union == 0, F.lit(1.0)).otherwise((F.col("t.n_mine") - left) / union)

    return row.select(
        F.col("t.id").alias(key), "t.n_chars", "t.edited_sha256", "t.fingerprint", "t.edited_fingerprint",
        near("edit", 1).alias("near_edited"), near("next", 2).alias("near_next"),
    )
