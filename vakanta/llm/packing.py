"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt by key into packs of about ``PACK_ROWS`` rows, each packed for itself: pieces in descending size, each
into the open bin it fills best. Where none fits, a bin opens of the size that costs least per token it can still be
filled with. At the end every bin shrinks to the cheapest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACK_ROWS = 20_000
# cost of a sequence of each permitted length: its tokens and a fixed share for handling it
CAPACITIES = {512: 544.0, 1024: 1056.0, 2048: 2080.0, 4096: 4128.0}


def word_count(text: Column) -> Column:
    """Runs without white space, and one for the end of the document."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long") + 1


def opening_size(size: int, left: int, costs: Mapping[int, float]) -> int:
    """Of the lengths that hold ``size``, the one of least cost per token out of the ``left`` to come; the shorter on a tie."""
    return min((c for c in costs if c >= size), key=lambda c: (costs[c] / min(c, left), c))


def pack(sizes: list[int], costs: Mapping[int, float]) -> list[tuple[int, int, int]]:
    """(bin, offset, final capacity) of each piece; pieces are taken as given, none above the largest length."""
    spare: list[tuple[int, int]] = []  # (room, bin), ascending
    filled: list[int] = []
    opened: list[int] = []
    placed: list[tuple[int, int]] = []
    left = sum(sizes)
    for size in sizes:
        at = bisect_left(spare, (size, -1))
        if at < len(spare):
            room, number = spare.pop(at)
        else:
            room, number = opening_size(size, left, costs), len(filled)
            filled.append(0)
            opened.append(room)
        placed.append((number, filled[number]))
        filled[number] += size
        left -= size
        if room > size:
            insort(spare, (room - size, number))
    final = [min((c for c in costs if f <= c <= o), key=lambda c: (costs[c], c)) for f, o in zip(filled, opened, strict=True)]
    return [(number, offset, final[number]) for number, offset in placed]


def best_fit(sized: DataFrame, costs: Mapping[int, float] = CAPACITIES, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Pack rows (key, n_tokens): (key, row, piece, piece_start, piece_tokens, pack, bin, bin_offset, bin_tokens, capacity).

    Documents above the largest length are cut into pieces of that length and a rest, none is dropped. Null sizes count
    as 0; documents of size 0 are one piece of size 0. ``row`` numbers rows that repeat a key within their pack. Null keys
    are keys like any other. An empty table gives no rows. A column ``salt``, if given, helps to deal rows of equal key
    and size to different packs.
    """
    largest = max(costs)
    salt = [F.col("salt") if "salt" in sized.columns else F.lit(0).alias("salt")]
    rows = sized.select(F.col("key").cast("long").alias("key"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n"), *salt)
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("t")).first()
    # long documents have many pieces: packs are counted by both
    packs = max(1, -(-total["n"] // pack_rows), -(-(total["t"] or 0) // (pack_rows * largest)))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest((F.ceil(F.col("n") / largest) - 1).cast("long"), F.lit(0).cast("long")))
    pieces = rows.select("key", "n", "salt", F.explode(starts).alias("piece"))
    pieces = pieces.select(
        "key",
        "piece",
        (F.col("piece") * largest).alias("piece_start"),
        F.least(F.col("n") - F.col("piece") * largest, F.lit(largest).cast("long")).alias("piece_tokens"),
        F.pmod(F.xxhash64("key", "piece", "n", "salt"), F.lit(packs)).alias("pack"),
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["piece_tokens", "key", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        part = part.reset_index(drop=True)
        placed = pd.DataFrame(pack(part["piece_tokens"].tolist(), costs), columns=["bin", "bin_offset", "capacity"])
        out = pd.concat([part, placed], axis=1)
        out["row"] = out.groupby(["key", "piece"], dropna=False).cumcount()
        out["bin_tokens"] = out.groupby("bin")["piece_tokens"].transform("sum")
        return out

    schema = (
        "key long, piece long, piece_start long, piece_tokens long, pack long, "
        "bin long, bin_offset long, capacity long, row long, bin_tokens long"
    )
    return pieces.groupBy("pack").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, costs: Mapping[int, float] = CAPACITIES, key: str = "doc_id", text: str = "text", pack_rows: int = PACK_ROWS) -> DataFrame:
    """``best_fit`` of whole documents by their number of words and an end; only keys and numbers move."""
    sized = docs.select(F.col(key).cast("long").alias("key"), word_count(F.col(text)).alias("n_tokens"), F.xxhash64(text).alias("salt"))
    return best_fit(sized, costs, pack_rows).withColumnRenamed("key", key)
