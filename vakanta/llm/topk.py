"""Exact search for the highest inner products by eliminating candidates with a table of pivot distances.

Inner products become distances by one more coordinate: with ``M`` the largest norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and
``q' = (q, 0)`` give ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``. For a pivot ``p``, ``|d(q', p) - d(x', p)|`` is a lower bound
of the distance; the largest over all pivots bounds the inner product from above. The pivots are far apart from each other, one set for
all; every candidate's distances to them are computed once and stored beside it. A query starts with the k-th best score
that a small set of candidates gives it, passes over all whose bound is below, evaluates the others in the order of their
bounds and stops exactly where no bound left reaches its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed

PIVOTS = 64
SAMPLE_ROWS = 2048
BLOCK_ROWS = 16_384
QUERY_ROWS = 8192
STEP = 256


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(key, row, v array<double>): every component as ``floor(scale * x)``, whole numbers; ``row`` tells all rows apart.

    Rows with a null key or vector, or with a null or non-finite component (before or after scaling), take no part. Rows
    that repeat a key all count, each with its own vector. Store the result before it is used twice: ``row`` is given where a
    row is read.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    fit = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    whole = F.transform(wide, lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    some = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fit)
    return some.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), whole.alias("v"))


def _matrix(rows, width: int):
    """Rows of whole doubles, shorter ones filled up with zeros."""
    import numpy as np

    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _exact(matrix, q):
    """Inner products as Python or numpy integers, exact at any size."""
    import numpy as np

    if len(q) == 0 or len(matrix) == 0:
        return np.zeros(len(matrix), dtype=np.int64)
    if float(np.abs(matrix).max()) * float(np.abs(q).max()) * len(q) < 2.0**53:
        return (matrix @ q).astype(np.int64)
    whole = [int(x) for x in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in matrix.tolist()], dtype=object)


def _squares(a, b):
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


class Pivots:
    """Pivots in the lifted space, and the largest squared norm of all candidates."""

    def __init__(self, sample, top: float, number: int):
        """Each pivot is the vector of the sample farthest from those before."""
        import numpy as np

        self.top, self.width = top, sample.shape[1]
        lift = self.lift(sample)
        chosen = [0] if len(sample) else []
        near = np.full(len(sample), np.inf)
        while len(chosen) < min(number, len(sample)):
            last = chosen[-1]
            near = np.minimum(near, np.nan_to_num(((sample - sample[last]) ** 2).sum(axis=1) + (lift - lift[last]) ** 2, nan=0.0))
            chosen.append(int(near.argmax()))
        self.vectors, self.lifts = sample[chosen], lift[chosen]

    def lift(self, rows):
        import numpy as np

        return np.sqrt(np.maximum(self.top - (rows * rows).sum(axis=1), 0.0))

    def distances(self, rows, lift):
        import numpy as np

        both = np.zeros((len(rows), max(self.width, rows.shape[1])))
        both[:, : rows.shape[1]] = rows
        pivots = np.zeros((len(self.vectors), both.shape[1]))
        pivots[:, : self.width] = self.vectors
        return np.sqrt(np.maximum(_squares(both, pivots) + (lift[:, None] - self.lifts[None, :]) ** 2, 0.0))


def _best(scores, keys, k: int):
    """Positions of the k highest scores, ties to the smaller key."""
    import numpy as np

    if len(scores) > k and scores.dtype != object:
        part = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return part[np.lexsort((keys[part], -scores[part]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], keys[i]))[:k], dtype=np.int64)


def _search(queries, query_rows, floors, apart, keys, rows, matrix, held, pivots: Pivots, k: int):
    """Yield (query's place, positions, scores, evaluated) of one block of candidates, at most k each.

    ``apart`` are the queries' distances to the pivots, ``held`` the candidates'; ``floors`` are scores that the k-th best reaches.
    """
    import numpy as np

    q_norms = (queries * queries).sum(axis=1)
    columns = np.ascontiguousarray(held.T)
    for i in range(len(queries)):
        low = np.zeros(len(keys))
        for p in range(len(columns)):
            np.maximum(low, np.abs(columns[p] - apart[i, p]), out=low)
        # rounding: distances carry relative errors of about 1e-15 of the largest square, widened here to 1e-9
        bound = (q_norms[i] + pivots.top - low * low) / 2 + 1e-9 * (q_norms[i] + pivots.top + 1.0)
        bound = np.where(np.isnan(bound), np.inf, bound)
        open_ = np.flatnonzero((bound >= floors[i]) & (rows != query_rows[i]))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        start, step = 0, STEP
        while start < len(order) and (len(at) < k or bound[order[start]] >= scores[-1]):
            part = order[start : start + step]
            at, scores = np.concatenate([at, part]), np.concatenate([scores, _exact(matrix[part], queries[i])])
            first = _best(scores, keys[at], k)
            at, scores = at[first], scores[first]
            start, step = start + len(part), 2 * step
        yield i, at, scores, start


def _stack(column, width: int | None = None):
    return _matrix(column, max(map(len, column), default=0) if width is None else width)


def _held(n: int) -> int:
    return min(max(int(n), -(2**63)), 2**63 - 1)


def with_distances(vectors: DataFrame, pivots: Pivots, lifted: bool) -> DataFrame:
    """The vectors with ``d``, their distances to the pivots; candidates are lifted, queries are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = _stack(batch.column(2).to_pylist())
            d = pivots.distances(rows, pivots.lift(rows) if lifted else np.zeros(len(rows)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], ["key", "row", "v", "d"])

    return vectors.select("key", "row", "v").mapInArrow(run, "key long, row long, v array<double>, d array<double>")


def _with_floors(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """The queries with ``floor``, the k-th best score that the sample gives; minus infinity if it is too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, rows = (np.array([r[i] for r in sample], dtype=np.int64) for i in (0, 1))
        matrix = _stack([r[2] for r in sample])
        for batch in batches:
            floors = []
            for row, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                q = np.zeros(matrix.shape[1])
                q[: len(v)] = v[: len(q)]
                others = rows != row
                scores = _exact(matrix[others], q)
                best = _best(scores, keys[others], k)
                floors.append(float(scores[best[-1]]) if len(best) == k else float("-inf"))
            # a float may lie above the whole number it stands for
            floors = [np.nextafter(f, float("-inf")) for f in floors]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64())], ["key", "row", "v", "d", "floor"])

    return queries.mapInArrow(run, "key long, row long, v array<double>, d array<double>, floor double")


def _met(queries: DataFrame, candidates: DataFrame, k: int, pivots: int) -> DataFrame:
    """(query_id, query_row, block, vec_id, score, evaluated, held): the k best of each meeting of a query and a block of candidates;
    a row without ``vec_id`` where a block has none."""
    sizes = queries.agg(F.count("*").alias("n")).first()["n"], candidates.agg(F.count("*").alias("n")).first()["n"]
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = candidates.agg(F.max(norm).alias("top")).first()["top"] or 0.0
    # as many rows as SAMPLE_ROWS at most, whatever the table's size
    sample = [(r["key"], r["row"], list(r["v"])) for r in candidates.orderBy(F.xxhash64("key", "v"), "row").limit(SAMPLE_ROWS).collect()]
    table = Pivots(_stack([r[2] for r in sample]), float(top), pivots)
    stored = checkpointed(with_distances(candidates, table, lifted=True))
    asking = checkpointed(_with_floors(with_distances(queries, table, lifted=False), sample, k))
    sets, blocks = -(-max(1, sizes[0]) // QUERY_ROWS), -(-max(1, sizes[1]) // BLOCK_ROWS)
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asking.withColumn("qset", deal(sets)).withColumn("block", every(blocks))
    right = stored.withColumn("block", deal(blocks)).withColumn("qset", every(sets))

    def meet(ask: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = ["query_id", "query_row", "block", "vec_id", "score", "evaluated", "held"]
        if ask.empty or held.empty:
            return pd.DataFrame({n: pd.array([], dtype="Int64") for n in names})
        width = max(max(map(len, ask["v"])), max(map(len, held["v"])))
        keys, out = held["key"].to_numpy(), []
        asked = _stack(ask["v"], width), ask["row"].to_numpy(), ask["floor"].to_numpy(), np.stack(ask["d"])
        found = _search(*asked, keys, held["row"].to_numpy(), _stack(held["v"], width), np.stack(held["d"]), table, k)
        names_of = ask["key"].to_numpy()
        for i, at, scores, seen in found:
            mine = (int(names_of[i]), int(asked[1][i]), int(held["block"].iloc[0]))
            out += [(*mine, int(keys[a]), _held(s), seen, len(keys)) for a, s in zip(at.tolist(), scores.tolist(), strict=True)]
            if not len(at):
                out.append((*mine, None, None, seen, len(keys)))
        return pd.DataFrame(out, columns=names).astype("Int64")

    return (
        left.groupBy("qset", "block")
        .cogroup(right.groupBy("qset", "block"))
        .applyInPandas(meet, "query_id long, query_row long, block long, vec_id long, score long, evaluated long, held long")
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k highest inner products of each query over all rows but its own.

    Both inputs are (key, row, v array<double> of whole numbers), stored; ``row`` is unique, and a query that is also a candidate has
    the same ``row`` there. Rows that repeat a key are queries and candidates like any other, told apart by ``query_row``.
    Shorter vectors count as filled up with zeros, so an empty vector scores 0 everywhere. Equal scores go to the smaller
    key; fewer candidates give fewer rows. Scores are exact; those beyond 64 bits are held at the ends of that range.
    No candidates or queries give no rows.

    Candidates are dealt into blocks of about ``BLOCK_ROWS``, queries into sets of about ``QUERY_ROWS``; each meeting of a block
    and a set is one group and returns at most k rows per query, which are then ranked. A candidate is sent once per
    set of queries.
    """
    near = _met(queries, candidates, k, pivots).filter("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    ranked = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")


def evaluated_share(queries: DataFrame, candidates: DataFrame, k: int = 5, pivots: int = PIVOTS) -> float:
    """The share of all pairs of query and candidate whose inner product was computed, apart from the sample's."""
    once = _met(queries, candidates, k, pivots).groupBy("query_row", "block").agg(F.first("held").alias("held"), F.first("evaluated").alias("evaluated"))
    row = once.agg(F.sum("evaluated").alias("e"), F.sum("held").alias("h")).first()
    return (row["e"] or 0) / row["h"] if row["h"] else 0.0
