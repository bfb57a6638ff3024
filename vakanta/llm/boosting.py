"""Small gradient-boosted trees with logistic loss, and a calibrated threshold, fitted on all rows of a table.

Trees see rows through bins of their features only, so equal binned rows become one row with a weight. Every level of a tree is a pass:
tasks add up gradients by node, feature and bin, and the splits are chosen on the sums. Sums are of whole numbers, so models do
not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed

BINS = 32
ROUNDS = 40
DEPTH = 3
SCALE = 1 << 24  # of gradients as whole numbers
TASK_ROWS = 1 << 17
KEPT_ROUNDS = 10  # trees whose margins are found anew in every pass
MOST_PARTS = 64


class Boosted:
    """Sum of trees over binned features. ``cuts`` has the bin edges of each feature; a tree is (feature, edge, left, right, value)."""

    def __init__(self, cuts, trees, start: float):
        self.cuts, self.trees, self.start = cuts, trees, start

    def margins(self, x):
        """Log-odds of each row."""
        import numpy as np

        binned = self.binned(np.asarray(x, dtype=np.float64))
        return raised(np.full(len(binned), self.start), binned, self.trees)

    def binned(self, x):
        import numpy as np

        return np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)])


def nodes(binned, tree):
    """The node of the tree where each row ends."""
    import numpy as np

    feature, edge, left, right, _ = tree
    node = np.zeros(len(binned), dtype=np.int64)
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        at = np.maximum(feature[node], 0)
        down = np.where(binned[np.arange(len(node)), at] <= edge[node], left[node], right[node])
        node = np.where(inner, down, node)


def raised(margins, binned, trees):
    """Margins with those of the trees added one after the other."""
    for tree in trees:
        margins = margins + tree[4][nodes(binned, tree)]
    return margins


class Growth:
    """A model that grows by a level at a time: every split is the one of most gain over histograms; ties to the first."""

    def __init__(self, cuts, rows: int, positives: int, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0):
        import numpy as np

        share = (positives + 1) / (rows + 2)
        self.model = Boosted(cuts, [], float(np.log(share / (1 - share))))
        self.rate, self.ridge, self.least = rate, ridge, least
        self.plant()

    def plant(self) -> None:
        """Begin a tree."""
        self.parts = ([-1], [0], [0], [0], [0.0])
        self.open = [0]

    def tree(self):
        import numpy as np

        return tuple(np.array(part) for part in self.parts)

    def histograms(self, binned, labels, weights, margins):
        """Sums (node, gradient or curvature, feature, bin) of the rows in open nodes."""
        import numpy as np

        p = 1 / (1 + np.exp(-margins))
        place = np.full(len(self.parts[0]), -1)
        place[self.open] = np.arange(len(self.open))
        place = place[nodes(binned, self.tree())]
        inside = place >= 0
        place, binned = place[inside] * BINS, binned[inside]
        out = np.empty((len(self.open), 2, binned.shape[1], BINS), dtype=np.int64)
        for i, slope in enumerate((p - labels, p * (1 - p))):
            whole = (np.rint(slope * SCALE) * weights)[inside]  # sums of whole numbers below 2^53 are exact
            for f in range(binned.shape[1]):
                out[:, i, f] = np.bincount(place + binned[:, f], whole, len(self.open) * BINS).reshape(-1, BINS)
        return out

    def grow(self, sums, last: bool) -> None:
        """Split the open nodes; nodes below the ``last`` level stay closed."""
        import numpy as np

        feature, edge, left, right, value = self.parts
        opened = []
        for node, (gs, hs) in zip(self.open, sums / SCALE, strict=True):
            g, h = gs[0].sum(), hs[0].sum()
            if node == 0:
                value[0] = -self.rate * g / (h + self.ridge)
            best = (1e-9, -1, 0, 0.0, 0.0)
            for f, cuts in enumerate(self.model.cuts):
                below, weight = np.cumsum(gs[f])[: len(cuts)], np.cumsum(hs[f])[: len(cuts)]
                gain = below**2 / (weight + self.ridge) + (g - below) ** 2 / (h - weight + self.ridge) - g**2 / (h + self.ridge)
                gain[(weight < self.least) | (h - weight < self.least)] = 0
                if len(gain) and gain.max() > best[0] + 1e-9:
                    at = int(gain.argmax())
                    best = (float(gain[at]), f, at, below[at], weight[at])
            if best[1] >= 0:
                feature[node], edge[node], left[node], right[node] = best[1], best[2], len(feature), len(feature) + 1
                for down, curved in ((best[3], best[4]), (g - best[3], h - best[4])):
                    opened.append(len(feature))
                    for part, new in zip(self.parts, (-1, 0, 0, 0, -self.rate * down / (curved + self.ridge)), strict=True):
                        part.append(new)
        self.open = [] if last else opened

    def finish(self) -> None:
        """Take the tree into the model and begin the next."""
        self.model.trees.append(self.tree())
        self.plant()


def fit(x, y, rounds: int = ROUNDS, depth: int = DEPTH) -> Boosted:
    """Newton boosting on rows held in memory: the same model that ``fit_all`` finds."""
    import numpy as np

    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for i in range(x.shape[1])]
    growth = Growth(cuts, len(y), int(y.sum()))
    binned = growth.model.binned(x)
    margins, weights = np.full(len(y), growth.model.start), np.ones(len(y))
    for _ in range(rounds):
        for level in range(depth):
            growth.grow(growth.histograms(binned, y, weights, margins), level == depth - 1)
        growth.finish()
        margins = raised(margins, binned, growth.model.trees[-1:])
    return growth.model


# --- on tables (kind int, label int, x array<int>), a model for each kind ------------------------------------------------


def _matrix(column: pa.Array):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _cuts(rows: DataFrame) -> dict[int, list]:
    """Bin edges of each kind's features: the values at whole 32nds of the rows in order, each once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            kinds, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for kind in np.unique(kinds).tolist():
                for f, values in enumerate(x[kinds == kind].T):
                    found, n = np.unique(values, return_counts=True)
                    columns = [pa.array(np.full(len(found), c, dtype=np.int32)) for c in (kind, f)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found.astype(np.int32)), pa.array(n)], ["kind", "feature", "value", "n"])

    counted = rows.select("kind", "x").mapInArrow(count, "kind int, feature int, value int, n long").groupBy("kind", "feature", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("kind", "feature")
    placed = counted.withColumns({"total": F.sum("n").over(whole), "end": F.sum("n").over(whole.orderBy("value"))})
    chosen = f"exists(sequence(1, {BINS - 1}), i -> (total - 1) * i div {BINS} >= end - n and (total - 1) * i div {BINS} < end)"
    out: dict[int, list] = {}
    for r in placed.filter(chosen).orderBy("kind", "feature", "value").collect():  # at most BINS - 1 of each feature
        features = out.setdefault(r["kind"], [])
        if len(features) <= r["feature"]:
            features.append([])
        features[r["feature"]].append(r["value"])
    return out


def _weighted(rows: DataFrame, models: dict[int, Boosted]) -> DataFrame:
    """(kind, label, bins, w, margin) of the kinds with a model: one row for all whose bins and label are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            kinds, labels, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for kind in np.unique(kinds).tolist():
                own = kinds == kind
                bins = models[kind].binned(x[own]).astype(np.uint8)
                columns = [pa.array(kinds[own]), pa.array(labels[own]), pa.array([b.tobytes() for b in bins], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "label", "bins"])

    binned = rows.filter(F.col("kind").isin(list(models))).select("kind", "label", "x").mapInArrow(run, "kind int, label int, bins binary")
    start = F.element_at(F.create_map(*[F.lit(v) for kind, model in models.items() for v in (kind, model.start)]), F.col("kind"))
    return binned.groupBy("kind", "label", "bins").agg(F.count("*").alias("w")).withColumn("margin", start)


def _by_kind(batch: pa.RecordBatch):
    """(kind, labels, bins, weights, margins) of the weighted rows."""
    import numpy as np

    kinds, labels, _, weights, margins = (None if i == 2 else c.to_numpy() for i, c in enumerate(batch.columns))
    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(kinds), -1).astype(np.int64)
    for kind in np.unique(kinds).tolist():
        own = kinds == kind
        yield kind, labels[own], bins[own], weights[own], margins[own]


def _level(rows: DataFrame, parts: int, growths: dict[int, Growth], since: int) -> dict:
    """Sums of the open nodes of each kind: one pass of all rows. Where tasks are many, their sums are added up in tasks first."""
    open_kinds = {kind: g for kind, g in growths.items() if g.open}
    shape = {kind: (len(g.open), 2, len(g.model.cuts), BINS) for kind, g in open_kinds.items()}

    def packed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["kind", "sums"])

    def unpacked(kind: int, raw: bytes):
        import numpy as np

        return np.frombuffer(raw, dtype=np.int64).reshape(shape[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for kind, labels, bins, weights, margins in _by_kind(batch):
                if kind in open_kinds:
                    growth = open_kinds[kind]
                    sums[kind] = sums.get(kind, 0) + growth.histograms(bins, labels, weights, raised(margins, bins, growth.model.trees[since:]))
        yield packed(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[kind] = sums.get(kind, 0) + unpacked(kind, raw)
        yield packed(sums)

    found = rows.mapInArrow(run, "kind int, sums binary")
    while parts > MOST_PARTS:
        parts = -(-parts // MOST_PARTS)
        found = found.repartition(parts).mapInArrow(add, "kind int, sums binary")
    out: dict = {}
    for r in found.collect():  # 16 KB a node, from MOST_PARTS tasks at most
        out[r["kind"]] = out.get(r["kind"], 0) + unpacked(r["kind"], r["sums"])
    return out


def _raised(rows: DataFrame, models: dict[int, Boosted], since: int) -> DataFrame:
    """The weighted rows with the trees from ``since`` on added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for kind, labels, bins, weights, margins in _by_kind(batch):
                more = raised(margins, bins, models[kind].trees[since:])
                raw = pa.array([b.tobytes() for b in bins.astype(np.uint8)], pa.binary())
                columns = [pa.array(np.full(len(labels), kind, dtype=np.int32)), pa.array(labels), raw, pa.array(weights), pa.array(more)]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "label", "bins", "w", "margin"])

    return rows.mapInArrow(run, rows.schema)


def fit_all(rows: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> dict[int, Boosted]:
    """A model for each kind, fitted on all its rows."""
    totals = {r["kind"]: r for r in rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("label").alias("positives")).collect()}
    growths = {kind: Growth(cuts, totals[kind]["n"], totals[kind]["positives"]) for kind, cuts in _cuts(rows).items()}
    models = {kind: growth.model for kind, growth in growths.items()}
    if not models:
        return {}
    weighted = checkpointed(_weighted(rows, models))
    parts, since = -(-weighted.count() // TASK_ROWS), 0
    held = checkpointed(weighted.repartition(parts))
    for number in range(rounds):
        if number - since == KEPT_ROUNDS:
            held, since = checkpointed(_raised(held, models, since)), number
        for level in range(depth):
            sums = _level(held, parts, growths, since)
            for kind, growth in growths.items():
                if growth.open:
                    growth.grow(sums[kind], level == depth - 1)
        for growth in growths.values():
            growth.finish()
    return models


def thresholds(rows: DataFrame, models: dict[int, Boosted], chance: float, least_rows: int = 20) -> dict[int, float]:
    """``threshold`` of each kind over all rows: neighbours are pooled in ranges of margins first, then among what is left."""
    if not models:
        return {}

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, blocks = None, []

        def done():
            columns = [pa.array([kind] * len(blocks), pa.int32()), *(pa.array([b[i] for b in blocks], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["kind", "margin", "positives", "n"])

        for batch in batches:
            for k, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != kind and blocks:
                    yield done()
                    blocks.clear()
                kind = k
                add_block(blocks, block)
        if blocks:
            yield done()

    judged = _raised(_weighted(rows, models), models, 0).groupBy("kind", "margin").agg(F.sum(F.col("label") * F.col("w")).alias("positives"), F.sum("w").alias("n"))
    ordered = judged.repartitionByRange("kind", "margin").sortWithinPartitions("kind", "margin")
    found: dict[int, list] = {kind: [] for kind in models}
    for r in sorted(ordered.mapInArrow(pool, "kind int, margin double, positives long, n long").collect()):
        add_block(found[r["kind"]], [r["margin"], r["positives"], r["n"]])
    return {kind: _first_above(blocks, chance, least_rows) for kind, blocks in found.items()}


# --- calibration --------------------------------------------------------------------------------------------------------


def add_block(blocks: list[list], block: list) -> None:
    """Add the next [lowest margin, positives, rows]; neighbours whose chances would fall, or stay, are pooled."""
    if blocks and blocks[-1][0] == block[0]:
        blocks[-1][1] += block[1]
        blocks[-1][2] += block[2]
    else:
        blocks.append(list(block))
    while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
        _, positives, rows = blocks.pop()
        blocks[-1][1] += positives
        blocks[-1][2] += rows


def _blocks(margins, y) -> list[list]:
    import numpy as np

    order = np.argsort(margins, kind="stable")
    blocks: list[list] = []
    for m, label in zip(np.asarray(margins)[order].tolist(), np.asarray(y)[order].tolist(), strict=True):
        add_block(blocks, [m, label, 1])
    return blocks


def isotonic(margins, y):
    """Rising steps (margins, chances) by pooling neighbours that would fall: chances as seen on rows kept apart."""
    blocks = _blocks(margins, y)
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


def _first_above(blocks: list[list], chance: float, least_rows: int) -> float:
    if sum(b[1] for b in blocks) < least_rows:
        return float("inf")
    return min((m for m, positives, n in blocks if positives / n >= chance), default=float("inf"))


def threshold(margins, y, chance: float, least_rows: int = 20) -> float:
    """The smallest margin from which on the calibrated chance is at least ``chance``; infinite if too few rows tell."""
    return _first_above(_blocks(margins, y), chance, least_rows)
