"""K-means on TF-IDF vectors, for many groups of documents in one job.

The vectors stay in a long table ``group, doc, weight, term, w`` and the centroids in a table with one row per
term of a group and one column per cluster. A pass joins the two, sums the products per document, assigns each
document to its nearest centroid and sums the new centroids per term, with partial sums before the
shuffle. Each group stops for itself, when a pass explains hardly more of it than the one before; its centroids then
stay. Only the number of groups still moving reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.skills import skill_list
from vakanta.functions.titles import clean_title
from vakanta.operators import lookup
from vakanta.operators.rows import counted, each
from vakanta.operators.tfidf import tfidf
from vakanta.session import checkpointed, spread_by

MAX_PASSES = 100
MIN_GAIN = 1e-4
SEED_DOCS = 512
DIGITS = 9


def _each(k: int, template: str) -> list[str]:
    """One SQL expression per cluster."""
    return [template.format(j=j) for j in range(k)]


def _nearest(values: list[str]) -> str:
    """SQL for the index of the smallest value, the first of equal ones; null if all are null.

    Values are rounded, so that the order in which sums were added up does not decide ties.
    """
    rounded = [f"round({value}, {DIGITS})" for value in values]
    return f"array_position(array({', '.join(rounded)}), least({', '.join(rounded)})) - 1"


@dataclass
class KMeans:
    """State of one run.

    ``terms`` holds the vectors, ``sizes`` the weight of documents without any term per group. ``centroids``
    has ``group, term``, for each cluster ``j`` the weight ``c{j}`` of the term and the squared length ``q{j}`` of the
    centroid, null where the group has no such cluster, and for the group ``explained``, the squared length that its
    centroids explain, and ``done``. ``small`` and ``few`` tell that centroids and groups are measured to fit a broadcast.
    """

    terms: DataFrame
    sizes: DataFrame
    group: list[str]
    doc: str
    k: int
    seed: int
    tolerance: float
    small: bool
    few: bool
    centroids: DataFrame

    def _per_group(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _of_document(self, expression: str) -> str:
        return f"{expression} over (partition by {', '.join([*self.group, self.doc])})"

    def assigned(self) -> DataFrame:
        """Vector rows with products summed per document, nearest cluster, and a mark on one row per document."""
        centroids = F.broadcast(self.centroids) if self.small else self.centroids
        rows = self.terms.join(centroids, [*self.group, "term"])
        dots = [self._of_document(f"sum(w * c{j})") + f" as dot{j}" for j in range(self.k)]
        head = f"term = {self._of_document('min(term)')} as head"
        nearest = _nearest(_each(self.k, "q{j} - 2 * dot{j}"))
        return rows.selectExpr("*", *dots, head).selectExpr("*", f"{nearest} as cluster")

    def seed_all(self, sample_docs: int = SEED_DOCS) -> None:
        """Pick all centroids of every group at once, in a number of jobs that does not depend on ``k``.

        Each group gives a sample of documents by weight (hashes stand in for random numbers), at most ``sample_docs``. One task per
        group picks from them as k-means++ does: each next one with a chance in proportion to its weight times its squared
        distance to the nearest one picked so far.
        """
        group, doc, k, seed = self.group, self.doc, self.k, self.seed
        chance = f"(pmod(xxhash64({seed}L, -1, {doc}), 1L << 53) + 0.5d) / (1L << 53)"
        heads = self.terms.groupBy(*group, doc).agg(F.max("weight").alias("weight")).withColumn("draw", F.expr(f"ln({chance}) / weight"))
        rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("draw"), doc))
        sample = heads.withColumn("draw", rank).where(F.col("draw") <= sample_docs).select(*group, doc)
        vectors = self.terms.join(sample, [*group, doc]).select(*group, doc, "weight", "term", "w")

        def pick(part):
            import math
            import random

            import pandas as pd

            docs: dict = {}
            weights = {}
            for name, weight, term, w in zip(part[doc], part["weight"], part["term"], part["w"], strict=True):
                docs.setdefault(name, {})[term] = w
                weights[name] = float(weight)
            gap = dict.fromkeys(sorted(docs), 1.0)
            chosen: list = []
            for j in range(k):
                open_ = [d for d, g in gap.items() if g > 1e-9]
                if not open_:
                    break
                best = max(open_, key=lambda d: (math.log(1 - random.Random(f"{seed}:{j}:{d}").random() * 0.999999) / (weights[d] * gap[d]), d))
                chosen.append(best)
                for d in open_:
                    mine = docs[best]
                    gap[d] = min(gap[d] if j else 2.0, max(0.0, 2 - 2 * sum(w * mine.get(t, 0.0) for t, w in docs[d].items())))
            out = pd.DataFrame({doc: chosen, "j": range(len(chosen))})
            for name in group:
                out[name] = part[name].iloc[0]
            return out[[*group, doc, "j"]]

        kinds = dict(self.terms.dtypes)
        picks = vectors.groupBy(*group).applyInPandas(pick, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, doc)), "j int"]))
        picks = checkpointed(picks)  # k rows of each group
        weights = self.terms.join(self._per_group(picks), [*group, doc]).groupBy(*group, "term").agg(*[F.max(F.when(F.col("j") == j, F.col("w"))).alias(f"p{j}") for j in range(k)])
        number = picks.groupBy(*group).agg(F.count("*").alias("picked"))
        state = self.centroids.join(weights, [*group, "term"], "left").join(self._per_group(number), group, "left")
        kept = [c for c in self.centroids.columns if c[0] not in "cq" or not c[1:].isdigit()]
        chosen = [f"if(picked > {j}, coalesce(p{j}, 0d), null) as c{j}" for j in range(k)] + [f"if(picked > {j}, 1d, null) as q{j}" for j in range(k)]
        self.centroids = checkpointed(state.selectExpr(*kept, *chosen))

    def step(self) -> int:
        """Move each centroid of the groups not done to the mean of its documents; returns how many groups still move.

        Minus the squared length that the centroids explain falls from pass to pass by as much as the total squared
        distance does. Sums per term are used several times in the plan; their shuffle is made once and reused.
        """
        k, group = self.k, self.group
        per_term = [
            *_each(k, "sum(if(cluster = {j}, weight * w, 0d)) as s{j}"),
            *_each(k, "sum(if(cluster = {j} and head, weight, 0)) as n{j}"),
            *_each(k, "max(c{j}) as c{j}"),
            *_each(k, "max(q{j}) as q{j}"),
            "max(explained) as explained",
            "max(done) as done",
        ]
        sums = self.assigned().groupBy(*group, "term").agg(*map(F.expr, per_term))

        # Documents without terms lie at the origin and belong to the shortest centroid.
        totals = sums.groupBy(*group).agg(*map(F.expr, _each(k, "sum(n{j}) as t{j}") + _each(k, "max(q{j}) as q{j}")))
        shortest = _nearest(_each(k, "q{j}"))
        counts = totals.join(self._per_group(self.sizes), group).selectExpr(
            *group, *_each(k, "t{j} + if(" + shortest + " = {j}, no_terms, 0) as m{j}")
        )
        moved = sums.join(self._per_group(counts), group).selectExpr(
            *group,
            "term",
            *_each(k, "if(m{j} > 0 and not done, s{j} / m{j}, c{j}) as c{j}"),
            *_each(k, "m{j}"),
            "explained as before",
            "done",
        )
        explained = " + ".join(_each(k, "coalesce(max(m{j}) * sum(c{j} * c{j}), 0d)"))
        lengths = (
            moved.groupBy(*group)
            .agg(
                *map(F.expr, _each(k, "sum(c{j} * c{j}) as q{j}")),
                F.expr(f"{explained} as explained"),
                F.max("before").alias("before"),
                F.max("done").alias("was_done"),
            )
            .selectExpr(
                *group,
                *_each(k, "q{j}"),
                "explained",
                f"was_done or coalesce(explained - before <= {self.tolerance}d * abs(before), false) as done",
            )
        )
        kept = moved.select(*group, "term", *_each(k, "c{j}"))
        self.centroids = checkpointed(kept.join(self._per_group(lengths), group))
        return self.centroids.where("not done").select(*group).distinct().count()

    def labels(self) -> DataFrame:
        return self.assigned().where("head").select(*self.group, self.doc, "weight", "cluster")


def kmeans(
    docs: DataFrame,
    vectors: DataFrame,
    group: list[str],
    doc: str,
    k: int,
    seed: int = S.CLUSTER_SEED,
    max_passes: int = MAX_PASSES,
    tolerance: float = MIN_GAIN,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels (``group, doc, weight, cluster``), centroids (``group, cluster, term, centroid_weight``) and, per group,
    whether it ``converged`` within ``max_passes``.

    ``docs`` has ``group, doc, weight``; ``vectors`` comes from ``tfidf``. Groups without vectors are left out. A group's
    result does not depend on the other groups.
    """
    terms = checkpointed(spread_by(vectors.select(*group, doc, "weight", "term", F.col("tfidf").alias("w")), *group, doc))
    nothing = [f"cast(null as double) as {name}{j}" for j in range(k) for name in "cq"]
    state = ["cast(null as double) as explained", "false as done"]
    centroids = checkpointed(terms.select(*group, "term").distinct().selectExpr(*group, "term", *nothing, *state))
    with_terms = terms.select(*group, doc).distinct()
    without = docs.select(*group, doc, "weight").join(with_terms, [*group, doc], "left_anti")
    sizes = checkpointed(
        without.groupBy(*group)
        .agg(F.sum("weight").alias("no_terms"))
        .join(centroids.select(*group).distinct(), group, "right")
        .fillna(0, ["no_terms"])
    )
    some = not centroids.isEmpty()
    small = lookup.measured_bytes(centroids) <= lookup.BROADCAST_BYTES
    few = lookup.measured_bytes(sizes) + sizes.count() * 64 * k <= lookup.BROADCAST_BYTES
    run = KMeans(terms, sizes, group, doc, k, seed, tolerance, small, few, centroids)
    if some:
        run.seed_all()
    for _ in range(max_passes if some else 0):
        if not run.step():
            break

    lengths = run.centroids.groupBy(*group).agg(
        *map(F.expr, _each(k, "max(q{j}) as q{j}")), F.max("done").alias("converged")
    )
    shortest = lengths.selectExpr(*group, f"{_nearest(_each(k, 'q{j}'))} as cluster")
    labels = run.labels().unionByName(without.join(shortest, group).select(*group, doc, "weight", "cluster"))
    pairs = ", ".join(_each(k, "named_struct('cluster', {j}L, 'centroid_weight', c{j})"))
    long = run.centroids.selectExpr(*group, "term", f"inline(array({pairs}))")
    return checkpointed(labels), long.where(F.col("centroid_weight").isNotNull()), lengths.select(*group, "converged")


def cluster_means(vectors: DataFrame, labels: DataFrame, group: list[str], doc: str) -> DataFrame:
    """``group, cluster, term, centroid_weight``: mean vectors of labelled documents (``group, doc, weight, cluster``)."""
    of_cluster = [*group, "cluster"]
    counts = labels.groupBy(*of_cluster).agg(F.sum("weight").alias("__n"))
    rows = vectors.select(*group, doc, "term", "tfidf").join(labels, [*group, doc])
    sums = rows.groupBy(*of_cluster, "term").agg(F.sum(F.col("tfidf") * F.col("weight")).alias("__sum"))
    return sums.join(counts, of_cluster).select(*of_cluster, "term", (F.col("__sum") / F.col("__n")).alias("centroid_weight"))


def certificate(
    docs: DataFrame, vectors: DataFrame, labels: DataFrame, centroids: DataFrame, group: list[str], doc: str, tolerance: float = 0.05
) -> DataFrame:
    """Per group: ``documents`` by weight, those ``in_one_cluster``, those ``not_nearest`` to their centroid, and the
    centroid weights ``off_mean`` by more than ``tolerance``, the bound that the last pass may still have moved them.

    Distances are recomputed from the vectors and centroids alone.
    """
    found = labels.groupBy(*group, doc).agg(F.count("*").alias("n"), F.first("cluster").alias("cluster"))
    joined = docs.select(*group, doc, "weight").join(found, [*group, doc], "left")
    counts = joined.groupBy(*group).agg(
        F.sum("weight").alias("documents"), F.sum(F.when(F.col("n") == 1, F.col("weight")).otherwise(0)).alias("in_one_cluster")
    )
    squares = centroids.groupBy(*group, "cluster").agg(F.sum(F.col("centroid_weight") ** 2).alias("q"))
    dots = (
        vectors.select(*group, doc, "term", "tfidf")
        .join(centroids, [*group, "term"])
        .groupBy(*group, doc, "cluster")
        .agg(F.sum(F.col("tfidf") * F.col("centroid_weight")).alias("dot"))
    )
    gaps = dots.join(squares, [*group, "cluster"]).withColumn("gap", F.col("q") - 2 * F.col("dot"))
    own = gaps.join(labels.select(*group, doc, F.col("cluster").alias("own")), [*group, doc])
    worst = own.groupBy(*group, doc).agg(
        F.min("gap").alias("least"), F.max(F.when(F.col("cluster") == F.col("own"), F.col("gap"))).alias("mine")
    )
    far = worst.where(F.col("mine") > F.col("least") + 1e-6).groupBy(*group).agg(F.count("*").alias("not_nearest"))
    means = cluster_means(vectors, labels, group, doc).withColumnRenamed("centroid_weight", "mean")
    apart = centroids.join(means, [*group, "cluster", "term"], "left").where(
        F.abs(F.col("centroid_weight") - F.coalesce("mean", F.lit(0.0))) > tolerance
    )
    off = apart.groupBy(*group).agg(F.count("*").alias("off_mean"))
    return counts.join(far, group, "left").join(off, group, "left").fillna(0, ["not_nearest", "off_mean"])


def top_terms(centroids: DataFrame, group: list[str], n: int = S.TOP_CLUSTER_TERMS) -> DataFrame:
    """Highest positive weights of each centroid; equal ones by term."""
    rounded = centroids.withColumn("centroid_weight", F.round("centroid_weight", DIGITS))
    order = W.partitionBy(*group, "cluster").orderBy(F.desc("centroid_weight"), F.col("term"))
    ranked = rounded.where(F.col("centroid_weight") > 0).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


@dataclass
class TitleClusters:
    """Result tables of the title clustering."""

    groups: DataFrame  # experience_level, search_term, n_titles, status, converged
    labels: DataFrame  # experience_level, search_term, clean_title, n_titles, cluster
    sizes: DataFrame  # experience_level, search_term, cluster, n_titles
    terms: DataFrame  # experience_level, search_term, cluster, rank, term, centroid_weight
    examples: DataFrame  # experience_level, search_term, cluster, rank, job_title


TITLE_GROUP = ["experience_level", "search_term"]


def cleaned_titles(df: DataFrame, levels: list[str] = S.COMPARED_LEVELS) -> DataFrame:
    """Distinct titles of each level and search term with their numbers, and their cleaned form.

    Copies are counted before anything else is done with them.
    """
    rows = df.where(F.col("experience_level").isin(levels) & F.col("search_term").isNotNull())
    counts = rows.groupBy(*TITLE_GROUP, "job_title").agg(counted(df).alias("n"))
    return counts.withColumn("clean_title", clean_title(F.col("job_title")))


def title_groups(titles: DataFrame, k: int = S.TITLE_CLUSTERS) -> DataFrame:
    """Number of usable titles of each group, and whether they are enough for ``k`` clusters."""
    usable = F.sum(F.when(F.col("clean_title") != "", F.col("n")).otherwise(0))
    groups = titles.groupBy(*TITLE_GROUP).agg(usable.alias("n_titles"))
    return groups.withColumn("status", F.when(F.col("n_titles") < k, "insufficient data").otherwise("clustered"))


def title_documents(titles: DataFrame, k: int = S.TITLE_CLUSTERS) -> DataFrame:
    """Distinct cleaned titles with their weight, for groups that have enough titles."""
    enough = title_groups(titles, k).where("status = 'clustered'")
    docs = titles.where(F.col("clean_title") != "").groupBy(*TITLE_GROUP, "clean_title")
    return docs.agg(F.sum("n").alias("weight")).join(enough, TITLE_GROUP, "left_semi")


def title_vectors(
    docs: DataFrame, stop_words: list[str] = S.GERMAN_STOP_WORDS, min_df: int = 2
) -> DataFrame:
    """TF-IDF of cleaned titles, with a vocabulary per level and search term."""
    text = docs.withColumn("__text", F.col("clean_title"))
    return tfidf(text, TITLE_GROUP, "clean_title", "__text", "weight", stop_words, min_df)


def title_clusters(
    df: DataFrame,
    k: int = S.TITLE_CLUSTERS,
    levels: list[str] = S.COMPARED_LEVELS,
    seed: int = S.CLUSTER_SEED,
    stop_words: list[str] = S.GERMAN_STOP_WORDS,
    min_df: int = 2,
    examples: int = S.CLUSTER_EXAMPLES,
    terms: int = S.TOP_CLUSTER_TERMS,
    max_passes: int = MAX_PASSES,
    tolerance: float = MIN_GAIN,
) -> TitleClusters:
    """Cluster the job titles of each level and search term.

    Examples follow the presentation order of the table, in which titles descend.
    """
    titles = checkpointed(cleaned_titles(df, levels))
    docs = checkpointed(title_documents(titles, k))
    vectors = title_vectors(docs, stop_words, min_df)
    labels, centroids, ended = kmeans(docs, vectors, TITLE_GROUP, "clean_title", k, seed, max_passes, tolerance)
    groups = (
        title_groups(titles, k)
        .join(ended, TITLE_GROUP, "left")
        .withColumn(
            "status",
            F.when((F.col("status") == "clustered") & F.col("converged").isNull(), "no features").otherwise(F.col("status")),
        )
    )
    named = labels.withColumnRenamed("weight", "n_titles")
    return TitleClusters(
        groups, named, cluster_sizes(labels), top_terms(centroids, TITLE_GROUP, terms), title_examples(titles, labels, examples)
    )


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*TITLE_GROUP, "cluster").agg(F.sum("weight").alias("n_titles"))


def title_examples(titles: DataFrame, labels: DataFrame, n: int = S.CLUSTER_EXAMPLES) -> DataFrame:
    """First ``n`` titles of each cluster, copies included: at most ``n`` distinct ones are ever needed."""
    of_cluster = [*TITLE_GROUP, "cluster"]
    found = titles.join(labels.drop("weight"), [*TITLE_GROUP, "clean_title"])
    order = W.partitionBy(*of_cluster).orderBy(F.desc("job_title"))
    first = found.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n)
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    counted = first.withColumn("__before", before).where(F.col("__before") < n)
    copies = F.sequence(F.col("__before") + 1, F.least(F.col("__before") + F.col("n"), F.lit(n)))
    return counted.select(*of_cluster, F.explode(copies).alias("rank"), "job_title")


def distinct_skills(df: DataFrame, column: str = "hard_skills") -> DataFrame:
    """Distinct skills of at least two characters."""
    return each(df, [], skill_list(F.col(column), min_length=2), "skill").distinct()


def english_stop_words() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def skill_clusters(
    df: DataFrame,
    column: str = "hard_skills",
    k: int = S.SKILL_CLUSTERS,
    seed: int = S.CLUSTER_SEED,
    stop_words: list[str] | None = None,
    max_passes: int = MAX_PASSES,
    tolerance: float = MIN_GAIN,
) -> DataFrame | None:
    """``skill, cluster`` of the distinct skills of a column; None if there are fewer than ``k`` skills."""
    skills = checkpointed(skill_documents(df, column))
    if skills.limit(k).count() < k:
        return None
    vectors = skill_vectors(skills, stop_words)
    labels, _, _ = kmeans(skills, vectors, ["skill_type"], "skill", k, seed, max_passes, tolerance)
    return labels.select("skill", "cluster")


def skill_documents(df: DataFrame, column: str = "hard_skills") -> DataFrame:
    return distinct_skills(df, column).select(F.lit(column).alias("skill_type"), "skill", F.lit(1).cast("long").alias("weight"))


def skill_vectors(skills: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    words = english_stop_words() if stop_words is None else stop_words
    return tfidf(skills.withColumn("__text", F.col("skill")), ["skill_type"], "skill", "__text", "weight", words)


def shown_skills(labels: DataFrame, n: int = S.SKILL_CLUSTER_SHOWN) -> DataFrame:
    """The report lists at most ``n`` skills of each cluster."""
    order = W.partitionBy("cluster").orderBy("skill")
    return labels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
