import pytest
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.operators import clusters as C
from vakanta.operators import lookup as L
from vakanta.operators.tfidf import term_counts, tfidf

TITLES = [
    "Data Engineer", "Data Analyst", "Senior Data Engineer", "Process Manager", "Prozess Manager RPA", "RPA Developer",
    "RPA Entwickler", "Projektleiter IT", "IT Projektleiter", "Prompt Engineer", "Prompt Designer", "und oder", "",
]


@pytest.fixture(scope="module")
def vacancies(spark):
    rows = [("entry", "T1", TITLES[i * i % len(TITLES)]) for i in range(90)]
    rows += [("entry", "T1", "Data Engineer")] * 60  # a hot title
    rows += [("advanced", "T2", TITLES[i % len(TITLES)]) for i in range(40)]
    rows += [("entry", "T3", "x y")] * 4 + [("entry", "T4", f"unik{i}") for i in range(6)] + [(None, "T1", "Data")]
    return spark.createDataFrame(rows, "experience_level string, search_term string, job_title string")


@pytest.fixture(scope="module")
def result(vacancies):
    return C.title_clusters(vacancies)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_every_title_is_in_one_cluster(result, vacancies):
    status = {(r[0], r[1]): (r["n_titles"], r["status"]) for r in result.groups.collect()}
    assert status[("entry", "T3")] == (4, "insufficient data")
    assert status[("entry", "T4")] == (6, "no features")
    labels = result.labels.collect()
    assert len({(r[0], r[1], r["clean_title"]) for r in labels}) == len(labels)
    assert {r["cluster"] for r in labels} <= set(range(S.TITLE_CLUSTERS))
    for level, term in (("entry", "T1"), ("advanced", "T2")):
        sizes = [r["n_titles"] for r in result.sizes.where(f"experience_level = '{level}' and search_term = '{term}'").collect()]
        assert sum(sizes) == status[(level, term)][0] and 1 < len(sizes) <= S.TITLE_CLUSTERS


def test_terms_and_examples(result):
    terms = result.terms.collect()
    assert all(r["centroid_weight"] > 0 and r["rank"] <= S.TOP_CLUSTER_TERMS for r in terms)
    examples = result.examples.collect()
    assert all(1 <= r["rank"] <= S.CLUSTER_EXAMPLES for r in examples)
    sizes = {(r[0], r[1], r["cluster"]): r["n_titles"] for r in result.sizes.collect()}
    for key, size in sizes.items():
        listed = [r for r in examples if (r[0], r[1], r["cluster"]) == key]
        assert len(listed) == min(size, S.CLUSTER_EXAMPLES)
        assert sorted(listed, key=lambda r: r["rank"]) == sorted(listed, key=lambda r: r["job_title"], reverse=True)


def test_result_does_not_depend_on_partitions_or_join(result, vacancies, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)  # take the path of vocabularies that are too large to broadcast
    again = C.title_clusters(vacancies.repartition(5))
    assert as_set(again.labels) == as_set(result.labels)


def test_cost_falls_and_labels_are_nearest(spark, monkeypatch):
    docs = spark.createDataFrame([("g", t.lower(), 1 + i) for i, t in enumerate(TITLES[:11])], "g string, d string, weight long")
    vectors = tfidf(docs.withColumn("t", F.col("d")), ["g"], "d", "t", "weight", [])
    costs, step = [], C.KMeans.step

    def recorded(self):
        moving = step(self)
        costs.append(-self.centroids.agg(F.max("explained")).first()[0])
        return moving

    monkeypatch.setattr(C.KMeans, "step", recorded)
    labels, centroids, ended = C.kmeans(docs, vectors, ["g"], "d", 3)
    assert as_set(ended) == {("g", True)} and len(costs) > 1
    found = C.certificate(docs, vectors, labels, centroids, ["g"], "d").first()
    assert (found["documents"], found["in_one_cluster"], found["not_nearest"], found["off_mean"]) == (66, 66, 0, 0)
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False))

    vec, cen = {}, {}
    for r in vectors.collect():
        vec.setdefault(r["d"], {})[r["term"]] = r["tfidf"]
    for r in centroids.collect():
        cen.setdefault(r["cluster"], {})[r["term"]] = r["centroid_weight"]
    for r in labels.collect():
        gap = {
            j: sum((vec[r["d"]].get(t, 0) - c.get(t, 0)) ** 2 for t in set(c) | set(vec[r["d"]])) for j, c in cen.items()
        }
        assert gap[r["cluster"]] <= min(gap.values()) + 1e-6


def test_skill_clusters(spark):
    rows = [(", ".join(label for _, label in S.HARD_SKILLS),), ("SQL, x",), (None,)]
    df = spark.createDataFrame(rows, "hard_skills string")
    labels = C.skill_clusters(df).collect()
    assert len(labels) == len({label for _, label in S.HARD_SKILLS})
    assert {r["cluster"] for r in labels} <= set(range(S.SKILL_CLUSTERS))
    assert C.skill_clusters(df.where("hard_skills = 'SQL, x'")) is None
    shown = C.shown_skills(spark.createDataFrame([(str(i), 0) for i in range(30)], "skill string, cluster int"))
    assert shown.count() == S.SKILL_CLUSTER_SHOWN


def test_a_group_does_not_depend_on_others(spark):
    """Labels of a small group are the same alone and next to a heavy one; passes without convergence are told."""
    few = [("small", f"{a} {b} {c}", 1) for a in ("data", "rpa", "ki") for b in ("engineer", "analyst", "lead") for c in ("x1", "y1", "z1")]
    many = [("heavy", f"{TITLES[i % 11].lower()} w{i % 17} v{i % 5}", 1000 + i) for i in range(90)]

    def run(rows, **more):
        docs = spark.createDataFrame(rows, "g string, d string, weight long").distinct().groupBy("g", "d").agg(F.max("weight").alias("weight"))
        vectors = tfidf(docs.withColumn("t", F.col("d")), ["g"], "d", "t", "weight", [])
        labels, _, ended = C.kmeans(docs, vectors, ["g"], "d", 4, **more)
        return as_set(labels.where("g = 'small'")), as_set(ended)

    alone, ended = run(few, tolerance=0.0)
    assert ended == {("small", True)}
    assert run(few + many, tolerance=0.0)[0] == alone
    assert run(few, max_passes=1)[1] == {("small", False)}


def test_measured_bytes_count_texts(spark):
    df = spark.createDataFrame([("a" * 1000, 1), ("é", 2), (None, 3)], "t string, n long")
    assert L.measured_bytes(df) == 1002 + 3 * 48


def test_counts_in_the_row_equal_an_aggregate(spark):
    docs = spark.createDataFrame([(1, "b a b c und a b"), (2, ""), (3, None), (4, "zz")], "d int, t string").withColumn("g", F.lit(1))
    got = {(r["d"], r["term"], r["tf"]) for r in term_counts(docs, ["g"], "d", "t", stop_words=["und"]).collect()}
    assert got == {(4, "zz", 1)}  # words of one letter do not count
    docs = docs.withColumn("t", F.regexp_replace("t", r"(\w)", "$1$1"))
    got = {(r["d"], r["term"], r["tf"]) for r in term_counts(docs, ["g"], "d", "t", stop_words=[]).where("d = 1").collect()}
    assert {x for x in got if " " not in x[1]} == {(1, "aa", 2), (1, "bb", 3), (1, "cc", 1), (1, "uunndd", 1)}
    assert (1, "bb aa", 1) in got and (1, "aa bb", 2) in got


def test_idf_and_unit_length(spark):
    docs = spark.createDataFrame([(1, "sql spark"), (2, "sql und spark"), (3, "rpa")], "d int, t string").withColumn("g", F.lit(1))
    rows = tfidf(docs, ["g"], "d", "t").collect()
    assert {r["term"]: (r["df"], round(r["idf"], 4)) for r in rows}["sql"] == (2, 1.2877)
    assert {r["term"] for r in rows if r["d"] == 2} == {"sql", "spark", "sql spark"}
    for d in (1, 2, 3):
        assert abs(sum(r["tfidf"] ** 2 for r in rows if r["d"] == d) - 1) < 1e-9
