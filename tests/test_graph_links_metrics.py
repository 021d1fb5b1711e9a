import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.operators import metrics as M

HAND = [("a", "b", 2019), ("b", "c", 2020), ("a", "c", 2021), ("d", "d", 2020), ("a", "d", 2022), ("c", "e", 2023), ("b", "e", 2024)]


CUTS = [2020, 2022, 2023]


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(HAND, "source string, target string, year int").cache()


def test_snapshots(hand):
    got = {r.cutoff_year: (r.n_nodes, r.n_edges) for r in G.summary(hand, CUTS, 2024).collect()}
    assert got == {2020: (4, 3), 2022: (4, 5), 2023: (5, 6), 2024: (5, 7)}
    snaps = G.snapshots(hand, CUTS, 2024)
    assert {r.cutoff_year: r["count"] for r in snaps.groupBy("cutoff_year").count().collect()} == {k: v[1] for k, v in got.items()}
    assert {r.cutoff_year: r["count"] for r in G.snapshot_nodes(snaps).groupBy("cutoff_year").count().collect()} == {k: v[0] for k, v in got.items()}


def test_positives_and_negatives(spark, hand):
    pos = L.positives(hand, CUTS, 2024)
    assert {(r.cutoff_year, r.node_a, r.node_b) for r in pos.collect()} == {(2020, "a", "c"), (2020, "a", "d"), (2023, "b", "e")}
    neg = L.negatives(hand, pos, CUTS, 2024).collect()
    assert {(r.node_a, r.node_b) for r in neg if r.cutoff_year == 2020} <= {("b", "d"), ("c", "d")}
    assert sorted(r.cutoff_year for r in neg) == [2020, 2020, 2023]
    assert sorted(neg) == sorted(L.negatives(hand, pos, CUTS, 2024).collect())
    counts = L.label_counts(L.labelled(pos, spark.createDataFrame(neg))).collect()
    assert all(r.positives == r.negatives for r in counts)


def test_the_first_attempts_count(spark):
    found = spark.createDataFrame([(1, "a", "b", a) for a in range(0, 9000, 3)] + [(2, "a", "b", a) for a in (5, 900, 7)], "cutoff_year int, node_a string, node_b string, attempt long")
    need = spark.createDataFrame([(1, 1100), (2, 2)], "cutoff_year int, need long")
    got = L._first_ones(found, need).collect()
    assert sorted(r.attempt for r in got if r.cutoff_year == 1) == list(range(0, 3300, 3)) and sorted(r.attempt for r in got if r.cutoff_year == 2) == [5, 7]


def test_degrees_and_common_neighbours(spark):
    e = spark.createDataFrame(HAND, "source string, target string, year int")
    assert {r.node: r.degree for r in G.degree(e).collect()} == {"a": 3, "b": 3, "c": 3, "d": 2, "e": 2}
    pairs = spark.createDataFrame([("a", "e"), ("d", "e")], "node_a string, node_b string")
    assert {(r.node_a, r.node_b): r.common_neighbors for r in G.common_neighbours(pairs, G.neighbours(e)).collect()} == {("a", "e"): 2, ("d", "e"): 0}
    assert {r.node for r in G.active_nodes(e, 2024, 2).collect()} == {"c", "e", "b"}
    both = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("a", None)], "source string, target string")
    assert [(r.node_a, r.node_b) for r in G.undirected_pairs(both).collect()] == [("a", "b")]


def test_build(spark):
    quads = [("The BERT model", "is used", "NLP", "2020", "p1"), ("bert", "uses", "Nlp ", "2020", "p2"), ("BERT", "uses", "nlp", "2021", "p3"), ("", "uses", "x", "2020", "p4"), ("long one", "uses", "BERT", "2020", "p5")]
    df = spark.createDataFrame([(*q, k) for k, q in enumerate(quads)], "subject string, relation string, object string, year string, paper_id string, _seq long")
    merges = spark.createDataFrame([("long one", "one")], "longer string, shorter string")
    p = G.prepare(df, merges)
    e = G.edges(p).orderBy("_seq").collect()
    assert [r.key for r in e] == ["is_used:0", "uses:1", "uses:2", "uses:3"] and e[3].source == "one"
    n = G.nodes(G.surface_forms(p))
    assert {r.id: (r.label, r.n_forms) for r in n.collect()} == {"bert": ("BERT", 3), "nlp": ("NLP", 3), "one": ("long one", 1)}
    s = G.build_stats(p, n).first()
    assert (s.input, s.skipped, s.merges_applied, s.unique_entities, s.multi_form_entities) == (5, 1, 1, 3, 2)


def test_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = G.indexed(df, ["v"], "at").collect()
    assert sorted((r.v, r["at"]) for r in got) == [(i, i) for i in range(1000)]


def test_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("s", "s"), ("p", "q"), ("q", "p")], "longer string, shorter string")
    got = {r.longer: r.shorter for r in G.collapse_chains(spark, m).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "x": "y"}


def scored(spark, scores, labels, g=0):
    return spark.createDataFrame([(g, float(s), y, k) for k, (s, y) in enumerate(zip(scores, labels))], "g int, score double, label int, id long")


def test_auc_and_average_precision_golden(spark):
    c = M.cumulated(scored(spark, [0.9, 0.8, 0.8, 0.3, 0.2, 0.1], [1, 0, 1, 0, 1, 0]), ["g"])
    assert math.isclose(M.roc_auc(c, ["g"]).first().roc_auc, 0.722222, abs_tol=1e-6)
    assert math.isclose(M.average_precision(c, ["g"]).first().average_precision, 0.755556, abs_tol=1e-6)


def test_curves_by_brute_force(spark):
    r = random.Random(4)
    s = [round(r.uniform(-1, 1), 2) for _ in range(400)]
    y = [int(r.random() < (x + 1) / 2) for x in s]
    c = M.cumulated(scored(spark, s, y), ["g"], bins=16)
    won = sum((a > b) + (a == b) / 2 for a, i in zip(s, y) if i for b, j in zip(s, y) if not j)
    assert math.isclose(M.roc_auc(c, ["g"]).first().roc_auc, won / (sum(y) * (len(y) - sum(y))))
    for p in M.pr_points(c, ["g"]).collect():
        top = [j for a, j in zip(s, y) if a >= p.threshold]
        assert math.isclose(p.precision, sum(top) / len(top)) and math.isclose(p.recall, sum(top) / sum(y))


@pytest.mark.parametrize(
    ("counts", "want"),
    [((338, 293, 9, 54), (0.564841, 0.535658, 0.974063, 0.691207)), ((222, 208, 3, 17), (0.531111, 0.516279, 0.986667, 0.677863)),
     ((344, 339, 3, 8), (0.507205, 0.503660, 0.991354, 0.667961)), ((224, 224, 1, 1), (0.5, 0.5, 0.995556, 0.665676))],
)
def test_published_metrics_from_counts(spark, counts, want):
    tp, fp, fn, tn = counts
    rows = [(1.0, 1)] * tp + [(1.0, 0)] * fp + [(0.0, 1)] * fn + [(0.0, 0)] * tn
    m = M.confusion(spark.createDataFrame([(0, s, y) for s, y in rows], "g int, score double, label int"), ["g"]).first()
    assert [round(x, 6) for x in (m.accuracy, m.precision, m.recall, m.f1)] == list(want)


def test_thresholds_and_precision_at_k(spark):
    b = M.best_threshold(scored(spark, [0.9, 0.4, 0.35, 0.1], [1, 1, 0, 0]), ["g"]).first()
    assert (round(b.threshold, 2), b.f1) == (0.36, 1.0)  # the lowest of those with the best F1
    assert M.best_threshold(scored(spark, [0.0, -0.5], [1, 0]), ["g"]).first()[1:] == (0.5, -1.0)
    k = {r.k: r.precision for r in M.precision_at_k(scored(spark, [0.9, 0.8, 0.1], [1, 0, 1]), ["g"], [1, 2, 50], ["id"]).collect()}
    assert k == {1: 1.0, 2: 0.5, 50: 2 / 3}


def test_nodes_keep_no_table_of_facts(spark, monkeypatch):
    from graphloom.plans.queries import queries

    def kept(df):
        raise AssertionError("rows were kept")

    monkeypatch.setattr(G, "durable", kept)
    assert queries()["graph_nodes"](spark, "/root/testdata/sf0.001").count() == queries()["node_degree"](spark, "/root/testdata/sf0.001").count()
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v"))
    got = sorted(G.ordered(df, ["v"], "at").collect(), key=lambda r: r["at"])
    assert [r.v for r in got] == list(range(3000))


def test_keys_number_the_kept_rows_by_other_columns(spark):
    quads = [("x", "uses", "y", "2020", "p", 9), ("", "uses", "y", "2020", "p", 5), ("u", "uses", "v", "2020", "p", 1)]
    p = G.prepare(spark.createDataFrame(quads, "subject string, relation string, object string, year string, paper_id string, place long"))
    assert sorted((r.key, r.source, r._seq) for r in G.edges(p, ["place"]).collect()) == [("uses:0", "u", 0), ("uses:1", "x", 1)]


def test_draws_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "DRAWS_PER_TASK", 1000)
    got = L._attempts(spark, [(2020, 9, 0, 5000), (2021, 7, 10, 12), (2022, 5, 3, 3)])
    assert sorted(got.filter("cutoff_year > 2020").collect()) == [(2021, 7, 10), (2021, 7, 11)]
    held = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) == 6 and max(r["count"] for r in held) == 1000
    e = spark.createDataFrame([(f"n{i % 40:02d}", f"n{(i * 7 + i // 40) % 40:02d}", 2019 + i % 6) for i in range(300)], "source string, target string, year int")
    pos = L.positives(e, [2020, 2021], 2024)
    some = sorted(L.negatives(e, pos, [2020, 2021], 2024).collect())
    monkeypatch.setattr(L, "DRAWS_PER_TASK", 1 << 18)
    assert some == sorted(L.negatives(e, pos, [2020, 2021], 2024).collect())


def test_repeated_positives_are_not_fanned_out(spark):
    e = spark.createDataFrame([(f"n{i % 40:02d}", f"n{(i * 7 + i // 40) % 40:02d}", 2019 + i % 6) for i in range(300)], "source string, target string, year int")
    got = L.repeated_positives(e, [2019, 2020, 2021, 2022], 2024)
    assert "explode(filter" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = L.repeated_pairs(L.positives(e, [2019, 2020, 2021, 2022], 2024))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and got.count()


def test_walkers_alone_move(spark):
    from graphloom.operators.embed import random_walks

    e = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 3) % 20}") for i in range(20)], "source string, target string")
    walks = random_walks(e, length=3, per_node=2)
    steps = walks._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("Join Inner") == 2 and "InMemoryRelation" in steps  # a join a step, with neighbours that are kept
    assert {(r.node, len(r.path)) for r in walks.collect()} == {(f"n{i}", 3) for i in range(20)}


def test_few_similarities_at_a_time(spark, monkeypatch):
    from graphloom.operators import neighbours as K

    v = spark.createDataFrame([(i, [float((i * j) % 13) - 6 for j in range(1, 6)]) for i in range(60)], "node long, vec array<double>")
    want = sorted(K.exact_knn(v, v, 5).collect())
    monkeypatch.setattr(K, "SIMS", 100)
    assert len(want) == 300 and sorted(K.exact_knn(v, v, 5).collect()) == want


def test_tables_are_written_by_folder_without_a_sort(spark, tmp_path):
    from graphloom.sources import sinks as X

    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []

    class Table:
        sparkSession = spark
        write = property(lambda self: self)

        def mode(self, _):
            return self

        partitionBy = mode

        def parquet(self, _):
            seen.append(int(spark.conf.get(name)))

    before = spark.conf.get(name)
    X.write_table(Table(), "unused", partition_by=("g",))
    assert seen == [X.OPEN_FOLDERS] and spark.conf.get(name) == before
    X.write_table(spark.range(100).withColumn("g", F.col("id") % 12), str(tmp_path / "t"), partition_by=("g",))
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("g").count().count() == 12
