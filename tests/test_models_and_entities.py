import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.vectors import pair_feature
from graphloom.operators import embed as E
from graphloom.operators import entities as N
from graphloom.operators import gaps as S
from graphloom.operators import model as D
from graphloom.operators import neighbours as K
from graphloom.plans import queries as Qs
from graphloom.plans import views as W
from graphloom.plans.queries import queries

TRAIN = D.train


def grams(name):
    out = []
    for w in name.split():
        p = f" {w} "
        for n in (3, 4, 5):
            out += [p[i : i + n] for i in range(len(p) - n + 1)] if len(p) >= n else []
    return out


def test_similar_pairs_are_all_pairs(spark):
    r = random.Random(2)
    words = ["graph", "graphs", "neural", "network", "networks", "deep", "model", "models", "x1", "x2"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(120)})
    w = N.tfidf(spark.createDataFrame([(n,) for n in names] + [(None,), (names[0],)], "entity string"))
    df, vec = {}, {}
    for n in names:
        for g in set(grams(n)):
            df[g] = df.get(g, 0) + 1
    for n in names:
        v = {g: grams(n).count(g) * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g in set(grams(n))}
        size = math.sqrt(sum(x * x for x in v.values()))
        vec[n] = {g: x / size for g, x in v.items()}
    for threshold in (0.6, 0.9):
        brute = {(a, b) for a in names for b in names if a != b and sum(vec[a].get(g, 0) * x for g, x in vec[b].items()) >= threshold}
        assert {(p.a, p.b) for p in N.similar_pairs(w, threshold).collect()} == brute


def test_merge_candidates(spark):
    names = ["graph network", "graph networks", "gpt-2 decoder", "gpt-3 decoders", "networks", "the networks", "ab cd", "cd ab"]
    got = {(r.longer, r.shorter): r.risky for r in N.merge_candidates(spark.createDataFrame([(n,) for n in names], "entity string"), 0.7).collect()}
    assert got[("graph networks", "graph network")] is False and got.get(("the networks", "networks"), True)
    assert not any("gpt" in a for a, _ in got) and ("ab cd", "cd ab") not in got
    assert N.merge_candidates(spark.createDataFrame([], "entity string")).count() == 0


def vectors(spark, n, d=8, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>")


def test_knn_is_exact_over_blocks(spark):
    x, df = vectors(spark, 150)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    got = {}
    for r in K.exact_knn(df.filter("node < 40"), df, 7, block_rows=23).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert got == {i: set(np.argsort(-sims[i])[:7].tolist()) for i in range(40)}
    approx = K.hashed_knn(df, df, 7, bits=4, tables=16).collect()
    hit = sum(r.b in set(np.argsort(-sims[r.a])[:7].tolist()) for r in approx)
    assert hit / (150 * 7) > 0.9


def toy(spark, n=240):
    r = np.random.default_rng(0)
    rows = []
    for i in range(n):
        y = i % 2
        x = r.normal(size=5) + y * np.array([1.5, 0, 0, 0, -1])
        rows.append((f"a{i}", f"b{i}", 2020 + i // 2 % 4, y, [*x.tolist(), 3.0], float(x[0])))
    return spark.createDataFrame(rows, "node_a string, node_b string, cutoff_year int, label int, x array<double>, cos_sim double")


def test_training_scaling_and_evaluation(spark, tmp_path):
    f = toy(spark)
    train = f.filter("cutoff_year in (2020, 2021)")
    m = D.train(f, train_cutoffs=(2020, 2021))
    x = np.array([r.x for r in train.collect()])
    assert np.allclose(m.scaler[0], x.mean(0)) and np.allclose(m.scaler[1], x.std(0))
    y = np.array([r.label for r in train.collect()])
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    w = len(y) / (2 * np.bincount(y))[y]
    t = np.zeros(7)
    a = np.column_stack([np.ones(len(z)), z])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ t))
        reg = np.diag([0] + [1 / 0.1] * 6)
        t += np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + reg + 1e-12 * np.eye(7), a.T @ (w * (y - p)) - reg @ t)
    assert np.allclose(m.weights, t[1:], atol=1e-4)
    m.save(str(tmp_path / "m"))
    again = D.LinkModel.load(str(tmp_path / "m"))
    key = lambda d: sorted((r.node_a, round(r.probability, 9)) for r in d.collect())
    assert key(m.score(f)) == key(again.score(f)) and again.meta["dimension"] == 6
    metrics, at_k, chosen = D.evaluate(m, f, [2022], [2023])
    assert metrics.count() == 4 and metrics.filter("Method = 'Logistic Regression' and Split = 'Test'").first()["ROC-AUC"] > 0.8
    assert at_k.count() == 6 and set(chosen) == {"Logistic Regression", "Cosine Similarity"}
    with pytest.raises(ValueError, match="both classes"):
        D.train(f.filter("label = 1"))
    with pytest.raises(ValueError, match="both splits"):
        D.evaluate(m, f, [2022], [2099])
    assert math.isnan(D.accuracy(m.score(f).filter("label = 7"))) and D.accuracy(m.score(f)) > 0.7


def test_features_only_of_the_own_cutoff(spark):
    pairs = spark.createDataFrame([("a", "b", 2020, 1), ("a", "b", 2021, 0), ("a", "z", 2020, 0)], "node_a string, node_b string, cutoff_year int, label int")
    emb = spark.createDataFrame([(2020, "a", [1.0, 0.0]), (2020, "b", [1.0, 1.0]), (2021, "a", [1.0, 0.0])], "cutoff_year int, node string, vec array<float>")
    (r,) = D.pair_features(pairs, emb).collect()
    assert (r.cutoff_year, len(r.x)) == (2020, 7) and math.isclose(r.cos_sim, 1 / math.sqrt(2), rel_tol=1e-6)


def test_feature_blocks_are_the_column_functions(spark):
    r = np.random.default_rng(5)
    a, b = r.normal(size=(6, 4)), r.normal(size=(6, 4))
    a[2] = 0
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "vec_a array<double>, vec_b array<double>")
    cols = np.array([r.x for r in df.select(pair_feature(F.col("vec_a"), F.col("vec_b")).alias("x")).collect()])
    block = np.array([r.x for r in D.with_features(df).collect()])
    assert np.allclose(cols, block) and np.allclose(block, D.feature_block(a, b))
    assert D.with_features(df.limit(0)).count() == 0


def test_walks_and_embeddings(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "y")], "source string, target string")
    walks = E.random_walks(e, length=12, per_node=3).collect()
    links = {("a", "b"), ("b", "c"), ("a", "c"), ("d", "d"), ("x", "y")}
    assert len(walks) == 6 * 3 and all(len(w.path) == 12 for w in walks)
    assert all(tuple(sorted(p)) in links for w in walks for p in zip(w.path, w.path[1:]))
    assert sorted(map(str, walks)) == sorted(map(str, E.random_walks(e, length=12, per_node=3).collect()))
    both = e.withColumn("cutoff_year", F.lit(1)).union(e.limit(1).withColumn("cutoff_year", F.lit(2)))
    by = E.random_walks(both, by=("cutoff_year",), length=5, per_node=2).collect()
    assert {(w.cutoff_year, w.node) for w in by} == {(1, n) for n in "abcdxy"} | {(2, n) for n in "ab"} and all(set(w.path) == {"a", "b"} for w in by if w.cutoff_year == 2)
    many = E.skip_gram(E.random_walks(e, length=5, per_node=4), dim=3, walks_per_task=5)
    assert {r.node for r in many.collect()} == set("abcdxy")
    v = E.embed(e, dim=6, length=12, per_node=3)
    assert {r.node: len(r.vec) for r in v.collect()} == dict.fromkeys("abcdxy", 6)
    assert E.embed(e.limit(0)).count() == 0


def test_registered_walks_are_those_of_the_reference(spark, monkeypatch):
    quads = spark.createDataFrame([("alpha", "uses", "beta", "1997", "p1")], "subject string, relation string, object string, year string, paper_id string")
    asked = []
    walks = E.random_walks
    monkeypatch.setattr(W, "surfaces", lambda *_, **k: quads)
    monkeypatch.setattr(E, "random_walks", lambda rows, **k: asked.append((k["length"], k["per_node"])) or walks(rows, **k))
    got = queries()["random_walk_embeddings"](spark, "").collect()
    assert {(r.cutoff_year, r.node) for r in got} == {(c, n) for c in (*W.CUTOFFS, W.FINAL_YEAR) for n in ("alpha", "beta")}
    assert asked == [(30, 10)]  # all cutoffs walk at once


def test_registered_models_train_to_the_default_limit(monkeypatch):
    asked = []
    monkeypatch.setattr(Qs, "_model_inputs", lambda *_: (None, None, None))
    monkeypatch.setattr(Qs, "durable", lambda x: x)
    monkeypatch.setattr(D, "pair_vectors", lambda *_: None)
    monkeypatch.setattr(D, "with_features", lambda x: x)
    monkeypatch.setattr(D, "train", lambda *_, **k: asked.append(k))
    Qs._trained(None, "")
    assert "iterations" not in asked[0] and inspect.signature(TRAIN).parameters["iterations"].default == 2000


def test_gaps(spark):
    r = np.random.default_rng(1)
    names = [f"node {i}" for i in range(30)] + ["case study"]
    nodes = spark.createDataFrame([(n, n.upper()) for n in names], "id string, label string")
    edges = spark.createDataFrame([(names[i], names[(i * 7 + 1) % 30], 2018 + i % 7) for i in range(30)], "source string, target string, year int")
    emb = spark.createDataFrame([(n, r.normal(size=4).tolist()) for n in names], "node string, vec array<float>")
    pairs = spark.createDataFrame([(names[i], names[i + 1], 2024, i % 2) for i in range(28)], "node_a string, node_b string, cutoff_year int, label int")
    m = D.train(D.pair_features(pairs, emb.withColumn("cutoff_year", F.lit(2024))))
    gaps, base = S.structural_gaps(nodes, edges, emb, m, final_year=2024, k=5, top=10)
    g = gaps.orderBy("rank").collect()
    linked = {tuple(sorted(p)) for p in edges.select("source", "target").collect()}
    assert [x.rank for x in g] == list(range(1, 11)) and all((x.node_a, x.node_b) not in linked and x.node_a < x.node_b for x in g)
    assert not any("case" in x.node_a + x.node_b for x in g) and all(x.label_a == x.node_a.upper() for x in g)
    assert [x.probability for x in g] == sorted((x.probability for x in g), reverse=True) and base.count() == 10
    assert S.structural_gaps(nodes, edges.limit(0), emb, m, final_year=2024)[0].count() == 0
