"""One query for each operator over the shared tables, keyed by name; oracles.py has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import embed as E
from graphloom.operators import entities as N
from graphloom.operators import gaps as S
from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.operators import metrics as M
from graphloom.operators import model as D
from graphloom.operators import neighbours as K
from graphloom.operators import papers as P
from graphloom.operators import quads as Q
from graphloom.operators.common import durable, shared_folder
from graphloom.operators.extract import StubExtractor, extract, quads_of
from graphloom.plans import views as W
from graphloom.plans.oracles import oracle_sql
from graphloom.sources import readers as R
from graphloom.sources import sinks as X

__all__ = ["oracle_sql", "queries", "snapshot_summary"]

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def _long(*names: str) -> dict:
    return {n: F.col(n).cast("long") for n in names}


# papers


@query
def merge_dedupe_papers(spark, sf):
    p = W.papers(spark, sf)
    first, second = p.filter("src = 'openalex'").drop("src"), p.filter("src <> 'openalex'").drop("src")
    merged = P.merge_papers(P.union_sources(("openalex", first), ("semantic_scholar", second)))
    return merged.select("source", "id", "title", "doi", F.length("abstract").cast("long").alias("n_abstract"))


@query
def merge_source_counts(spark, sf):
    p = W.papers(spark, sf)
    first, second = p.filter("src = 'openalex'").drop("src"), p.filter("src <> 'openalex'").drop("src")
    return P.count_by(P.merge_papers(P.union_sources(("openalex", first), ("semantic_scholar", second))), "source")


@query
def merge_stats(spark, sf):
    p = W.papers(spark, sf)
    return P.merge_stats(p, P.merge_papers(p))


@query
def collect_filter(spark, sf):
    return P.collect_filter(W.papers(spark, sf)).select("id", F.col("_seq").alias("seq"))


@query
def clean_papers(spark, sf):
    return P.clean_papers(P.clean_verdicts(W.papers(spark, sf))).select("id", "title", F.col("year").cast("long").alias("year"), "abstract", "cited_by_count")


@query
def clean_stats(spark, sf):
    return P.clean_stats(P.clean_verdicts(W.papers(spark, sf)))


@query
def year_distribution(spark, sf):
    c = P.clean_papers(P.clean_verdicts(W.papers(spark, sf)))
    return P.year_distribution(c).withColumns(_long("year") | {"pct": F.round("pct", 6)})


@query
def dataset_stats(spark, sf):
    s = P.dataset_stats(P.clean_papers(P.clean_verdicts(W.papers(spark, sf))))
    return s.withColumns(_long("min_year", "max_year", "words_min", "words_max") | {c: F.round(c, 6) for c in ("words_mean", "words_median", "cited_mean", "cited_median")})


@query
def holdout_split(spark, sf):
    return P.holdout_split(W.papers(spark, sf)).groupBy("split").agg(F.count("*").alias("n"))


@query
def year_quota(spark, sf):
    p = W.papers(spark, sf).withColumn("y", T.normalize_year(F.col("year")))
    return P.cap_per_group(p.filter("y is not null"), "y", 20).select(F.col("y").cast("long").alias("year"), F.col("_seq").alias("seq"))


@query
def papers_per_year(spark, sf):
    p = W.papers(spark, sf).withColumn("y", T.normalize_year(F.col("year")).cast("long"))
    return P.count_by(p.filter("y is not null"), "y")


# quadruples


@query
def quad_verdicts(spark, sf):
    c = Q.classify(W.surfaces(spark, sf), W.YEAR_FROM, W.YEAR_TO)
    return c.groupBy("subject", "relation_norm", "object", F.col("year_int").cast("long").alias("year_int"), "verdict").agg(F.count("*").alias("n"))


@query
def quad_breakdown(spark, sf):
    b = Q.breakdown(Q.classify(W.surfaces(spark, sf), W.YEAR_FROM, W.YEAR_TO))
    return b.select("reason", "n", F.round("pct", 6).alias("pct"))


@query
def clean_quads(spark, sf):
    return Q.accepted(Q.classify(W.surfaces(spark, sf), W.YEAR_FROM, W.YEAR_TO)).select("subject", "relation", "object", F.col("year").cast("long").alias("year"), "paper_id")


@query
def rejected_quads(spark, sf):
    return Q.rejected(Q.classify(W.surfaces(spark, sf), W.YEAR_FROM, W.YEAR_TO)).select("subject", "relation", "object", "year", "paper_id", F.col("_rejection_reason").alias("reason"))


@query
def llm_json_parse(spark, sf):
    return quads_of(W.replies(spark, sf))


# graph


@query
def canonical_entities(spark, sf):
    forms = G.surface_forms(G.prepare(W.kept_surfaces(spark, sf, "_seq")))
    return G.nodes(forms)


@query
def graph_edges(spark, sf):
    e = G.edges(G.prepare(W.kept_surfaces(spark, sf, "columns")), list(W.ORDER))
    return e.select("source", "target", "key", "relation", F.col("year").cast("long").alias("year"), "paper_id")


@query
def graph_nodes(spark, sf):
    p = G.prepare(W.facts(spark, sf, "_seq"))
    return G.nodes(G.surface_forms(p)).select("id", "label")


@query
def graph_summary(spark, sf):
    p = G.prepare(W.kept_surfaces(spark, sf, "_seq"), _merge_list(spark, sf))
    p = durable(p.select("source", "target", "subject", "object", "_seq", "n_merged", "ok"))
    return G.build_stats(p, G.nodes(G.surface_forms(p)))


@query
def relation_counts(spark, sf):
    return G.relation_counts(W.fact_edges(spark, sf))


def _merge_list(spark, sf):
    """Merges as a review would leave them, with chains: each supplier's name into that of a tenth of its number."""
    s = W.table(spark, sf, "supplier")
    return s.filter("s_suppkey > 0").select(F.lower("s_name").alias("longer"), F.format_string("supplier#%09d", F.floor(F.col("s_suppkey") / 10).cast("long")).alias("shorter"))


@query
def apply_merges(spark, sf):
    p = G.prepare(W.kept_surfaces(spark, sf), _merge_list(spark, sf)).filter("ok")
    return p.groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("n_merged").cast("long").alias("n_merged"))


@query
def collapse_merge_chains(spark, sf):
    return G.collapse_chains(spark, _merge_list(spark, sf))


@query
def snapshot_summary(spark, sf):
    return G.summary(W.fact_edges(spark, sf), list(W.CUTOFFS), W.FINAL_YEAR).withColumns(_long("cutoff_year"))


@query
def snapshot_nodes(spark, sf):
    return G.snapshot_nodes(W.fact_snapshots(spark, sf)).withColumns(_long("cutoff_year"))


@query
def snapshot_pairs(spark, sf):
    return G.undirected_pairs(W.fact_snapshots(spark, sf), ["cutoff_year"]).withColumns(_long("cutoff_year"))


@query
def node_degree(spark, sf):
    return G.degree(W.fact_edges(spark, sf))


@query
def active_nodes(spark, sf):
    return G.active_nodes(W.fact_edges(spark, sf), W.FINAL_YEAR, 2)


@query
def common_neighbors(spark, sf):
    e = W.steady_edges(spark, sf)
    pairs = e.select(F.col("source").alias("node_a"), F.concat(F.lit("p"), (F.substring("source", 2, 20).cast("long") + 1).cast("string")).alias("node_b")).distinct()
    return G.common_neighbours(pairs, durable(G.neighbours(e)))


# labels


def _dated(spark, sf):
    """The first year of each directed pair is all that labels need of the edges."""
    return durable(W.fact_edges(spark, sf).groupBy("source", "target").agg(F.min("year").alias("year")))


@query
def link_positives(spark, sf):
    return L.positives(W.fact_edges(spark, sf), list(W.CUTOFFS), W.FINAL_YEAR).withColumns(_long("cutoff_year"))


@query
def link_negatives(spark, sf):
    e = _dated(spark, sf)
    return L.negatives(e, L.positives(e, list(W.CUTOFFS), W.FINAL_YEAR), list(W.CUTOFFS), W.FINAL_YEAR).withColumns(_long("cutoff_year", "attempt"))


@query
def label_counts(spark, sf):
    e = _dated(spark, sf)
    pos = durable(L.positives(e, list(W.CUTOFFS), W.FINAL_YEAR))
    return L.label_counts(L.labelled(pos, L.negatives(e, pos, list(W.CUTOFFS), W.FINAL_YEAR))).withColumns(_long("cutoff_year"))


@query
def repeated_pairs(spark, sf):
    return L.repeated_positives(W.fact_edges(spark, sf), list(W.CUTOFFS), W.FINAL_YEAR)


@query
def split_by_cutoff(spark, sf):
    s = L.split_by_cutoff(W.scored_pairs(spark, sf), [2020, 2021], [2022], [2023])
    return s.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


# vectors


@query
def cosine_pairs(spark, sf):
    return W.scored_pairs(spark, sf).withColumns(_long("cutoff_year", "label"))


@query
def pair_features(spark, sf):
    e = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"), F.lit(2020).alias("cutoff_year"))
    pairs = e.select(F.col("node").alias("node_a"), (F.col("node") + 1).alias("node_b"), "cutoff_year")
    f = D.pair_features(pairs, e)
    return f.select("node_a", "node_b", F.size("x").cast("long").alias("dim"), *[F.round(F.aggregate(F.slice("x", s, n), F.lit(0.0), lambda a, v: a + v), 6).alias(c) for c, s, n in (("hadamard", 1, 64), ("l1", 65, 64), ("l2", 129, 64))], F.round("cos_sim", 6).alias("cos_sim"))


@query
def knn_candidates(spark, sf):
    e = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    return K.exact_knn(e, e, 10).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def unlinked_candidates(spark, sf):
    e = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    linked = W.scored_pairs(spark, sf).select("node_a", "node_b")
    return K.candidate_pairs(K.exact_knn(e, e, 10), linked)


# metrics


def _scored(spark, sf):
    return W.scored_pairs(spark, sf).withColumnRenamed("cutoff_year", "g").withColumns(_long("g"))


@query
def confusion_metrics(spark, sf):
    c = M.confusion(_scored(spark, sf), ["g"], 0.2)
    return c.withColumns({x: F.round(x, 6) for x in ("accuracy", "precision", "recall", "f1")})


@query
def roc_auc(spark, sf):
    return M.roc_auc(M.cumulated(_scored(spark, sf), ["g"]), ["g"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query
def average_precision(spark, sf):
    return M.average_precision(M.cumulated(_scored(spark, sf), ["g"]), ["g"]).withColumn("average_precision", F.round("average_precision", 6))


@query
def roc_points(spark, sf):
    return M.roc_points(M.cumulated(_scored(spark, sf), ["g"]), ["g"]).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query
def pr_points(spark, sf):
    return M.pr_points(M.cumulated(_scored(spark, sf), ["g"]), ["g"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query
def precision_at_k(spark, sf):
    return M.precision_at_k(_scored(spark, sf), ["g"], [10, 20, 50], ["node_a", "node_b"]).withColumns(_long("k") | {"precision": F.round("precision", 6)})


@query
def best_threshold(spark, sf):
    return M.best_threshold(_scored(spark, sf), ["g"]).withColumns({c: F.round(c, 6) for c in ("threshold", "f1")})


@query
def scaler_stats(spark, sf):
    mean, std = D.fit_scaler(W.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")))
    return spark.createDataFrame([(i, round(m, 6), round(s, 6)) for i, (m, s) in enumerate(zip(mean, std))], "i long, mean double, std double")


@query
def scaled_vectors(spark, sf):
    e = W.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v))
    return D.scale(e, D.fit_scaler(e)).select("vec_id", F.round(total, 6).alias("total"))


# entity names


@query
def char_ngram_tfidf(spark, sf):
    return N.tfidf(W.names(spark, sf)).withColumn("weight", F.round("weight", 6))


@query
def merge_candidates(spark, sf):
    return N.merge_candidates(W.names(spark, sf)).select("longer", "shorter", "similarity", "risky")


@query
def merge_map(spark, sf):
    return N.merge_map(N.merge_candidates(W.names(spark, sf)))


@query
def entity_length_hist(spark, sf):
    return N.length_histogram(W.surfaces(spark, sf).select(F.col("subject").alias("label")).filter("label is not null"))


@query
def long_entities(spark, sf):
    labels = W.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.expr("split_part(text, chr(10), 1)").alias("label"))
    return N.long_labels(labels)


@query
def entity_validity(spark, sf):
    d = W.table(spark, sf, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('case-', lang) WHEN 1 THEN split_part(text, chr(10), 1) WHEN 2 THEN '' ELSE concat('Results of ', source) END AS label")
    return d.select("doc_id", T.valid_entity(F.col("label")).alias("ok"))


@query
def gap_confidence(spark, sf):
    s = W.scored_pairs(spark, sf)
    p = F.abs(F.col("score")) * 4
    return s.select("node_a", "node_b", F.round(p, 4).alias("probability"), T.confidence_label(p).alias("confidence"))


# trained models: no SQL says the same


def _model_inputs(spark, sf):
    """Edges, embeddings by cutoff made from the vectors of parts and suppliers, and labelled pairs."""
    e = _dated(spark, sf)
    pos = durable(L.positives(e, list(W.CUTOFFS), W.FINAL_YEAR))
    pairs = L.labelled(pos, L.negatives(e, pos, list(W.CUTOFFS), W.FINAL_YEAR))
    v = W.table(spark, sf, "embeddings")
    n = v.count()
    marks = F.array(*[F.lit(c) for c in (*W.CUTOFFS, W.FINAL_YEAR)])
    nodes = G.first_years(e).select(F.explode(F.filter(marks, lambda c: c >= F.col("first_year"))).alias("cutoff_year"), "node").withColumn("vec_id", F.pmod(F.xxhash64("node", "cutoff_year"), F.lit(n)))
    emb = durable(nodes.join(v.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("cutoff_year", "node", "vec"))
    return e, pairs, emb


def _trained(spark, sf):
    e, pairs, emb = _model_inputs(spark, sf)
    feats = durable(D.pair_vectors(pairs, emb))
    return e, emb, feats, D.train(feats, train_cutoffs=tuple(W.CUTOFFS[:2]))


@query
def link_model_eval(spark, sf):
    _, _, feats, model = _trained(spark, sf)
    return D.evaluate(model, feats, [W.CUTOFFS[2]], [W.CUTOFFS[3]])[0]


@query
def structural_gaps(spark, sf):
    edges, emb, _, model = _trained(spark, sf)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("label", F.col("id"))
    now = emb.filter(F.col("cutoff_year") == W.FINAL_YEAR).select("node", "vec")
    return S.structural_gaps(nodes, edges, now, model, final_year=W.FINAL_YEAR)[0]


def _walked(spark, sf):
    """(edges, embeddings of each cutoff by walks over its snapshot) of the accepted facts."""
    facts = W.surfaces(spark, sf)
    e = durable(G.prepare(Q.accepted(Q.classify(facts, W.YEAR_FROM, W.YEAR_TO))).filter("ok").select("source", "target", F.col("year_int").alias("year")))
    snaps = durable(G.snapshots(e, list(W.CUTOFFS), W.FINAL_YEAR).select("cutoff_year", "source", "target").distinct())
    return e, E.embeddings_by_cutoff(snaps, [*W.CUTOFFS, W.FINAL_YEAR], dim=64)


@query
def random_walk_embeddings(spark, sf):
    return _walked(spark, sf)[1]


@query
def walked_gaps(spark, sf):
    """The whole chain: facts, snapshots, walks, vectors, labels, features, model, ranked gaps."""
    e, emb = _walked(spark, sf)
    emb = durable(emb)
    dated = durable(e.groupBy("source", "target").agg(F.min("year").alias("year")))
    pos = durable(L.positives(dated, list(W.CUTOFFS), W.FINAL_YEAR))
    pairs = L.labelled(pos, L.negatives(dated, pos, list(W.CUTOFFS), W.FINAL_YEAR))
    model = D.train(durable(D.pair_vectors(pairs, emb)), train_cutoffs=tuple(W.CUTOFFS[:2]))
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("label", F.col("id"))
    now = emb.filter(F.col("cutoff_year") == W.FINAL_YEAR).select("node", "vec")
    return S.structural_gaps(nodes, e, now, model, final_year=W.FINAL_YEAR)[0]


# a model of known weights: what it scores and ranks, SQL can say


def _known_model() -> D.LinkModel:
    """probability = sigmoid(3 cosine - 0.1) over the features of two vectors of 64."""
    return D.LinkModel([0.0] * 192 + [3.0], -0.1, ([0.0] * 193, [1.0] * 193), {"dimension": 193})


def _known_features(spark, sf):
    pairs = W.scored_pairs(spark, sf).drop("score")
    e = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    return D.pair_features(pairs, e.withColumn("cutoff_year", F.explode(F.array(*[F.lit(y) for y in range(2020, 2024)]))))


@query
def model_scores(spark, sf):
    where = f"{_folder(spark)}/model"
    _known_model().save(where)
    scored = D.LinkModel.load(where).score(_known_features(spark, sf))
    return scored.select("node_a", "node_b", F.round("probability", 6).alias("probability"))


@query
def model_accuracy(spark, sf):
    scored = _known_model().score(_known_features(spark, sf))
    return spark.createDataFrame([(round(D.accuracy(scored, 0.6), 6),)], "accuracy double")


def _evaluated(spark, sf):
    return D.evaluate(_known_model(), durable(_known_features(spark, sf)), [2022], [2023])


@query
def evaluation_metrics(spark, sf):
    m = _evaluated(spark, sf)[0]
    return m.select(F.col("Split").alias("split"), F.col("Method").alias("method"), F.col("Samples").alias("n"), F.col("Positive").alias("positive"),
                    *[F.round(F.col(f"`{c}`"), 6).alias(c.lower().replace("-", "_").replace(" ", "_")) for c in ("Accuracy", "Precision", "Recall", "F1", "ROC-AUC", "Average Precision")])


@query
def evaluation_report_lines(spark, sf):
    path = f"{_folder(spark)}/evaluation.md"
    X.evaluation_report(*_evaluated(spark, sf), path)
    return spark.read.text(path).filter("value like 'Threshold%' or value like '| 10 |%' or value like '| 20 |%' or value like '| 50 |%'").withColumnRenamed("value", "line")


def _vector_graph(spark, sf):
    """(nodes, edges, embeddings): each vector linked to the next three, in years by number; some labels are no entities."""
    v = W.table(spark, sf, "embeddings")
    name = lambda c: F.format_string("n%05d", c)
    nodes = v.selectExpr("format_string('n%05d', vec_id) AS id", "CASE vec_id % 10 WHEN 0 THEN NULL WHEN 1 THEN concat('case-', vec_id) ELSE concat('Node ', vec_id) END AS label")
    near = v.select("vec_id", F.explode(F.expr("array(vec_id + 1, vec_id + 2, vec_id + 3)")).alias("to"))
    edges = near.select(name(F.col("vec_id")).alias("source"), name(F.col("to")).alias("target"), (2018 + F.col("vec_id") % 7).cast("int").alias("year"))
    return nodes, edges, v.select(name(F.col("vec_id")).alias("node"), F.col("embedding").alias("vec"))


@query
def gap_candidates(spark, sf):
    nodes, edges, emb = _vector_graph(spark, sf)
    return S.find_candidates(edges, S.usable_nodes(nodes, emb), final_year=2024)


@query
def gap_report(spark, sf):
    nodes, edges, emb = _vector_graph(spark, sf)
    path = f"{_folder(spark)}/gaps"
    X.write_json_lines(S.structural_gaps(nodes, edges, emb, _known_model(), final_year=2024)[0], path)
    return R.read_json_array(spark, path, "gap", multi_line=False).drop("_seq", "type").withColumns(_long("rank"))


@query
def gap_baseline(spark, sf):
    nodes, edges, emb = _vector_graph(spark, sf)
    return S.structural_gaps(nodes, edges, emb, _known_model(), final_year=2024)[1].withColumns(_long("rank"))


@query
def undirected_with_loops(spark, sf):
    e = W.fact_edges(spark, sf).withColumn("target", F.when(F.col("year") % 2 == 0, F.col("target")).otherwise(F.col("source")))
    return G.undirected_pairs(e, loops=True)


@query
def walk_checks(spark, sf):
    """Of each node's walks: how many, how long, and how many steps are no links of the graph."""
    e = durable(W.fact_edges(spark, sf).filter("year <= 1996").select("source", "target").distinct())
    walks = durable(E.random_walks(e, length=12, per_node=3))
    links = G.undirected_pairs(e, loops=True).withColumn("linked", F.lit(1))
    steps = walks.select("node", "walk", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(least(path[i - 1], path[i]) AS node_a, greatest(path[i - 1], path[i]) AS node_b))")).alias("s")).select("node", "walk", "s.*")
    bad = steps.join(links, ["node_a", "node_b"], "left").groupBy("node").agg(F.count_if(F.col("linked").isNull()).alias("not_linked"), F.count("*").alias("steps"))
    return walks.groupBy("node").agg(F.count("*").alias("walks"), F.min(F.col("path")[0]).alias("start")).join(bad, "node")


# sources and sinks: what is written comes back


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _paper_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "year", "doi", "citationCount", F.length("abstract").cast("long").alias("n_abstract"))


@query
def json_strict_scan(spark, sf):
    path = _folder(spark)
    X.write_json_lines(W.papers(spark, sf).drop("_seq"), path)
    return _paper_columns(R.read_json_array(spark, path, "raw_paper", multi_line=False))


@query
def json_tolerant_scan(spark, sf):
    path = _folder(spark)
    X.write_json_lines(W.papers(spark, sf).drop("_seq"), path)
    W.table(spark, sf, "region").select(F.concat(F.lit('{"id": "broken '), "r_name").alias("value")).write.mode("append").text(path)
    found = R.read_json_array(spark, path, "raw_paper", strict=False, multi_line=False)
    return _paper_columns(found.unionByName(R.read_json_array(spark, path + "-missing", "raw_paper", strict=False)))


@query
def json_array_file(spark, sf):
    path = f"{_folder(spark)}/papers.json"
    some = W.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.lit("2020").alias("year"))
    X.export_json_array(some, path)
    return R.read_json_array(spark, path, "raw_paper").select("id", "title", "year", "abstract")


def _supplier_graph(spark, sf):
    s, n = W.table(spark, sf, "supplier"), W.table(spark, sf, "nation")
    both = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = s.select(F.col("s_name").alias("id"), F.lower("s_name").alias("label")).union(n.select("n_name", F.lower("n_name")))
    edges = both.select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.concat(F.lit("in:"), "s_suppkey").alias("key"), F.lit("in").alias("relation"), (2000 + F.col("s_suppkey") % 9).cast("int").alias("year"), (2000 + F.col("s_suppkey") % 9).cast("int").alias("timestamp"), F.col("s_suppkey").cast("string").alias("paper_id"))
    return nodes, edges


@query
def graph_file(spark, sf):
    path = f"{_folder(spark)}/graph.json"
    X.export_graph_json(*_supplier_graph(spark, sf), path)
    nodes, edges = R.read_graph(spark, path)
    return edges.join(nodes, F.col("source") == F.col("id")).select("source", "label", "target", "key", "relation", F.col("year").cast("long").alias("year"), "paper_id")


@query
def graphml_lines(spark, sf):
    path = f"{_folder(spark)}/graph.graphml"
    X.export_graphml(*_supplier_graph(spark, sf), path)
    return spark.read.text(path).filter("value like '<node%' or value like '<edge%'").withColumnRenamed("value", "line")


@query
def snapshot_scan(spark, sf):
    path = _folder(spark)
    X.write_table(W.fact_snapshots(spark, sf), path, partition_by=("cutoff_year",))
    every = R.read_snapshots(spark, path).groupBy("cutoff_year").agg(F.count("*").alias("n"))
    one = R.read_snapshots(spark, path, W.CUTOFFS[1]).agg(F.lit(0).alias("cutoff_year"), F.count("*").alias("n"))
    return every.union(one).withColumns(_long("cutoff_year"))


@query
def pairs_csv(spark, sf):
    path = _folder(spark)
    X.write_csv(W.scored_pairs(spark, sf).select("node_a", "node_b", "cutoff_year", "label"), path)
    return R.read_pairs(spark, path).withColumns(_long("cutoff_year", "label"))


@query
def feature_files(spark, sf):
    path = _folder(spark)
    X.write_table(_known_features(spark, sf), path)
    return R.read_features(spark, path).select("node_a", "node_b", F.size("x").cast("long").alias("dim"), F.round("cos_sim", 6).alias("cos_sim"))


@query
def embedding_files(spark, sf):
    path = _folder(spark)
    e = W.table(spark, sf, "embeddings").select((2020 + F.col("vec_id") % 4).alias("cutoff_year"), F.col("vec_id").cast("string").alias("node"), F.col("embedding").alias("vec"))
    X.write_table(e, path, partition_by=("cutoff_year",))
    return R.read_embeddings(spark, path, 2021).select("node", F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query
def merge_map_file(spark, sf):
    path = f"{_folder(spark)}/merges.json"
    X.export_merge_map(_merge_list(spark, sf), path)
    return R.read_merge_map(spark, path).unionByName(R.read_merge_map(spark, path + ".missing"))


@query
def prompt_texts(spark, sf):
    path = f"{_folder(spark)}/prompt.txt"
    X.replace_text(path, ["Year {year}; reply as {{json}}.\n", "{abstract}\n"])
    first = W.papers(spark, sf).orderBy("_seq").limit(60)
    return first.select(F.col("_seq").alias("seq"), T.render_prompt(R.read_prompt(spark, path), F.col("year"), F.col("abstract")).alias("prompt"))


@query
def papers_to_do(spark, sf):
    p = W.papers(spark, sf).filter("id is not null")
    done = p.filter("_seq % 3 = 0").select(F.col("id").alias("paper_id"))
    return R.not_done(p, done).select("id", F.col("_seq").alias("seq"))


def _echo(prompt: str) -> str:
    return "" if len(prompt) % 7 == 0 else '[{"subject": "prompt", "relation": "has length", "object": "%d", "year": 2020}]' % len(prompt)


@query
def extracted_quads(spark, sf):
    p = P.clean_papers(P.clean_verdicts(W.papers(spark, sf))).select("id", "title", F.col("year").cast("string").alias("year"), "abstract")
    p = G.indexed(p, ["id"], "_seq")
    store = _folder(spark)
    extract(p.filter("_seq < 20"), StubExtractor(_echo), "{year}|{abstract}", store)
    return extract(p, StubExtractor(_echo), "{year}|{abstract}", store)


@query
def holdout_files(spark, sf):
    path = _folder(spark)
    X.write_split(P.holdout_split(W.papers(spark, sf)).drop("_seq"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query
def dataset_report_lines(spark, sf):
    path = f"{_folder(spark)}/corpus.md"
    c = durable(P.clean_papers(P.clean_verdicts(W.papers(spark, sf))))
    X.dataset_report(P.dataset_stats(c), P.year_distribution(c), path)
    return spark.read.text(path).filter("value rlike '^([|] [0-9]|[0-9]+ papers)'").withColumnRenamed("value", "line")


@query
def merge_review_lines(spark, sf):
    path = f"{_folder(spark)}/merges.md"
    X.merge_review(durable(N.merge_candidates(W.names(spark, sf))), path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.filter("line like '| %' and line not like '| Longer%'").select((F.col("line_no") - 5).cast("long").alias("place"), "line")


@query
def vector_norms(spark, sf):
    e = W.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))
