"""The stages put together: papers to a temporal graph, then labels, a model, its evaluation and structural gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.operators import embed as E
from graphloom.operators import entities as N
from graphloom.operators import gaps as S
from graphloom.operators import graph as G
from graphloom.operators import links as L
from graphloom.operators import model as D
from graphloom.operators import papers as P
from graphloom.operators import quads as Q
from graphloom.operators.common import durable
from graphloom.operators.extract import Extractor, extract
from graphloom.sources import readers as R
from graphloom.sources import sinks as W


@dataclass(frozen=True)
class Layout:
    """Where each stage leaves its table under a root that Spark can write."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root}/{name}"


def clean(papers: DataFrame, out: Layout, cfg: Config) -> DataFrame:
    """The holdout year is split off before the latest allowed year cuts; both tables and the counters are written."""
    split = P.holdout_split(papers, cfg.holdout_year)
    W.write_table(split.filter("split = 'holdout'"), out.holdout)
    verdicts = P.clean_verdicts(papers, cfg.max_year, cfg.min_abstract_words)
    W.write_table(P.clean_stats(verdicts), out.clean_stats)
    W.write_table(P.clean_papers(verdicts), out.papers)
    return papers.sparkSession.read.parquet(out.papers)


def report(papers: DataFrame, out: Layout, path: str | None = None) -> None:
    """The summary of the clean papers in Markdown."""
    W.dataset_report(P.dataset_stats(papers), P.year_distribution(papers), path or f"{out.root}/dataset_summary.md")


def build_graph(quads: DataFrame, out: Layout, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), written; quads need _seq."""
    spark = quads.sparkSession
    prepared = durable(G.prepare(quads, merges))
    W.write_table(G.edges(prepared), out.edges)
    nodes = durable(G.nodes(G.surface_forms(prepared)))
    W.write_table(nodes.select("id", "label"), out.nodes)
    W.write_table(G.build_stats(prepared, nodes), out.graph_stats)
    return spark.read.parquet(out.nodes), spark.read.parquet(out.edges)


def corpus_to_graph(papers: DataFrame, extractor: Extractor, template: str, out: Layout, cfg: Config, *, limit: int = 0, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """clean, extract, filter, build; extraction takes up what an earlier run has stored."""
    rows = clean(papers, out, cfg)
    quads = extract(rows, extractor, template, out.replies, limit=limit, max_tokens=cfg.max_tokens)
    verdicts = Q.classify(quads, cfg.year_from, cfg.year_to, cfg.max_entity_words)
    W.write_table(verdicts, out.verdicts)
    verdicts = papers.sparkSession.read.parquet(out.verdicts)
    W.write_table(Q.breakdown(verdicts), out.breakdown)
    order = ["paper_id", "subject", "relation", "object", "year"]
    return build_graph(G.indexed(Q.accepted(verdicts), order, "_seq"), out, merges)


def link_prediction(edges: DataFrame, out: Layout, cfg: Config) -> D.LinkModel:
    """snapshots, labels, embeddings and features by cutoff, the model and its evaluation; each a table of its own."""
    spark = edges.sparkSession
    W.write_table(G.snapshots(edges, list(cfg.cutoffs), cfg.final_year), out.snapshots, partition_by=("cutoff_year",))
    snaps = R.read_snapshots(spark, out.snapshots)
    pos = durable(L.positives(edges, list(cfg.cutoffs), cfg.final_year))
    neg = L.negatives(edges, pos, list(cfg.cutoffs), cfg.final_year, ratio=cfg.negative_ratio, attempts=cfg.negative_attempts, seed=cfg.seed)
    W.write_csv(L.labelled(pos, neg), out.pairs)
    emb = E.embeddings_by_cutoff(snaps, [*cfg.cutoffs, cfg.final_year], dim=cfg.embedding_dim, window=cfg.walk_window, length=cfg.walk_length, per_node=cfg.walks_per_node, seed=cfg.seed)
    W.write_table(emb, out.embeddings, partition_by=("cutoff_year",))
    W.write_table(D.pair_features(R.read_pairs(spark, out.pairs), R.read_embeddings(spark, out.embeddings)), out.features)
    feats = R.read_features(spark, out.features)
    model = D.train(feats, c=cfg.lr_c, iterations=cfg.lr_iterations, train_cutoffs=cfg.train_cutoffs, seed=cfg.seed)
    model.save(out.model)
    metrics, at_k, chosen = D.evaluate(model, feats, list(cfg.val_cutoffs), list(cfg.test_cutoffs), cfg.precision_ks)
    W.write_csv(metrics, out.evaluation)
    W.write_csv(at_k, out.precision_at_k)
    W.evaluation_report(metrics, at_k, chosen, f"{out.root}/evaluation.md")
    W.write_table(spark.createDataFrame(sorted(chosen.items()), "method string, threshold double"), out.thresholds)
    return model


def find_gaps(nodes: DataFrame, edges: DataFrame, model: D.LinkModel, out: Layout, cfg: Config) -> tuple[DataFrame, DataFrame]:
    emb = R.read_embeddings(edges.sparkSession, out.embeddings, cfg.final_year).select("node", "vec")
    found = S.structural_gaps(nodes, edges, emb, model, final_year=cfg.final_year, window=cfg.recent_window, k=cfg.neighbours, top=cfg.top_gaps)
    for name, df in zip(("gaps", "gaps_baseline"), found):
        W.write_json_lines(df, f"{out.root}/{name}")
    return found


def propose_merges(nodes: DataFrame, out: Layout, cfg: Config) -> DataFrame:
    """Merge candidates for review; a reviewed map goes back into build_graph."""
    found = durable(N.merge_candidates(nodes.select(F.col("id").alias("entity")), cfg.merge_similarity))
    W.write_table(found, out.merge_candidates)
    W.write_table(N.merge_map(found), out.merge_map)
    W.merge_review(found, f"{out.root}/entity_merge_candidates.md", cfg.merge_similarity)
    return found


def session(name: str = "graphloom") -> SparkSession:
    """A session with adaptive execution; partitions, memory and the checkpoint folder are the cluster's to set."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
