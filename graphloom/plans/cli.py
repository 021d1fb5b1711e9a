"""Command line: python -m graphloom.plans.cli STAGE ..."""

from __future__ import annotations

import argparse
import os
import signal
from dataclasses import replace

from graphloom.config import Config
from graphloom.operators import model as D
from graphloom.operators import papers as P
from graphloom.operators import quads as Q
from graphloom.operators.extract import ChatExtractor
from graphloom.plans import pipeline as L
from graphloom.sources import readers as R
from graphloom.sources import sinks as W
from graphloom.sources.papers_api import Fetcher, Limiter, crawl


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="Temporal knowledge graphs from papers.")
    top.add_argument("--root", default="work", help="folder of the stages' tables")
    top.add_argument("--year-from", type=int, default=Config.year_from)
    top.add_argument("--year-to", type=int, default=Config.year_to)
    sub = top.add_subparsers(dest="stage", required=True)

    c = sub.add_parser("collect", help="papers from a search service")
    c.add_argument("--url", required=True)
    c.add_argument("--concept", default=Config.concept)
    c.add_argument("--target-total", "--limit", type=int, default=Config.target_total)
    c.add_argument("--initial-per-year", type=int)
    c.add_argument("--increment", type=int, default=Config.cap_increment)
    c.add_argument("--api-key-env", default="PAPERS_API_KEY")
    c.add_argument("--output")
    c.add_argument("--no-resume", action="store_true")

    c = sub.add_parser("merge", help="papers of two sources as one list")
    c.add_argument("--first", required=True)
    c.add_argument("--second", required=True)
    c.add_argument("--output")

    c = sub.add_parser("clean", help="verdicts, counters and clean papers")
    c.add_argument("--input")
    c.add_argument("--output", help="the clean papers as JSON lines too")

    c = sub.add_parser("stats", help="a report on the clean papers")
    c.add_argument("--output")

    c = sub.add_parser("extract", help="quadruples by a chat model; takes up stored replies")
    c.add_argument("--prompt", required=True)
    c.add_argument("--model", required=True)
    c.add_argument("--base-url", required=True)
    c.add_argument("--key-env", default="OPENAI_API_KEY")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--input", help="clean papers as JSON lines instead of the stage's table")
    c.add_argument("--output", help="the quadruples as JSON lines too")
    c.add_argument("--checkpoint", help="the table of replies")
    c.add_argument("--checkpoint-every", type=int, default=20)
    c.add_argument("--debug", action="store_true", help="print how the replies ended")
    c.add_argument("--no-resume", action="store_true")
    c.add_argument("--max-tokens", type=int, default=Config.max_tokens)

    c = sub.add_parser("filter", help="accepted and rejected quadruples")
    c.add_argument("--input")
    c.add_argument("--output")
    c.add_argument("--rejected-output")

    c = sub.add_parser("graph", help="nodes and edges, GraphML if asked for")
    c.add_argument("--input", help="accepted quadruples as JSON lines instead of the stage's table")
    c.add_argument("--merges")
    c.add_argument("--json-output")
    c.add_argument("--graphml-output")

    sub.add_parser("links", help="snapshots, labels, embeddings, features, model, evaluation")
    sub.add_parser("gaps", help="structural gaps of the newest graph")
    sub.add_parser("merges", help="merge candidates for review")

    c = sub.add_parser("run", help="collect (or not), clean, extract, filter and graph")
    c.add_argument("--skip-collect", action="store_true")
    c.add_argument("--url")
    c.add_argument("--collect-limit", type=int, default=Config.target_total)
    c.add_argument("--extract-limit", type=int, default=0)
    c.add_argument("--merges")
    c.add_argument("--graphml-output")
    c.add_argument("--prompt", required=True)
    c.add_argument("--model", required=True)
    c.add_argument("--base-url", required=True)
    return top


def collect(spark, args, cfg: Config, out: L.Layout, target: int, path: str | None = None) -> None:
    key = os.environ.get(getattr(args, "api_key_env", "PAPERS_API_KEY")) or None
    fetcher = Fetcher(args.url, getattr(args, "concept", cfg.concept), limiter=Limiter(), api_key=key)
    years = list(range(cfg.year_from, cfg.year_to + 1))
    crawl(spark, fetcher, years, target, path or out.raw, resume=not getattr(args, "no_resume", False), initial=getattr(args, "initial_per_year", None), increment=getattr(args, "increment", cfg.cap_increment))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    cfg = replace(Config(), year_from=args.year_from, year_to=args.year_to)
    signal.signal(signal.SIGTERM, signal.default_int_handler)  # ends as an interrupt does: what is stored stays
    spark, out = L.session(), L.Layout(args.root)
    raw = lambda path: R.read_json_array(spark, path or out.raw, "raw_paper", multi_line=False)
    if args.stage == "collect":
        collect(spark, args, cfg, out, args.target_total, args.output)
    elif args.stage == "merge":
        first = R.read_json_array(spark, args.first, "openalex_paper", strict=False)
        second = R.read_json_array(spark, args.second, "raw_paper", strict=False)
        merged = P.merge_papers(P.union_sources(("openalex", first), ("semantic_scholar", second)))
        W.write_json_lines(merged.orderBy("_first").drop("_key", "_first", "_seq"), args.output or out.raw)
    elif args.stage == "clean":
        papers = L.clean(raw(args.input), out, cfg)
        if args.output:
            W.write_json_lines(papers, args.output)
    elif args.stage == "stats":
        L.report(spark.read.parquet(out.papers), out, args.output)
    elif args.stage == "extract":
        template = R.read_prompt(spark, args.prompt)
        papers = R.read_json_array(spark, args.input, "clean_paper", multi_line=False) if args.input else spark.read.parquet(out.papers)
        store = args.checkpoint or out.replies
        quads = L.extract(papers, ChatExtractor(args.base_url, args.model, args.key_env), template, store, limit=args.limit, resume=not args.no_resume, max_tokens=args.max_tokens, batch=args.checkpoint_every)
        W.write_table(quads, out.quads)
        if args.output:
            W.write_json_lines(quads, args.output)
        if args.debug:
            spark.read.parquet(store).groupBy("status").count().show()
    elif args.stage == "filter":
        verdicts = Q.classify(spark.read.parquet(args.input or out.quads), cfg.year_from, cfg.year_to, cfg.max_entity_words)
        W.write_table(verdicts, out.verdicts)
        verdicts = spark.read.parquet(out.verdicts)
        W.write_json_lines(Q.accepted(verdicts), args.output or out.accepted)
        W.write_json_lines(Q.rejected(verdicts), args.rejected_output or out.rejected)
        print("\n".join(W.verdict_report(Q.breakdown(verdicts))))
    elif args.stage == "graph":
        merges = R.read_merge_map(spark, args.merges) if args.merges else None
        order = ["paper_id", "subject", "relation", "object", "year"]
        quads = R.read_json_array(spark, args.input, "quad", multi_line=False).drop("_seq") if args.input else spark.read.parquet(out.verdicts)
        if args.input:
            quads = Q.classify(quads, cfg.year_from, cfg.year_to, cfg.max_entity_words)
        nodes, edges = L.build_graph(L.G.indexed(Q.accepted(quads), order, "_seq"), out, merges)
        if args.json_output:
            W.export_graph_json(nodes, edges, args.json_output)
        if args.graphml_output:
            W.export_graphml(nodes, edges, args.graphml_output)
    elif args.stage == "links":
        L.link_prediction(spark.read.parquet(out.edges), out, cfg)
    elif args.stage == "gaps":
        L.find_gaps(spark.read.parquet(out.nodes), spark.read.parquet(out.edges), D.LinkModel.load(out.model), out, cfg)
    elif args.stage == "merges":
        L.propose_merges(spark.read.parquet(out.nodes), out, cfg)
    elif args.stage == "run":
        if not args.skip_collect:
            collect(spark, args, cfg, out, args.collect_limit)
        merges = R.read_merge_map(spark, args.merges) if args.merges else None
        nodes, edges = L.corpus_to_graph(raw(None), ChatExtractor(args.base_url, args.model), R.read_prompt(spark, args.prompt), out, cfg, limit=args.extract_limit, merges=merges)
        L.report(spark.read.parquet(out.papers), out)
        if args.graphml_output:
            W.export_graphml(nodes, edges, args.graphml_output)


if __name__ == "__main__":
    main()
