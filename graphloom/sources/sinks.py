"""Writers: tables through Spark's commit protocol, and small reports and exports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.entities import review_order


#: Folders that a task writes side by side; of more it sorts its rows first.
OPEN_FOLDERS = 8


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, OPEN_FOLDERS)  # without it a task sorts all of its rows by folder, on disk where they are many
    try:
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_split(df: DataFrame, path: str) -> None:
    """Rows by their split column; the input is never overwritten."""
    write_table(df, path, partition_by=("split",))


def replace_text(path: str, lines: Iterable[str]) -> None:
    """A text file, written beside its place and moved there when complete: through Hadoop where the path has a scheme,
    so that a shared folder serves, else on the driver's own disk."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path):
        spark = SparkSession.getActiveSession()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        final, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        fs = final.getFileSystem(conf)
        out = fs.create(part, True)
        held, size = [], 0
        try:
            for line in lines:
                held.append(line)
                size += len(line)
                if size > 1 << 20:
                    out.write(bytearray("".join(held).encode("utf-8")))
                    held, size = [], 0
            out.write(bytearray("".join(held).encode("utf-8")))
        finally:
            out.close()
        fs.delete(final, False)
        if not fs.rename(part, final):
            raise OSError(f"could not move {path}.tmp")
        return
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_suffix(p.suffix + ".tmp")
    with tmp.open("w", encoding="utf-8") as f:
        f.writelines(lines)
    tmp.replace(p)


def export_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in one local file, rows streamed through the driver; for small results."""

    def lines():
        yield "["
        for k, r in enumerate(df.toLocalIterator()):
            yield (",\n" if k else "\n") + json.dumps(r.asDict(recursive=True), ensure_ascii=False)
        yield "\n]\n"

    replace_text(path, lines())


def export_merge_map(df: DataFrame, path: str) -> None:
    rows = {r.longer: r.shorter for r in df.orderBy("longer").toLocalIterator()}
    replace_text(path, [json.dumps(rows, ensure_ascii=False, indent=2)])


def export_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON document {nodes, edges}; rows are streamed through the driver."""

    def lines():
        for head, df in (('{"nodes": [', nodes.select("id", "label")), ('"edges": [', edges)):
            yield head
            for k, r in enumerate(df.toLocalIterator()):
                yield (",\n" if k else "\n") + json.dumps(r.asDict(recursive=True), ensure_ascii=False)
            yield "],\n" if head.startswith("{") else "]}\n"

    replace_text(path, lines())


def export_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A directed multigraph in GraphML; rows are streamed through the driver."""
    node_keys, edge_keys = ("label",), ("relation", "year", "timestamp", "paper_id")

    def lines():
        yield '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        for owner, keys in (("node", node_keys), ("edge", edge_keys)):
            for k in keys:
                kind = "long" if k in ("year", "timestamp") else "string"
                yield f'<key id="{owner}_{k}" for="{owner}" attr.name="{k}" attr.type="{kind}"/>\n'
        yield '<graph edgedefault="directed">\n'
        for r in nodes.select("id", "label").toLocalIterator():
            yield f"<node id={quoteattr(r.id)}><data key=\"node_label\">{escape(r.label or '')}</data></node>\n"
        for r in edges.select("source", "target", "key", *edge_keys).toLocalIterator():
            data = "".join(f'<data key="edge_{k}">{escape(str(r[k]))}</data>' for k in edge_keys if r[k] is not None)
            yield f"<edge source={quoteattr(r.source)} target={quoteattr(r.target)} id={quoteattr(r.key)}>{data}</edge>\n"
        yield "</graph>\n</graphml>\n"

    replace_text(path, lines())


def _table(head: list[str], rows: Iterable[Iterable]) -> list[str]:
    return ["| " + " | ".join(head) + " |\n", "|" + "---|" * len(head) + "\n", *("| " + " | ".join(str(x) for x in r) + " |\n" for r in rows)]


def dataset_report(stats: DataFrame, years: DataFrame, path: str) -> None:
    """Counts, years, words and citations of a corpus in Markdown; both tables are small aggregates."""
    s = stats.first()
    lines = ["# Corpus summary\n\n", f"{s.papers} papers, {s.min_year} to {s.max_year}.\n\n", "## Years\n\n"]
    lines += _table(["Year", "Papers", "Share"], [(r.year, r.n, f"{r.pct:.1f}%") for r in years.orderBy("year").collect()])
    lines += ["\n## Abstracts\n\n", f"Words: mean {s.words_mean or 0:.1f}, median {s.words_median}, {s.words_min} to {s.words_max}.\n"]
    lines += ["\n## Citations\n\n", f"Mean {s.cited_mean:.1f}, median {s.cited_median}, most {s.cited_max}.\n"]
    replace_text(path, lines)


def merge_review(candidates: DataFrame, path: str, threshold: float = 0.90) -> None:
    """Merge candidates for a person to review, risky ones first."""
    head = candidates.agg(F.count("*").alias("n"), F.count_if("risky").alias("risky")).first()

    def lines():
        yield f"# Entity merge candidates\n\n{head.n} pairs of nearest neighbours from {threshold} on; {head.risky} are risky.\n\n"
        yield from _table(["Longer", "Shorter", "Similarity", "Risky"], [])
        for r in review_order(candidates).toLocalIterator():
            yield f"| {r.longer} | {r.shorter} | {r.similarity} | {'yes' if r.risky else ''} |\n"

    replace_text(path, lines())


def evaluation_report(metrics: DataFrame, at_k: DataFrame, chosen: dict[str, float], path: str) -> None:
    """The metric table, precision at k and the thresholds in Markdown."""
    cols = metrics.columns
    lines = ["# Link prediction\n\n", *_table(cols, [[f"{v:.6f}" if isinstance(v, float) else v for v in r] for r in metrics.orderBy("Method", "Split").collect()])]
    lines += ["\n## Precision at k (test)\n\n", *_table(["k", "Method", "Precision"], [(r.k, r.method, f"{r.precision:.3f}") for r in at_k.orderBy("k", "method").collect()])]
    lines += ["\n", *(f"Threshold of {m} from validation: {t:.2f}\n" for m, t in sorted(chosen.items()))]
    replace_text(path, lines)


def verdict_report(counts: DataFrame) -> list[str]:
    return [f"{r.reason}: {r.n} ({r.pct:.1f}%)" for r in counts.orderBy(F.desc("n"), "reason").collect()]
