"""The star-schema and text tables seen as papers, quadruples, graphs and scored pairs.

The expressions are SQL that both engines read alike, so that a query and its oracle start from the same rows. Nulls,
repeats and odd values are made from the keys, since the tables themselves have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine_similarity, norm
from graphloom.operators import graph as G
from graphloom.operators import quads as Q
from graphloom.operators.common import durable

#: Ship years of the line items are 1995 to 2001: the graph's cutoffs and its final year.
CUTOFFS, FINAL_YEAR = (1997, 1998, 1999, 2000), 2001
YEAR_FROM, YEAR_TO = 1996, 2000

PAPER = {
    "id": "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN concat('d', doc_id - 7) ELSE concat('d', doc_id) END",
    "title": "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END",
    "year": "CASE WHEN doc_id % 37 = 0 THEN 'n/a' WHEN doc_id % 41 = 0 THEN NULL ELSE concat(' ', 2018 + doc_id % 9) END",
    "abstract": "CASE WHEN doc_id % 31 = 0 THEN NULL ELSE text END",
    "doi": "CASE WHEN doc_id % 5 = 0 THEN concat(' HTTPS://doi.org/10.1/X', doc_id % 90) END",
    "citationCount": "CASE WHEN doc_id % 13 <> 0 THEN n_chars % 97 END",
    "src": "CASE WHEN doc_id % 3 = 0 THEN 'openalex' ELSE 'semantic_scholar' END",
}

FACT = {
    "subject": "concat('p', l_partkey)",
    "relation": "concat(lower(l_returnflag), ' ', lower(l_linestatus))",
    "object": "concat('s', l_suppkey)",
    "year": "CAST(year(l_shipdate) AS {string})",
    "paper_id": "CAST(l_orderkey AS {string})",
}

SURFACE = {
    "subject": "CASE l_linenumber WHEN 1 THEN concat('The ', p_name, ' model') WHEN 2 THEN upper(p_name) WHEN 3 THEN concat(' \"', p_name, '.\"  ')"
    " WHEN 4 THEN 'Several methods' WHEN 5 THEN concat(p_name, ' of the very large kind') WHEN 6 THEN NULL ELSE concat('a ', p_name, '  model framework') END",
    "relation": "CASE l_orderkey % 6 WHEN 0 THEN 'Are Evaluated-On' WHEN 1 THEN 'is a' WHEN 2 THEN 'were used for' WHEN 3 THEN ' improves ' WHEN 4 THEN 'HAS' ELSE 'extends' END",
    "object": "CASE l_suppkey % 5 WHEN 0 THEN concat('an ', s_name, ' approach') WHEN 1 THEN 'BERT model' WHEN 2 THEN 'gpt' WHEN 3 THEN lower(s_name) ELSE s_name END",
    "year": "CASE WHEN l_orderkey % 53 = 0 THEN '2020.5' WHEN l_orderkey % 59 = 0 THEN NULL ELSE concat(year(l_shipdate), ' ') END",
    "paper_id": "CAST(l_orderkey AS {string})",
}

#: The total order of line items.
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def exprs(view: dict[str, str], string: str = "STRING") -> list[str]:
    return [f"{e.replace('{string}', string)} AS {c}" for c, e in view.items()]


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(*exprs(PAPER), "doc_id AS _seq")


def _seen(rows: DataFrame, order: str) -> DataFrame:
    """rows with _seq, a number that grows in the order of the items; with the columns of the order; or with neither."""
    if order == "columns":
        return rows
    return (G.ordered(rows, list(ORDER), "_seq") if order == "_seq" else rows).drop(*ORDER)


def facts(spark: SparkSession, sf: str, order: str = "") -> DataFrame:
    """Quadruples of line items by key."""
    return _seen(table(spark, sf, "lineitem").selectExpr(*exprs(FACT), *ORDER), order)


def surfaces(spark: SparkSession, sf: str, order: str = "") -> DataFrame:
    """Quadruples of line items by name, with the variants that extraction brings."""
    rows = (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(*exprs(SURFACE), *ORDER)
    )
    return _seen(rows, order)


def kept_surfaces(spark: SparkSession, sf: str, order: str = "") -> DataFrame:
    """The accepted ones; only these are put in order."""
    return _seen(Q.accepted(Q.classify(surfaces(spark, sf, "columns"), YEAR_FROM, YEAR_TO)), order)


def fact_edges(spark: SparkSession, sf: str) -> DataFrame:
    """source, target, relation, year of the facts; keys and order are not needed here."""
    p = G.prepare(facts(spark, sf))
    return p.filter("ok").select("source", "target", F.col("rel").alias("relation"), F.col("year_int").alias("year"))


def fact_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return G.snapshots(fact_edges(spark, sf), list(CUTOFFS), FINAL_YEAR)


def scored_pairs(spark: SparkSession, sf: str, reach: int = 10) -> DataFrame:
    """node_a, node_b, cutoff_year, label, score: each vector with the next reach ones; label is whether classes agree."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("y")).withColumn("n", norm(F.col("v")))
    a = e.select(F.col("vec_id").alias("node_a"), F.col("v").alias("va"), F.col("y").alias("ya"), F.col("n").alias("na"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step"))
    b = e.select(F.col("vec_id").alias("node_b"), F.col("v").alias("vb"), F.col("y").alias("yb"), F.col("n").alias("nb"))
    both = a.withColumn("node_b", F.col("node_a") + F.col("step")).join(b, "node_b")
    score = F.round(cosine_similarity(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")), 6)
    return both.select(
        "node_a", "node_b", (F.lit(2020) + F.pmod("node_a", F.lit(4))).cast("int").alias("cutoff_year"),
        (F.col("ya") == F.col("yb")).cast("int").alias("label"), score.alias("score"),
    )


def names(spark: SparkSession, sf: str) -> DataFrame:
    """entity: part names with the variants that merging looks for."""
    forms = "explode(array(p_name, concat(p_name, 's'), concat('the ', p_name, 's'), concat(p_name, ' ', p_size % 3), concat(p_name, ' networks'), 'networks', 'network')) AS entity"
    return table(spark, sf, "part").selectExpr(forms).distinct()


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """paper_id, raw: model replies in the shapes that occur, made from events."""
    entry = "concat('{\"subject\": \"', event_type, '\", \"relation\": \"is ', event_type, '\", \"object\": \"u', user_id, '\", \"year\": ', CASE WHEN event_id % 3 = 0 THEN concat('\"', 2018 + event_id % 7, '\"') WHEN event_id % 3 = 1 THEN 'null' ELSE CAST(2018 + event_id % 7 AS STRING) END, '}')"
    fence = "repeat('`', 3)"
    raw = (
        f"CASE event_id % 6 WHEN 0 THEN concat({fence}, 'json', chr(10), '[', {entry}, ']', chr(10), {fence}) WHEN 1 THEN concat('[', {entry}, ', ', {entry}, ']')"
        f" WHEN 2 THEN {entry} WHEN 3 THEN 'sorry, no json' WHEN 4 THEN '[]' ELSE concat('  [', {entry}, ']  ') END"
    )
    return table(spark, sf, "events").selectExpr("CAST(event_id AS STRING) AS paper_id", f"{raw} AS raw")


def steady_edges(spark: SparkSession, sf: str) -> DataFrame:
    return durable(fact_edges(spark, sf))
