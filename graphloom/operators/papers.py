"""Merging, cleaning and describing paper metadata. _seq LONG stands for the order of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T


def collect_filter(papers: DataFrame, min_words: int = 20) -> DataFrame:
    """Rows with an id and an abstract of min_words words; the first of each id stays."""
    some = papers.filter((F.coalesce("id", F.lit("")) != "") & (T.word_count(F.col("abstract")) >= min_words))
    return first_by(some, F.col("id"))


def project_api(papers: DataFrame) -> DataFrame:
    """API records as raw papers: the DOI out of externalIds, the authors' names."""
    return papers.select(
        F.col("paperId").alias("id"), "title", F.col("year").cast("string").alias("year"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        "citationCount", "referenceCount", F.col("externalIds.DOI").alias("doi"), F.transform("authors", lambda a: a["name"]).alias("authors"),
    )


def first_by(df: DataFrame, key: Column, seq: str = "_seq") -> DataFrame:
    """The first row of each key in input order."""
    w = Window.partitionBy("_key").orderBy(seq)
    return df.withColumn("_key", key).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_key", "_rank")


def cap_per_group(df: DataFrame, group: str, cap: int, seq: str = "_seq") -> DataFrame:
    """The first cap rows of each group."""
    w = Window.partitionBy(group).orderBy(seq)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= cap).drop("_rank")


def union_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """All rows with their source's name. _seq grows within a source; an earlier source stands before a later one."""
    out = None
    for k, (name, df) in enumerate(sources):
        one = df.withColumn("source", F.lit(name)).withColumn("_seq", F.col("_seq") + F.lit(k << 56) if k else F.col("_seq"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def merge_papers(papers: DataFrame) -> DataFrame:
    """One row a paper: rows with neither title nor DOI go; of one key the longest abstract stays, the earlier on a tie.

    _first is where the key was first seen, the place of the row in the reference order."""
    has = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("doi", F.lit("")) != "")
    keyed = papers.filter(has).withColumn("_key", T.dedup_key(F.col("doi"), F.col("title"), F.col("id")))
    w = Window.partitionBy("_key")
    best = F.row_number().over(w.orderBy(F.length(F.coalesce("abstract", F.lit(""))).desc(), "_seq"))
    return keyed.withColumn("_first", F.min("_seq").over(w)).withColumn("_rank", best).filter("_rank = 1").drop("_rank")


def merge_stats(papers: DataFrame, merged: DataFrame) -> DataFrame:
    """raw, dropped (neither title nor DOI), kept, duplicates."""
    has = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("doi", F.lit("")) != "")
    raw = papers.agg(F.count("*").alias("raw"), F.count_if(~has).alias("dropped"))
    return raw.crossJoin(merged.agg(F.count("*").alias("kept"))).select("raw", "dropped", "kept", (F.col("raw") - F.col("kept") - F.col("dropped")).alias("duplicates"))


def clean_verdicts(papers: DataFrame, max_year: int = 2025, min_words: int = 20) -> DataFrame:
    """papers with year_int and verdict: missing, future, short, duplicate or clean; the first that fits.

    A duplicate is a later row of its key among the rows that pass the other tests. The window over keys sees only
    those rows' keys, so failed rows take no part in it."""
    title, abstract = T.normalize_text(F.col("title")), T.normalize_text(F.col("abstract"))
    year = T.normalize_year(F.col("year"))
    base = (
        F.when((title == "") | (abstract == "") | (F.coalesce(F.trim(F.col("year").cast("string")), F.lit("")) == ""), "missing")
        .when(year.isNull(), "missing").when(year > max_year, "future").when(T.word_count(F.col("abstract")) < min_words, "short")
    )
    rows = papers.withColumn("year_int", year).withColumn("_base", base).withColumn(
        "_key", F.when(F.col("_base").isNull(), T.paper_key(F.col("id"), F.col("title"))).otherwise(F.concat(F.lit("row:"), F.col("_seq").cast("string")))
    )
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("_seq"))
    return rows.withColumn("verdict", F.coalesce("_base", F.when(rank > 1, "duplicate").otherwise("clean"))).drop("_base", "_key")


def clean_papers(verdicts: DataFrame) -> DataFrame:
    """The clean rows: id (the title where there is none), title, year, abstract, cited_by_count."""
    i, t = T.normalize_text(F.col("id")), T.normalize_text(F.col("title"))
    cited = [F.col(c).cast("long") for c in ("citationCount", "cited_by_count") if c in verdicts.columns]
    return verdicts.filter("verdict = 'clean'").select(
        F.when(i != "", i).otherwise(t).alias("id"), t.alias("title"), F.col("year_int").alias("year"),
        T.normalize_text(F.col("abstract")).alias("abstract"), (F.coalesce(*cited) if cited else F.lit(0).cast("long")).alias("cited_by_count"), "_seq",
    )


def clean_stats(verdicts: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(
        F.count("*").alias("input"), n("duplicate").alias("duplicates_removed"), n("missing").alias("missing_required_fields"),
        n("short").alias("short_or_empty_abstract"), n("future").alias("future_papers_removed"), n("clean").alias("output"),
    )


def holdout_split(papers: DataFrame, holdout_year: int = 2026) -> DataFrame:
    """papers with split: train before the year, holdout in it, null after; a missing year counts as 0."""
    y = F.coalesce(T.normalize_year(F.col("year")), F.lit(0))
    return papers.withColumn("split", F.when(y < holdout_year, "train").when(y == holdout_year, "holdout"))


def year_distribution(papers: DataFrame) -> DataFrame:
    """year, n, pct of the rows with a year (0 counts as none). The total comes from the few rows per year."""
    per = papers.filter("coalesce(year, 0) <> 0").groupBy("year").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return per.select("year", "n", T.percent(F.col("n"), total).alias("pct"))


def dataset_stats(papers: DataFrame) -> DataFrame:
    """One row: counts, span of years, words of abstracts that are there, citations that are known (0 without any)."""
    words = F.when(F.coalesce("abstract", F.lit("")) != "", T.word_count(F.col("abstract")))
    year = F.when(F.col("year") != 0, F.col("year"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return papers.select(words.alias("w"), year.alias("y"), F.col("cited_by_count").alias("c")).agg(
        F.count("*").alias("papers"), F.min("y").alias("min_year"), F.max("y").alias("max_year"),
        F.avg("w").alias("words_mean"), F.median("w").alias("words_median"), F.min("w").alias("words_min"), F.max("w").alias("words_max"),
        zero(F.avg("c")).cast("double").alias("cited_mean"), zero(F.median("c")).cast("double").alias("cited_median"), zero(F.max("c")).cast("long").alias("cited_max"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
