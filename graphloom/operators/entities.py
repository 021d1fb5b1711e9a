"""Merge candidates between entity names: nearest neighbours by TF-IDF over character n-grams."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.operators.common import durable


def tfidf(entities: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """entity, gram, weight: term frequency times ln((1 + n) / (1 + df)) + 1, vectors of length 1."""
    names = entities.select("entity").filter("entity is not null").distinct()
    counts = names.select("entity", F.explode(T.char_ngrams(F.col("entity"), low, high)).alias("gram")).groupBy("entity", "gram").agg(F.count("*").alias("tf"))
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    n = names.agg(F.count("*").alias("n"))
    weighted = counts.join(df, "gram").crossJoin(F.broadcast(n)).select(
        "entity", "gram", (F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)).alias("w")
    )  # n is one row
    norms = weighted.groupBy("entity").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "entity").select("entity", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def similar_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity for all ordered pairs of different entities at the threshold or above.

    Prefix filtering (Bayardo, Ma and Srikant, WWW 2007) keeps it exact without joining on frequent grams: with an
    entity's grams from rare to frequent, those after the place where the rest of the vector is shorter than the
    threshold cannot make a pair on their own, so only the grams before it are indexed and probed, and each candidate
    is then scored over all of its grams."""
    df = weights.groupBy("gram").agg(F.count("*").alias("df"))
    rest = F.coalesce(
        F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("entity").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)
    )
    ranked = weights.join(df, "gram").withColumn("_rest", rest)
    prefix = ranked.filter(F.col("_rest") >= (threshold - 1e-9) ** 2).select("entity", "gram")
    prefix = durable(prefix)
    p, q = prefix.select(F.col("entity").alias("a"), "gram"), prefix.select(F.col("entity").alias("b"), "gram")
    candidates = p.join(q, "gram").filter("a < b").select("a", "b").distinct()
    wa, wb = weights.select(F.col("entity").alias("a"), "gram", F.col("weight").alias("_wa")), weights.select(F.col("entity").alias("b"), "gram", F.col("weight").alias("_wb"))
    scored = candidates.join(wa, "a").join(wb, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-9)
    return scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def merge_candidates(entities: DataFrame, threshold: float = 0.90) -> DataFrame:
    """longer, shorter, similarity (3 places), risky: one row per entity whose nearest other entity is near enough.

    Ties go to the smaller name. Pairs with different numbers and pairs of equal length are passed over."""
    pairs = similar_pairs(tfidf(entities), threshold)
    nearest = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("similarity", 9)), "b"))
    top = pairs.withColumn("_r", nearest).filter("_r = 1").filter(~T.has_conflicting_numbers(F.col("a"), F.col("b"))).filter(F.length("a") != F.length("b"))
    longer, shorter = T.longer_shorter(F.col("a"), F.col("b"))
    return top.select(
        longer.alias("longer"), shorter.alias("shorter"), F.round("similarity", 3).alias("similarity"),
        T.is_risky_generic_merge(F.col("a"), F.col("b")).alias("risky"), F.col("a").alias("entity"),
    )


def merge_map(candidates: DataFrame) -> DataFrame:
    """longer, shorter: one target per longer name; of several the one that the last entity (by name) gave."""
    last = F.row_number().over(Window.partitionBy("longer").orderBy(F.desc("entity")))
    return candidates.withColumn("_r", last).filter("_r = 1").select("longer", "shorter")


def review_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("risky"), F.desc("similarity"), "entity")


def length_histogram(labels: DataFrame) -> DataFrame:
    """n_words, n over labels (column label)."""
    return labels.groupBy(T.word_count(F.col("label")).cast("long").alias("n_words")).agg(F.count("*").alias("n"))


def long_labels(labels: DataFrame, words: int = 6, top: int = 100) -> DataFrame:
    """The first top labels, by id, of more than so many words (a report)."""
    return labels.filter(T.word_count(F.col("label")) > words).orderBy("id").limit(top)
