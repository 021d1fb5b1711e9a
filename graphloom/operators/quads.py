"""Verdicts over extracted quadruples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import config as V
from graphloom.functions import text as T


def classify(quads: DataFrame, year_from: int = 2018, year_to: int = 2024, max_words: int = 6, allowed: list[str] | None = None) -> DataFrame:
    """quads with relation_norm, year_int and verdict; the tests run in the order given, cheap ones first.

    allowed is an optional stricter list of relations; rows outside it are unlisted_relation."""
    subject, obj, relation = F.col("subject"), F.col("object"), T.normalize_relation(F.col("relation"))
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    year = T.normalize_year(F.col("year"))
    verdict = (
        F.when(missing(subject) | missing(obj) | ~T.has_text(F.col("relation")), "missing_field")
        .when(~F.coalesce(year.between(year_from, year_to), F.lit(False)), "invalid_year")
        .when(relation.isin(*V.BANNED_RELATIONS), "banned_relation")
        .when(T.is_generic_phrase(subject) | T.is_generic_phrase(obj), "generic_entity")
        .when(T.more_words(subject, max_words) | T.more_words(obj, max_words), "entity_too_long")
    )
    if allowed is not None:
        verdict = verdict.when(~relation.isin(*allowed), "unlisted_relation")
    return quads.withColumns({"relation_norm": relation, "year_int": year, "verdict": verdict.otherwise("valid")})


def accepted(classified: DataFrame) -> DataFrame:
    """Valid rows with their relation and year normalised."""
    rows = classified.filter("verdict = 'valid'")
    return rows.withColumns({"relation": F.col("relation_norm"), "year": F.col("year_int")}).drop("relation_norm", "year_int", "verdict")


def rejected(classified: DataFrame) -> DataFrame:
    """The other rows as they came, with _rejection_reason."""
    return classified.filter("verdict <> 'valid'").withColumnRenamed("verdict", "_rejection_reason").drop("relation_norm", "year_int")


def breakdown(classified: DataFrame) -> DataFrame:
    """reason, n, pct of all rows; the valid ones are counted but not listed."""
    per = classified.groupBy("verdict").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return per.withColumn("pct", T.percent(F.col("n"), total)).filter("verdict <> 'valid'").withColumnRenamed("verdict", "reason")
