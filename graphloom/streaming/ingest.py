"""Streaming ingest of extracted quadruples: an extension, since batches are all that the model of the pipeline asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import graph as G
from graphloom.operators import quads as Q


def distinct_quads(stream: DataFrame, event_time: str = "ts", lateness: str = "1 day") -> DataFrame:
    """The stream without repeats of (subject, relation, object, year, paper_id) that come within lateness."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["subject", "relation", "object", "year", "paper_id"])


def verdict_counts(stream: DataFrame, event_time: str = "ts", window: str = "1 hour", lateness: str = "1 day", **years) -> DataFrame:
    """Verdicts counted by tumbling windows of event time; late rows within lateness still count."""
    rows = Q.classify(stream, **years).withWatermark(event_time, lateness)
    return rows.groupBy(F.window(event_time, window), "verdict").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, edges_path: str, checkpoint: str, **years) -> StreamingQuery:
    """Appends the accepted facts of each micro-batch to a table of edges by year; a batch that is run again after a
    failure replaces its own rows, so each fact is stored once. Snapshots are views over the table (year <= cutoff)."""

    def store(batch: DataFrame, number: int) -> None:
        p = G.prepare(Q.accepted(Q.classify(batch, **years))).filter("ok")
        rows = p.select("source", "target", F.col("rel").alias("relation"), F.col("year_int").alias("year"), "paper_id", F.lit(number).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(edges_path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
