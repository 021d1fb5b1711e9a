"""Readers of every dataset, with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import schema


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def sequenced(df: DataFrame) -> DataFrame:
    """df with _seq: the order of the input. Files are read in order of their names, rows in their order."""
    return df.withColumn("_seq", F.monotonically_increasing_id())


def read_json_array(spark: SparkSession, path: str, name: str, *, strict: bool = True, multi_line: bool = True) -> DataFrame:
    """A JSON array (or JSON lines, multi_line=False) with _seq.

    strict: a missing path and broken JSON raise; otherwise either gives no rows."""
    if not strict and not _exists(spark, path):
        return sequenced(spark.createDataFrame([], schema(name)))
    reader = spark.read.schema(schema(name)).option("multiLine", multi_line).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return sequenced(reader.json(path))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file; edges with _seq."""
    doc = spark.read.schema(schema("graph")).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.inline("nodes")), sequenced(doc.select(F.inline("edges")))


def read_snapshots(spark: SparkSession, path: str, cutoff: int | None = None) -> DataFrame:
    """Snapshot edges; a cutoff reads its partition only. No snapshots raise."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    return df if cutoff is None else df.filter(F.col("cutoff_year") == cutoff)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("pair")).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_embeddings(spark: SparkSession, path: str, cutoff: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if cutoff is None else df.filter(F.col("cutoff_year") == cutoff)


def read_merge_map(spark: SparkSession, path: str) -> DataFrame:
    """longer, shorter of a JSON object; a missing file is an empty map."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "longer string, shorter string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("longer", "shorter"))


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt template; a missing one raises FileNotFoundError."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def read_text_or_none(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()[0] if _exists(spark, path) else None


def not_done(papers: DataFrame, done: DataFrame | None) -> DataFrame:
    """Papers whose id is not among the processed ones (column paper_id)."""
    if done is None:
        return papers
    return papers.join(done.select(F.col("paper_id").alias("id")).distinct(), "id", "left_anti")


def read_table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table that an earlier run may have left, or None."""
    if not _exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # a folder without a file yet
        return None
