"""A training corpus from documents in five stages; run(spark, sf_dir) applies them one after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_encode, load_ranks
from graphloom.llm.common import checkpoint_folder, durable, numbered, settled
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.quality import keep_quality
from graphloom.llm.simhash import simhash_dedup
from graphloom.shipping import shipped


#: Row numbers are broadcast up to so many, some 30 MB; beyond, the texts are dealt out to meet them.
BROADCAST_ROWS = 2_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, settled, without the rows whose row_id is in dropped."""
    dropped = durable(dropped)
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    number = "row_id"
    while number in docs.columns:
        number += "_"
    return numbered(docs, number).join(dropped.withColumnRenamed("row_id", number), number, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    docs = settled(docs)
    return _without(docs, exact_dedup(docs).filter("not kept").select("row_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: the one with the smallest id, of repeated ids the first."""
    docs = settled(docs)
    return _without(docs, simhash_dedup(docs).filter("not kept").select("row_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    docs = settled(docs)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated").select("row_id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    import public_tokenizers

    return bpe_encode(docs, load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    (name, shipped(stage))
    for name, stage in (("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("tokens", tokens))
]

#: The classifier and the fingerprints are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder and read again by the next.

    A stage's table is deleted once the next one is written; the last one stays, since the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
