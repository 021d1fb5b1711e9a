"""Ids beyond 2^53 beside null ids come back whole; row numbers stay the same in every scan."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_encode
from graphloom.llm.common import durable, numbered, settled
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.html_wrappers import extract_main_text
from graphloom.llm.passages import near_passages
from graphloom.llm.quality import classify_quality
from graphloom.llm.simhash import simhash_dedup

BIG = 2**60 + 1
TEXT = " ".join(f"w{i}" for i in range(80))
RANKS = {bytes([b]): b for b in range(256)}


@pytest.mark.parametrize(
    "make",
    [
        lambda s, d: exact_dedup(d), lambda s, d: simhash_dedup(d), lambda s, d: bpe_encode(d, RANKS, r"\S+|\s+"),
        lambda s, d: decontaminate(d, s.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")),
        lambda s, d: decontaminate(d, s.createDataFrame([(1, "w1 w2 w3"), (2, "w5 w6")], "item_id long, text string"), block_bytes=1),
        lambda s, d: classify_quality(d, s.createDataFrame([(BIG, 1), (5, 0)], "doc_id long, quality int")),
        lambda s, d: extract_main_text(d.selectExpr("doc_id AS page_id", "'http://a.b/c' AS url", "text AS html")).withColumnRenamed("page_id", "doc_id"),
    ],
)
def test_ids(spark, make):
    docs = spark.createDataFrame([(BIG, TEXT), (None, TEXT + " more"), (5, "short")], "doc_id long, text string").coalesce(1)
    got = make(spark, docs)
    assert dict(got.dtypes)["doc_id"] == "bigint" and {r.doc_id for r in got.collect()} == {BIG, None, 5}


def test_pairs(spark):
    docs = spark.createDataFrame([(BIG, TEXT), (None, TEXT + " more"), (BIG + 1, "x " + TEXT)], "doc_id long, text string").coalesce(1)
    got = near_passages(docs).collect()
    assert {i for r in got for i in (r.doc_id, r.other_id)} == {BIG, BIG + 1, None} and {r.class_id for r in got} == {BIG}


def split_finely(spark, on):
    for k, v in (("spark.sql.files.minPartitionNum", "24"), ("spark.sql.files.maxPartitionBytes", "8k"), ("spark.sql.files.openCostInBytes", "1k")):
        spark.conf.set(k, v) if on else spark.conf.unset(k)


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"text number {i // 2} " * (1 + i % 5)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.option("parquet.block.size", 8192).parquet(path)
    docs = spark.read.parquet(path)
    parts, coarse = docs.rdd.getNumPartitions(), {r.doc_id: r.row_id for r in numbered(docs).collect()}
    dropped = durable(exact_dedup(docs).filter("not kept").select("row_id"))
    try:
        split_finely(spark, True)
        again = spark.read.parquet(path)
        assert again.rdd.getNumPartitions() > parts
        assert {r.doc_id: r.row_id for r in numbered(again).collect()} == coarse and len(set(coarse.values())) == 3000
        pipeline = pytest.importorskip("corpus_pipeline")
        kept = {r.doc_id for r in pipeline._without(again, dropped).collect()}
    finally:
        split_finely(spark, False)
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, -1))
    assert kept == set(last.values())


def test_numbers_of_tables_that_are_no_files(spark):
    made = spark.range(50).repartition(7).withColumn("x", F.rand())
    fixed = settled(made)
    one, two = ({r.id: r.row_id for r in numbered(fixed).collect()} for _ in range(2))
    assert one == two and len(set(one.values())) == 50
    assert numbered(spark.createDataFrame([], "doc_id long, text string")).count() == 0
