"""Node embeddings: seeded random walks by joins, then skip-gram over the walks; one model a cutoff."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.common import durable
from graphloom.operators.graph import undirected_pairs


def random_walks(edge_rows: DataFrame, *, by: tuple[str, ...] = (), length: int = 30, per_node: int = 10, seed: int = 42, cut_every: int = 8) -> DataFrame:
    """by, node, walk, path: uniform walks over the undirected simple graph of each by, the same for one seed.

    A step is an equi-join of the walkers with the numbered neighbours of where they stand: the hash of (seed, by, node,
    walk, step) picks the number. A neighbour's row has the number of its own neighbours, which the next step asks for. All
    graphs walk in the same joins. The neighbours are dealt by the key of the join once and kept so; only walkers move. A
    hub's neighbours are rows, dealt apart, not an array in one task."""
    pairs = undirected_pairs(edge_rows, by, loops=True)
    nbr = pairs.select(*by, F.col("node_a").alias("at"), F.col("node_b").alias("to")).union(pairs.select(*by, "node_b", "node_a")).distinct()
    place = F.row_number().over(Window.partitionBy(*by, "at").orderBy("to")) - 1
    nbr = durable(nbr.withColumn("place", place.cast("long")))
    size = durable(nbr.groupBy(*by, "at").agg(F.count("*").alias("size")))
    parts = int(edge_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = nbr.join(size.select(*by, F.col("at").alias("to"), F.col("size").alias("next_size")), [*by, "to"])
    steps = steps.select(*by, "at", "place", "to", "next_size").repartition(parts, *by, "at", "place").persist(StorageLevel.MEMORY_AND_DISK)
    walks = size.select(*by, F.col("at").alias("node"), "at", "size", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), F.array("at").alias("path"))
    for step in range(1, length):
        pick = F.pmod(F.xxhash64(F.lit(seed), *by, "node", "walk", F.lit(step)), F.col("size"))
        walks = walks.withColumn("place", pick).join(steps, [*by, "at", "place"])
        walks = walks.select(*by, "node", F.col("to").alias("at"), F.col("next_size").alias("size"), "walk", F.concat("path", F.array("to")).alias("path"))
        if step % cut_every == 0:
            walks = durable(walks)
    return walks.select(*by, "node", "walk", "path")


def skip_gram(walks: DataFrame, *, dim: int = 64, window: int = 5, seed: int = 42, walks_per_task: int = 500_000) -> DataFrame:
    """node, vec by skip-gram over sorted walks. Up to walks_per_task walks train in one task, which makes the result
    repeatable; more are dealt out by ranges and their vectors are joined after the pass."""
    n = walks.count()
    if not n:
        return walks.sparkSession.createDataFrame([], "node string, vec array<float>")
    tasks = -(-n // walks_per_task)
    ordered = walks.orderBy("node", "walk").coalesce(1) if tasks == 1 else walks.repartitionByRange(tasks, "node", "walk").sortWithinPartitions("node", "walk")
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, seed=seed, numPartitions=tasks, inputCol="path", outputCol="v").fit(ordered)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector", "float32").alias("vec"))


def embed(edge_rows: DataFrame, *, dim: int = 64, window: int = 5, length: int = 30, per_node: int = 10, seed: int = 42) -> DataFrame:
    """node, vec of one graph."""
    return skip_gram(durable(random_walks(edge_rows, length=length, per_node=per_node, seed=seed)), dim=dim, window=window, seed=seed)


def embeddings_by_cutoff(snaps: DataFrame, cutoffs: list[int], *, dim: int = 64, window: int = 5, length: int = 30, per_node: int = 10, seed: int = 42) -> DataFrame:
    """cutoff_year, node, vec: a model of its own for each snapshot, so no later edge leaks into an earlier one."""
    walks = durable(random_walks(snaps.filter(F.col("cutoff_year").isin(*cutoffs)), by=("cutoff_year",), length=length, per_node=per_node, seed=seed))
    out = None
    for c in cutoffs:
        one = skip_gram(walks.filter(F.col("cutoff_year") == c), dim=dim, window=window, seed=seed).withColumn("cutoff_year", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out.select("cutoff_year", "node", "vec")
