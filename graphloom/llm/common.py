"""What several text operators share: ASCII folding, durable intermediate tables, components."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that lower-cases A-Z and leaves every other byte.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: The same, and every byte outside 0-9, a-z and non-ASCII becomes a space.
FOLD_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def as_text(id_col: str) -> Column:
    """A long id as text, for the way through pandas: there a batch with a null turns longs into floats, and ids beyond
    2^53 would lose digits."""
    return F.col(id_col).cast("long").cast("string")


def with_long(df: DataFrame, *ids: str) -> DataFrame:
    """df with ids that went as text as longs again."""
    return df.withColumns({i: F.col(i).cast("long") for i in ids})


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the vectorised lower(); the two agree there."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where that is unset, a folder of this machine
    is taken in local mode, and a cluster is refused."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Row numbers leave so many bits to the places in a file.
ROW_BITS = 36


def _plain(docs: DataFrame, leaf: str) -> bool:
    """Whether docs is a leaf of that kind under projections and filters at most."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    names = [line.lstrip(" +-:").partition(" ")[0].partition("[")[0] for line in plan.splitlines() if line.strip()]
    return bool(names) and names[-1].startswith(leaf) and all(n in ("Project", "Filter") for n in names[:-1])


def _file_places(docs: DataFrame) -> tuple[Column, Column] | None:
    """(file, place in it) of each row where docs is a plain scan of files whose rows have places, Parquet that is."""
    if not _plain(docs, "Relation"):
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["file_path"], meta["row_index"]).schema  # noqa: B018
    except AnalysisException:
        return None
    return meta["file_path"], meta["row_index"]


def _one_slash(path: Column) -> Column:
    """A path with one slash after its scheme: Spark writes file:/a in one place and file:///a in another."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def settled(docs: DataFrame) -> DataFrame:
    """docs itself if its rows keep their numbers in every scan; else a durable copy, whose rows do."""
    return docs if _file_places(docs) or _plain(docs, "LogicalRDD") else durable(docs)


def numbered(docs: DataFrame, name: str = "row_id") -> DataFrame:
    """docs with a long that tells its rows apart and is the same in every scan, however many cores or splits it has.

    A row of a file has the file's number among the sorted paths and its place in the file. The paths are those that
    the driver holds for the scan anyway; they go out as a small table. Other tables are settled first: the partitions
    of a checkpoint do not change."""
    docs = settled(docs)
    places = _file_places(docs)
    if places is None:
        return docs.withColumn(name, F.monotonically_increasing_id())
    path, place = places
    files = sorted(set(docs.inputFiles()))
    if len(files) < 2:
        return docs.withColumn(name, place)
    spark, file, number = docs.sparkSession, f"{name}_file", f"{name}_number"
    text = spark._jsparkSession.createDataset([f"{i} {path}" for i, path in enumerate(files)], spark._jvm.org.apache.spark.sql.Encoders.STRING())
    cut = F.split("value", " ", 2)
    listed = DataFrame(text.toDF(), spark).select(cut[0].cast("long").alias(number), _one_slash(cut[1]).alias(file))
    found = docs.withColumns({file: _one_slash(path), name: place}).join(F.broadcast(listed), file, "left")
    known = F.coalesce(F.col(number), F.raise_error(F.concat(F.lit("not a file of the scan: "), F.col(file))).cast("long"))
    return found.withColumn(name, F.shiftleft(known, ROW_BITS).bitwiseOR(F.col(name))).drop(file, number)


#: Up to so many links the smallest neighbours, a row a node, are broadcast: some 50 MB.
BROADCAST_LINKS = 1_000_000


def connected_components(edges: DataFrame, max_rounds: int = 40, broadcast_links: int = BROADCAST_LINKS) -> DataFrame:
    """(node, root) for every node of the undirected edges (a long, b long); root is the component's smallest node.

    Alternating large-star and small-star rounds: each keeps the components, replaces links by links to smaller
    nodes and ends when nothing changes, after about log(n) rounds. No round gathers a node's neighbours in a task:
    the minima are partial aggregates; they are broadcast while there are few links, and else written first, so that
    the joins are between plain exchanges, which AQE splits where a node is hot."""
    e = durable(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark, before = (e.count(), None), None

    def beside(low: DataFrame) -> DataFrame:
        return F.broadcast(low) if mark[0] <= broadcast_links else durable(low)

    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = beside(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(beside(low), "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = durable(small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
