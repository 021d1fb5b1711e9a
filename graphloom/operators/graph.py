"""The temporal multigraph: canonical edges, nodes, snapshots and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.operators.common import durable, small


def prepare(quads: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """quads with source, target, rel (canonical, merged), n_merged and ok (no part missing).

    merges (longer, shorter) is applied once to either side; it is a reviewed list and broadcast while it is small."""
    year = T.normalize_year(F.col("year"))
    rows = quads.withColumns({
        "source": T.canonicalize_entity(F.col("subject")), "target": T.canonicalize_entity(F.col("object")),
        "rel": T.graph_relation(F.col("relation")), "year_int": year, "n_merged": F.lit(0),
    })
    if merges is not None:
        m = small(merges.select("longer", "shorter").filter("longer is not null"))
        for side in ("source", "target"):
            hit = m.select(F.col("longer").alias("_from"), F.col("shorter").alias("_to"))
            rows = rows.join(hit, rows[side] == hit["_from"], "left").withColumns({
                side: F.coalesce("_to", side), "n_merged": F.col("n_merged") + F.col("_from").isNotNull().cast("int"),
            }).drop("_from", "_to")
        named = F.coalesce((F.col("source") != "") & (F.col("target") != ""), F.lit(False))
    else:  # of the raw names, so that a filter does not make the ids a second time
        named = T.has_text(F.col("subject"), T.MARKS) & T.has_text(F.col("object"), T.MARKS)
    return rows.withColumn("ok", named & (F.trim(F.coalesce(F.col("relation"), F.lit(""))) != "") & F.col("year_int").isNotNull())


#: Bits of the place inside its partition in Spark's increasing numbers.
PLACE_BITS = 33


def indexed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a dense position from 0 in the given total order.

    Rows are range-partitioned and sorted, numbered inside their partition by the order they stand in, and shifted by the
    rows of the partitions before: no task sees more than its range, the driver gets one count a partition."""
    placed = durable(ordered(df, order, "__at"))
    part = F.shiftright("__at", PLACE_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(base), part == F.col("__part")).withColumn(name, (F.col("__base") + inside).cast("long")).drop("__part", "__at", "__base")


def ordered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a number that grows in the given total order, with gaps between the partitions: one shuffle, nothing kept.

    To be read once in a plan, or kept first: the ranges are drawn anew for another shuffle."""
    return df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def edges(prepared: DataFrame, order: list[str] | None = None) -> DataFrame:
    """source, target, key, relation, year, timestamp, paper_id, _seq; key is relation:position among the kept rows.

    _seq is the position itself where the order is given by other columns."""
    order = order or ["_seq"]
    kept = prepared.filter("ok").select("source", "target", "rel", "year_int", "paper_id", *order)
    rows = indexed(kept, order, "position")
    return rows.select(
        "source", "target", F.concat_ws(":", "rel", F.col("position").cast("string")).alias("key"), F.col("rel").alias("relation"),
        F.col("year_int").alias("year"), F.col("year_int").alias("timestamp"), "paper_id", F.col("_seq" if "_seq" in order else "position").alias("_seq"),
    )


def surface_forms(prepared: DataFrame) -> DataFrame:
    """entity, surface, n, first_seq over both sides of the kept rows; a subject stands before its object."""
    kept = prepared.filter("ok")
    sides = F.array(*[
        F.struct(F.col(e).alias("entity"), F.trim(F.col(raw)).alias("surface"), (F.col("_seq") * 2 + k).alias("at"))
        for k, (e, raw) in enumerate((("source", "subject"), ("target", "object")))
    ])  # one reading of the rows, in whose order _seq may have been drawn
    return kept.select(F.inline(sides)).groupBy("entity", "surface").agg(F.count("*").alias("n"), F.min("at").alias("first_seq"))


def nodes(forms: DataFrame) -> DataFrame:
    """id, label, n_forms: the most frequent surface form, the first seen on a tie; acronyms in upper case."""
    best = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "first_seq"))
    count = F.count("*").over(Window.partitionBy("entity"))
    top = forms.withColumn("_rank", best).withColumn("n_forms", count).filter("_rank = 1")
    return top.select(F.col("entity").alias("id"), T.display_label(F.col("entity"), F.col("surface")).alias("label"), "n_forms")


def build_stats(prepared: DataFrame, node_rows: DataFrame) -> DataFrame:
    """input, skipped, merges_applied (before the skip), unique_entities, multi_form_entities."""
    a = prepared.agg(F.count("*").alias("input"), F.count_if(~F.col("ok")).alias("skipped"), F.coalesce(F.sum("n_merged"), F.lit(0)).cast("long").alias("merges_applied"))
    b = node_rows.agg(F.count("*").alias("unique_entities"), F.count_if(F.col("n_forms") > 1).alias("multi_form_entities"))
    return a.crossJoin(b)  # one row each


def relation_counts(edge_rows: DataFrame, top: int = 10) -> DataFrame:
    """The top-k report of relations."""
    return edge_rows.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(top)


def snapshots(edge_rows: DataFrame, cutoffs: list[int], final_year: int) -> DataFrame:
    """edges with cutoff_year, cumulative: an edge is in every snapshot whose cutoff is not before its year.

    Each row carries its cutoffs as an array, so the fan-out needs no join."""
    marks = F.array(*[F.lit(c) for c in sorted({*cutoffs, final_year})])
    return edge_rows.withColumn("cutoff_year", F.explode(F.filter(marks, lambda c: c >= F.col("year"))))


def snapshot_nodes(snaps: DataFrame) -> DataFrame:
    """Distinct (cutoff_year, node)."""
    return snaps.select("cutoff_year", F.explode(F.array("source", "target")).alias("node")).distinct()


def undirected_pairs(df: DataFrame, by: list[str] = (), loops: bool = False) -> DataFrame:
    """Distinct (by, node_a, node_b) with node_a < node_b; self-loops only if asked for."""
    some = df.filter("source is not null and target is not null")
    if not loops:
        some = some.filter("source <> target")
    return some.select(*by, F.least("source", "target").alias("node_a"), F.greatest("source", "target").alias("node_b")).distinct()


def neighbours(edge_rows: DataFrame) -> DataFrame:
    """Distinct (node, nbr) in both directions; a self-loop makes a node its own neighbour once."""
    p = edge_rows.select("source", "target").distinct()
    return p.select(F.col("source").alias("node"), F.col("target").alias("nbr")).union(p.select("target", "source")).distinct()


def degree(edge_rows: DataFrame) -> DataFrame:
    return neighbours(edge_rows).groupBy("node").agg(F.count("*").alias("degree"))


def common_neighbours(pairs: DataFrame, nbrs: DataFrame) -> DataFrame:
    """pairs (node_a, node_b) with common_neighbors: the neighbours of the node with fewer that are also the other's, by
    two equi-joins, so a hub fans out only where it meets another."""
    deg = nbrs.groupBy("node").agg(F.count("*").alias("n"))
    sized = pairs.select("node_a", "node_b").distinct()
    for s in "ab":
        sized = sized.join(deg.select(F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}")), f"node_{s}", "left")
    fewer = F.coalesce("n_a", F.lit(0)) <= F.coalesce("n_b", F.lit(0))
    few = sized.select("node_a", "node_b", F.when(fewer, F.col("node_a")).otherwise(F.col("node_b")).alias("few"), F.when(fewer, F.col("node_b")).otherwise(F.col("node_a")).alias("many"))
    met = few.join(nbrs.select(F.col("node").alias("few"), "nbr"), "few").join(nbrs.select(F.col("node").alias("many"), "nbr"), ["many", "nbr"], "left_semi")
    counts = met.groupBy("node_a", "node_b").agg(F.count("*").alias("common_neighbors"))
    return pairs.join(counts, ["node_a", "node_b"], "left").withColumn("common_neighbors", F.coalesce("common_neighbors", F.lit(0).cast("long")))


def active_nodes(edge_rows: DataFrame, final_year: int, window: int) -> DataFrame:
    """Distinct nodes with an edge in the last window years; later edges count too."""
    recent = edge_rows.filter(F.col("year") >= final_year - window + 1)
    return recent.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def first_years(edge_rows: DataFrame) -> DataFrame:
    """node, first_year: a node is in every snapshot from its first edge on, so this one row says it for all cutoffs."""
    both = edge_rows.select(F.explode(F.array("source", "target")).alias("node"), "year")
    return both.groupBy("node").agg(F.min("year").alias("first_year"))


def pair_first_years(edge_rows: DataFrame, loops: bool = False) -> DataFrame:
    """node_a, node_b, first_year of each undirected pair; self-loops only if asked for."""
    some = edge_rows.filter("source is not null and target is not null" + ("" if loops else " and source <> target"))
    return some.groupBy(F.least("source", "target").alias("node_a"), F.greatest("source", "target").alias("node_b")).agg(F.min("year").alias("first_year"))


def summary(edge_rows: DataFrame, cutoffs: list[int], final_year: int) -> DataFrame:
    """cutoff_year, n_nodes, n_edges of each snapshot, from counts by year: nothing is fanned out but the years."""
    marks = F.array(*[F.lit(c) for c in sorted({*cutoffs, final_year})])

    def cumulated(df: DataFrame, year: str, name: str) -> DataFrame:
        per = df.groupBy(year).agg(F.count("*").alias("_n"))
        fanned = per.select(F.explode(F.filter(marks, lambda c: c >= F.col(year))).alias("cutoff_year"), "_n")
        return fanned.groupBy("cutoff_year").agg(F.sum("_n").alias(name))

    n = cumulated(first_years(edge_rows), "first_year", "n_nodes")
    e = cumulated(edge_rows.select("year"), "year", "n_edges")
    return n.join(e, "cutoff_year").select("cutoff_year", "n_nodes", "n_edges")


def collapse_chains(spark: SparkSession, merges: DataFrame, max_rounds: int = 20) -> DataFrame:
    """The merge map with every chain followed to its end; entries on a cycle are dropped."""
    m = durable(merges.select("longer", "shorter").filter("longer <> shorter").distinct())
    for _ in range(max_rounds):
        nxt = m.select(F.col("longer").alias("_from"), F.col("shorter").alias("_to"))
        moved = m.join(nxt, m.shorter == nxt["_from"], "left").select("longer", F.coalesce("_to", "shorter").alias("shorter"), F.col("_to").isNotNull().alias("_moved"))
        moved = durable(moved.filter("longer <> shorter"))
        m = moved.select("longer", "shorter")
        if moved.filter("_moved").isEmpty():
            break
    return m
