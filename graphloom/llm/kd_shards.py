"""Sharding by a k-d tree over document metadata, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import durable

#: A coordinate has AXIS_BITS; below them TIE_BITS of a unit's hash order units with equal coordinates.
AXIS_BITS, TIE_BITS, STEP_BITS = 20, 40, 12


def _axes(docs: DataFrame, id_col: str) -> tuple[list[Column], list[str]]:
    """Coordinates of the metadata as long columns in [0, 2^AXIS_BITS): categories by hash, counts by logarithm, ids as they are."""
    top = (1 << AXIS_BITS) - 1
    have = set(docs.columns)
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << AXIS_BITS))
    cols = [bucket(c).alias(f"axis_{c}") for c in ("source", "lang") if c in have]
    if "n_chars" in have:
        size = F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
        cols.append(F.least(F.floor(F.log2(size + 1) * top / 40), F.lit(top)).cast("long").alias("axis_n_chars"))
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    span = max(1, (high or 0) - (low or 0))
    cols.append(F.coalesce(F.floor((F.col(id_col) - (low or 0)) / span * top), F.lit(0)).cast("long").alias("axis_id"))
    return cols, [f"axis_{c}" for c in ("source", "lang", "n_chars") if c in have] + ["axis_id"]


class _Node:
    """A part of the tree that is to become leaves first .. first + leaves - 1."""

    def __init__(self, number: int, first: int, leaves: int):
        self.number, self.first, self.leaves = number, first, leaves
        self.axis = self.cut = self.left = self.right = None


def _place(nodes: list[_Node]) -> Column:
    """The number of the node that a unit is in, for the tree as grown so far."""

    def at(node: _Node) -> Column:
        if node.left is None:
            return F.lit(node.number)
        return F.when(_key(node.axis) < node.cut, at(node.left)).otherwise(at(node.right))

    return at(nodes[0])


def _key(axis: str) -> Column:
    return F.shiftleft(F.col(axis), TIE_BITS).bitwiseOR(F.col("tie"))


def grow_tree(units: DataFrame, axes: list[str], leaves: int, tolerance: float) -> list[_Node]:
    """A k-d tree with that many leaves over units (axes, tie, weight).

    A node of k leaves is cut along its widest axis so that floor(k/2)/k of its bytes lie below. The weighted quantile
    is found for all nodes of a level at once: sums by STEP_BITS of the key, then again inside the bin that the
    quantile falls in, until that bin weighs under tolerance of a leaf. The driver gets at most leaves * 2^STEP_BITS
    sums, whatever the input."""
    nodes = [_Node(0, 0, leaves)]
    while wide := [n for n in nodes if n.left is None and n.leaves > 1]:
        placed = units.withColumn("node", _place(nodes)).filter(F.col("node").isin([n.number for n in wide]))
        stats = {
            r["node"]: r
            for r in placed.groupBy("node").agg(
                F.sum("weight").alias("weight"), *[(F.max(a) - F.min(a)).alias(a) for a in axes]
            ).collect()
        }
        search = {}
        for n in wide:
            r = stats.get(n.number)
            n.axis = max(axes, key=lambda a: (r[a] if r else 0, a))
            total = float(r["weight"]) if r else 0.0
            want = total * (n.leaves // 2) / n.leaves
            search[n.number] = {"n": n, "want": want, "below": 0.0, "prefix": 0, "fine": tolerance * total / n.leaves, "cut": 0 if total else 1}
        by_axis = F.coalesce(*[F.when(F.col("node").isin([n.number for n in wide if n.axis == a]), _key(a)) for a in axes if any(n.axis == a for n in wide)])
        keyed = placed.withColumn("key", by_axis)
        shift = AXIS_BITS + TIE_BITS
        open_ = {k: s for k, s in search.items() if not s["cut"]}
        while open_ and shift > 0:
            shift -= STEP_BITS
            inside = F.lit(False)
            for k, s in open_.items():
                inside = inside | ((F.col("node") == k) & (F.shiftright("key", shift + STEP_BITS) == s["prefix"]))
            rows = keyed.filter(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("weight")).collect()
            bins: dict[int, list] = {}
            for r in rows:
                bins.setdefault(r["node"], []).append((r["bin"], float(r["weight"])))
            for k in list(open_):
                s = open_[k]
                for b, w in sorted(bins.get(k, [])):
                    if s["below"] + w >= s["want"]:
                        break
                    s["below"] += w
                s["prefix"] = b
                if w <= s["fine"] or shift == 0:
                    past = s["below"] + w - s["want"] < s["want"] - s["below"]
                    s["cut"] = (b + past) << shift
                    del open_[k]
        for s in search.values():
            n = s["n"]
            half = n.leaves // 2
            n.cut = s["cut"]
            n.left, n.right = _Node(len(nodes), n.first, half), _Node(len(nodes) + 1, n.first + half, n.leaves - half)
            nodes += [n.left, n.right]
    return nodes


def kd_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shards: int | None = None,
    target_bytes: int | None = None,
    whole_share: float = 0.25,
    piece_share: float = 0.0625,
    tolerance: float = 0.002,
    rows_per_run: int = 250_000,
) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard, slot. Shards get near equal bytes.

    size is the text's UTF-8 bytes plus 8; null counts as the empty text. Give shards, or target_bytes for as many as
    that takes. Equal texts form one unit that stays in one shard, unless it weighs over whole_share of a shard: then
    it is dealt by hash into pieces of about piece_share of one, so a hot group cannot unbalance the shards. slot
    numbers a shard's rows from 0 without gaps; it is counted in runs of about rows_per_run, so no task holds a whole
    shard. Only ids, hashes and coordinates move. Null metadata and ids have coordinates of their own; repeated rows
    keep a slot each; an empty table gives no rows; other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    axes, names = _axes(docs, id_col)
    rows = durable(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
            F.monotonically_increasing_id().alias("row_id"), *axes,
        )
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    limit = max(1.0, total / shards * whole_share)
    group = ["text_hash", "text_crc32"]
    # at most shards / whole_share groups can weigh more than limit, so the broadcast is bounded
    heavy = rows.groupBy(*group).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit).select(
        *group, F.ceil(F.col("bytes") / limit * (whole_share / piece_share)).alias("pieces")
    )
    piece = F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("pieces")), F.lit(0)).cast("long")
    rows = rows.join(F.broadcast(heavy), group, "left").withColumn("piece", piece).drop("pieces")
    unit = [*group, "piece"]
    units = durable(
        rows.groupBy(*unit).agg(F.sum("size").alias("weight"), *[F.min(a).alias(a) for a in names])
        .withColumn("tie", F.pmod(F.xxhash64(*unit), F.lit(1 << TIE_BITS)))
    )
    nodes = grow_tree(units, names, shards, tolerance)
    leaf = F.create_map(*[F.lit(x) for n in nodes if n.left is None for x in (n.number, n.first)])
    placed = units.select(*unit, leaf[_place(nodes)].cast("int").alias("shard"))
    runs = max(16, math.ceil(count / shards / rows_per_run))
    dealt = durable(
        rows.join(placed, unit).select("doc_id", "size", "text_crc32", "shard", "row_id", F.pmod(F.xxhash64("row_id", F.lit("run")), F.lit(runs)).alias("run"))
    )
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard", "run").agg(F.count("*").alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "row_id")) - 1
    numbered = dealt.withColumn("inside", inside).join(base, ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"))
