"""SimHash near-deduplication by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import FOLD, as_text, connected_components, durable, numbered, with_long

#: Fixed by the fingerprint's definition: bits, and the segments whose balls are enumerated.
BITS, SEGMENTS, WIDTH = 64, 2, 32


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint: bit i is set if it is in over half the shingles' XXH64. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(BITS, np.int64), 1 << 14
    a, b = starts[: n - k + 1], ends[k - 1 :]
    for at in range(0, len(a), step):
        h = np.array([digest(line[i:j], seed) for i, j in zip(a[at : at + step].tolist(), b[at : at + step].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(a)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(row_id, doc_id, fp) per row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([simhash(t, shingle, seed) for t in pdf.text], np.uint64).astype(np.int64)
            yield pd.DataFrame({"row_id": pdf.row_id, "doc_id": pdf.doc_id, "fp": fps})

    rows = numbered(docs.select(as_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("row_id", "doc_id", "text")
    return with_long(rows.mapInPandas(run, "row_id long, doc_id string, fp long"), "doc_id")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints: each joins its tree when first reached."""
    edges, rest = [], fps
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            edges += [(int(x), int(y)) for y in rest[near]]
            stack += list(rest[near])
            rest = rest[~near]
    return edges


def _probe(radius: int):
    """Rows (key, fp) sorted by key -> verified links (a, b); the fingerprints of a key may straddle batches."""

    def links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([first, [len(keys)]]))
        value = (fps >> ((keys >> WIDTH).astype(np.uint64) * np.uint64(WIDTH))) & np.uint64(0xFFFFFFFF)
        low, high = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
        # equal segments meet in 33 keys; the one that is their own value serves them
        use = (size > 1) & ((low < high) | (low == (keys[first] & 0xFFFFFFFF).astype(np.uint64)))
        pair = first[use & (size == 2)]
        x, y = fps[pair], fps[pair + 1]
        near = np.bitwise_count(x ^ y) <= radius
        found = list(zip(x[near].tolist(), y[near].tolist()))
        for i, n in zip(first[use & (size > 2)], size[use & (size > 2)]):
            found += _forest(fps[i : i + n], radius)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for pdf in batches:
            keys = np.concatenate([keys, pdf.key.to_numpy(np.int64)])
            fps = np.concatenate([fps, pdf.fp.to_numpy(np.int64).view(np.uint64)])
            if len(keys) and keys[0] != keys[-1]:
                cut = np.searchsorted(keys, keys[-1])
                yield frame(links(keys[:cut], fps[:cut]))
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield frame(links(keys, fps))

    def frame(found) -> pd.DataFrame:
        e = np.array(found or np.zeros((0, 2)), np.uint64).astype(np.int64)
        return pd.DataFrame({"a": e.min(1) if len(e) else e[:, 0], "b": e.max(1) if len(e) else e[:, 1]}).drop_duplicates()

    return run


def near_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Verified links (a, b) among distinct fingerprints (fp) that keep every component of the graph of all links.

    Two fingerprints within radius 4 differ in at most 2 bits of one 32-bit half, so the balls of radius 1 around
    those halves meet: each fingerprint is filed under the 33 values of either ball, and the fingerprints filed under
    one value are compared at full width. A value emits a spanning forest of its links, so a group of n near copies
    gives n - 1 rows, and no link between components is lost. What one value can hold is bounded by the distinct
    fingerprints near it, since equal ones were merged before."""
    if not 0 <= radius <= 5:
        raise ValueError("two segments with balls of radius 1 cover distances up to 5")
    half = F.expr("transform(array(0, 1), s -> shiftrightunsigned(fp, 32 * s) & 4294967295L)")
    filed = distinct.select("fp", half.alias("halves")).select(
        "fp",
        F.explode(
            F.expr(
                "flatten(transform(array(0, 1), s -> transform(sequence(-1, 31), b -> "
                "(shiftleft(cast(s as long), 32) | (halves[s] ^ if(b < 0, 0L, shiftleft(1L, b)))))))"
            )
        ).alias("key"),
    )
    dealt = filed.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInPandas(_probe(radius), "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Per row of docs: row_id, doc_id, fp (long), fingerprint (16 hex digits), component_id (the smallest id of its
    component), kept (true for one row of each component, one with component_id).

    Null texts and texts without words have fingerprint zero and link like others. Null ids are passed over by the
    minimum; a component of null ids alone has component_id null. Repeated rows come back repeated and one is kept; an
    empty table gives no rows; other columns are not read. row_id is that of
    numbered(docs) where docs is settled."""
    fps = durable(fingerprints(docs, id_col, text_col, shingle, seed))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))
    groups = durable(fps.groupBy("fp").agg(first.alias("first")))
    roots = connected_components(near_links(groups.select("fp"), radius))
    # minima and names are written before they are joined: both sides are then plain exchanges, which AQE splits where hot
    rooted = durable(groups.join(roots, groups.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("first")))
    named = durable(rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("first")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp").select("row_id", "doc_id", "fp", hexed, "component_id", (F.col("row_id") == F.col("first")).alias("kept"))
