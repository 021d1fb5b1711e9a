"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import durable, lower_az, numbered

#: Bits of a filter word, words of a filter page.
WORD, PAGE = 64, 1024


def _repeats(keys: DataFrame, m: int, probes: int) -> DataFrame:
    """(page, held): pages of PAGE words of a filter of m bits, in which every bit that two rows set stands.

    First pass. Each task turns its rows' slots into words of the filter (ones: set bits, odd: bits set an odd number of
    times, n: how often any was set); what it sends are those words, never rows or hashes, and Spark ORs them up. Where
    n says that a bit of a word was set again and odd cannot tell which one, all its set bits count as set twice: that
    lets a unique text through as a possible repeat, and never misses a repeat."""
    slots = F.array(*[F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(m)) for i in range(probes)])
    bit = F.expr(f"shiftleft(1L, cast(slot % {WORD} as int))")
    words = keys.select(F.explode(slots).alias("slot")).groupBy(F.expr(f"slot div {WORD}").alias("word")).agg(
        F.bit_or(bit).alias("ones"), F.bit_xor(bit).alias("odd"), F.count("*").alias("n")
    )
    even = F.col("ones").bitwiseAND(F.bitwise_not("odd"))
    told = F.col("n") - F.bit_count("ones") == F.bit_count(even)
    twice = words.filter(F.col("n") > F.bit_count("ones")).select("word", F.when(told, even).otherwise(F.col("ones")).alias("bits"))
    pages = twice.groupBy(F.expr(f"word div {PAGE}").alias("page")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.expr(f"word % {PAGE}").alias("k"), "bits"))).alias("held")
    )
    return pages.select("page", F.expr(f"transform(sequence(0L, {PAGE - 1}L), i -> coalesce(held[i], 0L))").alias("held"))


def _with_maybe(keys: DataFrame, rows: int, bits_per_row: int, probes: int, filter_bytes: int) -> DataFrame:
    """keys with maybe: false if the text is certainly unique.

    Second pass: every row looks its slots up in the broadcast filter, in place. The filter has bits_per_row bits a row
    and filter_bytes at most: beyond that it fills up and tells fewer unique texts apart, which costs a shuffle of
    their hashes and changes no result."""
    m = 1 << min(max(16, math.ceil(math.log2(max(1, rows) * bits_per_row))), (8 * filter_bytes).bit_length() - 1)
    pages = F.broadcast(durable(_repeats(keys, m, probes)))  # m / 8 bytes at most
    out, every = keys, F.lit(True)
    for i in range(probes):
        slot = F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(m))
        out = out.withColumn(f"slot{i}", slot).join(pages.select(F.col("page").alias(f"page{i}"), F.col("held").alias(f"held{i}")), F.expr(f"slot{i} div {WORD * PAGE}") == F.col(f"page{i}"), "left")
        every = every & F.expr(f"coalesce(getbit(held{i}[cast(slot{i} div {WORD} % {PAGE} as int)], cast(slot{i} % {WORD} as int)), 0) = 1")
    return out.select(*keys.columns, every.alias("maybe"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    bits_per_row: int = 16,
    probes: int = 2,
    filter_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with the
    largest id stays; a null id is below all others, and of repeated ids one row stays. row_id is that of
    numbered(docs) where docs is settled. Only ids and hashes are kept; texts never shuffle, and of the texts that the
    filter knows to be unique nothing does. An empty table gives no rows; other columns of docs are not read, whatever
    their names."""
    keys = durable(
        numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).select(
            "row_id", "doc_id", F.sha2(lower_az(F.col("text")).cast("binary"), 256).alias("text_sha256")
        )
    )
    flagged = _with_maybe(keys, keys.count(), bits_per_row, probes, filter_bytes)
    alone = flagged.filter(~F.col("maybe")).select(
        "row_id", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    some = flagged.filter("maybe")
    # written first, so that the join's sides are both plain exchanges and AQE can split a hot group's rows
    groups = durable(
        some.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("top"))
    )
    grouped = some.join(groups, "text_sha256").select(
        "row_id", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("top.row_id")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(grouped)
