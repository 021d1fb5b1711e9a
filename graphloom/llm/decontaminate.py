"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import FOLD_WORDS, as_text, numbered, with_long


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD_WORDS).split()


class Blocks:
    """One automaton over the normalised items, and their words.

    Any window words in a row of an item hold a whole one of its aligned blocks of (window + 1) // 2 words, so the
    automaton files the blocks alone, as many letters as the items have, and not every window, ten times as many. A
    match is a place in an item; it counts if the equal words around it make a window. An item of fewer words is one
    block; one without words has none."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        self.window, self.names, self.words = window, [], []
        self.automaton = ahocorasick.Automaton()
        places: dict[bytes, list] = {}
        size = (window + 1) // 2
        for name, text in items:
            w = words_of(text)
            if not w:
                continue
            n = size if len(w) >= window else len(w)
            for i in range(0, len(w) - n + 1, n):
                places.setdefault(b" ".join(w[i : i + n]), []).append((len(self.words), i))
            self.names.append(name)
            self.words.append(w)
        # bytes are read as Latin-1 so that the automaton's letters are bytes; a block stands between spaces
        for block, at in places.items():
            self.automaton.add_word(f" {block.decode('latin-1')} ", (block.count(b" ") + 1, at))
        if places:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """(words, whether each is hit, items) of one text, scanned once."""
        w = words_of(text)
        if not w or not self.words:
            return len(w), np.zeros(len(w), bool), set()
        line = f" {b' '.join(w).decode('latin-1')} "
        matches = list(self.automaton.iter(line))
        if not matches:
            return len(w), np.zeros(len(w), bool), set()
        gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        edge, items = np.zeros(len(w) + 1, np.int64), set()
        known: dict[tuple[int, int], int] = {}  # by item and shift: the end of the last run of equal words
        for (_, (n, places)), last in zip(matches, np.searchsorted(gaps, [end for end, _ in matches]).tolist()):
            for k, at in places:
                item, i = self.words[k], last - n
                if known.get((k, i - at), -1) >= last:
                    continue
                low = 0
                while low < min(i, at) and w[i - low - 1] == item[at - low - 1]:
                    low += 1
                high = n
                while high < min(len(w) - i, len(item) - at) and w[i + high] == item[at + high]:
                    high += 1
                known[k, i - at] = i + high
                if low + high >= min(self.window, len(item)):
                    edge[i - low] += 1
                    edge[i + high] -= 1
                    items.add(self.names[k])
        return len(w), np.cumsum(edge)[:-1] > 0, items


def word_spans(text: str, flags: np.ndarray) -> list[tuple[int, int]]:
    """The character ranges in the original text of each run of hit words."""
    import regex

    at = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(at[i][0], at[j - 1][1]) for i, j in zip(edges[::2], edges[1::2])]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted strings), contaminated, spans (of the original text).

    The benchmark is a stated query set. While its texts stay under block_bytes of UTF-8, one automaton scans every text
    once; a larger benchmark is cut into blocks of that size, each with an automaton and a scan of its own, and the
    scans are folded row by row, so what a task holds stays bounded (some 60 bytes a letter of the block). Texts of any
    length are scanned whole. Null texts and items have no words; null item ids
    count as the string 'null'; repeated ids are one item; an empty benchmark hits nothing. Other columns of docs are
    not read."""
    schema = "row_id long, doc_id string, n_words long, hits array<struct<start:int,end:int>>, items array<string>, spans array<struct<start:int,end:int>>"
    sized = benchmark.select(F.col("item_id"), F.col("text"))
    sc = docs.sparkSession.sparkContext
    blocks, block, held = [], [], 0
    for r in sized.toLocalIterator():
        block.append(("null" if r[0] is None else str(r[0]), r[1]))
        held += len((r[1] or "").encode("utf-8", "surrogatepass"))
        if held >= block_bytes:
            blocks.append(sc.broadcast(block))
            block, held = [], 0
    blocks.append(sc.broadcast(block))

    def scanner(one):
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks = Blocks(one.value, window)
            for pdf in batches:
                out = []
                for row_id, doc_id, text in zip(pdf.row_id, pdf.doc_id, pdf.text):
                    n, flags, items = blocks.scan(text)
                    runs, spans = [], []
                    if items:
                        e = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                        runs = [{"start": int(i), "end": int(j)} for i, j in zip(e[::2], e[1::2])]
                        spans = [{"start": i, "end": j} for i, j in word_spans(text, flags)]
                    out.append((row_id, doc_id, n, runs, sorted(items), spans))
                yield pd.DataFrame(out, columns=["row_id", "doc_id", "n_words", "hits", "items", "spans"])

        return scan

    rows = numbered(docs.select(as_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("row_id", "doc_id", "text")
    scans = [rows.mapInPandas(scanner(b), schema) for b in blocks]
    if len(scans) == 1:
        return _counted(scans[0])
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    merged = every.groupBy("row_id", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return _counted(merged)


def _counted(df: DataFrame) -> DataFrame:
    """Words in the union of the sorted runs."""
    covered = F.expr(
        "aggregate(hits, named_struct('n', 0L, 'to', 0), (a, h) -> named_struct("
        "'n', a.n + greatest(0, h.end - greatest(h.start, a.to)), 'to', greatest(a.to, h.end))).n"
    )
    return with_long(df, "doc_id").select("row_id", "doc_id", "n_words", covered.alias("n_hit"), "items", (F.size("hits") > 0).alias("contaminated"), "spans")
