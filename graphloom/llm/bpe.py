"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_text, with_long


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """What two tokens merge into, looked up once for each pair of ids: the rank of their joined bytes, or none."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.width = max(self.tokens, default=0) + 1
        self.pairs: dict[int, int] = {}

    def of(self, a: int, b: int) -> int:
        """The rank, -1 for none. At most as many pairs are held as can merge or stood side by side in the texts seen."""
        key = a * self.width + b
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each word. An inverted index from what a pair merges into to the places of that pair in any word is
    worked off by rank; a merge touches only the pairs beside it.

    A library encodes a word by taking the lowest rank, leftmost first, again and again. Words don't touch each other,
    so ranks may be taken over all of them at once; within a word a merge that opens a lower rank hands the word's
    other places of this rank back until that one is done."""
    whole = [merges.ranks.get(w) for w in words]
    part: list[int] = []  # a token's id at its first byte, -1 at its others and between words
    starts, of = [], merges.of
    for w, r in zip(words, whole):
        starts.append(len(part))
        if r is None:
            part += map(merges.single.__getitem__, w)
            part.append(-1)
    if None in part:
        raise ValueError("the vocabulary lacks a byte of the texts")
    n = len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    for i in range(n - 1):
        a, b = part[i], part[i + 1]
        if a >= 0 and b >= 0 and (r := of(a, b)) >= 0:
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
    queue = list(index)
    heapq.heapify(queue)

    def opened(i: int, r: int) -> None:
        if r not in index:
            index[r] = []
            heapq.heappush(queue, r)
        index[r].append(i)

    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank)
        places.sort()
        back, until, last = [], -1, -1
        for i in places:
            if i == last:
                continue
            last = i
            if i < until:  # still in the word that waits for a lower rank
                back.append(i)
                continue
            a, j = part[i], after[i]
            if a < 0 or part[j] < 0 or of(a, part[j]) != rank:
                continue
            part[i], part[j] = rank, -1
            after[i] = k = after[j]
            before[k] = i
            lower = False
            if (b := part[k]) >= 0 and (r := of(rank, b)) >= 0:
                opened(i, r)
                lower = r < rank
            h = before[i]
            if h >= 0 and part[h] >= 0 and (r := of(part[h], rank)) >= 0:
                opened(h, r)
                lower = lower or r < rank
            if lower:
                until = i
                while part[until] >= 0:
                    until = after[until]
        if back:
            for i in back:
                opened(i, rank)
    out = []
    for r, s in zip(whole, starts):
        if r is not None:
            out.append([r])
            continue
        ids = []
        while (a := part[s]) >= 0:
            ids.append(a)
            s = after[s]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts in batches; keeps the ids of at most held words of at most 64 characters that it met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, held: int = 800_000):
        import regex

        self.merges, self.find, self.held = Merges(ranks), regex.compile(pattern).findall, held
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        if len(self.known) > self.held // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = {w for s in split for w in s}.difference(known)
        for w in new.intersection(older):
            known[w] = older[w]
        new = sorted(new.difference(known))
        fresh = replay([w.encode("utf-8", "surrogatepass") for w in new], self.merges)
        known.update(zip(new, (array("I", ids).tobytes() for ids in fresh)))
        out = [b"".join([known[w] for w in s]) for s in split]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, array("I", ids)))


#: The encoder of a worker process: tasks that follow each other on it share what it has learnt of the words.
_HELD: dict = {}


def _encoder(name: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if (name, pattern) not in _HELD:
        _HELD.clear()
        _HELD[name, pattern] = Encoder(ranks, pattern)
    return _HELD[name, pattern]


def bpe_encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests_only: bool = False,
    batch_chars: int = 1_000_000,
) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (array<int>), decoded (string); with digests_only ids_sha256 and decoded_sha256.

    Each match of pattern is encoded separately and without special tokens. The distinct words of some batch_chars
    characters are replayed together. Null is the empty text: no ids. A word whose bytes the ranks cannot spell raises.
    Nothing shuffles; the ranks are a fixed vocabulary and are broadcast. Other columns are not read."""
    import hashlib

    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("the vocabulary is larger than a broadcast of 64 MB")
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ranks))
    schema = "doc_id string, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(*held.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for pdf in batches:
            texts, at = [t if t is not None else "" for t in pdf.text], 0
            while at < len(texts):  # results leave in slices too, so that a task holds one slice of them
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= batch_chars):
                    size += len(texts[to])
                    to += 1
                ids = enc.encode(texts[at:to])
                out = {"doc_id": pdf.doc_id.iloc[at:to].array, "n_tokens": [len(x) // 4 for x in ids]}
                if digests_only:
                    out |= {"ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(enc.decode(x)) for x in ids]}
                else:
                    out |= {"ids": [np.frombuffer(x, "<i4") for x in ids], "decoded": [enc.decode(x).decode("utf-8", "replace") for x in ids]}
                yield pd.DataFrame(out)
                at = to

    return with_long(docs.select(as_text(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema), "doc_id")
