import collections
import hashlib
import random

import pytest
import xxhash

from graphloom.llm.common import connected_components
from graphloom.llm.decontaminate import Blocks, decontaminate
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.simhash import near_links, simhash, simhash_dedup

SCHEMA = "doc_id long, text string, keep_id string, fp string"
ROWS = [
    (1, "Same text", "x", None), (2, "same TEXT", None, "y"), (3, "", None, None), (4, None, None, None),
    (5, "É only", None, None), (6, "é only", None, None), (None, "same text", None, None), (2, "same TEXT", None, None),
    (7, "word " * 30_000, None, None), (8, "a b c", None, None), (9, "A B\tc", None, None),
]


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("filter_bytes", [64 << 20, 16])
def test_exact_dedup_by_brute_force(spark, filter_bytes):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA), filter_bytes=filter_bytes).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[fold(r[1])].append(r[0])
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    assert {r.text_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).count() == simhash_dedup(none).count() == 0
    assert decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def slow_simhash(t):
    w = fold(t).encode().split()
    n = min(4, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_bits():
    for t in [None, "", " \t", "One two", "one two three four five five five", "é " * 9 + "\x0bz"]:
        assert simhash(t) == slow_simhash(t)


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_near_links_keep_every_component(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)} | {0}
    for c in list(fps)[:12]:
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: i for i, x in enumerate(signed)}
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert all((fps[at[e.a]] ^ fps[at[e.b]]).bit_count() <= 4 for e in got)
    assert union(len(fps), [(at[e.a], at[e.b]) for e in got]) == union(len(fps), brute)


def test_simhash_dedup_rows(spark):
    got = simhash_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    f = [slow_simhash(r[1]) for r in ROWS]
    brute = union(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    least = {}
    for r, c in zip(ROWS, brute):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    want = sorted((str(r[0]), f"{x:016x}", least[c]) for r, x, c in zip(ROWS, f, brute))
    assert sorted((str(g.doc_id), g.fingerprint, g.component_id) for g in got) == want


def test_components(spark):
    r = random.Random(1)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(0, i) for i in range(250, 300)] + [(i, i + 1) for i in range(400, 480)]
    roots = union(500, e)
    for few in (10**6, 0):
        got = {x.node: x.root for x in connected_components(spark.createDataFrame(e, "a long, b long"), broadcast_links=few).collect()}
        assert got == {n: roots[n] for p in e if p[0] != p[1] for n in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontaminate_by_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([14, 10, 3, 25])] + [(9, None), (10, " ,. "), (None, "lonely null item")]
    docs = [(1, "X, " + items[0][1].upper().replace(" ", "-- ") + " tail"), (2, items[1][1] + " " + items[2][1]), (3, None), (4, "clean words"), (5, "É" + items[3][1]), (6, "a lonely NULL item!"), (7, items[0][1] * 400)]
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    for block in (8 << 20, 20):
        got = {x.doc_id: x for x in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()}
        for i, t in docs:
            w, hit, found = words(t), set(), set()
            for k, item in items:
                v = words(item)
                n = min(10, len(v))
                for win in [v[a : a + n] for a in range(len(v) - n + 1)] if v else []:
                    for a in range(len(w) - n + 1):
                        if w[a : a + n] == win:
                            hit |= set(range(a, a + n))
                            found.add("null" if k is None else str(k))
            x = got[i]
            assert (x.n_words, x.n_hit, x["items"], x.contaminated) == (len(w), len(hit), sorted(found), bool(hit)), (i, block)
        assert docs[0][1][got[1].spans[0].start : got[1].spans[0].end].startswith(items[0][1].upper()[:3])


def test_decontaminate_long_texts_and_clashing_columns(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = "w " * 200_000 + item + " w" * 100_000
    docs = spark.createDataFrame([(1, long, 5, "x", True), (2, "", 6, None, False), (2, item.upper(), None, "y", None)], "doc_id long, text string, row_id long, items string, contaminated boolean")
    found = decontaminate(docs, spark.createDataFrame([(7, item, "z"), (7, item, None)], "item_id long, text string, n_words string"))
    assert found.columns == ["row_id", "doc_id", "n_words", "n_hit", "items", "contaminated", "spans"]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()) == [(1, 300_030, 30, ["7"]), (2, 0, 0, []), (2, 30, 30, ["7"])]


@pytest.mark.parametrize(("window", "n"), [(1, 1), (2, 5), (9, 40), (10, 10), (11, 23)])
def test_blocks_find_what_windows_find(window, n):
    r = random.Random(window * 100 + n)
    word = lambda: r.choice("abc")
    items = [(str(k), " ".join(word() for _ in range(r.randint(1, n)))) for k in range(6)]
    blocks = Blocks(items, window)
    for _ in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        hit, found = set(), set()
        for k, item in items:
            v = item.split()
            m = min(window, len(v))
            for i in range(len(v) - m + 1):
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[i : i + m]:
                        hit |= set(range(a, a + m))
                        found.add(k)
        size, flags, names = blocks.scan(" ".join(w))
        assert (size, set(flags.nonzero()[0].tolist()), names) == (len(w), hit, found)


def test_unique_rows_meet_no_exchange(spark, capsys):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    for filter_bytes in (64 << 20, 16):
        exact_dedup(rows, filter_bytes=filter_bytes).explain()
        plan = capsys.readouterr().out
        head, _, _ = plan.partition("SortMergeJoin")
        assert "Exchange hashpartitioning" not in head and plan.count("BroadcastExchange") + plan.count("ReusedExchange") >= 2
