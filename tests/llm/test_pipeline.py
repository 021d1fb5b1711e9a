import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from graphloom.llm.quality import keep_quality  # noqa: E402
from graphloom.llm.simhash import simhash  # noqa: E402


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    r = random.Random(6)
    vocab = [f"{a}{b}" for a in "river stone walk under light small house sing".split() for b in "abcdefgh"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n)) + "."
    items = [(i, text(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(150):
        good = i % 6 != 0
        t = text(r.randint(40, 90)) if good else " | ".join(text(40).split())
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), 0))
    docs += [(200 + i, docs[i + 1][1].upper(), "en", "s", 1) for i in range(4)]
    docs += [(300 + i, docs[20 + i][1] + " tail", "en", "s", 1) for i in range(3)]
    docs += [(400 + i, text(30) + " " + items[i][1] + " " + text(10), "en", "s", 1) for i in range(3)]
    docs += [(500, None, None, None, None), (501, "", None, None, None), (1, docs[1][1], "en", "s", 5), (None, text(50), "en", "s", 1)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), items


def brute(rows, items):
    """The stages after the classifier on (doc_id, text) rows."""
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append((d is not None, d or 0, d, t))
    rows = [(max(g)[2], max(g)[3]) for g in groups.values()]
    f = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    near = {}
    for i, (d, t) in enumerate(rows):
        near.setdefault(find(i), []).append((d is None, d or 0, d, t))
    rows = [(min(g)[2], min(g)[3]) for g in near.values()]
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    bad = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(len(w) - 9)}
    return [(d, t or "") for d, t in rows if not any(tuple(words(t)[i : i + 10]) in bad for i in range(len(words(t)) - 9))]


def test_pipeline_by_brute_force(spark, tables):
    sf, items = tables
    got = corpus_pipeline.run(spark, sf).collect()
    kept = keep_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    want = brute([(x.doc_id, x.text) for x in kept], items)
    key = lambda p: (str(p[0]), hashlib.md5(p[1].encode()).hexdigest())
    assert sorted(key((g.doc_id, g.decoded)) for g in got) == sorted(map(key, want))
    ids = {g.doc_id for g in got}
    assert not ids & {400, 401, 402} and not ids & set(range(0, 150, 6)) and len(ids & set(range(150))) > 110


def test_stages_keep_the_columns_of_documents(spark, tables):
    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_on_columns_of_clashing_names(spark, tables):
    sf, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.selectExpr("*", "'r' AS row_id", "1 AS kept", "doc_id AS row_id_", "text AS contaminated")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, more, sf)
        assert got.columns == more.columns and got.count() == stage(spark, docs, sf).count()
