import binascii
import collections
import hashlib
import math
import os
import random
import re

import pytest

from graphloom.llm.kd_shards import kd_shards
from graphloom.llm.licenses import BASE, license_summary, resolve, rules, scan_licenses
from graphloom.llm.pii import find_personal_data, sanitise, span_summary
from graphloom.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size string"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def corpus(n=3000, hot=900, seed=2):
    r = random.Random(seed)
    out = [(i, "x" * r.randint(0, 400) + f"é{i}" * (r.random() < 0.9), r.choice(["en", "fr", None]), "src0" if r.random() < 0.4 else f"s{r.randrange(9)}", r.randint(0, 400), None, None) for i in range(n)]
    out += [(n + i, "hot copy " * 20, "en", "src1", 180, None, None) for i in range(hot)]
    out += [(n + hot + i, f"twin {i // 2} " * 9, "de", f"s{i}", 90, None, None) for i in range(200)]
    return out + [(None, None, None, None, None, None, None), (5, None, None, None, None, None, None), (6, "long " * 2000, "en", "a", 10_000, None, None)]


def test_shards_are_near_equal_and_keep_copies_together(spark):
    rows = corpus()
    got = kd_shards(spark.createDataFrame(rows, DOCS), shards=24).collect()
    assert len(got) == len(rows)
    assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 8, binascii.crc32((r[1] or "").encode())) for r in rows)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for g in got:
        load[g.shard] += g.size
        slots[g.shard].append(g.slot)
    fair = sum(load.values()) / 24
    assert set(load) == set(range(24)) and max(abs(v - fair) for v in load.values()) < 0.1 * fair
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r[0]: r[1] for r in rows}
    homes = collections.defaultdict(set)
    for g in got:
        homes[text[g.doc_id]].add(g.shard)
    assert all(len(homes[t]) == 1 for t in homes if t and t.startswith("twin"))


def test_shards_of_few_and_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert kd_shards(none, shards=24).count() == 0
    one = kd_shards(spark.createDataFrame(corpus(0, 0)[-3:], DOCS), target_bytes=5000).collect()
    assert len(one) == 3 and {g.slot for g in one} <= {0, 1, 2}


def place_all(t):
    w = words(t)
    out = []
    for phrase, label in BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, sorted(out)


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. mit license mit-license", None, "", " .,;",
    "GNU General Public License, version 3. Also CC BY-NC 4.0", "no licence here " * 5000 + "CC BY", "smit license", "ÉMIT License mit license",
    "SPDX-License-Identifier: GPL-2.0-only", "Permission is hereby granted, free of charge, to any person obtaining a copy",
]


def brute_kept(found):
    """found: (first, last, priority, label, rule). One at a time, the surest first, against all that were kept before."""
    kept = []
    for level in sorted({f[2] for f in found}, reverse=True):
        alive = [f for f in found if f[2] == level and not any(k[0] <= f[1] and f[0] <= k[1] for k in kept)]
        for f in alive:
            larger = [g for g in alive if g[0] <= f[0] and f[1] <= g[1] and (g[:2] != f[:2] or g[3:] < f[3:])]
            kept += [] if larger else [f]
    return kept


def brute_labels(t):
    line = f" {' '.join(words(t))} "
    found, base = [], set()
    for i, r in enumerate(rules()):
        if f" {r.keyword} " in line:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                first = line[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" "), r.priority, r.label, i))
                base |= {r.label} if r.base else set()
    return ",".join(sorted(base | {f[3] for f in brute_kept(found)}))


def test_suppression_by_brute_force(spark):
    r = random.Random(14)
    rows = []
    for doc in range(120):
        for rule in range(r.randint(1, 14)):
            first = r.randint(0, 20)
            rows.append((doc, rule, r.choice("abc"), first, first + r.randint(0, 8), r.choice([20, 30, 50, 70])))
    found = spark.createDataFrame(rows, "row_id long, rule int, label string, first long, last long, priority int")
    got = sorted((x.row_id, x.first, x.last, x.priority, x.label, x.rule) for x in resolve(found, [20, 30, 50, 70]).filter("kept").collect())
    by = collections.defaultdict(list)
    for doc, rule, label, first, last, priority in rows:
        by[doc].append((first, last, priority, label, rule))
    assert got == sorted((doc, *k) for doc, f in by.items() for k in brute_kept(f))


def test_a_later_detection_of_higher_priority_suppresses(spark):
    docs = [(1, "under the terms of the GNU GPL version 3", *[None] * 5), (2, "licensed under the apache license version 2.0 or the mit license", *[None] * 5)]
    got = {x.doc_id: x.labels for x in license_summary(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == "gpl-3" and got[2] == "apache,apache-2.0,mit"


def test_licenses_by_brute_force(spark):
    assert len(rules()) > 200
    docs = [(i, t, None, None, None, None, None) for i, t in enumerate(LICENSED)]
    got = {x.doc_id: x for x in license_summary(spark.createDataFrame(docs, DOCS)).collect()}
    for i, t in enumerate(LICENSED):
        w, places = place_all(t)
        x = got[i]
        assert (x.n_words, x.n_base) == (len(w), len(places)), t
        assert (x.first_word, x.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert x.base_labels == ",".join(sorted({p[1] for p in places})) and x.labels == brute_labels(t)
        assert 0 <= x.score <= 1 and (x.score > 0) == bool(x.labels)
    assert "apache-2.0" in got[0].labels and "gpl-2.0" in got[9].labels and "mit" in got[10].labels
    assert license_summary(spark.createDataFrame([], DOCS)).count() == 0
    assert scan_licenses(spark.createDataFrame(docs[2:5], DOCS))[1].count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def private_texts():
    r = random.Random(11)
    bits = ["a@b.c", "_x@d-e.f-g.h", "é", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "007.0.0.255", "4785380592391139", "4785 3805-9239 1139", "4111 1111 1111 1111 1", "+1 (743) 555-3824", "+4", "0", " ", "-", ".", "@", "🎉", "+", "(", "word", "\n", "12345678901234567890"]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(500)] + [None, "", "9" * 20_000, "a" * 50_000 + "@", "1 " * 9000, "mail me: a@b.co " * 700, "1." + "0" * 70 + "1.2.3", "0" * 4000 + "1." + "0" * 4000 + "7.2.3 and", "1.2.3." * 3000]


def test_pattern_spans_by_brute_force(spark):
    texts = private_texts()
    rows, spans = find_personal_data(spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS))
    got = {x.doc_id: x for x in span_summary(rows, spans).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        x = got[i]
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), repr(t)[:300]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert x.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))


def test_disclosing_terms(spark):
    docs = [(i, f"clear words here {i} Zanzibar-desk jo@x.org and more", *[None] * 5) for i in range(4)]
    docs += [(10 + i, f"clear words here and more {i}", *[None] * 5) for i in range(40)] + [(99, "other pat@y.org", *[None] * 5)]
    rows, spans = find_personal_data(spark.createDataFrame(docs, DOCS))
    terms = {(s.value, s.row_id) for s in spans.collect() if s.kind == "term"}
    assert {t for t, _ in terms} == {"zanzibar", "desk"} and len(terms) == 8
    clean = {r.doc_id: r.text for r in sanitise(rows, spans).collect()}
    assert clean[0] == "clear words here 0 - [EMAIL] and more" and clean[10] == docs[4][1] and clean[99] == "other [EMAIL]"


def test_terms_by_brute_force(spark):
    r = random.Random(21)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["é-x", "Zoë", "tog"]
    values = ["jo@x.org", "pat@y.org", "+1 (743) 555-3824", "9.8.7.6", "solo@z.org"]
    docs = []
    for i in range(160):
        w = [r.choice(vocab) for _ in range(r.randint(0, 400))]
        if i % 9 == 0:
            w += [f"kept{i % 4}", "Marker,"] * r.randint(1, 2) + [values[i % 4]]
        r.shuffle(w)
        docs.append((i, " ".join(w) if i != 5 else None, *[None] * 5))
    docs += [(200, "marker stands here alone, kept0 jo@x.org", *[None] * 5), (201, "only MARKER", *[None] * 5), (202, "solo@z.org hapax", *[None] * 5), (7, docs[9][1], *[None] * 5)]
    rows, spans = find_personal_data(spark.createDataFrame(docs, DOCS), threshold=0.6)
    got = sorted((x.row_id, x.value, x.start, x.end) for x in spans.filter("kind = 'term'").collect())
    ids = {(x.doc_id, x.text): x.row_id for x in rows.collect()}
    texts = {ids[d[0], d[1] or ""]: d[1] or "" for d in docs}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    outside = {i: re.sub(PLAIN["email"], lambda m: " " * len(m[0]), t) for i, t in texts.items()}
    terms = {i: {w for w in word.findall(low(t)) if not re.fullmatch("[0-9]+", w)} for i, t in outside.items()}
    held = {i: {(k, t[a:b]) for k, a, b in brute_spans(t)} for i, t in texts.items()}
    n, n_t, n_e, n_te = len(texts), collections.Counter(), collections.Counter(), collections.Counter()
    for i in texts:
        n_t.update(terms[i])
        n_e.update(held[i])
        n_te.update((t, e) for t in terms[i] for e in held[i])
    strong = {t for (t, e), k in n_te.items() if k >= 2 and math.log(k * n / (n_t[t] * n_e[e])) / math.log(n / n_e[e]) >= 0.6}
    want = sorted((i, m[0], *m.span()) for i, t in outside.items() for m in word.finditer(low(t)) if m[0] in strong)
    assert {"marker", "kept0"} <= strong and "hapax" not in strong and got == want
    far = spans.filter("kind = 'term' and value = 'marker'").join(rows, "row_id").filter("doc_id = 201").count()
    assert far == 1  # a document without the value
    brute_clean = {i: clean(t, sorted(brute_spans(t) + [("term", a, b) for j, _, a, b in want if j == i], key=lambda s: (s[1], -s[2], s[0]))) for i, t in texts.items()}
    assert {x.row_id: x.text for x in sanitise(rows, spans).collect()} == brute_clean


def clean(text, spans):
    out, at = "", 0
    for kind, a, b in spans:
        out += text[at:a] + ("" if a < at or kind == "term" else f"[{kind.upper()}]")
        at = max(at, b)
    return out + text[at:]


@pytest.mark.parametrize("make", [lambda d: kd_shards(d, shards=3), license_summary, lambda d: span_summary(*find_personal_data(d))])
def test_native_plans_hold_no_python(spark, make, capsys):
    make(spark.createDataFrame(corpus(20, 3), DOCS)).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_the_registered_shards(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op2_kd_shards"](spark, sf).collect()
    assert sorted(g.doc_id for g in got) == sorted(rows) and {(g.law, g.grown_shard) for g in got} == {("bytes", None)}
    assert all(g.size == len(rows[g.doc_id].encode()) + 8 and g.text_crc32 == binascii.crc32(rows[g.doc_id].encode()) and 0 <= g.shard < 24 for g in got)
    slots = collections.defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_words_of_texts_are_not_written_down(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.llm import pii

    written, durable = [], pii.durable

    def counted(df):
        df = durable(df)
        for f in df.schema.fields:
            if f.dataType.simpleString() == "array<bigint>":
                written.append(df.agg(F.sum(F.size(f.name))).first()[0] or 0)
        return df

    monkeypatch.setattr(pii, "durable", counted)
    rows = [(i, f"plain words number{i} of a text") for i in range(20)]
    _, spans = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert spans.count() == 0 and sum(written) == 0


def test_texts_stay_where_they_are_while_few_rows_have_a_shared_value(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.llm.common import numbered
    from graphloom.llm.pii import disclosing_terms

    texts = [f"plain words number{i} of a text" for i in range(20)] + ["mail secretname at x@y.org"] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    rows = numbered(spark.read.parquet(f"{tmp_path}/d"))
    found = rows.filter(F.contains("text", F.lit("@"))).select("row_id", F.lit("email").alias("kind"), F.lit("x@y.org").alias("value"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        strong = disclosing_terms(rows, found)
        semi = [x for x in strong._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in x]
        assert semi and all("BroadcastHashJoin" in x for x in semi)
        assert strong.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
