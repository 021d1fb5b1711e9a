import random

import numpy as np

from graphloom.llm.quality import LEXICAL, TEXT_MEASURES, _fit_view, _logistic, _sums, _surest, classify_quality, co_train, keep_quality, text_features, text_measures

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=400):
    r = random.Random(8)
    vocab = ["the", "of", "river", "stone", "walks", "under", "light", "and", "small", "house", "sings", "a", "in"]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        w = [r.choice(vocab) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(r.randint(20, 200))]
        text = " ".join(w) + "." if good else r.choice([" | ".join(w), "### ".join(w), (w[0] + " " + w[1] + "\n") * 40, " ".join(w).upper() + "!!"])
        rows.append((i, text, r.choice(["en", "de", None]), f"s{r.randrange(5)}", len(text), None))
        if i % 2:
            labels.append((i, int(good), 0))
        rows[-1] = rows[-1][:5] + (str(int(good)),)
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {x.doc_id: x for x in classify_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    rest = [r for r in rows if r[0] % 2 == 0]
    assert len(got) == len(rows) and np.mean([got[r[0]].kept == (r[5] == "1") for r in rest]) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values())


def test_odd_rows_and_no_labels(spark):
    rows, labels = corpus(60)
    rows += [(900, None, None, None, None, None), (900, "", None, None, -5, None), (None, "word " * 30_000, "xx", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    few = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {x.score for x in classify_quality(docs, few).collect()} == {0.5}
    assert keep_quality(docs, few).count() == len(rows)
    ok = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    scored = classify_quality(docs, ok).collect()
    assert len(scored) == len(rows)
    kept = keep_quality(docs, ok)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in scored)
    assert classify_quality(docs.limit(0), ok).count() == 0


def test_sums_are_the_matrices_of_all_rows(spark):
    rows, labels = corpus(80)
    model, table = co_train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=1)
    sums = _sums(table, None, {})
    y = dict((a, b) for a, b, _ in labels)
    for c in (0, 1):
        both = [text_measures(r[1]) for r in rows if y.get(r[0]) == c]
        x = text_features(np.array([m for m, _ in both], np.float32).reshape(-1, TEXT_MEASURES), np.array([m for _, m in both], np.uint8).reshape(-1, LEXICAL))
        assert np.allclose(sums[0, c], x.T @ x)
    assert np.isfinite(_fit_view(sums, 1).weights).all()
    found = _surest(table, model, 0.2, 0.8)
    more = _sums(table, model, {k: (place, 0.5) for k, (place, _) in found.items()})
    for (view, c), (_, n) in found.items():
        assert n >= 0.2 * (0.8 if c else 0.2) * 40 - 1 and np.isclose(more[1 - view, c][0, 0], sums[1 - view, c][0, 0] + 0.5 * n)


def auc(y, p):
    one, zero = p[y == 1][:, None], p[y == 0][None, :]
    return float((one > zero).mean() + 0.5 * (one == zero).mean())


def test_views_teach_each_other_and_the_mix_is_no_worse(spark):
    r = random.Random(12)
    rows, labels, truth = [], [], {}
    for i in range(1500):
        good = i % 3 != 0
        # each view sees the class through noise of its own
        seen = good if r.random() < 0.85 else not good
        w = [r.choice(["calm", "clear", "useful"] if seen and r.random() < 0.3 else ["win", "cheap", "click"] if r.random() < 0.3 else ["river", "stone", "walk"]) for _ in range(60)]
        source = f"good{r.randrange(3)}" if (good if r.random() < 0.85 else not good) else f"bad{r.randrange(3)}"
        rows.append((i, " ".join(w), "en", source, 400, None))
        truth[i] = int(good)
        if i < 200:
            labels.append((i, int(good), 0))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, _ = co_train(docs, known)
    taught = {(view, c): (n, weight) for step, view, c, n, weight in model.exchanged if step == 2}
    assert len(taught) == 4 and all(n >= 30 and weight > 0.3 for n, weight in taught.values())
    got = [x for x in classify_quality(docs, known).collect() if x.doc_id >= 200]
    y = np.array([truth[x.doc_id] for x in got])
    text, meta, mix = (auc(y, np.array([x[k] for x in got])) for k in ("p_text", "p_meta", "score"))
    assert mix >= max(text, meta) and min(text, meta) > 0.75


def test_scores_by_brute_force(spark):
    rows, labels = corpus(120)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, table = co_train(docs, known)
    pdf = table.toPandas()
    from graphloom.llm.quality import _features

    t, m = _features(pdf)
    odds = [v.a * np.array([sum(a * b for a, b in zip(row, v.weights)) for row in x]) + v.b for v, x in ((model.text, t), (model.meta, m))]
    p = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in odds]
    z = model.mix[0] + sum(k * np.log(q / (1 - q)) for k, q in zip(model.mix[1:], p))
    want = dict(zip(pdf.doc_id, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    got = {x.doc_id: x for x in classify_quality(docs, known).collect()}
    assert all(abs(got[i].score - w) < 1e-9 and got[i].kept == (w >= 0.5) for i, w in want.items())


def test_logistic_separates():
    x = np.column_stack([np.ones(200), np.linspace(-1, 1, 200)])
    assert ((x @ _logistic(x, (x[:, 1] > 0).astype(float)) > 0) == (x[:, 1] > 0)).mean() > 0.98
