"""Golden cases of the scalar functions, derived by reading."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom import config as C
from graphloom.functions import text as T
from graphloom.functions import vectors as V


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.normalize_text, " a\t b c\n", "a b c"), (T.normalize_text, None, ""),
        (T.merge_title, "BERT: Pre-training of  Deep!", "bert pretraining of deep"), (T.merge_title, "中文", ""), (T.merge_title, None, ""),
        (T.normalize_doi, " HTTPS://doi.org/10.1/ABC ", "10.1/abc"), (T.normalize_doi, "https://dx.doi.org/10.1/x", "https://dx.doi.org/10.1/x"),
        (T.word_count, "", 0), (T.word_count, " a  b ", 2),
        (T.normalize_relation, "Are Evaluated-On", "is_evaluated_on"), (T.normalize_relation, "were used for", "was_used_for"),
        (T.normalize_relation, "ARE", "are"), (T.normalize_relation, "are a", "is_a"),
        (T.normalize_year, " 2020 ", 2020), (T.normalize_year, "2020.5", None), (T.normalize_year, "abc", None), (T.normalize_year, None, None),
        (T.is_generic_phrase, "models", True), (T.is_generic_phrase, "various models", True), (T.is_generic_phrase, "several neural models", True),
        (T.is_generic_phrase, "", True), (T.is_generic_phrase, "deep models", False), (T.is_generic_phrase, "model", False),
        (T.canonicalize_entity, "The BERT model", "bert"), (T.canonicalize_entity, "a graph-based approach", "graph-based"),
        (T.canonicalize_entity, "GPT-2 model", "gpt-2"), (T.canonicalize_entity, "model", "model"), (T.canonicalize_entity, "the the model", "the"),
        (T.canonicalize_entity, "model framework method", "model framework"), (T.canonicalize_entity, "deep learning algorithms", "deep learning algorithms"),
        (T.canonicalize_entity, None, ""), (T.canonicalize_entity, ' "X." ', "x"),
        (T.clean_json_text, "```json\n[]\n```", "[]"), (T.clean_json_text, " [1] ", "[1]"),
        (T.valid_entity, "", False), (T.valid_entity, "case-based reasoning", False), (T.valid_entity, "a b c d e f g h i", False), (T.valid_entity, "a b c d e f g h", True),
        (T.graph_relation, " Is  Used ", "is_used"),
        (T.normalize_title, " Die  STRAẞE ", "die strasse"), (T.normalize_relation, "Heißt Über", "heisst_über"), (T.canonicalize_entity, "The Große Straße", "grosse strasse"),
        (T.casefold, "ΟΔΟΣ οδός", "οδοσ οδόσ"), (T.casefold, "ﬁrſt ŉ İ", "ﬁrſt ŉ İ".casefold()), (T.casefold, "ꭰᏰ µ ǰ ΐ", "ꭰᏰ µ ǰ ΐ".casefold()), (T.casefold, None, None),
        (T.char_ngrams, "a", [" a "]), (T.char_ngrams, "ab", [" ab", "ab ", " ab "]), (T.char_ngrams, "abc d", [" ab", "abc", "bc ", " abc", "abc ", " abc ", " d "]), (T.char_ngrams, "", []),
    ],
)
def test_golden(spark, f, value, want):
    assert one(spark, f(F.col("x")), x=value) == want


@pytest.mark.parametrize(("a", "b", "conflict"), [("gpt-2", "gpt-3", True), ("gpt-3", "gpt 3", False), ("gpt", "gpt-3", False), ("1 2", "2 1", False)])
def test_numbers(spark, a, b, conflict):
    assert one(spark, T.has_conflicting_numbers(F.col("a"), F.col("b")), a=a, b=b) is conflict


def test_risky_and_direction(spark):
    risky = T.is_risky_generic_merge(F.col("a"), F.col("b"))
    assert one(spark, risky, a="nlp architectures", b="architectures") and not one(spark, risky, a="bert", b="bert model")
    longer, shorter = T.longer_shorter(F.col("a"), F.col("b"))
    assert one(spark, F.concat_ws(">", longer, shorter), a="ab", b="abc") == "abc>ab" and one(spark, longer, a="ab", b="cd") is None


def test_keys(spark):
    key = T.dedup_key(F.col("d"), F.col("t"), F.col("i"))
    assert [one(spark, key, d=d, t=t, i=i) for d, t, i in (("10.1/X", "a", "1"), (None, "A b!", "1"), ("", "中文", "1"))] == ["doi:10.1/x", "title:a b", "id:1"]
    assert one(spark, T.paper_key(F.col("i"), F.col("t")), i=None, t=" A  b") == "title:a b"


@pytest.mark.parametrize(("raw", "n"), [('{"subject":"x"}', 0), ("oops", 0), ("[]", 0), ('[{"subject":"x","year":2020}]', 1), ('```json\n[{"subject":null},{"object":"o"}]```', 2), (None, 0)])
def test_reply_must_be_a_list(spark, raw, n):
    assert one(spark, F.size(T.parse_quads(F.col("x"))), x=raw) == n


def test_prompt(spark):
    p = T.render_prompt('{{"y": {year}}}: {abstract} {x}', F.lit(2020), F.col("x"))
    assert one(spark, p, x="An {odd} abstract") == '{"y": 2020}: An {odd} abstract {x}'


@pytest.mark.parametrize(("p", "want"), [(0.9, "HIGH"), (0.75, "MEDIUM"), (0.7499, "LOW"), (0.89996, "MEDIUM")])
def test_confidence(spark, p, want):
    assert one(spark, T.confidence_label(F.col("x")), x=p) == want


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))
    x = one(spark, V.pair_feature(a, b))
    assert x[:6] == [3, -2, 2, 3, 4, 9] and math.isclose(x[6], 0.141421356, rel_tol=1e-6)
    assert one(spark, V.cosine_similarity(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_words_are_searched_as_they_would_be_split(spark):
    odd = ["", " ", "\t", "methods", " Several  odd\nmethods ", "several methods", "severalmethods", "some  task ", "the methods", "methods several", "a b c d e f", "a b\tc d e f g", " a b c d e f g　", "x" * 3000 + " y"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").select("i", T.is_generic_phrase(F.col("s")), T.more_words(F.col("s"), 6), T.has_text(F.col("s")), T.word_count(F.col("s"))).collect()
    for i, generic, more, some, n in got:
        w = odd[i].lower().split()
        assert generic == (not w or (w[-1] in C.GENERIC_TERMS and (len(w) == 1 or w[0] in C.VAGUE_QUALIFIERS))), odd[i]
        assert (more, some, n) == (len(w) > 6, bool(w), len(w)), odd[i]


def test_a_filter_of_facts_makes_no_ids(spark):
    from graphloom.operators import graph as G

    rows = [("The BERT Model", "Uses", " ẞ x. ", "2020"), (" ., \"", "uses", "x", "2020"), ("x", " ", "y", "2020"), ("x", "uses", None, "2020"), ("x", "uses", "y", "2020.5"), ("Σς model model", "uses", "model", "2020")]
    p = G.prepare(spark.createDataFrame(rows, "subject string, relation string, object string, year string")).filter("ok")
    plan = p.select("source", "target")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]
    assert sorted((r.source, r.target) for r in p.collect()) == [("bert", "ss x"), ("σσ model", "model")]


def test_letters_to_fold_are_few_ranges(spark):
    assert T._fold_class().count("-") < 80 < len(T._folds())
    rest = "".join(T._folds()) + "azAZéİ"
    got = spark.createDataFrame([(c,) for c in rest], "c string").select("c", T.casefold(F.col("c")).alias("f")).collect()
    assert [r.c for r in got if r.f != r.c.casefold()] == []
