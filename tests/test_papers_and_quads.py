from pyspark.sql import functions as F

from graphloom.operators import papers as P
from graphloom.operators import quads as Q

RAW = "id string, title string, year string, abstract string, citationCount long, doi string, _seq long"
LONG = " ".join(f"w{i}" for i in range(20))


def rows(spark, *items):
    return spark.createDataFrame([(*i, k) for k, i in enumerate(items)], RAW)


def test_clean_chain(spark):
    df = rows(
        spark, ("1", "a", "2020", LONG, 5, None), ("1", "b", "2020", LONG, None, None), (None, "A", "2025", LONG, 1, None), (None, " a ", "2024", LONG, 1, None),
        ("2", "t", "2026", "three short words", 0, None), ("3", "t", "abc", LONG, 0, None), ("4", None, "2020", LONG, 0, None), ("5", "t", "2020", LONG[:-4], 0, None), ("6", "t", None, LONG, 0, None),
    )
    v = P.clean_verdicts(df)
    assert [r.verdict for r in v.orderBy("_seq").collect()] == ["clean", "duplicate", "clean", "duplicate", "future", "missing", "missing", "short", "missing"]
    s = P.clean_stats(v).first()
    assert s.input == s.duplicates_removed + s.missing_required_fields + s.short_or_empty_abstract + s.future_papers_removed + s.output == 9
    got = P.clean_papers(v).orderBy("_seq").collect()
    assert [(r.id, r.year, r.cited_by_count) for r in got] == [("1", 2020, 5), ("A", 2025, 1)]


def test_a_failed_row_is_no_first_of_its_key(spark):
    df = rows(spark, ("1", "a", "2020", "too short", 0, None), ("1", "a", "2020", LONG, 0, None))
    assert [r.verdict for r in P.clean_verdicts(df).orderBy("_seq").collect()] == ["short", "clean"]


def test_merge_prefers_the_longest_and_the_earlier(spark):
    a = rows(spark, ("1", "T one", "2020", "short", 0, "https://doi.org/10.1/A"), ("2", "Only title", "2020", "same", 0, None), ("3", None, "2020", "x", 0, ""))
    b = rows(spark, ("9", "other", "2020", "much longer", 0, "10.1/a"), ("8", "only title!", "2020", "SAME", 0, None))
    u = P.union_sources(("openalex", a), ("semantic_scholar", b))
    m = P.merge_papers(u)
    assert [(r.id, r.source) for r in m.orderBy("_first").collect()] == [("9", "semantic_scholar"), ("2", "openalex")]
    s = P.merge_stats(u, m).first()
    assert (s.raw, s.dropped, s.kept, s.duplicates) == (5, 1, 2, 2)
    assert {r.source: r.n for r in P.count_by(m, "source").collect()} == {"semantic_scholar": 1, "openalex": 1}


def test_stats_quota_holdout_and_collect(spark):
    df = rows(spark, ("1", "a", "2020", LONG, 4, None), ("2", "b", "2020", LONG, None, None), ("3", "c", "2026", LONG, 8, None), ("1", "d", None, LONG, 8, None), ("", "e", "2020", LONG, 8, None))
    assert [r.id for r in P.collect_filter(df).orderBy("_seq").collect()] == ["1", "2", "3"]
    assert [r.split for r in P.holdout_split(df).orderBy("_seq").collect()] == ["train", "train", "holdout", "train", "train"]
    assert [r._seq for r in P.cap_per_group(df.filter("year is not null"), "year", 2).orderBy("_seq").collect()] == [0, 1, 2]
    c = P.clean_papers(P.clean_verdicts(df, max_year=2030))
    s = P.dataset_stats(c).first()
    assert (s.papers, s.min_year, s.max_year, s.words_median, s.cited_mean, s.cited_max) == (4, 2020, 2026, 20.0, 20 / 3, 8)
    assert {r.year: r.pct for r in P.year_distribution(c).collect()} == {2020: 75.0, 2026: 25.0}
    empty = P.dataset_stats(c.limit(0)).first()
    assert (empty.papers, empty.cited_mean, empty.cited_max) == (0, 0.0, 0)


def test_api_projection(spark):
    from graphloom.schemas import schema

    df = spark.createDataFrame([("p", "t", None, 2020, 1, 2, ("10.1/x",), [("Ann",), (None,)])], schema("api_paper"))
    r = P.project_api(df).first()
    assert (r.id, r.doi, r.authors, r.abstract, r.year) == ("p", "10.1/x", ["Ann", None], "", "2020")


QUAD = "subject string, relation string, object string, year string, paper_id string"


def test_verdict_chain(spark):
    data = [
        ("", "r", "o", "1999"), ("s", "r", "o", "2025"), ("s", "is a", "o", "2020"), ("various models", "uses", "o", "2020"),
        ("a b c d e f g", "uses", "o", "2020"), ("a b c d e f", "Uses", "o", " 2020 "), ("s", None, "o", "2020"), ("s", "r", "o", None),
    ]
    c = Q.classify(spark.createDataFrame([(*d, str(k)) for k, d in enumerate(data)], QUAD))
    want = ["missing_field", "invalid_year", "banned_relation", "generic_entity", "entity_too_long", "valid", "missing_field", "invalid_year"]
    assert [r.verdict for r in c.orderBy("paper_id").collect()] == want
    good, bad = Q.accepted(c), Q.rejected(c)
    assert good.columns == ["subject", "relation", "object", "year", "paper_id"] and [(r.relation, r.year) for r in good.collect()] == [("uses", 2020)]
    assert good.count() + bad.count() == c.count() and bad.filter(F.col("relation") == "is a").first()._rejection_reason == "banned_relation"
    assert {r.reason: r.pct for r in Q.breakdown(c).collect()}["missing_field"] == 25.0
    assert Q.classify(c.select(*good.columns), allowed=["other"]).filter("verdict = 'unlisted_relation'").count() == 1
