import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.operators.extract import QuotaError, StubExtractor, call, extract, quads_of
from graphloom.plans import cli
from graphloom.plans import pipeline as L
from graphloom.sources import papers_api as A
from graphloom.sources import readers as R
from graphloom.sources import sinks as W
from graphloom.streaming import ingest as I

TEMPLATE = 'Facts of {year}: {abstract} as {{"subject": ...}}'


def replies():
    """A local function, so that it travels to the workers by value."""

    def reply(prompt):
        import json

        word = prompt.split()[3]
        facts = [{"subject": f"the {word} model", "relation": "improves", "object": o, "year": y} for o, y in (("alpha beta", 2019), ("gamma", 2021), (f"delta {word}", "2023"), (None, 2020))]
        return "```json\n" + json.dumps(facts) + "\n```"

    return reply


def papers(spark, n=12):
    rows = [(str(i), f"t{i}", str(2018 + i % 7), " ".join([f"topic{i % 4}"] + ["w"] * 25), i, 0, None, ["A"], i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, title string, year string, abstract string, citationCount long, referenceCount long, doi string, authors array<string>, _seq long")


def test_readers(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": "1", "title": "x", "year": 2020}, {"id": None, "year": "n/a"}]))
    rows = R.read_json_array(spark, str(p), "raw_paper").orderBy("_seq").collect()
    assert [(r.id, r.year) for r in rows] == [("1", "2020"), (None, "n/a")]
    assert R.read_json_array(spark, str(tmp_path / "none.json"), "raw_paper", strict=False).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        R.read_json_array(spark, str(tmp_path / "none.json"), "raw_paper")
    (tmp_path / "bad.json").write_text("[{")
    assert R.read_json_array(spark, str(tmp_path / "bad.json"), "raw_paper", strict=False).count() == 0
    (tmp_path / "m.json").write_text('{"long name": "name"}')
    assert [tuple(r) for r in R.read_merge_map(spark, str(tmp_path / "m.json")).collect()] == [("long name", "name")]
    assert R.read_merge_map(spark, str(tmp_path / "no.json")).count() == 0
    for f in (R.read_prompt, R.read_snapshots):
        with pytest.raises(FileNotFoundError):
            f(spark, str(tmp_path / "no"))
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A"}], "edges": [{"source": "a", "target": "a", "key": "r:0", "relation": "r", "year": 2020}]}))
    nodes, edges = R.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().label == "A" and edges.first()["year"] == 2020


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A & B"), ("b", None)], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "r:0", "r", 2020, 2020, "p<1>")], "source string, target string, key string, relation string, year int, timestamp int, paper_id string")
    W.export_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    root = ET.parse(tmp_path / "g.graphml").getroot()
    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    assert len(root.findall(".//g:node", ns)) == 2 and root.find(".//g:edge", ns).attrib["source"] == "a"
    W.export_json_array(nodes, str(tmp_path / "n.json"))
    assert json.loads((tmp_path / "n.json").read_text())[0] == {"id": "a", "label": "A & B"}
    W.export_merge_map(spark.createDataFrame([("x", "y")], "longer string, shorter string"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"x": "y"}
    W.merge_review(spark.createDataFrame([("long", "l", 0.95, True, "long")], "longer string, shorter string, similarity double, risky boolean, entity string"), str(tmp_path / "r.md"))
    assert "| long | l | 0.95 | yes |" in (tmp_path / "r.md").read_text()


class Service:
    """Pages of records per year; fails where told."""

    def __init__(self, years, page=3, fail=()):
        self.years, self.page, self.fail, self.calls = years, page, list(fail), 0

    def __call__(self, url, headers):
        self.calls += 1
        if self.fail and (status := self.fail.pop(0)):
            return status, {"Retry-After": "7"} if status == 429 else {}, {}
        q = dict(x.split("=") for x in url.split("?")[1].split("&"))
        data, at = self.years.get(int(q["year"]), []), int(q.get("token", 0))
        more = at + self.page < len(data)
        return 200, {}, {"data": data[at : at + self.page], "token": str(at + self.page) if more else None}


def records(year, n, short=()):
    return [{"paperId": f"{year}-{i}", "abstract": "w " * (5 if i in short else 25), "year": year} for i in range(n)]


def fetcher(service):
    slept = []
    return A.Fetcher("http://x", "q", transport=service, limiter=A.Limiter(0, clock=lambda: 0.0, sleep=slept.append)), slept


def test_rounds_lose_no_record_at_the_cap():
    s = Service({2020: records(2020, 8), 2021: records(2021, 2, short={0})})
    f, _ = fetcher(s)
    got = [r["paperId"] for r, _ in A.collect_rounds(f, [2020, 2021], 100, initial=2, increment=2)]
    assert sorted(got) == sorted([f"2020-{i}" for i in range(8)] + ["2021-1"])
    f, _ = fetcher(Service({2020: records(2020, 8)}))
    assert len(list(A.collect_rounds(f, [2020], 5))) == 5


def test_retries_and_resume():
    f, slept = fetcher(Service({2020: records(2020, 2)}, fail=[429, 500]))
    assert len(list(A.collect_rounds(f, [2020], 10))) == 2 and slept.count(7) == 1 and slept.count(5) == 1
    f, _ = fetcher(Service({2020: records(2020, 5)}, fail=[500] * 3))
    assert list(A.collect_rounds(f, [2020], 10)) == []
    seen, state = set(), {}
    f, _ = fetcher(Service({2020: records(2020, 6)}))
    first = next(A.collect_rounds(f, [2020], 10, state=state, seen=seen))
    again = A.load_state(A.dump_state(state))
    rest = list(A.collect_rounds(f, [2020], 10, state=again, seen=seen))
    assert len(rest) == 5 and first[0]["paperId"] == "2020-0"
    assert A.load_state("broken") == {} == A.load_state(None)


def test_limiter_waits():
    now, slept = [0.0], []
    lim = A.Limiter(2.0, clock=lambda: now[0], sleep=slept.append)
    lim.wait()
    now[0] = 0.5
    lim.wait()
    assert slept == [1.5]


def test_calls():
    class Cut:
        def __init__(self):
            self.asked = []

        def complete(self, prompt, max_tokens):
            self.asked.append(max_tokens)
            return (None, "length") if len(self.asked) < 3 else ("[]", "stop")

    c = Cut()
    assert call(c, "p", max_tokens=3000) == ("[]", "ok") and c.asked == [3000, 6000, 8000]

    class Broken:
        def complete(self, prompt, max_tokens):
            raise OSError

    waits = []
    assert call(Broken(), "p", sleep=waits.append) == (None, "failed") and waits == [2, 4, 8]

    class Spent:
        def complete(self, prompt, max_tokens):
            raise QuotaError("spent")

    with pytest.raises(QuotaError):
        call(Spent(), "p")
    assert call(StubExtractor(""), "p") == (None, "empty")


def test_a_crawl_is_saved_by_page_and_taken_up(spark, tmp_path):
    raw = str(tmp_path / "raw")

    class Breaking(Service):
        def __call__(self, url, headers):
            if self.calls == 2:
                raise KeyboardInterrupt
            return super().__call__(url, headers)

    f, _ = fetcher(Breaking({2020: records(2020, 7), 2021: records(2021, 4)}, page=3))
    with pytest.raises(KeyboardInterrupt):
        A.crawl(spark, f, [2020, 2021], 100, raw)
    held = [r.id for r in R.read_json_array(spark, raw, "raw_paper", multi_line=False).collect()]
    assert sorted(held) == [f"2020-{i}" for i in range(6)]
    state = A.load_state(R.read_text_or_none(spark, raw + ".state"))
    assert state[2020].count == 6 and state[2020].token == "6"
    again = Service({2020: records(2020, 7), 2021: records(2021, 4)}, page=3)
    assert A.crawl(spark, fetcher(again)[0], [2020, 2021], 100, raw) == 5 and again.calls == 3
    every = [r.id for r in R.read_json_array(spark, raw, "raw_paper", multi_line=False).collect()]
    assert sorted(every) == sorted([f"2020-{i}" for i in range(7)] + [f"2021-{i}" for i in range(4)])
    assert A.crawl(spark, fetcher(Service({2020: records(2020, 2)}))[0], [2020], 10, raw, resume=False) == 2


def test_extraction_takes_up_what_is_stored(spark, tmp_path):
    store = str(tmp_path / "replies")
    p = papers(spark).withColumn("year", F.col("year").cast("int"))
    a = extract(p, StubExtractor(replies()), TEMPLATE, store, limit=5)
    assert a.select("paper_id").distinct().count() == 5
    b = extract(p, StubExtractor("[]"), TEMPLATE, store, batch=4)
    assert b.select("paper_id").distinct().count() == 5 and spark.read.parquet(store).count() == 12
    c = extract(p, StubExtractor(replies()), TEMPLATE, store)
    assert c.count() == 20 and quads_of(spark.read.parquet(store)).filter("object is null").count() == 5


def test_extraction_is_one_job_and_each_task_keeps_its_papers(spark, tmp_path):
    def but_the_last(prompt):
        if "w29 " in prompt:
            raise QuotaError("no more calls")
        return "[]"

    store, sc = str(tmp_path / "replies"), spark.sparkContext
    p = spark.createDataFrame([(f"d{i}", f"t{i}", 2020, f"w{i} x", i) for i in range(30)], "id string, title string, year int, abstract string, _seq long")
    jobs = []
    for name, batch in (("few", 30), ("many", 1)):
        sc.setJobGroup(f"extract {name}", "")
        extract(p, StubExtractor("[]"), TEMPLATE, store + name, batch=batch)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"extract {name}")))
    sc._jsc.clearJobGroup()
    assert jobs[0] == jobs[1]
    held = spark.read.parquet(store + "many").groupBy(F.input_file_name()).count().collect()
    assert len(held) == 30 and {r["count"] for r in held} == {1}
    with pytest.raises(Exception, match="no more calls"):
        extract(p, StubExtractor(but_the_last), TEMPLATE, store, batch=1)
    assert 20 <= spark.read.parquet(store).count() < 30
    assert extract(p, StubExtractor("[]"), TEMPLATE, store, batch=7).count() == 0 and spark.read.parquet(store).select("paper_id").distinct().count() == 30


def test_corpus_to_gaps(spark, tmp_path):
    out, cfg = L.Layout(str(tmp_path)), Config(embedding_dim=8, walk_length=6, walks_per_node=2, cutoffs=(2019, 2020, 2021, 2022), final_year=2023, train_cutoffs=(2019, 2020), val_cutoffs=(2021,), test_cutoffs=(2022,), lr_iterations=20)
    nodes, edges = L.corpus_to_graph(papers(spark), StubExtractor(replies()), TEMPLATE, out, cfg)
    assert edges.count() == 36 and {r.reason: r.n for r in spark.read.parquet(out.breakdown).collect()} == {"missing_field": 12}
    assert spark.read.parquet(out.clean_stats).first().output == 12 and "topic0" in {r.id for r in nodes.collect()}
    assert L.propose_merges(nodes, out, cfg).count() >= 0
    more = spark.createDataFrame([(f"n{i}", f"n{(i * 5 + j) % 14}", 2019 + (i + j) % 5) for i in range(14) for j in (1, 2, 3)], "source string, target string, year int")
    model = L.link_prediction(more, out, cfg)
    assert spark.read.option("header", True).csv(out.evaluation).count() == 4
    assert "| Test | Cosine Similarity |" in (tmp_path / "evaluation.md").read_text() and (tmp_path / "entity_merge_candidates.md").exists()
    L.report(spark.read.parquet(out.papers), out)
    assert "12 papers" in (tmp_path / "dataset_summary.md").read_text()
    ids = more.select(F.col("source").alias("id"), F.col("source").alias("label")).distinct()
    gaps, base = L.find_gaps(ids, more, model, out, cfg)
    assert gaps.columns[0] == "type" and spark.read.json(f"{out.root}/gaps_baseline").count() == base.count()


def test_command_line():
    a = cli.parser().parse_args(["--root", "r", "run", "--skip-collect", "--prompt", "p", "--model", "m", "--base-url", "u", "--collect-limit", "9"])
    assert (a.stage, a.skip_collect, a.collect_limit) == ("run", True, 9)
    assert cli.parser().parse_args(["collect", "--url", "u", "--limit", "7"]).target_total == 7
    assert cli.parser().parse_args(["extract", "--prompt", "p", "--model", "m", "--base-url", "u"]).checkpoint_every == 20
    assert cli.parser().parse_args(["filter", "--output", "a", "--rejected-output", "b"]).rejected_output == "b"
    assert cli.parser().parse_args(["graph", "--input", "i", "--json-output", "j"]).json_output == "j"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["extract"])


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    schema = "subject string, relation string, object string, year string, paper_id string, ts timestamp"
    rows = [("the a model", "uses", "b", "2020", "p", "2024-01-01 00:00:00"), ("a", "is a", "b", "2020", "p", "2024-01-01 00:00:01"), ("the a model", "uses", "b", "2020", "p", "2024-01-01 00:00:02")]
    spark.createDataFrame([(*r[:5], None) for r in rows], schema).drop("ts").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = I.ingest(I.distinct_quads(stream), str(tmp_path / "edges"), str(tmp_path / "cp"))
    q.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "edges")).collect()
    assert [(r.source, r.target, r.relation, r.year) for r in got] == [("a", "b", "uses", 2020)]
    counts = I.verdict_counts(spark.readStream.schema(schema).parquet(str(src)))
    q = counts.writeStream.format("memory").queryName("verdicts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r.verdict: r.n for r in spark.table("verdicts").collect()} == {"valid": 2, "banned_relation": 1}
