"""Quadruples from abstracts by a language model behind a small protocol; one reply a paper, many rows out."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T


#: Tasks of one job; what the driver holds of a job grows with them.
ROUND = 50_000


class QuotaError(RuntimeError):
    """No more calls are allowed; trying again is of no use."""


class Extractor(Protocol):
    """complete(prompt, max_tokens) -> (text or None, why it ended: 'stop', 'length', ...). Must be picklable."""

    def complete(self, prompt: str, max_tokens: int) -> tuple[str | None, str]: ...


class StubExtractor:
    """Deterministic offline replies for tests: a canned reply, or one that a function makes of the prompt."""

    def __init__(self, reply: str | Callable[[str], str] = "[]"):
        self.reply = reply

    def complete(self, prompt: str, max_tokens: int) -> tuple[str | None, str]:
        return (self.reply(prompt) if callable(self.reply) else self.reply), "stop"


class ChatExtractor:
    """A chat-completions service over HTTP; its key is read from an environment variable on the worker."""

    def __init__(self, url: str, model: str, key_env: str = "OPENAI_API_KEY", timeout: float = 120.0):
        self.url, self.model, self.key_env, self.timeout = url, model, key_env, timeout

    def complete(self, prompt: str, max_tokens: int) -> tuple[str | None, str]:
        import json
        import urllib.error
        import urllib.request

        key = os.environ.get(self.key_env)
        if not key:
            raise RuntimeError(f"set {self.key_env}")
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": max_tokens}).encode()
        req = urllib.request.Request(f"{self.url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                choice = json.load(r)["choices"][0]
        except urllib.error.HTTPError as e:
            if "insufficient_quota" in e.read().decode("utf-8", "replace").replace(" ", "_").lower():
                raise QuotaError(str(e)) from e
            raise
        return choice["message"].get("content"), choice.get("finish_reason") or "stop"


def call(extractor: Extractor, prompt: str, *, max_tokens: int = 2000, limit: int = 8000, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str]:
    """(reply, status): a cut-off empty reply is asked again with twice the tokens, an error after a pause; a quota
    error ends the job. Status is ok, empty or failed."""
    tokens = max_tokens
    for attempt in range(1, attempts + 1):
        try:
            text, why = extractor.complete(prompt, tokens)
        except QuotaError:
            raise
        except Exception:  # noqa: BLE001  whatever the service's client raises
            sleep(min(2**attempt, 30))
            continue
        if text:
            return text, "ok"
        if why != "length":
            return None, "empty"
        tokens = min(tokens * 2, limit)
    return None, "failed"


def replies(papers: DataFrame, extractor: Extractor, template: str, *, max_tokens: int = 2000, partitions: int | None = None) -> DataFrame:
    """paper_id, raw, status: one call a paper. papers: id, title, year, abstract. The output costs calls: write it at once.

    A paper without an id goes by its title. Limits on the number of papers must be set before this."""
    rows = papers.select(F.coalesce("id", "title").alias("paper_id"), T.render_prompt(template, F.col("year"), F.col("abstract")).alias("prompt"))
    if partitions:
        rows = rows.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [call(extractor, p, max_tokens=max_tokens) for p in pdf.prompt]
            yield pd.DataFrame({"paper_id": pdf.paper_id, "raw": [g[0] for g in got], "status": [g[1] for g in got]})

    return rows.mapInPandas(run, "paper_id string, raw string, status string")


def quads_of(raw: DataFrame) -> DataFrame:
    """subject, relation, object, year, paper_id of every entry in every reply that is a JSON list; missing parts are null."""
    return raw.select("paper_id", F.inline(T.parse_quads(F.col("raw")))).select("subject", "relation", "object", "year", "paper_id")


def extract(papers: DataFrame, extractor: Extractor, template: str, store: str, *, limit: int = 0, resume: bool = True, max_tokens: int = 2000, batch: int = 20) -> DataFrame:
    """Quadruples of papers, through a table of replies at store that a later run takes up.

    A paper counts as processed once its reply is in the table, with quadruples or without. Every batch papers are a task
    of their own, and a task's file joins the table when the task ends, not when the job does, so that an interruption or
    an error loses no more than batch papers a running task; 0 writes once at the end. One job takes ROUND tasks, however
    many papers there are."""
    from graphloom.operators.graph import indexed
    from graphloom.sources.readers import not_done, read_table_or_none

    spark = papers.sparkSession
    todo = papers.orderBy("_seq").limit(limit) if limit else papers
    done = read_table_or_none(spark, store) if resume else None
    if done is not None:
        todo = not_done(todo, done.filter("status <> 'failed'"))
    mode = "append" if resume else "overwrite"
    if batch:
        todo = indexed(todo, ["_seq"], "_at").withColumn("_batch", F.floor(F.col("_at") / batch))
        tasks = int(todo.agg(F.max("_batch")).first()[0] or 0) + 1
        for low in range(0, tasks, ROUND):
            size = min(ROUND, tasks - low)
            dealt = todo.filter(F.col("_batch").between(low, low + size - 1)).repartitionById(size, (F.col("_batch") - low).cast("int"))
            found = replies(dealt, extractor, template, max_tokens=max_tokens)
            found.write.mode(mode).option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
            mode = "append"
    else:
        replies(todo, extractor, template, max_tokens=max_tokens).write.mode(mode).parquet(store)
    return quads_of(spark.read.parquet(store).filter("status = 'ok'").dropDuplicates(["paper_id"]))
