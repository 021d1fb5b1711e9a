"""Quality classifier by co-training a text view and a metadata view (Blum and Mitchell, 1998)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_text, durable, with_long

#: Fixed grid of the piecewise-linear basis: each measure m in [0, 1] becomes m and max(0, m - k) for these k.
KNOTS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85])
TEXT_MEASURES, LANGS, SOURCES = 12, 8, 32
#: Hash buckets of the words and pairs of words of a text, half of them each.
LEXICAL = 128

_CLASS = np.zeros(256, np.int8)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 0 if _c >= 128 or _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 3 if _ch.isspace() else 4


class _Memo(dict):
    """A word's hash, whatever its case."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        return h


def text_measures(text: str | None, memo: _Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a whole text TEXT_MEASURES numbers in [0, 1], and for each of LEXICAL buckets of words and pairs of words the
    root of its share, in steps of 1/255; an empty text has zeros."""
    out, lexical = np.zeros(TEXT_MEASURES, np.float32), np.zeros(LEXICAL, np.uint8)
    words = (text or "").split()
    if not words:
        return out, lexical
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    lower, upper, digit, space, other = np.bincount(_CLASS[raw], minlength=5) / len(raw)
    n, distinct = len(words), len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    bare = sum(1 for w in words if not any(c.isalnum() for c in w))
    tail = sum(1 for w in words if len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum())
    short = sum(1 for w in words if len(w) <= 3)
    marks = sum(1 for w in words if not w[-1].isalnum())
    out[:] = (
        upper, digit, other, min(1, other / (lower + upper + 1e-9)), np.log1p(distinct) / np.log1p(n), distinct / n,
        len(set(lines)) / max(1, len(lines)), bare / n, tail / n, short / n, marks / n, min(1, len(raw) / n / 20),
    )
    memo = _Memo() if memo is None else memo
    h = np.fromiter((memo[w] for w in words), np.uint32, n)
    pairs = h[:-1] * np.uint32(31) + h[1:]
    half = LEXICAL // 2
    counts = np.concatenate([np.bincount(h % half, minlength=half), np.bincount(pairs % half, minlength=half)])
    lexical[:] = np.rint(255 * np.sqrt(counts / n))
    return out, lexical


def text_features(measures: np.ndarray, lexical: np.ndarray) -> np.ndarray:
    m = measures.astype(np.float64)
    hinges = np.maximum(0, m[:, :, None] - KNOTS).reshape(len(m), -1)
    return np.hstack([np.ones((len(m), 1)), m, hinges, lexical / 255.0])


def meta_features(lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """The page's metadata: hashed language and source, and the length on a logarithmic scale with hinges."""
    n = len(lang)
    bucket = lambda s, k: np.array([zlib.crc32(str(x).encode()) % k for x in s], np.int64)
    out = np.zeros((n, 1 + LANGS + SOURCES))
    out[:, 0] = 1
    rows = np.arange(n)
    out[rows, 1 + bucket(lang, LANGS)] = 1
    out[rows, 1 + LANGS + bucket(source, SOURCES)] = 1
    size = np.clip(np.log1p(np.clip(pd.to_numeric(n_chars, errors="coerce").fillna(0).to_numpy(float), 0, None)) / 16, 0, 1)[:, None]
    return np.hstack([out, size, np.maximum(0, size - KNOTS)])


#: Steps on the scale by which the surest documents are found.
PLACES = 4096


@dataclass
class View:
    """A linear score and its calibration: probability = sigmoid(a * score + b)."""

    weights: np.ndarray
    a: float = 0.0
    b: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.a * (x @ self.weights) + self.b

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))

    def places(self, x: np.ndarray) -> np.ndarray:
        """How sure the view is of class 1, as one of PLACES steps of its log odds."""
        return np.floor((PLACES - 1) / (1 + np.exp(-np.clip(self.odds(x) / 8, -30, 30)))).astype(np.int64)


@dataclass
class CoTrained:
    """Both views, the weights of their calibrated log odds, and what the views taught each other: (round, teaching
    view, class, documents, weight) with view 0 the text and 1 the metadata."""

    text: View
    meta: View
    mix: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))
    fitted: bool = True
    exchanged: list = field(default_factory=list)

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = self.text.probability(text_x), self.meta.probability(meta_x)
        z = self.mix[0] + self.mix[1] * np.log(p / (1 - p)) + self.mix[2] * np.log(q / (1 - q))
        return p, q, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with classes weighted alike; the first column is the constant."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    t = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(t))
    penalty[0, 0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ t)
        t += step
        if np.abs(step).max() < 1e-8:
            break
    return t


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures, lexical, lang, source, n_chars): what both views see of each document, a small row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo()
        for pdf in batches:
            m = [text_measures(t, memo) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "measures": [x for x, _ in m], "lexical": [x.tobytes() for _, x in m], "lang": pdf.lang, "source": pdf.source, "n_chars": pdf.n_chars.astype("Int64")})

    meta = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    rows = docs.select(as_text(id_col).alias("doc_id"), F.col(text_col).alias("text"), *meta)
    return with_long(rows.mapInPandas(run, "doc_id string, measures array<float>, lexical binary, lang string, source string, n_chars long"), "doc_id")


def _features(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    m = np.array(pdf.measures.tolist(), np.float32).reshape(len(pdf), TEXT_MEASURES)
    lexical = np.frombuffer(b"".join(pdf.lexical), np.uint8).reshape(len(pdf), LEXICAL)
    return text_features(m, lexical), meta_features(pdf.lang, pdf.source, pdf.n_chars)


def _surest(table: DataFrame, model: CoTrained, share: float, prior: float) -> dict[tuple[int, int], tuple[int, int]]:
    """(view, class) -> (place, documents): of the unlabelled documents the share of which each view is most sure, dealt
    to the classes as the labels are, is what lies from that place on. Ties go together. One pass counts places."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, PLACES), np.int64)
        for pdf in batches:
            if len(pdf):
                for view, (v, x) in enumerate(zip((held.value.text, held.value.meta), _features(pdf))):
                    total[view] += np.bincount(v.places(x), minlength=PLACES)
        view, place = np.nonzero(total)
        yield pd.DataFrame({"view": view, "place": place, "n": total[view, place]})

    unlabelled = table.filter("quality is null").drop("doc_id", "quality")
    rows = unlabelled.mapInPandas(run, "view int, place int, n long").groupBy("view", "place").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for view, g in rows.groupby("view"):
        n = np.zeros(PLACES, np.int64)
        n[g.place] = g.n
        for c, want in ((0, share * (1 - prior) * n.sum()), (1, share * prior * n.sum())):
            sums = np.cumsum(n if c == 0 else n[::-1])
            at = min(int(np.searchsorted(sums, max(want, 1))), PLACES - 1)
            out[int(view), c] = (at if c == 0 else PLACES - 1 - at, int(sums[at]))
    return out


def _beyond(places: np.ndarray, c: int, place: int) -> np.ndarray:
    return places >= place if c else places <= place


def _sums(table: DataFrame, model: CoTrained | None, teach: dict[tuple[int, int], tuple[int, float]]) -> dict[tuple[int, int], np.ndarray]:
    """For each view and class the sum of x x' over all documents that teach it: the labelled ones and, weighted, the
    unlabelled ones beyond the other view's place in teach. One pass; tasks send sums, Spark adds them up by place."""
    held = table.sparkSession.sparkContext.broadcast((model, teach))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, teach = held.value
        total: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            xs = _features(pdf)
            y = pdf.quality.to_numpy(float)
            given = ~np.isnan(y)
            places = [v.places(x) for v, x in zip((model.text, model.meta), xs)] if model else None
            for view in (0, 1):
                for c in (0, 1):
                    w = (given & (y == c)).astype(float)
                    if (1 - view, c) in teach:
                        place, weight = teach[1 - view, c]
                        w += weight * (~given & _beyond(places[1 - view], c, place))
                    some = w > 0
                    x = xs[view][some]
                    total[view, c] = total.get((view, c), 0) + (x * w[some, None]).T @ x
        for (view, c), m in total.items():
            flat = np.asarray(m).ravel()
            yield pd.DataFrame({"view": view, "c": c, "at": np.arange(len(flat)), "v": flat})

    rows = table.mapInPandas(run, "view int, c int, at int, v double").groupBy("view", "c", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for (view, c), g in rows.groupby(["view", "c"]):
        d = int(round(np.sqrt(len(g))))
        out[int(view), int(c)] = g.sort_values("at").v.to_numpy().reshape(d, d)
    return out


def _fit_view(sums: dict, view: int, ridge: float = 1e-3) -> View:
    """Least squares on labels -1 and 1, classes weighted alike, from the sums alone; x[0] is 1, so row 0 holds sums of x."""
    zero, one = sums[view, 0], sums[view, 1]
    n0, n1 = max(zero[0, 0], 1.0), max(one[0, 0], 1.0)
    a = zero / n0 + one / n1 + ridge * np.eye(len(zero))
    return View(np.linalg.solve(a, one[0] / n1 - zero[0] / n0))


def co_train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, share: float = 0.05, labelled_rows: int = 20_000
) -> tuple[CoTrained, DataFrame]:
    """(model, the measured documents with their labels).

    The first round fits both views on the labelled documents. Each later one lets each view hand the other the share of
    all unlabelled documents, growing by round, of which it is most sure, by class as the labels are dealt, and fits both
    on these too, over the whole corpus, by sums that tasks add up. A pseudo-label weighs what the view's surest labels
    are better than chance on labelled documents, so a view that knows nothing teaches with a weight near 0.

    Calibration, these weights and the mix are fitted on about labelled_rows labelled documents at most, taken by hash of
    the id; half of them calibrate, half set the mix. A document with several labels counts with the smallest; null
    labels and ids teach nothing. Without both classes the model is not fitted and scores 0.5."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    table = durable(measured(docs, id_col, text_col).join(known, "doc_id", "left"))
    taught = table.filter("quality is not null")
    part = labelled_rows / max(1, taught.count())
    if part < 1:  # by hash, so that no task and not the driver holds more than the bound; a margin keeps it there
        taught = taught.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * 0.97 * (1 << 20)))
    bounded = taught.toPandas()
    if set(bounded.quality) != {0.0, 1.0}:
        return CoTrained(View(np.zeros(1)), View(np.zeros(1)), fitted=False), table
    bounded = bounded.sort_values("doc_id")
    xs, y = _features(bounded), bounded.quality.to_numpy()
    first = np.arange(len(y)) % 2 == 0 if len(set(y[::2])) == 2 and len(set(y[1::2])) == 2 else np.ones(len(y), bool)
    model, teach, exchanged, prior = None, {}, [], float(y.mean())
    for r in range(rounds):
        if model:
            found = _surest(table, model, share * r, prior)
            for (view, c), (place, n) in found.items():
                there = _beyond((model.text, model.meta)[view].places(xs[view]), c, place)
                chance = prior if c else 1 - prior
                right = ((y[there] == c).sum() + chance) / (there.sum() + 1)
                weight = float(np.clip((right - chance) / (1 - chance), 0, 1))
                teach[view, c] = (place, weight)
                exchanged.append((r, view, c, n, weight))
        sums = _sums(table, model, teach)
        views = [_fit_view(sums, v) for v in (0, 1)]
        for v, x in zip(views, xs):
            s = x[first] @ v.weights
            v.b, v.a = _logistic(np.column_stack([np.ones(len(s)), s]), y[first])
        model = CoTrained(*views, exchanged=exchanged)
    p, q, _ = model.score(*xs)
    rest = ~first if not first.all() else first
    odds = np.column_stack([np.ones(rest.sum()), np.log(p[rest] / (1 - p[rest])), np.log(q[rest] / (1 - q[rest]))])
    model.mix = _logistic(odds, y[rest])
    return model, table


def _scored(table: DataFrame, model: CoTrained, keep_from: float) -> DataFrame:
    held = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = held.value
            p = m.score(*_features(pdf)) if m.fitted else [np.full(len(pdf), 0.5)] * 3
            yield pd.DataFrame({"doc_id": pdf.doc_id, "p_text": p[0], "p_meta": p[1], "score": p[2], "kept": p[2] >= keep_from})

    rows = table.select(as_text("doc_id").alias("doc_id"), "measures", "lexical", "lang", "source", "n_chars")
    return with_long(rows.mapInPandas(run, "doc_id string, p_text double, p_meta double, score double, kept boolean"), "doc_id")


def classify_quality(docs: DataFrame, labels: DataFrame, *, keep_from: float = 0.5, **training) -> DataFrame:
    """Per row of docs: doc_id, p_text, p_meta (the views' calibrated probabilities), score (both combined), kept.

    Null metadata is a value of its own, null text is empty; repeated rows come back repeated; an empty table gives no
    rows; extra columns are not read."""
    model, table = co_train(docs, labels, **training)
    return _scored(table, model, keep_from)


def keep_quality(docs: DataFrame, labels: DataFrame, *, keep_from: float = 0.5, text_col: str = "text", **training) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns. The texts are measured once more beside their rows, so they never shuffle."""
    model, _ = co_train(docs, labels, text_col=text_col, **training)
    if not model.fitted:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        memo = _Memo()
        both = [text_measures(t, memo) for t in text]
        m = np.array([x for x, _ in both], np.float32).reshape(len(text), TEXT_MEASURES)
        lexical = np.array([x for _, x in both], np.uint8).reshape(len(text), LEXICAL)
        return pd.Series(held.value.score(text_features(m, lexical), meta_features(lang, source, n_chars))[2])

    meta = [F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.filter(score(F.col(text_col), *meta) >= keep_from)
