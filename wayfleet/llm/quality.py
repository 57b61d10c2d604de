"""Quality classifier by co-training of two views.

One view sees the text: the frequencies of its byte pairs, hashed, and how well it compresses. The
other sees the page metadata: source, language, length and layout. Each is a logistic regression
fitted on labelled documents. In every round each view labels all unlabelled documents that it is sure
of, and those pseudo-labels, which together weigh less than the labels, teach the other view. At the end both
views are calibrated on labelled documents that were not used for fitting, and their evidence is
added up to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import cut, text_or_empty

LABELLED = 8_000    # bound of the labelled sample that the views are fitted on
ROUNDS, SURE, WEIGHT = 2, 0.95, 0.3   # a pseudo-label's weight, and of all together for each labelled document at most
THRESHOLD = 0.5
PAIRS, SOURCES, LANGS = 256, 32, 16   # buckets for byte pairs, sources and languages
FEATURES = "doc_id long, text_view array<float>, page_view array<float>"


def text_view(data: bytes) -> np.ndarray:
    """Square roots of hashed byte-pair frequencies, and compressed over whole size."""
    out = np.zeros(PAIRS + 1, np.float32)
    if len(data) > 1:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        pairs = ((b[:-1] * np.uint32(257) + b[1:]) * np.uint32(2654435761)) >> np.uint32(24)
        out[:PAIRS] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / len(pairs))
    out[PAIRS] = min(2.0, len(zlib.compress(data, 1)) / max(1, len(data)))
    return out


def page_view(data: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Hashed source and language, logarithms of length, number of lines and mean line length."""
    out = np.zeros(SOURCES + LANGS + 3, np.float32)
    lines = data.count(b"\n") + 1
    if source is not None:
        out[zlib.crc32(source.encode()) % SOURCES] = 1
    if lang is not None:
        out[SOURCES + zlib.crc32(lang.encode()) % LANGS] = 1
    out[-3:] = np.log1p([len(data), lines, len(data) / lines])
    return out


def _views(batch: pa.RecordBatch, columns: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, source, lang in zip(*(batch.column(c).to_pylist() for c in columns)):
        data = (text or "").encode()
        yield text_view(data), page_view(data, source, lang)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float32())
    for batch in batches:
        views = list(_views(batch, (1, 2, 3)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in views], kind), pa.array([v[1] for v in views], kind)],
                                         names=["doc_id", "text_view", "page_view"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"),
                       docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"))


@dataclass
class View:
    """A calibrated logistic regression: log odds = slope * (weights . x + intercept) + shift."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    """Both views and the log odds of a good document; without views every document has the prior."""

    text: View | None
    page: View | None
    prior: float

    def score(self, texts: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            same = np.full(len(texts), _chance(np.array(self.prior)))
            return same, same, same
        a, b = self.text.log_odds(texts), self.page.log_odds(pages)
        return _chance(a), _chance(b), _chance(a + b - self.prior)


def _chance(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def _fitted(rows: DataFrame, view: str) -> View:
    data = rows.select(array_to_vector(view).alias("features"), "label", "weight")
    model = LogisticRegression(maxIter=20, regParam=0.01, weightCol="weight").fit(data)
    return View(model.coefficients.toArray(), float(model.intercept))


def _calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Slope and shift by Newton steps on the held-out labels, drawn a little towards slope 1, shift 0."""
    raw, w = view.raw(x), np.array([1.0, 0.0])
    design = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(20):
        p = _chance(design @ w)
        gradient = design.T @ (p - y) + 1e-1 * (w - [1, 0])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-1 * np.eye(2), gradient)
        w = w - np.clip(step, -2, 2)
    return View(view.weights, view.intercept, float(max(w[0], 0.0)), float(w[1]))


def _log_odds(rows: DataFrame, view: str, model: View):
    products = F.zip_with(F.col(view).cast("array<double>"), F.array(*[F.lit(float(w)) for w in model.weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(model.intercept), lambda acc, x: acc + x)


def _chances(rows: DataFrame, views: dict[str, View]) -> DataFrame:
    return rows.withColumns({f"by_{view}": 1 / (1 + F.exp(-_log_odds(rows, view, model))) for view, model in views.items()})


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``labelled`` documents with a label, by hash of doc_id, and on all rows without one.

    Labels that are null or neither 0 nor 1 are left out; of several for a document the majority counts, 1 at
    a tie. A labelled document counts once, an unlabelled one as often as it occurs. Without documents of both
    labels there are no views and the prior alone is left (1 if there is no label at all).
    """
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
                   .filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(labelled)
    features = cut(_narrow(docs).mapInArrow(_feature_batches, FEATURES).join(known, "doc_id", "left"), "features")
    free = features.filter("label IS NULL")
    rows = (features.drop("label").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])   # at most ``labelled`` ids
                    .withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(5)) == 0))
    rows = cut(rows, "views")
    mean = rows.agg(F.avg("label")).first()[0]
    classes = rows.filter("label IS NOT NULL").groupBy("label", "test").count().collect()
    prior = float(np.log(np.clip(1.0 if mean is None else mean, 1e-6, 1 - 1e-6) / np.clip(0.0 if mean is None else 1 - mean, 1e-6, 1 - 1e-6)))
    if len({r["label"] for r in classes if not r["test"]}) < 2:
        return Model(None, None, prior)
    train_rows = rows.filter("label IS NOT NULL AND NOT test").withColumn("weight", F.lit(1.0))
    most = WEIGHT * sum(r["count"] for r in classes if not r["test"])
    views = {v: _fitted(train_rows, v) for v in ("text_view", "page_view")}
    for _ in range(rounds):
        judged = _chances(free, views)
        sure = {v: (F.col(f"by_{v}") >= SURE) | (F.col(f"by_{v}") <= 1 - SURE) for v in views}
        found = judged.agg(*[F.count(F.when(sure[v], 1)).alias(v) for v in views]).first()
        taught_by = {}
        for view in views:
            weight = min(WEIGHT, most / max(1, found[view]))
            taught_by[view] = _chances(free, {view: views[view]}).filter(sure[view]).select(
                "text_view", "page_view", (F.col(f"by_{view}") >= 0.5).cast("double").alias("label"), F.lit(weight).alias("weight"))
        learned = train_rows.select("text_view", "page_view", "label", "weight")
        views = {"text_view": _fitted(learned.unionByName(taught_by["page_view"]), "text_view"),
                 "page_view": _fitted(learned.unionByName(taught_by["text_view"]), "page_view")}
    test = rows.filter("label IS NOT NULL AND test").select("label", "text_view", "page_view").toPandas()   # part of the bounded sample
    if test["label"].nunique() < 2:
        return Model(views["text_view"], views["page_view"], prior)
    y = test["label"].to_numpy()
    return Model(*(_calibrated(views[v], np.stack(test[v].to_numpy()).astype(float), y) for v in ("text_view", "page_view")), prior)


def _score(model: Model, batch: pa.RecordBatch, columns: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    views = list(_views(batch, columns))
    if not views:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    return model.score(*(np.stack(v).astype(float) for v in zip(*views)))


def _score_batches(model: Model, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, page, both = _score(model, batch, (1, 2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(page), pa.array(both), pa.array(both >= threshold)],
                                         names=["doc_id", "p_text", "p_page", "score", "keep"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_text, p_page, score, keep)`` per row: each view's probability of good quality, both combined, and the verdict.

    A null text counts as empty; null source or language are no feature. Equal rows get equal scores,
    a score at the threshold is kept, null ids stay null. No rows give no rows; other columns are not read.
    """
    return _narrow(docs).mapInArrow(partial(_score_batches, model, threshold), "doc_id long, p_text double, p_page double, score double, keep boolean")


def _keep_batches(model: Model, threshold: float, columns: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_score(model, batch, columns)[2] >= threshold))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns as they are."""
    columns = tuple(docs.columns.index(c) for c in ("text", "source", "lang"))
    return docs.mapInArrow(partial(_keep_batches, model, threshold, columns), docs.schema)
