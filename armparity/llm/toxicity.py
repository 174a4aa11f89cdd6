"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - t_k): the weights are shared by all thresholds, the
thresholds are ordered, and the sum of the probabilities is the expected severity.
Features are the words of a text and the first letters of its longer words, present or
not. They are screened by a chi-square count over all labelled texts; the fit then
takes a bounded sample of these (:class:`Settings`), with some texts of every feature
that was chosen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armparity.llm.common import checkpointed, columns_of, fingerprint, tidy

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds and parameters of a fit."""

    per_class: int = 4000  #: labelled texts of each class that the fit takes, those lowest by hash
    features: int = 3000  #: features kept by the screening
    least_docs: int = 5  #: labelled texts a feature must be in; the fit takes as many of each feature
    least_chi2: float = 30.0
    grades: int = 4  #: 0 clean, then rising severity
    decay: float = 2e-5  #: ridge on the weights
    steps: int = 600


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def probabilities(self, found: set[str]) -> list[float]:
        """P(grade >= k) for k = 1, 2, ... of a text with the features ``found``."""
        # summed in a fixed order: a set's order differs between workers
        score = math.fsum(self.weights[f] for f in found if f in self.weights)
        return [1 / (1 + math.exp(min(500.0, t - score))) for t in self.thresholds]


def features(text: str | None) -> set[str]:
    """Words in lower case, and ``^`` with the first four and five letters of longer words."""
    if not text:
        return set()
    words = set(_LETTERS.findall(" ".join(set(text.lower().split()))))
    return words.union(*({"^" + w[:4], "^" + w[:5]} for w in words if len(w) > 5))


_KEY = ["doc_id", "h1", "h2"]


def _hashed(docs: DataFrame) -> DataFrame:
    h1, h2 = fingerprint(F.col("text"))
    return docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled texts without the text: ``h1``, ``h2`` by which they are ordered, ``toxic``, and the lowest ``doc_id``.

    A document labelled more than once counts once, and so does a text that several
    documents have: as toxic if any label says so.
    """
    marked = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    # copies of one text are one observation, else their chance words look like signs
    rows = _hashed(docs).select(*_KEY).join(marked, "doc_id")
    return checkpointed(rows.groupBy("h1", "h2").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")))


def _rows(docs: DataFrame, labelled: DataFrame, place: dict[str, int], s: Settings) -> list[tuple[int, list[int]]]:
    """Class and features of the texts that the fit takes: the lowest of each class, and ``least_docs`` of every feature too rare among them."""
    taken = [labelled.filter(F.col("toxic") == y).orderBy("h1", "h2").limit(s.per_class) for y in (0, 1)]
    ids = checkpointed(taken[0].unionByName(taken[1]))

    def encode(text: str | None) -> list[int]:
        return sorted(place[f] for f in features(text) if f in place)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], names=["y", "x"])

    texts = _hashed(docs).join(F.broadcast(ids), _KEY).dropDuplicates(_KEY)
    rows = [(r.y, r.x) for r in texts.select("toxic", "text").mapInArrow(tidy(encoded), "y int, x array<int>").collect()]
    held = Counter(k for _, x in rows for k in x)
    rare = {k for k in place.values() if held[k] < s.least_docs}
    if rare:

        def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [encode(t.as_py()) for t in batch.column(1)]
                kept = [k for k, x in enumerate(found) if not rare.isdisjoint(x)]
                own = [batch.column(c).take(pa.array(kept, pa.int32())) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([found[k] for k in kept], pa.list_(pa.int32()))], names=[*_KEY, "x"])

        hashed = _hashed(docs)
        more = (hashed.mapInArrow(tidy(holders), f"doc_id {dict(hashed.dtypes)['doc_id']}, h1 bigint, h2 bigint, x array<int>")
                .join(labelled.join(F.broadcast(ids), ["h1", "h2"], "left_anti"), _KEY).dropDuplicates(_KEY))
        of = more.select("h1", "h2", "toxic", "x", F.explode("x").alias("f")).filter(F.col("f").isin(*rare))
        # Spark applies the rank limit before the shuffle as well
        rank = F.row_number().over(Window.partitionBy("f").orderBy("h1", "h2"))
        more = of.withColumn("rank", rank).filter(F.col("rank") <= s.least_docs).dropDuplicates(["h1", "h2"]).withColumnRenamed("toxic", "y")
        rows += [(r.y, r.x) for r in more.select("y", "x").collect()]
    return sorted(rows)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """The model, or ``None`` where either class has no labelled text (then nothing is judged toxic)."""
    labelled = _labelled(docs, labels)
    total = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return None
    n0, n1 = float(total[0]), float(total[1])
    texts = _hashed(docs).join(labelled.hint("merge"), _KEY).dropDuplicates(_KEY)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[y].update(features(t.as_py()))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([seen[y][n] for n in names], pa.int64()) for y in (0, 1))], names=["f", "n0", "n1"])

    counts = texts.select("toxic", "text").mapInArrow(tidy(counted), "f string, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1"), F.col("n0")
    n = n0 + n1
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (n0 * n1 * (a + b) * (n - a - b))
    chosen = (counts.filter((a + b >= s.least_docs) & (a + b < n)).withColumn("chi2", chi2)
              .filter(F.col("chi2") >= s.least_chi2).orderBy(F.desc("chi2"), "f").limit(s.features).collect())
    names = sorted(r.f for r in chosen)
    harsh = {r.f for r in chosen if r.n1 * n0 > 8 * r.n0 * n1}
    rows = _rows(docs, labelled, {f: i for i, f in enumerate(names)}, s)
    return _regress(rows, names, np.array([f in harsh for f in names]), s)


def _regress(rows: list[tuple[int, list[int]]], names: list[str], harsh: np.ndarray, s: Settings) -> Model:
    """Full-batch Adam on the likelihood of the grades.

    The labels say toxic or not. Toxic texts are graded by how many of the terms that go
    with toxicity they hold, each counted by its support: about equal shares of them get
    the grades 1, 2, and so on, and texts with as much get the same grade.
    """
    y = np.array([label for label, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    col = np.array([c for _, x in rows for c in x], np.int64)
    m, top = len(names), s.grades - 1
    # a feature's weight is its parameter times this: the ridge holds rare features back more
    held = np.bincount(col, minlength=m) if m else np.zeros(0)
    scale = np.sqrt(held / max(1, held.max(initial=1)))
    evidence = np.round(np.bincount(at, weights=(scale * harsh)[col], minlength=len(rows)) if len(col) else np.zeros(len(rows)), 9)
    cuts = np.quantile(evidence[y == 1], np.arange(1, top) / top)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, evidence, side="left"), 0)
    params = np.concatenate([np.zeros(m), [2.0], np.zeros(top - 1)])  # weights, first threshold, logs of the gaps
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, s.steps + 1):
        gaps = np.exp(params[m + 1 :])
        cuts = params[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, weights=(params[:m] * scale)[col], minlength=len(rows)) if len(col) else np.zeros(len(rows))
        # the probability of a grade is the difference of neighbouring cumulative ones
        upper = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -500, 500)))
        cum = np.concatenate([np.ones((len(rows), 1)), upper, np.zeros((len(rows), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(rows), 1)), upper * (1 - upper), np.zeros((len(rows), 1))], axis=1)
        r = np.arange(len(rows))
        p = np.maximum(cum[r, grade] - cum[r, grade + 1], 1e-12)
        d_cum = np.zeros_like(upper)
        for k in range(top):
            d_cum[:, k] = (grade == k + 1) / p * slope[:, k + 1] - (grade == k) / p * slope[:, k + 1]
        d_score = d_cum.sum(axis=1)
        grad = np.zeros_like(params)
        if len(col):
            grad[:m] = np.bincount(col, weights=d_score[at], minlength=m) * scale
        d_cuts = -d_cum.sum(axis=0)
        grad[m] = d_cuts.sum()
        for k in range(1, top):
            grad[m + k] = d_cuts[k:].sum() * gaps[k - 1]
        grad /= len(rows)
        grad[:m] -= s.decay * params[:m]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        params = params + 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    cuts = params[m] + np.concatenate([[0.0], np.cumsum(np.exp(params[m + 1 :]))])
    weights = {f: float(w) for f, w in zip(names, params[:m] * scale) if abs(w) > 1e-6}
    return Model(weights, tuple(float(c) for c in cuts))


def severity(docs: DataFrame, model: Model | None, cutoff: float = 0.5) -> DataFrame:
    """``doc_id``, ``severity`` (expected grade), ``grade`` (most probable), ``toxic``: one row per input row.

    ``toxic`` says that P(grade >= 1) reaches ``cutoff``. Whole texts are judged; null and
    empty texts have no features. Without a model every severity is 0. Ties of grades go
    to the lower. Repeated rows are judged alike; other columns play no part.
    """
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [_judge(model, v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.int32()),
                 pa.array([j[2] >= cutoff for j in judged], pa.bool_())], names=["doc_id", "severity", "grade", "toxic"])

    return narrow.mapInArrow(tidy(run), f"doc_id {dict(narrow.dtypes)['doc_id']}, severity double, grade int, toxic boolean")


def _judge(model: Model | None, text: str | None) -> tuple[float, int, float]:
    """Expected grade, most probable grade, P(grade >= 1)."""
    if model is None:
        return 0.0, 0, 0.0
    p = model.probabilities(features(text))
    of = [a - b for a, b in zip([1.0, *p], [*p, 0.0])]
    return sum(p), max(range(len(of)), key=lambda k: (of[k], -k)), p[0]


def keep_civil(docs: DataFrame, model: Model | None, cutoff: float = 0.5) -> DataFrame:
    """The rows of ``docs`` not judged toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([_judge(model, v.as_py())[2] < cutoff for v in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), columns_of(docs))
