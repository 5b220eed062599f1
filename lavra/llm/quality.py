r"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold[k] - s)`` with ordered thresholds and one score
``s = w . x`` shared by all grades. ``x`` is the text's token profile: shares of hashed tokens
(words lower-cased; runs of punctuation; markers for words in capitals and for words that
follow themselves, with or without a mark between), in ``2**bits`` buckets. The expected grade and the tail probability ``P(grade >= good)`` select documents.
Two grades make it logistic regression; any number of integer grades works alike.

Training is on at most ``per_class`` labelled documents, ``sample_mb`` of text, of each grade, none of them held out
(``crc32(doc_id as text) mod 3 = 1``); profiles are made on the executors and the driver
receives bucket numbers and counts. Thresholds stay ordered by construction: each is the one
before plus an exponential. Scoring covers every document and whole texts in one pass
without a shuffle; the weights, of a fixed size, are broadcast.

Defined results: null and empty texts have no tokens and score 0; without labels of two
grades everything is kept, with null grade and probability; a document labelled twice counts with its
largest grade; a tail probability of exactly ``at_least`` is kept; repeated rows score alike; very long
texts are scored whole, one at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, released
from .training import HELD_OUT, fold, labelled_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")
AGAIN = "\0again"
BITS = 18
CACHE = 400_000  # tokens whose weight a worker remembers; then it starts anew


def tokens(text: str | None) -> list[str]:
    """Words and runs of punctuation, and a marker wherever a word follows itself."""
    found = TOKEN.findall(text or "")
    marked = [AGAIN for a, b in zip(found, found[1:], strict=False) if a == b]
    marked += [AGAIN for a, b in zip(found, found[2:], strict=False) if a == b and a.isalnum()]
    return found + marked


def bucket(token: str, bits: int = BITS) -> int:
    if len(token) > 2 and token.isupper():
        token = "\0capitals"
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def _profiles(sample: DataFrame) -> list:
    def run(batches):
        for b in batches:
            ids, counts = [], []
            for t in b.column(1):
                c = Counter(map(bucket, tokens(t.as_py())))
                ids.append(list(c))
                counts.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["y", "ids", "counts"]
            )

    return sample.select("doc_id", "text", "y").mapInArrow(run, "y int, ids array<int>, counts array<int>").collect()


class Model:
    """Weights per bucket, ordered thresholds and the grades they part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, s: float) -> np.ndarray:
        """P(grade >= k) of each grade but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -500, 500)))


def train(sample: DataFrame, epochs: int = 200, l2: float = 1e-7) -> Model | None:
    """The model by Adam on all of the bounded sample; None without two grades."""
    rows = _profiles(sample)
    grades = sorted({r["y"] for r in rows})
    if len(grades) < 2:
        return None
    y = np.searchsorted(grades, [r["y"] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r["ids"]) for r in rows])
    column = np.concatenate([np.array(r["ids"], np.int64) for r in rows])
    value = np.concatenate([np.array(r["counts"], np.float64) / max(1, sum(r["counts"])) for r in rows])
    del rows
    used, column = np.unique(column, return_inverse=True)
    k, n = len(grades) - 1, len(y)
    share = 1 / np.bincount(y)[y] / len(grades)  # all grades weigh the same
    theta = np.concatenate([np.zeros(len(used)), [-0.5 * (k - 1)], np.zeros(k - 1)])  # weights, first threshold, log gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    low, high = y - 1, y  # grade g lies between cuts g - 1 and g
    for step in range(1, epochs + 1):
        w, cuts = theta[: len(used)], theta[len(used)] + np.append(0.0, np.cumsum(np.exp(theta[len(used) + 1 :])))
        s = np.bincount(doc, value * w[column], n)
        below = 1 / (1 + np.exp(np.clip(s[:, None] - cuts, -60, 60)))  # P(grade <= cut)
        edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        slope = edges * (1 - edges)
        p = np.maximum(edges[np.arange(n), high + 1] - edges[np.arange(n), low + 1], 1e-12)
        up, down = slope[np.arange(n), high + 1] / p, slope[np.arange(n), low + 1] / p
        gs = share * (up - down)  # of the negative log-likelihood by s
        gcut = np.zeros(k)
        np.add.at(gcut, high[high < k], -(share * up)[high < k])
        np.add.at(gcut, low[low >= 0], (share * down)[low >= 0])
        gaps = np.exp(theta[len(used) + 1 :]) * np.cumsum(gcut[::-1])[::-1][1:]
        grad = np.concatenate([np.bincount(column, value * gs[doc], len(used)) + l2 * w, [gcut.sum()], gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = theta[: len(used)]
    cuts = theta[len(used)] + np.append(0.0, np.cumsum(np.exp(theta[len(used) + 1 :])))
    return Model(weights, cuts, grades)


class _Weights(dict):
    """Weights by token, looked up in the model once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token):
        if len(self) >= CACHE:
            self.clear()
        w = self[token] = float(self.model.weights[bucket(token)])
        return w


def tails(model: Model, weight: _Weights, text: str | None) -> np.ndarray:
    found = tokens(text)
    return model.tails(sum(map(weight.__getitem__, found)) / max(1, len(found)))


def _place(model: Model, good: int | None) -> int:
    """Which tail is that of ``good``; by default that of the grade above the lowest."""
    return 0 if good is None else min(len(model.grades) - 2, max(0, int(np.searchsorted(model.grades, good)) - 1))


def score(docs: DataFrame, model: Model | None, good: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability of grade >= good."""
    texts = id_text(docs, id_col, text_col)
    if model is None:
        return texts.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), _place(model, good)

    def run(batches):
        model = shared.value
        weight, steps = _Weights(model), np.diff(model.grades)
        for b in batches:
            found = [tails(model, weight, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([model.grades[0] + float(steps @ x) for x in found], pa.float64()),
                    pa.array([float(x[at]) for x in found], pa.float64()),
                ],
                ["doc_id", "expected_grade", "tail_probability"],
            )

    return texts.mapInArrow(released(run), "doc_id long, expected_grade double, tail_probability double")


def select(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, good: int | None = None, at_least: float = 0.5, text_col: str = "text", sample_mb: float = 32.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability is ``at_least``; rows stay where they are."""
    model = train(labelled_sample(docs, labels, "quality", per_class, sample_mb=sample_mb))
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), _place(model, good)

    @F.pandas_udf("double")
    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        weight = _Weights(model)
        for texts in batches:
            yield pd.Series([float(tails(model, weight, t)[at]) for t in texts], dtype="float64")

    return docs.where(tail(F.col(text_col)) >= at_least)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, good: int | None = None, at_least: float = 0.5, sample_mb: float = 32.0) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, keep, one row per input row."""
    model = train(labelled_sample(docs, labels, "quality", per_class, sample_mb=sample_mb))
    return score(docs, model, good).select(
        "doc_id",
        F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"),
        "expected_grade",
        "tail_probability",
        F.coalesce(F.col("tail_probability") >= at_least, F.lit(True)).alias("keep"),
    )
