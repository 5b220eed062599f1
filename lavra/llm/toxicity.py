r"""Toxicity by multiple-instance learning.

Only documents carry labels, yet toxicity sits in sentences. A sentence has the probability
``p = sigmoid(bias + sum of its words' weights)``, where a word's weight is that of the word
itself plus those of its beginnings (offensive stems come with many endings). Weights aren't
negative: harmless words, however many, don't make up for an offensive one. A document is toxic if any sentence is:
``P = 1 - prod(1 - p)`` (noisy-or). Weights are trained on document labels through the
noisy-or, after which the sentence scores locate what offends: the sentences of 0.5 or more and, of a
document of 0.5 or more, the fewest that hold half of its noisy-or mass.

Training is on at most ``per_class`` labelled documents, ``sample_mb`` of text, of each class whose
``crc32(doc_id as text) mod 3`` isn't 1 (whole texts, tokenised on the executors; the driver
receives the distinct words of sentences). Features of fewer than ``min_docs`` sampled documents
have no weight. Scoring covers every document and whole texts, in one pass without a shuffle; the
model, of bounded size as its sample is, is broadcast.

Defined results: null and empty texts have no sentences and score 0; without labels of both
classes every score is 0; repeated rows score alike; a document labelled twice counts
with its largest label; sentences of equal weight are located in order; very long texts are scored whole,
one at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .training import HELD_OUT, fold, labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREDICT_AT = 0.7
LEAST, MOST = 3, 8  # letters of the beginnings
CACHE = 400_000


def sentences(text: str | None) -> list[list[str]]:
    return [w for s in SENTENCE.findall((text or "").lower()) if (w := WORD.findall(s))]


def features(word: str) -> list[str]:
    """The word and its beginnings of LEAST to MOST letters."""
    return [f"={word}", *(word[:n] for n in range(LEAST, min(MOST, len(word)) + 1))]


def _bags(sample: DataFrame) -> list:
    def run(batches):
        for b in batches:
            bags = [[" ".join(sorted(set(s))) for s in sentences(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(bags, pa.list_(pa.string()))], ["y", "bags"])

    return sample.select("doc_id", "text", "y").mapInArrow(run, "y int, bags array<string>").collect()


Model = tuple[dict[str, float], float]


def train(sample: DataFrame, min_docs: int = 3, epochs: int = 200, l1: float = 1e-6) -> Model:
    """(feature weights, bias) of the noisy-or model, by Adam on all of the bounded sample."""
    rows = _bags(sample)
    y = np.array([r["y"] > 0 for r in rows], np.float64)
    if len(rows) == 0 or y.min() == y.max():
        return {}, -math.inf
    number: dict[str, int] = {}
    word, sentence, doc = array("i"), array("i"), array("i")
    for d, r in enumerate(rows):
        for s in r["bags"]:
            ids = [number.setdefault(w, len(number)) for w in s.split(" ")]
            word.extend(ids)
            sentence.extend([len(doc)] * len(ids))
            doc.append(d)
    del rows
    word, sentence, doc = (np.frombuffer(x, np.int32) for x in (word, sentence, doc))
    pairs = np.unique(doc[sentence].astype(np.int64) << 32 | word) & 0xFFFFFFFF  # each word of a document once
    n_docs = np.bincount(pairs, minlength=len(number))
    seen: Counter = Counter()
    for w, n in zip(number, n_docs.tolist(), strict=True):
        for f in features(w):
            seen[f] += n
    kept = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= min_docs)}
    owner, feature = array("i"), array("i")
    for w, i in number.items():
        ids = [kept[f] for f in features(w) if f in kept]
        owner.extend([i] * len(ids))
        feature.extend(ids)
    owner, feature = np.frombuffer(owner, np.int32), np.frombuffer(feature, np.int32)
    weight, bias = np.zeros(len(kept)), -4.0
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh the same
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, epochs + 1):
        z = bias + np.bincount(sentence, np.bincount(owner, weight[feature], len(number))[word], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        clean = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))  # prod(1 - p)
        pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share
        g = pull[doc] * p
        by_word = np.bincount(word, g[sentence], len(number))
        grad = np.append(np.bincount(feature, by_word[owner], len(kept)) + l1, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        weight, bias = np.maximum(0.0, weight - move[:-1]), bias - move[-1]
    return {f: float(weight[i]) for f, i in kept.items() if abs(weight[i]) > 1e-3}, float(bias)


class _Weights(dict):
    """Weights by word: the sum over its features, remembered for up to CACHE words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.of = weights.get

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        w = self[word] = sum([self.of(f, 0.0) for f in features(word)])
        return w


def sentence_scores(text: str | None, weights: _Weights, bias: float) -> list[float]:
    """The logit of every sentence."""
    get = weights.__getitem__
    return [bias + sum(map(get, set(s))) for s in sentences(text)]


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - sigmoid(z)), summed as logarithms."""
    total = 0.0
    for z in logits:
        total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
    return -math.expm1(-total)


def located(logits: list[float]) -> list[int]:
    """The sentences that make a document offend: those of 0.5 or more, and of a document of 0.5 or more
    the fewest, largest first and earlier ones of equals first, that hold half of its mass ``-log(1 - score)``.

    So many faint sentences that add up are named too, and no positive document is left without any.
    """
    mass = [max(z, 0.0) + math.log1p(math.exp(-abs(z))) for z in logits]
    total, held = sum(mass), 0.0
    out = {i for i, z in enumerate(logits) if z >= 0}
    if total >= math.log(2):
        for i in sorted(range(len(mass)), key=lambda i: -mass[i]):
            if held >= total / 2:
                break
            held += mass[i]
            out.add(i)
    return sorted(out)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, offending (0-based numbers of the sentences located, ascending)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = _Weights(shared.value[0]), shared.value[1]
        for b in batches:
            out = [sentence_scores(t.as_py(), weights, bias) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([noisy_or(z) if bias > -math.inf else 0.0 for z in out], pa.float64()),
                    pa.array([len(z) for z in out], pa.int64()),
                    pa.array([located(z) for z in out], pa.list_(pa.int64())),
                ],
                ["doc_id", "score", "n_sentences", "offending"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<long>")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2_000, sample_mb: float = 32.0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending, one row per input row."""
    model = train(labelled_sample(docs, labels, "toxic", per_class, sample_mb=sample_mb))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
        "n_sentences",
        "offending",
    )
