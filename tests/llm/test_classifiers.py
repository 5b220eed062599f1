import zlib

import numpy as np

from lavra.llm import quality, toxicity
from lavra.llm.queries import op6_quality, op8_toxicity

BIG = "/root/testdata/sf0.1"


def _labels(spark, name, path=BIG):
    return {r[0]: r[1] for r in spark.read.parquet(f"{path}/labels.parquet").select("doc_id", name).collect()}


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


def test_toxicity_held_out_accuracy(spark):
    rows = op8_toxicity(spark, BIG).collect()
    y = _labels(spark, "toxic")
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    pairs = [(y[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in y]
    assert np.mean([a == b for a, b in pairs]) > 0.97
    assert np.mean([b for a, b in pairs if a == 1]) > 0.8 and np.mean([b for a, b in pairs if a == 0]) < 0.02
    assert all(r["offending"] for r in rows if r["predicted"] and r["score"] > 0.9)


def test_quality_held_out_accuracy(spark):
    rows = op6_quality(spark, BIG).collect()
    y = _labels(spark, "quality")
    pairs = [(y[r["doc_id"]], r["keep"]) for r in rows if r["held_out"] and r["doc_id"] in y]
    assert np.mean([k for g, k in pairs if g == 1]) > 0.99
    assert np.mean([k for g, k in pairs if g == 0]) < 0.1


def test_awkward_rows(spark, docs, empty, sf):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (18, 2, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    for df, n in ((docs, docs.count()), (empty, 0)):
        assert quality.quality(df, labels).count() == n
        assert toxicity.toxicity(df, labels).count() == n
    nothing = labels.limit(0)
    assert {r["keep"] for r in quality.quality(docs, nothing).collect()} == {True}
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.0}
    assert quality.select(docs, nothing).count() == docs.count()
    assert set(quality.select(docs, labels).columns) == set(docs.columns)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert scores[0] == scores[1] == 0.0  # no sentences


def test_noisy_or():
    z = [-3.0, 0.5, 2.0, -800.0, 40.0]
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    assert abs(toxicity.noisy_or(z) - (1 - np.prod(1 - p))) < 1e-12
    assert toxicity.noisy_or([]) == 0.0


def test_ordinal_grades_are_learned_in_order(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        g = i % 3
        rows.append((i, " ".join(rng.choice(["bad", "fair", "good"], 60, p=[[0.7, 0.2, 0.1], [0.25, 0.5, 0.25], [0.1, 0.2, 0.7]][g])), g + 1))
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert model.grades == [1, 2, 3] and model.thresholds[0] < model.thresholds[1]
    weight = quality._Weights(model)
    means = [np.mean([1 + quality.tails(model, weight, t).sum() for _, t, g in rows if g == k]) for k in (1, 2, 3)]
    assert means[0] < 1.5 < means[1] < 2.5 < means[2]
    graded = [quality.tails(model, weight, t) for _, t, _ in rows]
    assert all(a >= b for a, b in graded)  # P(grade >= 2) >= P(grade >= 3)
    assert np.mean([1 + (a >= 0.5) + (b >= 0.5) == g for (a, b), (_, _, g) in zip(graded, rows, strict=True)]) > 0.9


def test_training_never_sees_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in toxicity.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", 10_000).collect()}
    assert ids and not any(map(held_out, ids))


def test_every_grade_enters_the_sample(spark):
    rows = [(i, f"text {i}", i % 21) for i in range(2000) if i % 21 not in (0, 20) or i < 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.labelled_sample(docs, docs, "quality", 21).groupBy("y").count().collect()
    assert {r["y"] for r in got} == set(range(21)) and max(r["count"] for r in got) <= 16


def test_located_sentences_hold_half_the_mass():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        for shift in (-6.0, -3.0, 0.0):
            z = (rng.normal(size=n) + shift).tolist()
            got, mass = toxicity.located(z), np.log1p(np.exp(np.array(z)))
            assert {i for i, x in enumerate(z) if x >= 0} <= set(got) and got == sorted(got)
            if 1 - np.exp(-mass.sum()) >= 0.5:
                assert mass[got].sum() >= mass.sum() / 2 - 1e-9
    assert toxicity.located([-2.0] * 10) == [0, 1, 2, 3, 4] and toxicity.located([-9.0]) == [] == toxicity.located([])


def test_toxicity_query_against_plain_python(spark, sf):
    """Scores and sentences of every row, recomputed from the model sentence by sentence."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, bias = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic", 2_000))
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in op8_toxicity(spark, sf).collect():
        clean, p = 1.0, []
        for s in toxicity.SENTENCE.findall((text[r["doc_id"]] or "").lower()):
            if ws := set(toxicity.WORD.findall(s)):
                p.append(1 / (1 + np.exp(-np.clip(bias + sum(weights.get(f, 0.0) for w in ws for f in toxicity.features(w)), -500, 500))))
                clean *= 1 - p[-1]
        assert abs(r["score"] - (1 - clean)) < 1e-6 and r["n_sentences"] == len(p)
        assert bool(r["offending"]) or r["score"] < 0.5


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000, i % 2) for i in range(300)], "doc_id long, text string, toxic int")
    got = toxicity.labelled_sample(docs, docs, "toxic", 100, sample_mb=0.01).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {0: 10, 1: 10}
