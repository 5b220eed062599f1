import random

import corpus_pipeline as p
from lavra.llm import shingles as m


def brute(rows, width=5):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids if find(d) != d}


def got(df, **kw):
    return {r["doc_id"]: r["component_id"] for r in m.near_copies(df, **kw).collect()}


def test_against_brute_force(docs, rows, spark, sf, given, empty):
    assert got(docs) == brute([r[:2] for r in rows])
    want = brute(given)
    assert want and got(spark.read.parquet(f"{sf}/documents.parquet")) == want
    assert got(empty) == {}


def test_groups_beyond_the_window(spark):
    """Edited copies of a few texts among texts that share a long common passage."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    common, rows = [word() for _ in range(40)], []
    for g in range(4):
        base = [word() for _ in range(120)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(120)] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(common + [word() for _ in range(rng.randrange(2, 15))]) for _ in range(150)]
    rng.shuffle(rows)
    rows = [*enumerate(rows), (None, rows[0]), (7, rows[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([r for r in rows if r[0] is not None])
    assert got(df, window=2) == want and got(df) == want


def test_pipeline_keeps_one_of_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, sf), name)
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert left and brute(left) == {}


def test_sets_compared_in_slices(docs, rows, spark, sf, given, monkeypatch):
    """Whole sets go a slice at a time, none of them with all shingles of a document, and the pairs are the same."""
    monkeypatch.setattr(m, "HOT", 0)
    shared = []
    monkeypatch.setattr(m, "materialize", lambda df, name, put=m.materialize: shared.append(name) or put(df, name))
    assert got(docs) == brute([r[:2] for r in rows])
    assert shared.count("shared-of-pairs") >= 8
