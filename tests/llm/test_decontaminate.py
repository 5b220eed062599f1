import random

import numpy as np
import pytest

from lavra.llm import decontaminate as m
from lavra.llm.queries import op1_decontaminate


def distance(item, words):
    """Least word edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def brute(docs, items):
    out = []
    for d, text in docs:
        w = m.words(text)
        hits = []
        for i, t in items:
            item = m.words(t)
            edits = int(0.2 * len(item) + 1e-9)
            known = set(item)
            if len(item) >= 8 and sum(x in known for x in w) >= len(item) - edits and distance(item, w) <= edits:
                hits.append(i)
        out.append((d, hits))
    return sorted(out)


def edited(words, edits, rng):
    w = list(words)
    for _ in range(edits):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[k] = "zzz"
        elif kind == 1:
            del w[k]
        else:
            w.insert(k, "yyy")
    return w


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(10, 50)))) for i in range(25)] + [(90, "short one"), (91, None), (92, "")]
    docs = []
    for d in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if d % 2:
            item = items[d % 25][1].split()
            at = rng.randint(0, len(words))
            words[at:at] = edited(item, rng.randint(0, len(item) // 5), rng)
        docs.append((d, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, items[0][1].upper().replace(" ", " -- ")), (1002, items[0][1])]
    schema = "doc_id long, text string, item_ids string, found string"
    return spark.createDataFrame([(*x, "a", "b") for x in docs], schema), spark.createDataFrame([*items, items[3]], "item_id long, text string"), docs, items


def test_recall_and_precision_against_brute_force(planted):
    docs, bench, rows, items = planted
    want = {(d, i) for d, hits in brute(rows, items) for i in hits}
    got = {(r["doc_id"], i) for r in m.contamination(docs, bench).collect() for i in r["item_ids"]}
    assert got <= want and len(want) >= 150
    assert len(got) >= 0.97 * len(want)


def test_blocks_of_items_give_the_same(planted):
    docs, bench, _, _ = planted
    rows = lambda df: sorted((r["doc_id"], r["contaminated"], r["item_ids"], r["best_similarity"]) for r in df.collect())
    assert rows(m.contamination(docs, bench, block_mb=0.002)) == rows(m.contamination(docs, bench))
    assert m.remove_contaminated(docs, bench).count() == m.contamination(docs, bench).where("not contaminated").count()
    assert m.remove_contaminated(docs, bench).columns == docs.columns


def test_awkward_tables(planted, docs, empty):
    _, bench, _, _ = planted
    assert m.contamination(docs, bench.limit(0)).where("not contaminated").count() == docs.count()
    assert m.contamination(empty, bench).count() == 0


def test_given_data(spark, sf, given):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(given, items)
    got = sorted((r["doc_id"], r["item_ids"]) for r in op1_decontaminate(spark, sf).collect())
    assert got == want and any(h for _, h in want)


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        item, region = rng.integers(1, 5, 9), rng.integers(1, 5, (1, 12))
        best = min(distance_full(item.tolist(), region[0, :k].tolist()) for k in range(13))
        assert m.edit_distances(region, item)[0] == best


def distance_full(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_short_items_match_word_for_word(spark):
    docs = spark.createDataFrame([(1, "Zwei kurze, Wörter hier"), (2, "zwei Wörter kurze"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "kurze wörter"), (8, ""), (9, "ganz andere")], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in m.contamination(docs, items).collect()}
    assert got == {1: [7], 2: [], 3: []}


def test_without_calibration_every_window_is_verified(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[:20] + ["x"] + words[21:]) + " c"), (2, " ".join(words[:20] + ["q"] * 20))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    monkeypatch.setattr(m, "calibrated", lambda *a: None)
    assert {r["doc_id"]: r["item_ids"] for r in m.contamination(docs, items).collect()} == {1: [7], 2: []}


def test_short_items_allow_their_edits(spark):
    """Items of one to nine words, whole, with one edit and with two, in every place, against brute force."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(40)]
    items = [(n, " ".join(rng.sample(vocab, n))) for n in range(1, 10)] + [(20, "a a a a a"), (21, "a b a b a b a"), (22, "seven words of which one is changed")]
    docs = [(0, "here seven words of that one is changed again"), (1, "a a b a a"), (2, "b a b a c b a b")]
    for d in range(3, 400):
        _, text = items[rng.randrange(len(items))]
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(words))
        words[at:at] = edited(text.split(), min(rng.randint(0, 2), len(text.split()) - 1), rng)
        docs.append((d, " ".join(words)))
    want = []
    for d, text in docs:
        w = m.words(text)
        want.append((d, [i for i, t in items if distance(m.words(t), w) <= int(0.2 * len(m.words(t)) + 1e-9)]))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # items of eight words and more are found by the LSH, so only their misses are allowed, and here none
    got = sorted((r["doc_id"], r["item_ids"]) for r in m.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted(want) and dict(got)[0] == [22]
