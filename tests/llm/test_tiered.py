"""Tiered search against the whole ranking."""

import math
import random
import re
from collections import Counter

import pytest

from lavra.llm import tiered
from lavra.llm.queries import ORACLES, op11_tiered_search
from tests.compare import connect, differences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, doc_id long, rank string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, doc int").repartition(3)
    b = spark.createDataFrame([(i, t, 5, "r") for i, t in items], ITEM)
    return sorted((tuple(r) for r in tiered.search(tiered.build(d), b, **kw).collect()), key=repr)


def corpus(n, seed, words=200):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % words}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    return docs, [*items, (50, docs[3][1]), (51, "nowhere W0, absent"), (52, "w0")]


@pytest.mark.parametrize("seed", range(3))
def test_every_item_as_brute_force(spark, seed):
    docs, items = corpus(150, seed)
    assert got(spark, docs, items) == brute(docs, items)


def test_awkward_rows(spark, rows):
    docs = [(r[0], r[1]) for r in rows] + [(None, "two words here"), (None, "two words here"), (900, "TWO\x00Words,two words"), (901, "ÉTÉ été İ ﬁ")]
    items = [(1, "two WORDS here"), (1, "two WORDS here"), (None, "three words"), (2, None), (3, ""), (4, "...!"), (5, "été ÉTÉ"), (6, "x" * 450), (7, " ".join(t or "" for _, t in docs))]
    assert got(spark, docs, items) == brute(docs, items)


def test_ties_repeats_and_a_term_of_all(spark):
    docs = [(i % 40, "same words everywhere") for i in range(120)] + [(200 + i, f"same other{i}") for i in range(5)]
    items = [(1, "same"), (2, "same words"), (3, "words everywhere other3")]
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


def test_small_segments_and_joins_without_broadcast(spark, monkeypatch):
    docs, items = corpus(120, 7)
    monkeypatch.setattr(tiered, "SMALL", 0)
    assert got(spark, docs, items, top=4) == brute(docs, items, top=4)


def test_segments_hold_all_postings(spark):
    docs, _ = corpus(60, 8)
    want = sorted((t, i, c) for i, text in docs for t, c in Counter(terms(text)).items())
    total, n = sum(len(terms(t)) for _, t in docs), len(docs)
    segment_of, m = {}, {}
    for start in (0, 25):
        s = tiered.Segment(start)
        for i, text in docs[start : start + (25 if not start else 99)]:
            m[i] = 10 + 90 * len(terms(text)) * n // total
            s.add(i, i, [t.encode() for t in terms(text)], m[i])
        segment_of[start] = s.rows().to_pylist()
    found = []
    for start, listed in segment_of.items():
        for r in listed:
            for t, floor in enumerate(tiered.FLOORS):
                cell = r[f"postings{t}"]
                assert r[f"n{t}"] == len(cell) and r[f"top{t}"] == max((p["sat"] for p in cell), default=0)
                assert all(p["sat"] >= floor and (not t or p["sat"] < tiered.FLOORS[t - 1]) for p in cell)
                found += [(r["term"], start + p["at"], p["sat"]) for p in cell]
    assert sorted(found) == [(t, i, 1_000_000_000 * c // (1000 * c + 8 * m[i])) for t, i, c in want]


def test_items_fall_through_only_without_proof(spark):
    """A rare term in plenty of documents is proved early; a term of fewer than ten documents is read to the end."""
    docs = [(i, f"common word{i % 50} pad{i}" + (" rare rarer" if i % 9 == 0 else "") + (" scarce" if i < 3 else "")) for i in range(300)]
    index = tiered.build(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(1, ["common", "rare", "rarer"]), (2, ["common", "scarce"])], "item long, terms array<string>")
    cells = tiered._cells(index, items)
    proven, scores = tiered._level(index, cells, 0, 10)
    assert [r.item for r in proven.collect()] == [1] and scores.select("item").distinct().count() == 1
    last, _ = tiered._level(index, cells, len(tiered.LEFT) - 1, 10)
    assert sorted(r.item for r in last.collect()) == [1, 2]


def test_query_against_sql(spark, sf):
    assert differences(spark, connect(sf), sf, op11_tiered_search, ORACLES["op11_tiered_search"]) is None
