import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given as hyp
from hypothesis import settings
from hypothesis import strategies as st

from lavra.llm import simhash as m


def slow(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(d, slow(t)) for d, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(fps))


def result(df):
    return sorted((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in df.collect())


def test_fixture_against_brute_force(docs, rows):
    assert result(m.near_duplicates(docs)) == brute([r[:2] for r in rows])


def test_given_data(spark, sf, given):
    from lavra.llm.queries import op5_simhash

    assert sorted(map(tuple, op5_simhash(spark, sf).collect())) == brute(given)


def test_spark_hash_agrees(spark):
    texts = ["a b c", "é ß ÿ", "x" * 100]
    got = [r[0] % 2**64 for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    assert got == [m.fingerprint(t) for t in texts]


def test_empty(empty):
    assert m.near_duplicates(empty).count() == 0


def _components(values, edges):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(Counter(find(v) for v in values).items())


def test_refiled_buckets_lose_no_link(spark):
    """Dense balls of fingerprints, with buckets that overflow at every level."""
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.int64):
        for _ in range(120):
            v = int(centre)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(b)
            values.add(v % 2**64)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]
    for most in (20_000, 40):
        got = [(r["a"] % 2**64, r["b"] % 2**64) for r in m.links(df, bucket_max=most).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in got)
        assert _components(values, got) == _components(values, want)


@settings(max_examples=50, deadline=None)
@hyp(st.lists(st.lists(st.floats(0, 100), min_size=5, max_size=5), min_size=1, max_size=4))
def test_allocation_is_the_cheapest(costs):
    import itertools

    costs = [[0.0, *c[1:]] for c in costs]
    best = min(
        (sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in itertools.product(range(-1, 4), repeat=len(costs)) if sum(t + 1 for t in ts) == 4),
    )
    cost, ts = m.allocate(costs, 3)
    assert abs(cost - best) < 1e-6 and sum(t + 1 for t in ts) == 4


def test_components_of_a_long_chain(spark):
    from lavra.llm.components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000
