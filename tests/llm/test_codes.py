"""Vector codes against plain nearest-entry search, in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lavra.llm import codes
from lavra.llm.queries import ORACLES, op12_norm_codes
from tests.compare import connect, differences

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) and the digest, by evaluating every entry."""
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), None)
    if dims is None:
        return [(i, None, None, None) for i, _, _ in kept], hashlib.sha256(b"").hexdigest()
    w = dims // parts
    cut = lambda v: [tuple(math.floor(256 * x) for x in v[p * w : (p + 1) * w]) for p in range(parts)]
    cuts = [cut(v) if len(v) == dims else None for _, v, _ in kept]
    books = [[c[p] for c in cuts if c][:entries] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cuts:
                if c:
                    groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(x) for x in zip(*groups[e], strict=True)) if e in groups else c for e, c in enumerate(books[p])]
    out = []
    for (i, _, lab), c in zip(kept, cuts, strict=True):
        found = c and [near(x, books[p]) for p, x in enumerate(c)]
        out.append((i, found and "".join(f"{e:02x}" for _, e in found), found and sum(d for d, _ in found), lab))
    sums = {}
    for _, _, e, lab in out:
        if e is not None:
            sums[lab] = sums.get(lab, 0) + e
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [(i, c, e, sums.get(lab)) for i, c, e, lab in out], hashlib.sha256(text.encode()).hexdigest()


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [tuple(r) for r in codes.compress(df, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


def check(spark, rows, **kw):
    want, sha = brute(rows, **kw)
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted(got(spark, rows, **kw), key=key) == sorted([(*r, sha) for r in want], key=key)


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rng.normal(0, spread, (n, dims))]


def test_every_row_as_brute_force(spark):
    check(spark, [(i * 7 % 301, v, i % 3 or None, None, 1) for i, v in enumerate(vectors(200, 32, 1))])


def test_awkward_rows(spark):
    v = vectors(90, 32, 2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, x, i % 2, "x", 0) for i, x in enumerate(v)]
    rows += [(5, v[5], 1, "x", 0), (5, v[6], 1, "x", 0), (None, v[7], None, None, None), (None, v[8], None, None, None)]
    rows += [(100, None, 1, "", 0), (101, v[0][:31] + [None], 1, "", 0), (102, v[0][:31] + [nan], 1, "", 0), (103, v[0][:31] + [-inf], 1, "", 0)]
    rows += [(-9, [1.0] * 5, 7, "", 0), (-8, [], 7, "", 0), (104, [0.5] * 64, None, "", 0)]  # kept, of other lengths
    check(spark, rows)


def test_ties_take_the_lower_index(spark):
    rng = random.Random(3)
    check(spark, [(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(16)], 0, None, 0) for i in range(150)])
    check(spark, [(i, [0.25] * 16, 0, None, 0) for i in range(70)])


def test_few_none_and_only_misfits(spark):
    check(spark, [(i, v, 1, None, 0) for i, v in enumerate(vectors(3, 16, 4))])
    assert got(spark, []) == []
    check(spark, [(1, [1.0, 2.0], 1, None, 0)])


def test_other_sizes(spark):
    check(spark, [(i, v, 1, None, 0) for i, v in enumerate(vectors(60, 12, 5))], parts=4, entries=5, rounds=3)


def test_huge_components_have_a_result(spark):
    rows = [(i, [s * 3e38] * 16, 1, None, 0) for i, s in enumerate((1, -1, 0.5))]
    found = got(spark, rows)
    assert len(found) == 3 and all(len(r[1]) == 32 and r[2] >= 0 for r in found)


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "HOT", 5)
    check(spark, [(i, v, 0 if i % 2 else i, None, 0) for i, v in enumerate(vectors(80, 16, 6))])


@pytest.mark.parametrize("seed", range(20))
def test_annulus_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    w, k = int(rng.integers(1, 9)), int(rng.integers(1, 70))
    spread = 10 ** int(rng.integers(0, 8))
    book, x = rng.integers(-spread, spread + 1, (k, w)), rng.integers(-spread, spread + 1, (300, w))
    index, far = codes.Annuli(book).nearest(x)
    all_far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (far == all_far.min(axis=1)).all() and (index == all_far.argmin(axis=1)).all()


def test_annulus_prunes(spark, sf):
    v = np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], dtype=np.float64)
    x = codes.integers(v)[:, :4]
    index = codes.Annuli(x[:64])
    index.nearest(x)
    assert index.evaluated < 0.7 * 64 * len(x)


def test_round_trip_and_decoding(spark, sf):
    rows = codes.usable(spark.read.parquet(f"{sf}/embeddings.parquet"))
    books = codes.train(rows)
    found = codes.decode(codes.encode(rows, books), books).join(rows.withColumnRenamed("vector", "given"), "vec_id").collect()
    for r in found:
        given = np.floor(np.array(r.given) * 256)
        assert int(((given - np.array(r.vector) * 256) ** 2).sum()) == r.error


def test_query_against_sql(spark, sf):
    assert differences(spark, connect(sf), sf, op12_norm_codes, ORACLES["op12_norm_codes"]) is None
