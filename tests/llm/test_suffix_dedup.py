import hashlib
from collections import Counter

import numpy as np
from hypothesis import given as hyp
from hypothesis import settings
from hypothesis import strategies as st

from lavra.llm import suffix_dedup as m


def brute(rows, length=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r)[:5] for r in df.collect())


def test_fixture_against_brute_force(docs, rows):
    want = brute([r[:2] for r in rows])
    assert any(x[2] for x in want)
    assert result(m.remove_repeats(docs)) == want
    assert result(m.remove_repeats(docs, group_max=1)) == want
    kept = m.remove_repeats(docs, with_bytes=True)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept.collect())


def test_shorter_strings(docs, rows):
    assert result(m.remove_repeats(docs, length=100)) == brute([r[:2] for r in rows], 100)


def test_given_data(spark, sf, given):
    from lavra.llm.queries import op9_suffix_dedup

    want = brute(given)
    assert any(0 < x[2] < x[1] for x in want)
    assert result(op9_suffix_dedup(spark, sf)) == want


def test_pieces_of_long_documents(docs, rows, monkeypatch):
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(3000))
    monkeypatch.setattr(m, "PIECE", 1500)
    pieces = [g for g in m._pieces([1, 2], [long, long[7:]], 400)]
    covered = {(k, at + i) for g in pieces for k, at, p in g for i in range(len(p) - 399)}
    assert covered == {(1, i) for i in range(len(long) - 399)} | {(2, i) for i in range(len(long) - 7 - 399)}


def test_empty(empty):
    assert m.remove_repeats(empty).count() == 0


def test_cover_has_every_difference():
    for v in (7, 16, 64):
        cover, s = m.difference_cover(v), m.shifts(v, m.difference_cover(v))
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
        assert all((a + s[a, b]) % v in cover and (b + s[a, b]) % v in cover for a in range(v) for b in range(v))


@settings(max_examples=60, deadline=None)
@hyp(st.binary(min_size=1, max_size=12), st.integers(1, 60), st.binary(max_size=80), st.integers(64, 90))
def test_order_and_marks(unit, times, tail, length):
    text = np.frombuffer(unit * times + tail + unit * times, np.uint8)
    data = text.tobytes()
    suffixes = np.arange(max(0, len(text) - length + 1))
    order = np.concatenate([p for p, _ in m.blockwise_order(text, suffixes, length)]) if len(suffixes) else suffixes
    keys = [data[i : i + length] for i in order]
    assert keys == sorted(keys) and sorted(order) == suffixes.tolist()
    seen = Counter(keys)
    assert m.repeated(text, suffixes, length).tolist() == [i for i in suffixes if seen[data[i : i + length]] > 1]
