import itertools
import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from lavra.llm import pieces as m


@pytest.fixture(scope="module")
def voc():
    return m.vocabulary(m.MODEL)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=m.MODEL)


def segmentations(voc, text, alpha):
    """All segmentations of a short text by recursion, with their scaled scores."""
    data = (" " + text).encode()
    score = {}
    for node_bytes, lp in _pieces(voc).items():
        score[node_bytes] = lp
    out = []

    def walk(at, ids, total):
        if at == len(data):
            out.append((tuple(ids), total))
            return
        width = next(k for k in range(1, 5) if at + k == len(data) or data[at + k] & 0xC0 != 0x80)
        if data[at : at + width] not in score:
            walk(at + width, ids + [voc.byte_id[c] for c in data[at : at + width]], total + alpha * voc.byte_lp * width)
        for k in range(1, len(data) - at + 1):
            if data[at : at + k] in score:
                i, lp = score[data[at : at + k]]
                walk(at + k, [*ids, i], total + alpha * lp)

    walk(0, [], 0.0)
    z = np.logaddexp.reduce([t for _, t in out])
    return {ids: t - z for ids, t in out}


def _pieces(voc):
    out = {}
    special = {0, 1, 2, *voc.byte_id}
    nodes = {}
    for i, b in enumerate(voc.bytes):
        if i not in special and b:
            node = 0
            for c in b:
                node = voc.step[node, c]
            nodes[b] = (i, float(voc.lp[node]))
    out.update(nodes)
    return out


def draw(voc, texts, k=3, alpha=0.5, seed=0, keys=None):
    lat, found = m.sample_batch(voc, list(keys or range(len(texts))), texts, k, alpha, seed)
    return [[(tuple(m.to_ids(voc, lat, a).tolist()), *rest) for a, *rest in one] for one in found]


TEXTS = ["", "a", " ", "the end", "Été ▁ 𝒳 日本語   x", "a\n\nb\n", "  two  spaces ", "tab\there", "x" * 300]


def test_round_trip_distinct_and_sorted(voc, sp):
    for text, one in zip(TEXTS, draw(voc, TEXTS), strict=True):
        assert len({ids for ids, *_ in one}) == len(one)
        assert [x[2] for x in one] == sorted((x[2] for x in one), reverse=True)
        for ids, *_ in one:
            assert voc.decode(ids) == text
            if "▁" not in text:
                assert sp.decode(list(ids)) == text


def test_probabilities_are_exact(voc):
    for text in ("the", "in\nat", "é日", "a b"):
        exact = segmentations(voc, text, 0.5)
        for ids, lp, _, _ in itertools.chain(*draw(voc, [text] * 30)):
            assert abs(exact[ids] - lp) < 1e-9


def test_few_segmentations_are_all_drawn(voc):
    exact = segmentations(voc, "at", 0.5)
    for one in draw(voc, ["at"] * 20, k=50):
        assert {x[0] for x in one} == set(exact) and all(x[3] == 1.0 for x in one)
        assert draw(voc, ["𝒳"], k=5)[0][0][1] <= 0.0


def test_draws_follow_the_plackett_luce_law(voc):
    """First draws are as likely as their segmentation; so are second draws, given the first."""
    exact = segmentations(voc, "then", 0.3)
    n = 6000
    both = Counter((a[0], b[0]) for a, b in draw(voc, ["then"] * n, k=2, alpha=0.3))
    first = Counter()
    for (a, _), c in both.items():
        first[a] += c
    for ids, lp in exact.items():
        p = math.exp(lp)
        assert abs(first[ids] - n * p) < 5 * math.sqrt(n * p) + 3
    top = first.most_common(1)[0][0]
    for ids, lp in exact.items():
        if ids != top:
            p = math.exp(lp) / (1 - math.exp(exact[top]))
            assert abs(both[top, ids] - first[top] * p) < 5 * math.sqrt(first[top] * p) + 3


def test_inclusion_scores_are_unbiased(voc):
    """Weighted by 1 / inclusion, the sampled probability mass has mean one."""
    total = [sum(math.exp(lp) / q for _, lp, _, q in one) for one in draw(voc, ["then"] * 3000, k=3, alpha=0.3)]
    assert abs(np.mean(total) - 1) < 0.05


def test_seeded_by_row_key_alone(voc):
    a = draw(voc, ["hello there world", "other"], keys=[7, 8])
    b = draw(voc, ["first", "more words here", "hello there world"], keys=[1, 2, 7])
    assert a[0] == b[2] and a[0] != draw(voc, ["hello there world"], keys=[7], seed=1)[0]


def test_table(spark, docs, rows, empty):
    out = m.encode(docs, k=2)
    got = out.collect()
    assert all(r["round_trip"] for r in got)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    text = dict((r[0], r[1]) for r in rows)
    back = m.decode(out).collect()
    assert all(r["decoded"] == (text[r["doc_id"]] or "") for r in back)
    assert [(r["n_pieces"], r["inclusion"]) for r in got if r["doc_id"] == 1] == [(0, 1.0)]
    again = m.encode(docs.repartition(7), k=2)
    key = lambda df: sorted((r["doc_id"], r["sample"], r["ids_xxh64"]) for r in df.collect())
    assert key(again) == key(out)
    assert m.encode(empty).count() == 0


def test_query_over_given_data(spark, sf, given):
    from lavra.llm.queries import op2_sentencepiece

    rows = op2_sentencepiece(spark, sf).collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == sum(2 for _, t in given if t)
