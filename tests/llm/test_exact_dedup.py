import hashlib
import re
from collections import defaultdict

from lavra.llm import exact_dedup as m


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((doc, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda x: (-x[1], x[0]))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out)


def test_fixture_against_brute_force(docs, rows):
    for options in ({}, {"capacity": 2, "max_depth": 4}):
        assert sorted(map(tuple, m.exact_dedup(docs, **options).collect())) == brute([r[:2] for r in rows])


def test_given_data(spark, sf, given):
    from lavra.llm.queries import op7_exact_dedup

    assert sorted(map(tuple, op7_exact_dedup(spark, sf).collect())) == brute(given)


def test_empty(empty):
    assert m.exact_dedup(empty).count() == 0


def test_directory_doubles_only_where_buckets_overflow():
    depth, buckets = m.grow_directory({0: 5, 1: 5, 9: 1}, 4, 5)
    assert depth == 4 and (0, 1, 4) in buckets and (8, 16, 1) in buckets
    assert sum(hi - lo for lo, hi, _ in buckets) == 16
    assert m.grow_directory({}, 4, 5) == (0, [(0, 16, 0)])


def test_keys_that_collide_are_chained(docs, rows):
    """With only four keys every chain holds many texts; classes are still those of the bytes."""
    from pyspark.sql import functions as F

    few = lambda norm: F.shiftleft(F.pmod(F.xxhash64(norm), F.lit(4)), 62)
    for options in ({}, {"capacity": 2, "max_depth": 4}):
        assert sorted(map(tuple, m.exact_dedup(docs, key=few, **options).collect())) == brute([r[:2] for r in rows])


def test_a_text_in_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2 * 2}", "r") for i in range(6000)] + [(None, "same  text", "r"), (None, "alone", "r"), (5, "other", "r")]
    got = m.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    hot = [r for r in got if r["group_size"] > 1000]
    assert len(hot) == 2001 and {r["keep_id"] for r in hot} == {None}  # the row with most code points has no id
    assert [r["doc_id"] for r in hot if r["kept"]] == [None]
    assert sum(r["kept"] for r in got) == len({t.replace(" ", "") for _, t, _ in rows})
