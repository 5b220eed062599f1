r"""The exact check behind the SimHash near-dedup stage: links by Jaccard similarity of word shingles.

A SimHash radius that met a Jaccard similarity of 0.8 with certainty would be half the fingerprint, so the
stage of the pipeline that drops near copies looks for what the fingerprints left here, by prefix filtering.

Words as in ``simhash``; a document is the set of its ``width``-word shingles (fewer words: the
whole sequence), as XXH64 values. Two documents link when their sets have a Jaccard similarity of
``num / den`` (4/5) or more; a document's component is the smallest doc_id reachable.

Candidates: in any common order of the shingles, two sets that similar share one among the first
``n - ceil(n * num / den) + 1`` of each, so only those are filed, and a document is compared with
those filed under the same shingle whose size and places allow the similarity. Nothing is missed,
whatever the order; one that puts shingles frequent in a sample last keeps buckets small.
A pair's 512-bit parity sketches, whose distance bounds that of the sets, rule out most of what is left;
the rest is verified on whole sets.

Scale: a bucket is compared by growing windows of its order by size. Rounds follow as long as a
bucket goes beyond the window and holds more than one component, and what is linked already isn't
paired again, so a large group of near copies costs a few pairs a member, not all of them.

Defined results: null text counts as empty; texts without words link to nothing, nor do rows
without an id; repeated rows are one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, drop, flagged, free_shuffles, id_text, materialize, released
from .components import components

WIDTH, NUM, DEN, SEED = 5, 4, 5, 42
SAMPLE, FREQUENT = 16, 50_000  # one document of 16 is counted, for the order only
CHUNK = 1 << 16
SKETCH = 8  # words of 64 bits
FILED = "h long, n int, doc_id long, pos int"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles as sorted signed longs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    n, digest, out = max(1, len(words) - width + 1), xxhash.xxh64_intdigest, []
    for lo in range(0, n, CHUNK):
        w = words[lo : lo + CHUNK + width - 1]
        runs = zip(*(w[k:] for k in range(width)), strict=False) if len(w) >= width else [w]
        out.append(np.unique(np.array([digest(s, SEED) for s in map(b" ".join, runs)], np.uint64).view(np.int64)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = pa.array([shingles(t.as_py(), width) for t in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["doc_id", "hs"])

    return texts.mapInArrow(released(run), "doc_id long, hs array<long>")


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met most often in a sample, sorted, and their counts; 50,000 rows at most."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    rows = (
        _sets(sample, width).select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        .where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    )
    rows = sorted((r["h"], r["n"]) for r in rows)
    return np.array([h for h, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH words: bit ``x mod 64 SKETCH`` is the parity of the shingles x that fall on it.

    The sketches of two sets differ in at most as many bits as the sets have shingles apart.
    """
    bits = np.bincount((h.view(np.uint64) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _index(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n (size of the set), s0, s1, ... (its sketch), prefix (the shingles it is filed under, in order): one pass over the texts."""
    known, counts = frequent(texts, width)
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids, sizes, sketches, prefixes = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = shingles(text.as_py(), width)
                    n = len(h)
                    if not n:
                        continue
                    ids.append(doc)
                    sizes.append(n)
                    sketches.append(sketch(h))
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
                    prefixes.append(h[: n - -(-n * num // den) + 1])
                columns = np.array(sketches, np.int64).reshape(-1, SKETCH).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), *[pa.array(c) for c in columns], pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "n", *names, "prefix"],
                )

    return texts.mapInArrow(released(run), "doc_id long, n int, " + ", ".join(f"{c} long" for c in names) + ", prefix array<long>")


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _shared(filed: DataFrame) -> DataFrame:
    """What is filed under a shingle that more than one row has."""

    def run(batches):
        last, before = None, None  # the row held back, the shingle of the one ahead of it
        for b in batches:
            if not b.num_rows:
                continue
            cols = _columns(b)
            if last is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(last, cols, strict=True)]
            h = cols[0]
            same = h[1:] == h[:-1]
            keep = np.append(same, False)
            keep[1:] |= same
            if before is not None:
                keep[0] |= h[0] == before
            out = [c[:-1][keep[:-1]] for c in cols]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["h", "n", "doc_id", "pos"])
            before = h[-2] if len(h) > 1 else before
            last = [c[-1:] for c in cols]
        if last is not None and before is not None and last[0][0] == before:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ["h", "n", "doc_id", "pos"])

    return filed.repartition("h").sortWithinPartitions("h", "n", "doc_id", "pos").mapInArrow(run, FILED)


def _pairs(rows: DataFrame, lo: int, hi: int, num: int, den: int) -> DataFrame:
    """a < b: rows of one bucket, lo to hi - 1 places apart, of different components, that may be similar enough."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols, start = _columns(b), 0
            if held is not None:
                start = len(held[0])
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            h, n, doc, pos, comp = cols
            n, left = n.astype(np.int64), (n - pos).astype(np.int64)
            for k in range(lo, hi):
                i = np.arange(max(start, k), len(h))
                i = i[(h[i] == h[i - k]) & (den * n[i - k] >= num * n[i])]
                if not len(i):
                    break  # sorted by size: further apart there are none either
                j = i - k
                ok = (comp[i] != comp[j]) & ((num + den) * np.minimum(left[i], left[j]) >= num * (n[i] + n[j]))
                if ok.any():
                    x, y = doc[i[ok]], doc[j[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            held = [c[-hi:] for c in cols]

    dealt = rows.repartition("h").sortWithinPartitions("h", "n", "doc_id", "pos").select("h", "n", "doc_id", "pos", "comp")
    return dealt.mapInArrow(run, "a long, b long").where("a < b").distinct()


def _close(pairs: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches don't rule the similarity out (a bound: no similar pair goes)."""
    names = [f"s{k}" for k in range(SKETCH)]
    first, second = (index.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), *[F.col(x).alias(f"{x}{c}") for x in names]) for c in "ab")
    apart = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in names), F.lit(0))
    return pairs.join(first, "a").join(second, "b").where((num + den) * apart <= (den - num) * (F.col("na") + F.col("nb"))).select("a", "b")


def _sliced(texts: DataFrame, width: int, slices: int) -> DataFrame:
    """doc_id, k, hs: the shingles of each document in ``slices`` rows by remainder."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                of = [(h.view(np.uint64) % np.uint64(slices)).astype(np.int32) for h in sets]
                for k in range(slices):
                    hs = pa.array([h[x == k] for h, x in zip(sets, of, strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(part.num_rows, k, np.int32)), hs], ["doc_id", "k", "hs"])

    return texts.mapInArrow(released(run), "doc_id long, k int, hs array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int, slices: int = 8) -> DataFrame:
    """The similar pairs. Whole sets are compared slice by slice, so that no more than a slice of them is shuffled at once."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    many = ids.count()
    slices = slices if many > HOT else 1
    marked = flagged(texts, F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("k")), many)  # other texts stay where they are
    sets = materialize(_sliced(marked.where("lavra_flagged").select("doc_id", "text").join(ids, "doc_id", "left_semi"), width, slices), "candidate-shingles")
    free_shuffles(texts.sparkSession)
    counts = []
    for k in range(slices):
        first, second = (sets.where(F.col("k") == k).select(F.col("doc_id").alias(c), F.col("hs").alias(f"h{c}")) for c in "ab")
        met = pairs.join(first, "a").join(second, "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("both"), (F.size("ha") + F.size("hb")).alias("n"))
        counts.append(materialize(met, "shared-of-pairs"))
        free_shuffles(texts.sparkSession)
    total = reduce(DataFrame.union, counts).groupBy("a", "b").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    out = materialize(total.where((num + den) * F.col("both") >= num * F.col("n")).select("a", "b"), "similar-pairs")
    drop(ids, sets, *counts)
    return out


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN, window: int = 8,
    only: DataFrame | None = None,
) -> DataFrame:
    """doc_id, component_id of every document that a smaller doc_id is reachable from; ``only``: among the doc_ids of that table."""
    texts = id_text(docs, id_col, text_col).where("doc_id is not null")
    index = _index(texts, width, num, den)
    index = materialize(index if only is None else index.join(only.select(F.col(only.columns[0]).alias("doc_id")), "doc_id", "left_semi"), "shingle-index")
    filed = index.select(F.posexplode("prefix").alias("pos", "h"), "n", "doc_id").select("h", "n", "doc_id", "pos")
    entries = materialize(_shared(filed), "shared-shingles")
    free_shuffles(docs.sparkSession)
    rows, edges, lo, hi = entries.withColumn("comp", F.col("doc_id")), [], 1, window + 1
    while True:
        pairs = materialize(_pairs(rows, lo, hi, num, den), "candidate-pairs")
        near = materialize(_close(pairs, index, num, den), "close-pairs")
        edges.append(_verified(near, texts, width, num, den))
        drop(pairs, near)
        roots = components(reduce(DataFrame.union, edges))
        now = entries.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id"))
        open_ = now.groupBy("h").agg(F.count("*").alias("rows"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        open_ = materialize(open_.where((F.col("rows") > hi) & (F.col("x") != F.col("y"))).select("h"), "open-buckets")
        if open_.isEmpty():
            drop(index, entries, open_, *edges)
            return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
        rows, lo, hi = now.join(open_, "h", "left_semi").select("h", "n", "doc_id", "pos", "comp"), hi, hi * 8
