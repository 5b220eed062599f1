r"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by an item if some stretch of it, read as lower-cased words, is
within ``floor((1 - similarity) * L)`` word edits of the item's L words.

Windows of the item's own size are embedded by the CGK random walk: at each step the current
word is copied and the walk moves on or stays by a random bit of (step, word), the same for
all strings, so strings within few edits get embeddings that agree in many places. Tables
sample a few places of the embedding each; windows that fall into an item's cell in any table
are candidates. How many embeddings are drawn is calibrated for each item length: edits
of the largest allowed number are simulated on random strings of that length, and embeddings
are added until the share found reaches ``recall``; where ``MOST`` of them don't reach it, every window
that survives the bound below is a candidate. Every candidate is verified by the exact edit distance.
Items of fewer than ``min_words`` words are too short to be embedded: every window that survives the bound is verified, so
their matches are exact. An item too short for an edit at all (under five words at a similarity of 0.8) matches word for word.

Windows are only embedded where they can match at all: an edit changes at most two pairs of
neighbouring words, so a stretch within e edits of an item keeps L - 1 - 2e of its pairs, and a
window with fewer pairs of every item is passed over (a bound, not a heuristic; words of no
item share one number). Places of known pairs are listed by item, so the cost follows them.

Scale: one pass over whole texts, no shuffle; a row's result is its own. The items travel in
blocks of at most ``block_mb`` of text, checked; a larger benchmark takes several blocks, each
its own pass.

Defined results: null text counts as empty; items without words, null ones too, are not looked for;
repeated rows and items are treated alike; of several items the list is sorted by item_id, of windows
that tie the similarity is the same; very long texts are read whole; empty tables give no rows, or none
contaminated; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

WORD = re.compile(r"\w+")
SAMPLED, TABLES = 2, 8  # places a table samples; tables on each embedding
MOST = 64  # embeddings calibration may ask for
BATCH = 1 << 20  # words handled at once


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def number_of(word: str) -> int:
    """62 bits of the word's hash, never 0: the same in every block of items."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 2 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def embed(strings: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """CGK: rows of word numbers (0 beyond an end) to ``steps`` places each."""
    n, size = strings.shape
    padded = np.concatenate([strings, np.zeros((n, 1), strings.dtype)], 1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, steps), strings.dtype)
    for step in range(steps):
        w = padded[rows, at]
        out[:, step] = w
        bit = _mix(w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + step)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), size)
    return out


def cells(embedding: np.ndarray, seed: int) -> np.ndarray:
    """TABLES keys per row, each of SAMPLED places."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(embedding), TABLES), np.uint64)
    for t in range(TABLES):
        key = np.full(len(embedding), t, np.uint64)
        for place in rng.choice(embedding.shape[1], SAMPLED, replace=False):
            key = _mix(key * np.uint64(31) + embedding[:, place].astype(np.uint64))
        out[:, t] = key
    return out


def steps_for(length: int) -> int:
    return max(SAMPLED + 1, math.ceil(1.5 * length))


def calibrated(length: int, edits: int, recall: float, trials: int = 256) -> int | None:
    """Embeddings needed so that strings ``edits`` apart share a cell with probability ``recall``; None if MOST don't do."""
    rng = np.random.default_rng(length * 1009 + edits)
    a = rng.integers(1, 1 << 30, (trials, length + edits))
    b = np.zeros((trials, length), np.int64)
    for i in range(trials):
        s = a[i, :length].tolist()
        for _ in range(edits):
            k, kind = int(rng.integers(0, len(s))), rng.integers(0, 3)
            if kind == 0:
                s[k] = int(rng.integers(1, 1 << 30))
            elif kind == 1 and len(s) > 1:
                del s[k]
            else:
                s.insert(k, int(rng.integers(1, 1 << 30)))
        s = (s + a[i, length:].tolist())[:length]  # the window has the item's size, whatever follows
        b[i, : len(s)] = s
    found = np.zeros(trials, bool)
    for seed in range(MOST):
        ca, cb = cells(embed(a[:, :length], seed, steps_for(length)), seed), cells(embed(b, seed, steps_for(length)), seed)
        found |= (ca == cb).any(1)
        if found.mean() >= recall:
            return seed + 1
    return None


def edit_distances(region: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Least edits between the item and any prefix of each region row (0 in a row matches nothing)."""
    n, size = region.shape
    ramp = np.arange(size + 1)
    d = np.tile(ramp, (n, 1))
    for i, w in enumerate(item, 1):
        sub = d[:, :-1] + (region != w)
        row = np.concatenate([np.full((n, 1), i), np.minimum(sub, d[:, 1:] + 1)], 1)
        d = np.minimum.accumulate(row - ramp, 1) + ramp
    return d.min(1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def allowed(length: int, similarity: float) -> int:
    """Edits that leave an item of so many words similar enough."""
    return math.floor((1 - similarity) * length + 1e-9)


class Index:
    """The items of one block, by length: vocabulary, embeddings to draw and the cells of the items."""

    def __init__(self, items: list[tuple[int, list[str]]], similarity: float, recall: float, min_words: int = 8):
        self.number: dict[str, int] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, ws in items:
            edits = allowed(len(ws), similarity)
            if not edits or (len(ws) < min_words and len(ws) - 1 - 2 * edits < 1):
                self.short[len(ws)][tuple(self.number.setdefault(w, number_of(w)) for w in ws)].append(item_id)
                continue
            by[len(ws)].append((item_id, np.array([self.number.setdefault(w, number_of(w)) for w in ws])))
        each = [(length, np.unique(_pair(x[:-1], x[1:]))) for length, g in sorted(by.items()) for _, x in g]
        self.sizes = np.array([length for length, _ in each], np.int64)  # of the items, numbered in this order
        found = np.concatenate([p for _, p in each]) if each else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        self.pairs, first = np.unique(found[order], return_index=True)
        self.holders = np.repeat(np.arange(len(each)), [len(p) for _, p in each])[order]  # items of each pair, from ``bounds``
        self.bounds = np.append(first, len(found))
        self.needed = self.sizes - 1 - 2 * np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.lengths = []
        for length, group in sorted(by.items()):
            edits = allowed(length, similarity)
            strings = np.stack([x for _, x in group])
            tables, needed = [], calibrated(length, edits, recall) if length >= min_words else None
            for seed in range(needed or 0):
                keys = cells(embed(strings, seed, steps_for(length)), seed).ravel()
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], order // TABLES))
            self.lengths.append((length, edits, group, tables if needed else None))
        self.longest = max([*(x[0] + x[1] for x in self.lengths), *self.short], default=0)

    def matches(self, stream: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, item_id, similarity) of the verified windows in a stream of word numbers."""
        out = self._word_for_word(stream)
        if len(stream) < 2 or not len(self.pairs):
            return out
        starts_of = self._starts(stream)
        for length, edits, group, tables in self.lengths:
            starts = starts_of(length)
            starts = starts[(starts >= 0) & (starts <= len(stream) - length)]
            starts = starts[stream[starts] > 0]  # a best stretch can be trimmed to start at a word of the item
            for lo in range(0, len(starts), 1 << 14):
                out += self._verified(stream, starts[lo : lo + (1 << 14)], length, edits, group, tables)
        return out

    def _word_for_word(self, stream: np.ndarray) -> list[tuple[int, int, float]]:
        out = []
        for n, items in self.short.items():
            if len(stream) < n:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(stream, n)
            firsts = np.unique(np.array([k[0] for k in items]))
            for i in np.flatnonzero(np.isin(windows[:, 0], firsts) & (windows > 0).all(1)).tolist():
                out += [(i, item_id, 1.0) for item_id in items.get(tuple(windows[i].tolist()), ())]
        return out

    def _starts(self, stream: np.ndarray):
        """A function of the length: sorted starts of the windows that keep enough pairs of one item of that length."""
        both = np.flatnonzero((stream[:-1] > 0) & (stream[1:] > 0))
        pair = _pair(stream[both], stream[both + 1])
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[at] == pair
        place, at = both[hit], at[hit]
        count = self.bounds[at + 1] - self.bounds[at]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, place = self.holders[np.repeat(self.bounds[at], count) + nth], np.repeat(place, count)
        order = np.argsort(item, kind="stable")  # places stay ascending within an item
        item, place = item[order], place[order]
        low, high = np.searchsorted(item, np.arange(len(self.sizes)), "left"), np.searchsorted(item, np.arange(len(self.sizes)), "right")

        def of(length: int) -> np.ndarray:
            ranges = []
            for k in np.flatnonzero(self.sizes == length):
                need, p = self.needed[k], place[low[k] : high[k]]
                if need < 1:
                    return np.arange(len(stream))
                if len(p) < need:
                    continue
                last, first = p[need - 1 :], p[: len(p) - need + 1]
                near = last - first <= length - 2  # the window holds all pairs between
                ranges.append(np.stack([last[near] - (length - 2), first[near]]))
            if not ranges:
                return np.zeros(0, np.int64)
            lo, hi = np.concatenate(ranges, 1)
            n = hi - lo + 1
            return np.unique(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

        return of

    def _verified(self, stream, starts, length, edits, group, tables):
        if not len(starts):
            return []
        padded = np.concatenate([stream, np.zeros(length + edits, stream.dtype)])
        regions = np.lib.stride_tricks.sliding_window_view(padded, length + edits)[starts]
        # passages recur: equal stretches (by 64 bits of hash) are embedded and verified once
        odd = _mix(np.arange(1, length + edits + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            _, first, same = np.unique((_mix(regions.astype(np.uint64)) * odd).sum(1), return_index=True, return_inverse=True)
        regions = regions[first]
        pairs = set() if tables is not None else {(o, i) for o in range(len(group)) for i in range(len(regions))}
        for seed, (keys, owner) in enumerate(tables or ()):
            own = cells(embed(regions[:, :length], seed, steps_for(length)), seed)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for i, t in zip(*np.nonzero(hi > lo), strict=True):
                pairs.update((int(o), int(i)) for o in owner[lo[i, t] : hi[i, t]])
        by = defaultdict(list)
        for o, i in pairs:
            by[o].append(i)
        order = np.argsort(same, kind="stable")
        bounds = np.searchsorted(same[order], np.arange(len(first) + 1))
        out = []
        for o, at in by.items():
            item_id, item = group[o]
            for i, d in zip(at, edit_distances(regions[at], item), strict=True):
                if d <= edits:
                    out += [(int(s), item_id, 1 - int(d) / length) for s in starts[order[bounds[i] : bounds[i + 1]]]]
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_mb: float):
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / (block_mb * 1e6)))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()  # about block_mb
        yield [(r["item_id"], w) for r in rows if (w := words(r["text"]))]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.99,
    min_words: int = 8,
    block_mb: float = 4.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), best_similarity (0 if none), one row per input row."""
    context = docs.sparkSession.sparkContext
    rows = id_text(docs, id_col, text_col)
    found = F.lit(None).cast("array<struct<item_id:long,similarity:double>>")
    for items in _blocks(benchmark, "item_id", "text", block_mb):
        hits = _hits(context.broadcast(Index(items, similarity, recall, min_words)))
        found = F.concat(F.coalesce(found, F.array().cast("array<struct<item_id:long,similarity:double>>")), hits(F.col("text")))
    rows = rows.select("doc_id", found.alias("found"))
    return rows.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("found.item_id"))).alias("item_ids"),
        F.coalesce(F.array_max(F.col("found.similarity")), F.lit(0.0)).alias("best_similarity"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, min_words: int = 8, block_mb: float = 4.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates; rows stay where they are."""
    context = docs.sparkSession.sparkContext
    for items in _blocks(benchmark, "item_id", "text", block_mb):
        docs = docs.where(F.size(_hits(context.broadcast(Index(items, similarity, recall, min_words)))(F.coalesce(F.col(text_col), F.lit("")))) == 0)
    return docs


def _hits(shared):
    """A column function: the matches of one block's items in each text."""

    def of(texts: list[str], index: Index) -> list[list[dict]]:
        get, gap = index.number.get, [0] * index.longest
        stream, starts = [], []
        for t in texts:
            starts.append(len(stream))
            stream += [get(w, 0) for w in words(t)]
            stream += gap  # no window reaches another document
        best: list[dict[int, float]] = [{} for _ in texts]
        for at, item, sim in index.matches(np.array(stream, np.int64)):
            d = best[int(np.searchsorted(starts, at, "right")) - 1]
            d[item] = max(sim, d.get(item, 0.0))
        return [[{"item_id": i, "similarity": s} for i, s in sorted(d.items())] for d in best]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))
        for column in batches:
            out, group, size = [], [], 0
            for t in column.to_pylist():
                group.append(t)
                size += len(t)
                if size > 6 * BATCH:
                    out += of(group, index)
                    group, size = [], 0
            out += of(group, index)
            yield pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<item_id:long,similarity:double>>")
