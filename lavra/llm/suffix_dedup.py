r"""Suffix-array dedup by difference-cover blockwise construction.

Every byte of a string of ``length`` bytes that starts in two places of the corpus is removed.
Equal strings are neighbours in a suffix array, so what is asked of a suffix is whether a
neighbour shares its first ``length`` bytes.

1. *Anchors.* Each string of ``length`` bytes has an anchor: its ``GRAM``-byte gram of least
   hash, leftmost of equals. Equal strings have equal anchors at equal offsets. Neighbouring
   strings share anchors, so a document falls into blocks (one anchor, the strings around
   it), about one per 170 bytes, and only blocks of one gram can hold equal strings. This
   deals the suffixes to tasks; blocks whose gram occurs once are done.
2. *Copies collapse.* Blocks with equal content count as one with a multiplicity, map-side,
   before anything is compared; a passage in a third of all documents is one block.
3. *Suffix sorting.* The distinct blocks of a gram with several contents are laid side by side
   and their suffixes sorted, one bucket of leading bytes at a time. A bucket is sorted
   on ``COVER`` bytes; longer ties are resolved by ranks: the positions whose remainder by ``COVER`` is
   in a difference cover are ranked beforehand (by COVER bytes, then doubling), and any two
   suffixes reach such positions within the same COVER bytes. So memory is a text block, its cover
   ranks and one bucket. Neighbours that share ``length`` bytes are marked.
4. Spans go back to the documents, are merged and cut.

A gram with more than ``group_max`` distinct blocks isn't laid out in one task: its strings
are dealt one by one to the task of their first ``length`` bytes' 128-bit hash and counted there,
with map-side sums (exact too, at more shuffle).

Blocks are told apart by 128 bits of hashes of their content, and blocks met twice go out whole on these alone;
everything else is decided on bytes.

Defined results: null text counts as empty; texts shorter than ``length`` lose nothing; rows
that repeat are separate documents and so repeat each other; strings are judged on the
input and overlapping ones count, so ties don't arise; very long texts are scanned in overlapping pieces; rows
without an id are told apart by their texts, and equal ones repeat each other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, id_text, materialize, released

LENGTH, GRAM, COVER = 400, 64, 64
PIECE = 1 << 20  # bytes scanned at once; positions in a piece take 21 bits
LAYOUT = 1 << 21  # bytes of blocks sorted at once


# --- difference covers and suffix sorting -------------------------------------------------

def difference_cover(v: int) -> list[int]:
    """Numbers below v such that every difference modulo v occurs: 0 .. r - 1 and the multiples of r."""
    r = int(np.ceil(np.sqrt(v)))
    return sorted({*range(r), *range(0, v, r)})


def shifts(v: int, cover: list[int]) -> np.ndarray:
    """shifts[a, b]: the least d with a + d and b + d both in the cover, modulo v."""
    inside = np.zeros(v, bool)
    inside[cover] = True
    out = np.full((v, v), -1, np.int64)
    for d in reversed(range(v)):
        moved = np.roll(inside, -d)  # moved[a] = inside[a + d]
        out[np.ix_(moved, moved)] = d
    return out


def _words(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the text."""
    full = np.concatenate([text, np.zeros(pad + 8, np.uint8)])
    out = np.zeros(len(text) + pad, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | full[k : k + len(out)]
    return out


def cover_ranks(words: np.ndarray, n: int, depth: int, v: int = COVER) -> np.ndarray:
    """ranks[i] for positions of the cover (others -1): order of the suffixes to at least ``depth`` bytes."""
    inside = np.zeros(v, bool)
    inside[difference_cover(v)] = True
    at = np.flatnonzero(inside[np.arange(n) % v])
    keys = [words[at + 8 * k] for k in range(v // 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    ranks = np.full(n + 2 * depth + v, -1, np.int64)
    ranks[at[order]] = np.cumsum(new)
    reach = v
    while reach < depth and len(at):
        pair = ranks[at] * (len(at) + 2) + ranks[at + reach] + 1
        _, ranks[at] = np.unique(pair, return_inverse=True)
        reach *= 2
    return ranks


def blockwise_order(text: np.ndarray, suffixes: np.ndarray, depth: int, v: int = COVER):
    """The suffixes in order to at least ``depth`` bytes, one bucket of leading two bytes after the other.

    Yields (positions in order, tied: whether each shares v bytes with the one before).
    """
    pad = 2 * depth + v
    words = _words(text, pad)
    ranks = cover_ranks(words, len(text), depth, v)
    shift = shifts(v, difference_cover(v))
    lead = (words[suffixes] >> np.uint64(48)).astype(np.int64)
    by_lead = np.argsort(lead, kind="stable")
    for bucket in np.split(by_lead, np.flatnonzero(np.diff(lead[by_lead])) + 1):
        p = suffixes[bucket]
        keys = [words[p + 8 * k] for k in range(v // 8)]
        order = np.lexsort(keys[::-1])
        tied = np.ones(len(p), bool)
        tied[:1] = False
        for k in keys:
            k = k[order]
            tied[1:] &= k[1:] == k[:-1]
        p = p[order]
        group = np.cumsum(~tied) - 1
        yield _by_ranks(p, group, ranks, shift, v), tied


def _by_ranks(p: np.ndarray, group: np.ndarray, ranks: np.ndarray, shift: np.ndarray, v: int) -> np.ndarray:
    """Sorts inside each tie group by cover ranks: three-way partition around a pivot, all groups at once."""
    p = p.copy()
    sizes = np.bincount(group, minlength=1) if len(p) else np.zeros(1, np.int64)
    todo = np.flatnonzero(sizes[group] > 1) if len(p) else np.zeros(0, np.int64)
    group = group[todo]
    while len(todo):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        run = np.repeat(np.arange(len(first)), size)
        q, pivot = p[todo], p[todo][first + size // 2][run]
        d = shift[q % v, pivot % v]
        side = np.sign(ranks[q + d] - ranks[pivot + d])
        key = run * 3 + side + 1
        order = np.argsort(key, kind="stable")
        p[todo] = q[order]
        key = key[order]
        size = np.bincount(key)
        more = (key % 3 != 1) & (size[key] > 1)
        todo, group = todo[more], key[more]
    return p


def repeated(text: np.ndarray, suffixes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The suffixes whose first ``length`` (COVER or more) bytes also start another of them, ascending."""
    words = _words(text, 2 * length)
    found = []
    for order, tied in blockwise_order(text, suffixes, length):
        at = np.flatnonzero(tied)
        steps = [*range(0, length - 8, 8), length - 8]
        for k in steps:  # neighbours that differ drop out word by word
            at = at[words[order[at] + k] == words[order[at - 1] + k]]
        found.append(np.union1d(order[at], order[at - 1]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


# --- anchors ------------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        h, size = _mix(buf.astype(np.uint64) + np.uint64(1)), 1
        while size < gram:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]
            h = h ^ (h >> np.uint64(29))
            size *= 2
        return _mix(h)


def anchors_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document number, anchor, first and last string, gram hash) of every block; documents lie side by side."""
    window = length - gram + 1
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(buf, gram)
    low = np.uint64((1 << 21) - 1)
    c = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        c = np.minimum(c[:-size], c[size:])
        size *= 2
    if size < window:
        c = np.minimum(c[: len(c) - (window - size)], c[window - size :])
    at = (c & low).astype(np.int64)
    last = ends - length  # the last string of each document
    doc = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    p = np.flatnonzero(np.arange(len(at)) <= last[doc])
    if not len(p):
        return none, none, none, none, none.astype(np.uint64)
    cut = np.append(True, (at[p][1:] != at[p][:-1]) | (doc[p][1:] != doc[p][:-1]))
    lo = p[cut]
    hi = p[np.append(np.flatnonzero(cut)[1:] - 1, len(p) - 1)]
    return doc[lo], at[lo], lo, hi, h[at[lo]]


def _pieces(ids, texts, length):
    """Documents in groups of about PIECE bytes; longer ones in overlapping parts: (key, byte offset, bytes)."""
    group, size = [], 0
    for key, text in zip(ids, texts, strict=True):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - length + 1), PIECE):
            part = data[at : at + PIECE + length - 1]
            if len(part) >= length:
                group.append((key, at, part))
                size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


BLOCKS = "doc_id long, mark long, h long, content long, anchor long, lo long, hi long"


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """Rows of BLOCKS; ``texts`` has doc_id, mark, text."""

    def run(batches):
        for b in batches:
            ids = list(zip(*(c.to_pylist() for c in b.columns[:2]), strict=True))
            for group in _pieces(ids, b.column(2).to_pylist(), length):
                data = b"".join(x[2] for x in group)
                ends = np.cumsum([len(x[2]) for x in group])
                starts = ends - np.array([len(x[2]) for x in group])
                doc, at, lo, hi, h = anchors_of(np.frombuffer(data, np.uint8), starts, ends, length)
                if not len(doc):
                    continue
                view = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                # offset of the anchor included: blocks with one content have it at one place anyway
                content = np.array([digest(view[x : y + length]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
                shift = np.array([x[1] for x in group])[doc] - starts[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([x[0][0] for x in group])[doc], pa.int64()),
                        pa.array(np.array([x[0][1] for x in group])[doc], pa.int64()),
                        pa.array(h.view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array(at + shift), pa.array(lo + shift), pa.array(hi + shift),
                    ],
                    [f.split()[0] for f in BLOCKS.split(", ")],
                )

    return texts.mapInArrow(released(run), BLOCKS)


# --- the operator -------------------------------------------------------------------------

RUNS = "h long, content long, runs array<struct<lo:int,hi:int>>"


def _cut_out(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of contested blocks: h, content, before (anchor minus first string), n (strings), data."""

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for text, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for x in blocks:
                    for k, v in enumerate((x["h"], x["content"], x["anchor"] - x["lo"], x["hi"] - x["lo"] + 1, data[x["lo"] : x["hi"] + length])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())],
                ["h", "content", "before", "n", "data"],
            )

    return joined.mapInArrow(released(run), "h long, content long, before int, n int, data binary")


def _runs(layout: list[tuple[int, int, int, int, bytes]], length: int):
    """For the blocks of whole groups side by side: per block the runs of repeated strings, by offset from the anchor."""
    text = np.frombuffer(b"".join(x[4] for x in layout), np.uint8)
    starts = np.cumsum([0, *(len(x[4]) for x in layout)])[:-1]
    n = np.array([x[3] for x in layout])
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(layout)), n)
    suffixes = starts[owner] + np.arange(n.sum()) - first[owner]
    hit = repeated(text, suffixes, length)
    who = np.searchsorted(starts, hit, "right") - 1
    cut = np.append(True, (np.diff(hit) != 1) | (np.diff(who) != 0)) if len(hit) else np.zeros(0, bool)
    lo = np.flatnonzero(cut)
    out: dict[int, list] = {}
    for a, b in zip(lo.tolist(), [*lo.tolist()[1:], len(hit)], strict=True):
        w = int(who[a])
        origin = int(starts[w]) + layout[w][2]
        out.setdefault(w, []).append({"lo": int(hit[a]) - origin, "hi": int(hit[b - 1]) - origin})
    return pa.RecordBatch.from_arrays(
        [
            pa.array([layout[w][0] for w in out], pa.int64()), pa.array([layout[w][1] for w in out], pa.int64()),
            pa.array(list(out.values()), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
        ],
        ["h", "content", "runs"],
    )


def _sorted_groups(blocks: DataFrame, length: int) -> DataFrame:
    def run(batches):
        layout, size, h = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= LAYOUT and row[0] != h:
                    yield _runs(layout, length)
                    layout, size = [], 0
                h = row[0]
                layout.append(row)
                size += len(row[4])
        if layout:
            yield _runs(layout, length)

    return blocks.repartition("h").sortWithinPartitions("h").mapInArrow(released(run), RUNS)


def _counted_strings(blocks: DataFrame, length: int) -> DataFrame:
    """The way for grams with too many blocks for one layout: each string by its hash, counted map-side."""

    def run(batches):
        for b in batches:
            for h, content, before, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                view = memoryview(data)
                d = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array(range(-before, n - before), pa.int32()), pa.array(d, pa.binary())],
                    ["h", "content", "at", "string"],
                )

    strings = blocks.mapInArrow(released(run), "h long, content long, at int, string binary")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1")
    return strings.join(twice, "string", "left_semi").groupBy("h", "content").agg(
        F.expr("transform(collect_list(at), x -> named_struct('lo', x, 'hi', x))").alias("runs")
    )


def _removed(joined: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                digest, kept, at = hashlib.sha256(), [], 0
                for lo, hi in [*merged, [len(data), len(data)]]:
                    digest.update(data[at:lo])
                    kept.append(data[at:lo])
                    at = hi
                row = (doc, len(data), sum(hi - lo for lo, hi in merged), len(merged), digest.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in merged], b"".join(kept) if with_bytes else None)
                for o, x in zip(out, row, strict=True):
                    o.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, k) for o, k in zip(out, kinds, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    return joined.mapInArrow(
        released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>, kept binary"
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, group_max: int = 20_000, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (bytes, end exclusive), kept (bytes, if ``with_bytes``)."""
    # rows that share a doc_id are told apart by 64 bits of hash of their text
    no_id = F.lit(-(1 << 63))
    texts = id_text(docs, id_col, text_col).select(F.coalesce("doc_id", no_id).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    if length < GRAM + 8:
        raise ValueError(f"length has to be at least {GRAM + 8}")
    found = materialize(anchors(texts.select("doc_id", "mark", "text"), length), "anchors")
    blocks = found.groupBy("h", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "anchor", "lo", "hi")).alias("first"))
    grams = blocks.groupBy("h").agg(F.count("*").alias("contents"), F.sum("n").alias("all")).where(F.col("all") > 1)
    shared = materialize(blocks.join(grams, "h").select("h", "content", "n", "contents", "all", "first"), "shared-blocks")

    copies = shared.where("n > 1").select("h", "content")
    contested = shared.where(F.col("contents") > 1).where(F.col("all") > 1)
    wanted = contested.select("first.doc_id", "first.mark", F.struct("h", "content", "contents", "first.anchor", "first.lo", "first.hi").alias("block"))
    by_doc = wanted.groupBy("doc_id", "mark").agg(F.collect_list("block").alias("blocks"))  # no more than a document has
    sources = texts.join(by_doc, ["doc_id", "mark"])
    small = F.expr(f"filter(blocks, b -> b.contents <= {int(group_max)})")
    large = F.expr(f"filter(blocks, b -> b.contents > {int(group_max)})")
    # a block met twice here stems from a repeated row, so its strings do repeat
    runs = _sorted_groups(_cut_out(sources.select("text", small.alias("blocks")), length), length)
    if not shared.where(F.col("contents") > group_max).limit(1).isEmpty():
        runs = runs.union(_counted_strings(_cut_out(sources.select("text", large.alias("blocks")), length), length))
    runs = runs.join(copies, ["h", "content"], "left_anti")  # copies are removed as a whole
    # blocks met in a thousandth of all places, a thousand of them at most, are known to every task, so that the
    # places of a passage that a third of all documents share stay where they are
    many = max(HOT, found.count() / HOT)
    hot = F.broadcast(shared.where(F.col("n") >= many).select("h", "content"))  # HOT rows at most
    rare = found.join(hot, ["h", "content"], "left_anti")
    whole = found.join(hot, ["h", "content"], "left_semi").unionByName(rare.join(copies, ["h", "content"], "left_semi"))
    whole = whole.select("doc_id", "mark", "lo", (F.col("hi") + length).alias("hi"))
    parts = rare.join(runs, ["h", "content"]).select("doc_id", "mark", "anchor", F.explode("runs").alias("r")).select(
        "doc_id", "mark", (F.col("anchor") + F.col("r.lo")).alias("lo"), (F.col("anchor") + F.col("r.hi") + length).alias("hi")
    )
    spans = whole.union(parts).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    return _removed(joined, length, with_bytes).withColumn("doc_id", F.nullif("doc_id", no_id))
