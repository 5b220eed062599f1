r"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node at every character boundary and an arc for every vocabulary piece
(a character that is no piece has one arc of byte pieces). With piece log-probabilities scaled
by ``alpha``, backward sums over the lattice give each arc its probability given its node, and
so each segmentation its exact probability.

The k segmentations of largest Gumbel-perturbed log-probability are a sample without
replacement. They are found by best-first (A*) search over regions of the lattice: a region is
a path up to a node together with the arcs barred there; its exact bound is a Gumbel
variable located at the log of the region's mass and truncated at its parent's. The best
region is opened by sampling a path inside it; what is left splits into the regions that
leave this path at each of its later nodes. The bound of the region that would come next, kappa,
gives each segmentation its inclusion score ``1 - exp(-exp(log_prob - kappa))``.

All randomness is a hash of (seed, row key, place), so a row's samples don't depend on
partitions, batches or retries. Pieces never cross a line feed, nor a space that follows
another character (checked on loading), so the lattice falls into words and equal words of a
batch are built once. Whole texts are encoded, in one pass without a shuffle.

Scores: unigram models bring log-probabilities. The scores of BPE models are merge ranks,
for which Zipf's law is used: ``-log(rank + 1)``, normalised over the vocabulary.

Defined results: null text counts as empty; an empty text has one segmentation, without pieces;
a text with fewer than k segmentations has rows for those alone, with inclusion 1 once all
are drawn; regions that tie are opened in the order their paths were drawn; rows that repeat, or share a doc_id and
text, draw alike, and rows without a doc_id draw as id 0; very long texts are one lattice of their distinct words; an empty table gives no rows; extra columns are ignored.
Decoding the ids gives the text back, byte by byte (a literal U+2581 travels as byte pieces).
"""

from __future__ import annotations

import math
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import id_text, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # default of the ``model_file`` parameter
SPACE = "▁"
END = 0xFF  # follows every word in the layout; no UTF-8 text has it
BATCH = 1 << 20  # default of the ``layout`` parameter


class Vocabulary:
    """Pieces as a byte trie with log-probabilities; the space mark is the byte 0x20."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = [-1] * 256
        normal, scores = [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
                scores.append(sp.get_score(i))
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        if min(self.byte_id) < 0:
            raise ValueError("the model needs byte pieces")
        ranked = min(scores, default=0.0) < -1000.0
        lp = -np.log(np.arange(1, len(normal) + 1)) if ranked else np.array(scores)
        if ranked:
            lp = lp - math.log(np.exp(lp).sum())
        self.byte_lp = float(lp.min()) - 1.0
        text = [self.bytes[i].decode() for i in normal]
        if any("\n" in t for t in text):
            self.words = re.compile(r"(?s).+")
        elif any(re.search(r"[^ ] ", t) for t in text):
            self.words = re.compile(r"[^\n]+|\n")
        else:
            self.words = re.compile(r" *[^ \n]+|\n| +")
        children: list[dict[int, int]] = [{}]
        last, chance = [-1], [0.0]
        for i, p in zip(normal, lp.tolist(), strict=True):
            node = 0
            for c in self.bytes[i]:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    last.append(-1)
                    chance.append(0.0)
                node = nxt
            last[node], chance[node] = i, p
        self.step = np.full((len(children), 256), -1, np.int32)
        for node, down in enumerate(children):
            for c, nxt in down.items():
                self.step[node, c] = nxt
        self.piece, self.lp = np.array(last, np.int32), np.array(chance)
        self.deepest = max(map(len, self.bytes))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.width = np.array([len(x) for x in self.bytes], np.int64)
        self.offset = np.cumsum(self.width) - self.width

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids, side by side."""
        size = self.width[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.offset[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def decode(self, ids) -> str:
        """The text of a sequence of ids; the space put before every text goes."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_loaded: dict[tuple[int, str], Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    """Loaded once a process."""
    key = (os.getpid(), model_file)
    if key not in _loaded:
        _loaded[key] = Vocabulary(model_file)
    return _loaded[key]


class Lattice:
    """The arcs of a batch's distinct words. Nodes are byte offsets in the layout of words, each followed by END.

    Arcs of a node lie together, longest first: ``first[node]``, ``p`` (given the node), ``size`` in
    bytes, ``origin`` (the node) and ``piece`` (negative: minus one minus the start of a
    character in byte pieces).
    """

    def __init__(self, voc: Vocabulary, words: list[str], alpha: float):
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        self.layout = np.frombuffer(b"".join(x + b"\xff" for x in data) + b"\xff", np.uint8)
        size = np.array([len(x) for x in data], np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        n = len(self.layout)
        self.first, self.count = np.zeros(n, np.int64), np.zeros(n, np.int16)
        beta = np.zeros(n)
        head = (self.layout & 0xC0) != 0x80
        byte_id = np.array(voc.byte_id, np.int32)
        parts: list[tuple[np.ndarray, ...]] = []
        total = 0
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for off in range(int(size.max(initial=0)) - 1, -1, -1):
            at = self.start[order[: alive[off]]] + off
            at = at[head[at]]
            if not len(at):
                continue
            rows, node = np.arange(len(at)), np.zeros(len(at), np.int32)
            found, lead = [], self.layout[at]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            known = np.zeros(len(at), bool)
            for k in range(voc.deepest):
                node = voc.step[node, self.layout[at[rows] + k]]
                live = node >= 0
                if not live.all():
                    rows, node = rows[live], node[live]
                if not len(rows):
                    break
                piece = voc.piece[node]
                is_piece = piece >= 0
                r = rows[is_piece]
                if len(r):
                    found.append((r, k + 1, piece[is_piece], alpha * voc.lp[node[is_piece]] + beta[at[r] + k + 1]))
                    known[r] |= width[r] == k + 1
            other = np.flatnonzero(~known)
            if len(other):
                w = width[other]
                single = np.where(w == 1, byte_id[lead[other]], -1 - at[other])
                found.append((other, w, single, alpha * voc.byte_lp * w + beta[at[other] + w]))
            count = np.zeros(len(at), np.int64)
            top = np.full(len(at), -np.inf)
            for r, _, _, v in found:
                count[r] += 1
                top[r] = np.maximum(top[r], v)
            mass = np.zeros(len(at))
            for r, _, _, v in found:
                mass[r] += np.exp(v - top[r])
            beta[at] = top + np.log(mass)
            base = np.cumsum(count) - count
            self.first[at], self.count[at] = base + total, count
            m = int(count.sum())
            p, length, ids = np.empty(m), np.empty(m, np.int32), np.empty(m, np.int64)
            for r, k, piece, v in reversed(found):
                p[base[r]] = np.exp(v - beta[at[r]])
                length[base[r]] = k
                ids[base[r]] = piece
                base[r] += 1
            alone = count == 1
            p[self.first[at[alone]] - total] = 1.0
            parts.append((p, length, ids, np.repeat(at, count)))
            total += m
        join = lambda k, kind: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, kind)
        self.p, self.size, self.piece, self.origin = join(0, float), join(1, np.int32), join(2, np.int64), join(3, np.int64)

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc of each node that ``u`` falls on."""
        arc, left = self.first[node].copy(), u.copy()
        last = arc + self.count[node] - 1
        todo = np.flatnonzero((left >= self.p[arc]) & (arc < last))
        while len(todo):
            left[todo] -= self.p[arc[todo]]
            arc[todo] += 1
            todo = todo[(left[todo] >= self.p[arc[todo]]) & (arc[todo] < last[todo])]
        return arc


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), from 53 bits of the hashed key."""
    return ((_mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _path(lat: Lattice, node: np.ndarray, end: np.ndarray, key: np.ndarray):
    """Arcs sampled from each node to its word's end: (arcs side by side, number per word)."""
    count = np.zeros(len(node), np.int64)
    steps, todo, at = [], np.flatnonzero(node < end), node[node < end]
    step = 0
    with np.errstate(over="ignore"):
        while len(todo):
            arc = lat.choose(at, _uniform(key[todo] + np.uint64(step * 0x632BE59BD9B4E019 & (2**64 - 1))))
            steps.append((todo, arc))
            count[todo] += 1
            at = at + lat.size[arc]
            more = at < end[todo]
            todo, at = todo[more], at[more]
            step += 1
    base = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for k, (t, arc) in enumerate(steps):
        out[base[t] + k] = arc
    return out, count


class _Sample:
    """One segmentation of a document: arcs, their log-probabilities, and the regions that leave it."""

    __slots__ = ("arcs", "word", "total", "gumbel", "bounds", "before", "barred_at")


def sample_batch(voc: Vocabulary, keys: list[int], texts: list[str], k: int, alpha: float, seed: int):
    """Per document a list of (ids, log_prob, gumbel, inclusion), by descending gumbel."""
    split = [voc.words.findall(" " + t) if t else [] for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    codes, words = pd.factorize(np.array([w for x in split for w in x], object))
    del split
    lat = Lattice(voc, words.tolist(), alpha)
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore", divide="ignore"):
        row_key = _mix(np.array([x & (2**64 - 1) for x in keys], np.uint64) + _mix(np.array([seed & (2**64 - 1)], np.uint64)))
        place = np.arange(len(codes)) - np.repeat(first, sizes)
        word_key = np.repeat(row_key, sizes) + _mix(place.astype(np.uint64) + np.uint64(1))
        arcs, per_word = _path(lat, lat.start[codes], lat.end[codes], _mix(word_key))
        log_p, log_rest = np.log(lat.p), np.log1p(-np.minimum(lat.p, 1.0))
        word_of = np.repeat(np.arange(len(codes)), per_word)
        ends = np.cumsum(per_word)
        drawn: list[list[_Sample]] = []
        rngs, kappas = [_Rng(int(x)) for x in row_key], [-math.inf] * len(texts)
        single: list[float] = []  # the gumbel of each document's first sample
        for d, rng in enumerate(rngs):
            lo, hi = int(first[d]), int(first[d] + sizes[d])
            a, b = (int(ends[lo - 1]) if lo else 0), (int(ends[hi - 1]) if hi else 0)
            single.append(-math.log(-math.log(rng.uniform())))
            drawn.append([_draw(lat, log_p, log_rest, arcs[a:b], word_of[a:b], 0, (), single[d], rng)] if hi > lo else [])
        for rank in range(1, k + 1):  # one region of every document is opened a round, all their paths at once
            opened = []
            for d, own in enumerate(drawn):
                if len(own) < rank:
                    continue
                s = max(own, key=lambda x: x.bounds.max(initial=-np.inf))
                t = int(s.bounds.argmax()) if len(s.bounds) else 0
                kappas[d] = float(s.bounds[t]) if len(s.bounds) else -math.inf
                if rank < k and kappas[d] > -math.inf:
                    opened.append((d, s, t, *_leave(lat, s, t, rngs[d])))
            if not opened:
                break
            spans = [np.arange(int(s.word[t]), int(first[d] + sizes[d])) for d, s, t, *_ in opened]
            idx, size = np.concatenate(spans), np.array([len(x) for x in spans])
            at, head = lat.start[codes[idx]], np.cumsum(size) - size
            at[head] = [int(lat.origin[arc]) + int(lat.size[arc]) for *_, arc in opened]
            tail, per = _path(lat, at, lat.end[codes[idx]], _mix(word_key[idx] + np.uint64(rank * 0x9E3779B97F4A7C15 & (2**64 - 1))))
            stop = np.cumsum(per)
            for (d, s, t, barred, arc), lo, n in zip(opened, head.tolist(), size.tolist(), strict=True):
                a = int(stop[lo - 1]) if lo else 0
                path = np.concatenate([s.arcs[:t], [arc], tail[a : int(stop[lo + n - 1])]])
                word = np.concatenate([s.word[: t + 1], np.repeat(idx[lo : lo + n], per[lo : lo + n])])
                drawn[d].append(_draw(lat, log_p, log_rest, path, word, t, barred, kappas[d], rngs[d]))
    out = []
    for own, kappa, g in zip(drawn, kappas, single, strict=True):
        scored = [(x.arcs, x.total, x.gumbel, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(50.0, x.total - kappa)))) for x in own]
        out.append(scored or [(np.zeros(0, np.int64), 0.0, g, 1.0)])
    return lat, out


class _Rng:
    def __init__(self, key: int):
        self.gen = np.random.Generator(np.random.PCG64(key))

    def uniform(self) -> float:
        return (self.gen.integers(0, 1 << 53) + 0.5) * 2.0**-53


def _draw(lat, log_p, log_rest, arcs, word, t, barred, gumbel, rng) -> _Sample:
    """The sample of a path that left its parent at place t, with ``barred`` arcs there besides its own."""
    s = _Sample()
    s.arcs, s.word, s.gumbel = arcs, word, gumbel
    own = log_p[arcs]
    s.before = np.cumsum(own) - own
    s.total = float(s.before[-1] + own[-1]) if len(arcs) else 0.0
    rest = log_rest[arcs].copy()
    s.barred_at = {t: (*barred, int(arcs[t]))}
    if barred:
        left = 1.0 - sum(float(lat.p[x]) for x in s.barred_at[t])
        others = int(lat.count[lat.origin[arcs[t]]]) - len(barred) - 1
        rest[t] = math.log(left) if left > 1e-15 and others > 0 else -math.inf
    mass = s.before + rest
    e = -np.log(rng.gen.random(len(arcs) - t) * (1 - 2.0**-53) + 2.0**-54)
    s.bounds = np.full(len(arcs), -np.inf)
    live = np.flatnonzero(mass[t:] > -np.inf) + t
    s.bounds[live] = -np.logaddexp(-gumbel, np.log(e[live - t]) - mass[live])
    return s


def _leave(lat, s: _Sample, t: int, rng) -> tuple[tuple, int]:
    """How the region that leaves ``s`` at place t is opened: the arcs barred there, and the arc taken."""
    barred = s.barred_at.get(t, (int(s.arcs[t]),))
    s.bounds[t] = -np.inf  # what is left of the region belongs to the new path
    node = int(lat.origin[s.arcs[t]])
    choice = [a for a in range(int(lat.first[node]), int(lat.first[node]) + int(lat.count[node])) if a not in barred]
    weight = np.cumsum(lat.p[choice])
    return barred, choice[min(len(choice) - 1, int(np.searchsorted(weight, rng.uniform() * weight[-1], "right")))]


def to_ids(voc: Vocabulary, lat: Lattice, arcs: np.ndarray) -> np.ndarray:
    ids = lat.piece[arcs]
    if (ids < 0).any():
        out: list[int] = []
        for i, a in zip(ids.tolist(), arcs.tolist(), strict=True):
            out += [i] if i >= 0 else [voc.byte_id[c] for c in lat.layout[-1 - i : -1 - i + int(lat.size[a])].tolist()]
        return np.array(out, np.int64)
    return ids


SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, gumbel double, inclusion double, ids_xxh64 long, round_trip boolean, ids array<int>"


def encode(
    docs: DataFrame, k: int = 2, alpha: float = 0.5, seed: int = 0, model_file: str = MODEL, with_ids: bool = True,
    id_col: str = "doc_id", text_col: str = "text", layout: int = BATCH,
) -> DataFrame:
    """Rows of SCHEMA, up to k per input row; ids are null unless ``with_ids``.

    About ``layout`` characters are laid out at once: more share more words, fewer take less of a
    worker's memory. The rows don't depend on it.
    """

    def run(batches):
        voc = vocabulary(model_file)
        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= layout:
                    yield _encoded(voc, ids, texts, k, alpha, seed, with_ids)
                    ids, texts, size = [], [], 0
            if ids:
                yield _encoded(voc, ids, texts, k, alpha, seed, with_ids)

    return id_text(docs, id_col, text_col).mapInArrow(released(run), SCHEMA)


def _encoded(voc, docs, texts, k, alpha, seed, with_ids) -> pa.RecordBatch:
    keys = [0 if d is None else d for d in docs]
    lat, found = sample_batch(voc, keys, texts, k, alpha, seed)
    cols: list[list] = [[] for _ in range(9)]
    for doc, text, samples in zip(docs, texts, found, strict=True):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for rank, (arcs, total, gumbel, inclusion) in enumerate(samples):
            ids = to_ids(voc, lat, arcs).astype(np.int32)
            back = voc.spelled(ids)
            digest = xxhash.xxh64_intdigest(ids.astype("<i4").tobytes())
            row = (doc, rank, len(ids), total, gumbel, inclusion, digest - (1 << 64) * (digest >> 63), np.array_equal(back[1:], data), ids if with_ids else None)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def decode(rows: DataFrame, ids_col: str = "ids", model_file: str = MODEL, to: str = "decoded") -> DataFrame:
    """The rows with a column ``to``, the text of their ids (null for null ids); a column of that name is an error."""
    if to in rows.columns:
        raise ValueError(f"the rows have a column {to!r} already; name another one")

    def run(batches):
        voc = vocabulary(model_file)
        for b in batches:
            texts = [None if x is None else voc.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, to])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(to, StringType())]))
