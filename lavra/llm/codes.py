"""Vector codes: each vector as one codebook index a part, found by annular norm pruning.

A vector's components become integers ``floor(scale * x)`` and are cut into equal consecutive parts; each
part position has a codebook of its own, fitted by a few rounds of Lloyd's step in integers. The nearest entry
is found by norms: ``| |x| - |c| |`` never exceeds the distance of x and c, so once some entry lies at distance
r, only entries whose norm is within r of |x| can be as near. Entries are sorted by norm; the few nearest in
norm give r, two binary searches give the interval, ends included, and exactly those entries are evaluated in
integers. Norms are doubles with a margin above their rounding, so that no entry as near is ever missed.

Every round is one scan of the vectors; a task sends back one row of sums for each entry it used, so what
reaches the driver is the codebooks alone (parts x entries rows), whatever the number of vectors.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped. The dimension is
that of the first vector, by id, whose length is a positive multiple of ``parts``; kept vectors of another
length have a null code and error. Fewer vectors than entries make smaller codebooks; repeated ids seed in the
order of their components; null ids come last. Components are held within +-2**b, b being chosen so that an
error fits a long (2**27 at 64 components, that is |x| = 2**19). ``label_error`` is null beyond a long.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, drop, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
STEP = 3  # entries to each side, by norm, that are evaluated before the annulus is narrowed again
CELL_BYTES = 32 << 20  # of differences held at once by one search


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and the vector as doubles, of the rows whose vector is whole and finite."""
    out = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(F.col("vector").isNotNull() & ~bad)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``, held within the range whose errors fit a long."""
    top = 2.0 ** ((60 - max(1, vectors.shape[1] - 1).bit_length()) // 2)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -top, top).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


class Annuli:
    """One codebook with its entries by norm."""

    def __init__(self, book: np.ndarray):
        norms = _norms(book)
        self.order = np.argsort(norms, kind="stable")
        self.book, self.norms, self.evaluated = book[self.order], norms[self.order], 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row (ties: the lower index) and its squared distance."""
        step = max(1, CELL_BYTES // (8 * x.shape[1] * len(self.book)))
        found = [self._nearest(x[i : i + step]) for i in range(0, len(x), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's evaluated entries are a stretch [lo, hi) by norm, which grows by ``STEP`` to both sides as far as its annulus goes."""
        k, norms = len(self.book), _norms(x)
        lo = np.searchsorted(self.norms, norms)
        hi = lo.copy()
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
        rows, least, most = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), k)  # nothing is known yet: all entries
        while len(rows):
            below, above = np.maximum(lo[rows] - STEP, np.minimum(least, lo[rows])), np.minimum(hi[rows] + STEP, np.maximum(most, hi[rows]))
            width = above - below - (hi[rows] - lo[rows])
            at = np.repeat(np.arange(len(rows)), width)
            entry = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width) + below[at]
            entry += np.where(entry >= lo[rows[at]], hi[rows[at]] - lo[rows[at]], 0)  # those between are evaluated already
            far = ((x[rows[at]] - self.book[entry]) ** 2).sum(axis=1)
            self.evaluated += len(at)
            starts = np.cumsum(width) - width
            nearest = np.minimum.reduceat(far, starts)
            first = np.minimum.reduceat(np.where(far == nearest[at], self.order[entry], k), starts)
            index[rows] = np.where(nearest < best[rows], first, np.where(nearest == best[rows], np.minimum(first, index[rows]), index[rows]))
            best[rows] = np.minimum(nearest, best[rows])
            lo[rows], hi[rows] = below, above
            reach = np.sqrt(best[rows].astype(np.float64))
            reach += 1e-6 + 1e-12 * (norms[rows] + reach)
            least, most = np.searchsorted(self.norms, norms[rows] - reach, "left"), np.searchsorted(self.norms, norms[rows] + reach, "right")
            more = (least < below) | (most > above)
            rows, least, most = rows[more], least[more], most[more]
        return index, best


def _cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component)."""
    return vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def _read(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the dimension, and the integers of those."""
    column = batch.column("vector")
    fits = np.asarray(column.value_lengths()) == dims
    flat = column.filter(pa.array(fits)).flatten()
    return fits, integers(np.asarray(flat, dtype=np.float64).reshape(-1, dims))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) of the rows of :func:`usable`; None if no vector has a fitting length."""
    fitting = vectors.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = fitting.orderBy(*by_id).select(F.size("vector")).head()
    if first is None:
        return None
    dims = first[0]
    seeds = fitting.where(F.size("vector") == dims).orderBy(*by_id).limit(entries).collect()
    books = _cut(integers(np.array([r.vector for r in seeds], dtype=np.float64)), parts)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, k, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Annuli(b) for b in books]
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            rows = _cut(_read(batch, parts * width)[1], parts)
            for p, index in enumerate(indexes) if rows.shape[1] else ():
                at = index.nearest(rows[p])[0]
                np.add.at(total[p], at, rows[p])
                count[p] += np.bincount(at, minlength=k)
        p, e = np.nonzero(count)
        offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * width)
        lists = pa.ListArray.from_arrays(offsets, pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], ["part", "entry", "n", "sums"])

    found = vectors.select("vector").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows at most
        out[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def encode(vectors: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of the rows of :func:`usable`."""
    if books is None:
        return vectors.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    parts, _, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Annuli(b) for b in books]
        for batch in batches:
            fits, found = _read(batch, parts * width)
            rows, code, error = _cut(found, parts), np.zeros((len(found), parts), np.uint8), np.zeros(len(found), np.int64)
            for p, index in enumerate(indexes) if len(found) else ():
                code[:, p], far = index.nearest(rows[p])
                error += far
            place = pa.array(np.where(fits, np.cumsum(fits) - 1, 0), mask=~fits)
            text = pa.array([c.tobytes().hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text.take(place), pa.array(error).take(place)], ["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector each code stands for: its entries' components over ``scale``."""
    parts, _, width = books.shape

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if c is None else np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(c))]) / scale for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{n}` {t}" for n, t in codes.dtypes)
    return codes.mapInArrow(vectors, f"{fields}, vector array<double>")


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of the components in order of part, entry and place."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256, label.

    Labels with a thousandth of the rows, of which there are at most a thousand, meet their sums by
    broadcast; the others by a join on the label.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    books = train(rows, parts, entries, rounds)
    codes = materialize(encode(rows, books), "vector-codes")
    summed = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"))
    totals = materialize(summed.withColumnRenamed("label", "of"), "label-errors")
    n_rows, n_labels = totals.agg(F.sum("n"), F.count("*")).head()
    hot = F.lit(True) if n_labels <= HOT else F.col("n") >= (n_rows or 0) / HOT
    same = F.col("label").eqNullSafe(F.col("of"))
    out = codes.join(F.broadcast(totals.where(hot)), same, "left")
    if n_labels > HOT:
        cold = out.where("n is null").select(*codes.columns).join(totals.where(~hot), same)
        out = out.where("n is not null").unionByName(cold)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
