r"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, 3-word shingles with repeats,
space-joined (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if set in over
half the hashes; no words: zero. Fingerprints link at ``distance`` (3) or fewer differing
bits; a document's component is the smallest doc_id reachable.

Candidates: if two fingerprints differ in at most t bits, then for thresholds with
``sum(t_i + 1) = t + 1`` some part i differs in at most ``t_i``. The 64 bits are grouped into
parts by correlation (measured over every distinct fingerprint), so that parts are as
independent of each other as they can be; for each number of parts, dynamic programming
allocates the thresholds (-1: part unused) that minimise the estimated candidates plus
probes, from histograms over every distinct fingerprint, and the cheapest layout wins. Each
fingerprint is filed in part i under all values within ``t_i`` of its own; buckets are verified
on all 64 bits.

Scale: documents with equal fingerprints collapse first, map-side. Matrix and histograms have
fixed sizes. A bucket emits a spanning forest of its links, never all pairs, so what it
emits is linear in what it holds. A bucket over ``bucket_max`` is not compared as one: it is
filed again by the parts of its remaining bits, and so on until it fits; the last level holds
at most 2**16 distinct fingerprints by construction. Components are found on edges by rounds of
joins. Nothing that grows with the corpus reaches the driver.

Defined results: null text counts as empty, fingerprint zero, linked like any other;
repeated rows are one document; a bit set in just half the hashes is 0; very long texts are
fingerprinted whole, in pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import HOT, drop, id_text, materialize, released
from .components import components

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
WIDEST = 16  # bits of the histograms that estimate candidates
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        w = words[lo : lo + CHUNK + SHINGLE - 1]
        h = np.array([digest(s, SEED) for s in map(b" ".join, zip(w, w[1:], w[2:], strict=False))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the columns in ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *keep])

    texts = id_text(docs, id_col, text_col, *keep)
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *(texts.schema[c] for c in keep)])
    return texts.mapInArrow(released(run), schema)


def correlations(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints and the 64 x 64 matrix of bit correlations over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8)
            x = np.unpackbits(fp.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), float(n)))], ["cell", "v"]
        )

    cells = distinct.select("fp").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in cells:  # 4,097 rows
        flat[r["cell"]] = r["v"]
    n, both = int(flat[-1]), flat[:-1].reshape(BITS, BITS)
    if not n:
        return 0, np.eye(BITS)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of equal size; each grows by the bit most correlated with it."""
    free, size, out = set(range(BITS)), BITS // parts, []
    for _ in range(parts - 1):
        first = max(free, key=lambda b: (sum(corr[b, c] for c in free), -b))
        group = [first]
        free.discard(first)
        while len(group) < size:
            nxt = max(free, key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return [*out, sorted(free)]


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed into a uint64."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _masks(width: int, t: int) -> np.ndarray:
    """All values of ``width`` bits with at most t bits set."""
    out, last = [0], [0]
    for _ in range(max(t, 0)):
        last = sorted({m | 1 << k for m in last for k in range(width) if not m >> k & 1} - set(out))
        out += last
    return np.array(out, np.uint64)


def histograms(distinct: DataFrame, corr: np.ndarray, layouts: list[list[list[int]]]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of each part's first WIDEST bits, over every distinct fingerprint: 2**16 cells a part at most."""
    heads = [(a, i, part[:WIDEST]) for a, parts in enumerate(layouts) for i, part in enumerate(parts)]

    def run(batches):
        totals = [np.zeros(1 << len(h[2]), np.int64) for h in heads]
        for b in batches:
            fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for t, h in zip(totals, heads, strict=True):
                t += np.bincount(project(fp, h[2]).astype(np.int64), minlength=len(t))
        # only sums of squares are needed; they need whole counts, so cells travel and are added up
        for k, t in enumerate(totals):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(t[at])], ["k", "cell", "n"])

    pairs = (
        distinct.select("fp").mapInArrow(run, "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n"))
        .groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq")).collect()
    )
    got = {r["k"]: r["sq"] for r in pairs}
    return {(a, i): got.get(k, 0.0) for k, (a, i, _) in enumerate(heads)}


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 of least total cost; ``costs[i][t + 1]`` is part i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, tau + 1):
                u = used + t + 1
                if u <= tau + 1 and (u not in nxt or c + part[t + 1] < nxt[u][0]):
                    nxt[u] = (c + part[t + 1], [*ts, t])
        best = nxt
    return best[tau + 1]


def plan(distinct: DataFrame, tau: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The parts and thresholds to probe: [(bits, t)]."""
    n, corr = correlations(distinct)
    layouts = [group_bits(corr, m) for m in range(1, tau + 2)]
    squares = histograms(distinct, corr, layouts)
    best = None
    for a, parts in enumerate(layouts):
        costs = []
        for i, part in enumerate(parts):
            rest = max(0, len(part) - WIDEST)  # bits beyond the histogram count as independent
            row = [0.0]
            for t in range(tau + 1):
                ball = len(_masks(len(part), t)) if len(part) <= 32 or t < 3 else 43_745.0
                # a probe costs as much as handling 20 candidates; candidates shrink by the bits not measured
                row.append(n * ball * 20.0 + squares[a, i] * ball / 2.0**rest)
            costs.append(row)
        found = allocate(costs, tau)
        if best is None or found[0] < best[0]:
            best = (found[0], [(p, t) for p, t in zip(parts, found[1], strict=True) if t >= 0])
    return best[1]


def _forest(fp: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: breadth-first, each met one against the unmet."""
    n, out = len(fp), []
    if n <= 64 and not np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= tau, 1).any():
        return out
    unmet = np.arange(n)
    while len(unmet) > 1:
        queue, unmet = [unmet[0]], unmet[1:]
        while queue and len(unmet):
            i = queue.pop()
            near = np.bitwise_count(fp[unmet] ^ fp[i]) <= tau
            if near.any():
                out += [(i, j) for j in unmet[near]]
                queue += unmet[near].tolist()
                unmet = unmet[~near]
    return out


def _file(rows: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """bucket (a hash of the path of parts and values so far), fp: every fingerprint under each value it probes."""
    masks = [(k, bits, _masks(len(bits), t)) for k, (bits, t) in enumerate(parts)]

    def run(batches):
        for b in batches:
            fp = np.ascontiguousarray(b.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            path = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for k, bits, ms in masks:
                v = project(fp, bits)
                for lo in range(0, len(ms), 64):
                    m = ms[lo : lo + 64]
                    key = _mix((v[:, None] ^ m[None, :]) ^ _mix(path + np.uint64(k + 1))[:, None]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(m)).view(np.int64))], ["bucket", "fp"]
                    )

    return rows.mapInArrow(run, "bucket long, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def links(distinct: DataFrame, tau: int = DISTANCE, bucket_max: int = 20_000, levels: int = 6) -> DataFrame:
    """Edges (a, b) whose components are those of all links at ``tau`` or fewer bits.

    Two keys that hash alike only make a bucket larger; every pair is verified on all bits.
    """
    parts = plan(distinct, tau)
    rows = distinct.select(F.lit(0).cast("long").alias("bucket"), "fp")
    found = []
    for level in range(levels):
        filed = materialize(_file(rows, parts), "filed-fingerprints")
        if level:
            drop(rows)
        big = materialize(filed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_max).select("bucket"), "large-buckets")
        last = level == levels - 1 or big.isEmpty()
        found.append(materialize(_compare(filed if last else filed.join(big, "bucket", "left_anti"), tau), "links"))
        if last:
            drop(filed, big)
            break
        rows = materialize(filed.join(big, "bucket", "left_semi").distinct(), "refiled")
        drop(filed, big)
        # Within a bucket the principle holds anew for any parts: deal the bits round, so that
        # those the keys so far have fixed are spread over all parts and each level fixes a
        # quarter of what is left (16 bits, so 2**16 fingerprints, after five levels).
        dealt = np.random.default_rng(level).permutation(BITS).tolist()
        parts = [(sorted(dealt[i :: tau + 1]), 0) for i in range(tau + 1)]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _compare(filed: DataFrame, tau: int) -> DataFrame:
    def run(batches):
        key, held = None, []

        def forest():
            fp = np.unique(np.concatenate(held))
            pairs = _forest(fp, tau) if len(fp) > 1 else []
            if pairs:
                i = np.array(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[i[:, 0]].view(np.int64)), pa.array(fp[i[:, 1]].view(np.int64))], ["a", "b"]
                )

        for b in batches:
            bucket = b.column(0).to_numpy(zero_copy_only=False)
            fp = np.ascontiguousarray(b.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if bucket[lo] != key:
                    if held:
                        yield from forest()
                    key, held = bucket[lo], []
                held.append(fp[lo:hi])
        if held:
            yield from forest()

    return filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = DISTANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id, one row per input row; with ``keep`` also those columns and ``first``.

    ``first`` marks the one row that stays of each component: that of the smallest doc_id (null last), then of the
    smallest columns in ``keep``; rows equal in all of these are marked alike.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, keep), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    distinct = materialize(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(rank).alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, tau))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("stays"))
    classes = materialize(placed.select("fp", "root", "n").join(least, "root").select("fp", "n", "stays"), "fingerprint-classes")
    many = max(HOT, fps.count() / HOT)
    hot = F.broadcast(classes.where(F.col("n") >= many))  # fingerprints of a thousandth of all rows: HOT at most
    rows = fps.join(hot, "fp").unionByName(fps.join(hot, "fp", "left_anti").join(classes.where(F.col("n") < many), "fp"))
    first = [*keep, (F.col("stays") == rank).alias("first")] if keep else []
    return rows.select("doc_id", "fp", F.col("stays.doc_id").alias("component_id"), *first)
