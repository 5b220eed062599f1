"""Ranked lexical search over a tiered index, exact.

The score of a document for an item is the sum, over the item's distinct terms, of the term's weight w times the
saturation ``(1000000000 * tf) div (1000 * tf + 8 * m)``, m growing with the document's length. The index keeps a
term's postings by saturation, in tiers from the highest down (``FLOORS``), with the highest saturation of each
tier; times the weight that bounds what any posting of the tier can add.

An item reads its cells (term and tier) from the highest bound down, to a level that leaves a share (``LEFT``) of its
bounds unread. Of each term, the highest unread bound is its residual. When the tenth best sum so far exceeds the sum
of the residuals, no unseen document can get in; seen ones that still could, by the residuals of the terms not seen in
them, get their unread terms looked up, and the item is done, with proof. All other items fall through to the next
level; the last one reads every cell, so each item ends exact. Long lists of frequent terms have low bounds, so they
are read last and mostly not at all but for the documents looked up.

Scale: one pass counts terms, one writes the index: a task turns its documents into segments of ``SEGMENT``
postings, one row a term, without a shuffle, so a term of every document is many rows, never one. Searching shuffles
sums by (item, document) alone and ranks by a window whose group limit leaves ten rows an item and task.
Query terms are broadcast while they are ``SMALL`` rows at most, and joined by a shuffle beyond that.

Defined results: null and empty texts have no terms and never rank. Every row is a document of its own, also if it
repeats an id or a whole row; a null id ranks after others of its score, and a repeated benchmark row is ranked each
time. Items without terms, an empty benchmark, or no documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, id_text, materialize

TOP = 10
#: Fixed by contract: what a term is, and the lower-casing of A-Z alone.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FLOORS = (750_000, 550_000, 350_000, 0)  # lowest saturation of each tier
LEFT = (0.4, 0.2, 0.08, 0.0)  # share of an item's bounds that each level leaves unread
SEGMENT = 3_000_000  # postings held by a task before it writes them
SMALL = 1_000_000  # rows that are broadcast at most

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def _terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Segment:
    """Postings of some documents, by term and tier."""

    def __init__(self, base: int):
        self.base, self.codes = base, {}
        self.term, self.tf, self.size = array("i"), array("q"), array("i")
        self.at, self.m, self.ids = [], [], []

    def add(self, number: int, doc_id: int | None, words: list[bytes], m: int) -> None:
        counts, codes = Counter(words), self.codes
        self.term.extend([codes.setdefault(w, len(codes)) for w in counts])
        self.tf.extend(counts.values())
        self.size.append(len(counts))
        self.at.append(number - self.base)
        self.m.append(m)
        self.ids.append(doc_id)

    def rows(self) -> pa.RecordBatch:
        words = sorted(self.codes)
        rank = np.empty(len(words), np.int64)
        rank[[self.codes[w] for w in words]] = np.arange(len(words))
        size, tf = np.asarray(self.size), np.asarray(self.tf)
        at, m = np.repeat(np.array(self.at, np.int32), size), np.repeat(np.array(self.m, np.int64), size)
        sat = ((1_000_000_000 * tf) // (1000 * tf + 8 * m)).astype(np.int32)
        tier = np.searchsorted(-np.array(FLOORS), -sat)
        term = rank[np.asarray(self.term)]
        order = np.lexsort((at, term))
        term, at, sat, tier = term[order], at[order], sat[order], tier[order]
        columns = [pa.array([b""] + words, pa.binary()).cast(pa.string()), pa.array([self.base] * (len(words) + 1), pa.int64())]
        names = ["term", "segment"]
        for t in range(len(FLOORS)):
            of = tier == t
            n = np.bincount(term[of], minlength=len(words))
            top = np.zeros(len(words), np.int32)
            np.maximum.at(top, term[of], sat[of])
            offsets = np.concatenate([[0, 0], np.cumsum(n)]).astype(np.int32)
            postings = pa.StructArray.from_arrays([pa.array(at[of]), pa.array(sat[of])], ["at", "sat"])
            columns += [pa.array(np.concatenate([[0], n]).astype(np.int32)), pa.array(np.concatenate([[0], top]).astype(np.int32)), pa.ListArray.from_arrays(offsets, postings)]
            names += [f"n{t}", f"top{t}", f"postings{t}"]
        documents = pa.StructArray.from_arrays([pa.array(self.at, pa.int32()), pa.array(self.ids, pa.int64())], ["at", "doc_id"])
        offsets = np.full(len(words) + 2, len(self.at), np.int32)
        offsets[0] = 0
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, documents)], [*names, "documents"])


class Index:
    """What :func:`build` has written: one row a term and segment, and the counts of the collection."""

    def __init__(self, rows: DataFrame, n_docs: int):
        self.rows, self.n_docs = rows, n_docs

    def drop(self) -> None:
        drop(self.rows)

    def documents(self) -> DataFrame:
        """doc and doc_id of all documents that have terms; their list is in the row of the empty term."""
        return self.rows.where("term = ''").select("segment", F.inline("documents")).select((F.col("segment") + F.col("at")).alias("doc"), "doc_id")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all documents, in the shared folder."""
    texts = id_text(docs, id_col, text_col)
    counted = texts.select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n")).where("n > 0")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = None
        for batch in batches:
            for number, doc_id, text in zip(batch.column("doc").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = _terms(text.as_py())
                if not words:
                    continue
                segment = segment or Segment(number)
                segment.add(number, doc_id, words, 10 + 90 * len(words) * n_docs // n_terms)
                if len(segment.term) >= SEGMENT:
                    yield segment.rows()
                    segment = None
        if segment:
            yield segment.rows()

    tiers = "".join(f", n{t} int, top{t} int, postings{t} array<struct<at: int, sat: int>>" for t in range(len(FLOORS)))
    rows = texts.withColumn("doc", F.monotonically_increasing_id()).mapInArrow(segments, f"term string, segment long{tiers}, documents array<struct<at: int, doc_id: long>>")
    return Index(materialize(rows, "tiered-index"), n_docs)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is small; it should be a written table."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _cells(index: Index, items: DataFrame) -> DataFrame:
    """item, term, tier, w, bound and level of every cell that can add to an item's sums.

    A cell's gap is what reading it takes off its term's residual; cells go by bound, highest first, and a level ends
    where the residuals that are left come to its share of all.
    """
    asked = materialize(items.select("item", F.explode("terms").alias("term")), "query-terms")
    tiers = range(len(FLOORS))
    sums = [F.sum(f"n{t}").alias(f"n{t}") for t in tiers] + [F.max(f"top{t}").alias(f"top{t}") for t in tiers]
    known = index.rows.select("term", *[c for t in tiers for c in (f"n{t}", f"top{t}")]).join(_small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(*sums)
    df = sum((F.col(f"n{t}") for t in tiers), F.lit(0))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * df + 1)))
    tops = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"top{t}").cast("long").alias("top")) for t in tiers])
    weighted = materialize(known.select("term", w.alias("w"), F.inline(tops)).select("term", "w", "tier", (F.col("w") * F.col("top")).alias("bound")).where("bound > 0"), "query-cells")
    by_bound = [F.col("bound").desc(), F.col("term"), F.col("tier")]
    whole = Window.partitionBy("item")
    before = whole.orderBy(*by_bound).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("bound") - F.coalesce(F.lead("bound").over(Window.partitionBy("item", "term").orderBy("tier")), F.lit(0))
    out = asked.join(_small(weighted), "term").withColumn("gap", gap)
    out = out.withColumn("all", F.sum("gap").over(whole)).withColumn("left", F.col("all") - F.coalesce(F.sum("gap").over(before), F.lit(0)))
    level = sum(((F.col("left") <= F.col("all") * share).cast("int") for share in LEFT), F.lit(0))
    cells = materialize(out.select("item", "term", "tier", "w", "bound", level.alias("level")), "item-cells")
    drop(asked, weighted)
    return cells


def _postings(index: Index, reads: DataFrame, *columns: str) -> DataFrame:
    """tier, doc, sat and ``columns`` of ``reads`` (tier and those) for all postings of each read cell; a scan reads one tier."""
    found = []
    for t in range(len(FLOORS)):
        rows = index.rows.where(f"n{t} > 0").select("term", "segment", F.col(f"postings{t}").alias("postings"))
        rows = rows.join(_small(reads.where(F.col("tier") == t).drop("tier")), "term").select(*columns, "segment", F.inline("postings"))
        found.append(rows.select(*columns, F.lit(t).alias("tier"), (F.col("segment") + F.col("at")).alias("doc"), "sat"))
    return reduce(DataFrame.unionAll, found)


def _best(sums: DataFrame, top: int, *order: Column) -> DataFrame:
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def _looked_up(index: Index, unread: DataFrame, wanted: DataFrame) -> DataFrame:
    """item, doc and what each unread cell adds to the document's sum, for the wanted pairs of item and document."""
    cells = materialize(unread.select("term", "tier", "w").distinct(), "unread-cells")
    docs = materialize(wanted.select("doc").distinct(), "wanted-documents")
    found = _postings(index, cells, "term", "w").join(_small(docs), "doc", "left_semi")
    each = found.join(wanted, "doc").join(unread.select("item", "term", "tier"), ["item", "term", "tier"])
    out = materialize(each.select("item", "doc", (F.col("w") * F.col("sat")).alias("low")), "looked-up")
    drop(cells, docs)
    return out


def _level(index: Index, cells: DataFrame, level: int, top: int) -> tuple[DataFrame, DataFrame]:
    """The items that the cells up to ``level`` prove, and (item, doc, score) of all documents that can rank for them."""
    residual = F.max(F.when(F.col("level") > level, F.col("bound")))
    terms = materialize(cells.groupBy("item", "term").agg(F.coalesce(residual, F.lit(0)).alias("residual")), "residuals")
    reads = materialize(cells.where(F.col("level") <= level).join(terms, ["item", "term"]).select("item", "term", "tier", "w", "residual"), "reads")
    sums = _postings(index, reads, "item", "w", "residual").groupBy("item", "doc").agg(F.sum(F.col("w") * F.col("sat")).alias("low"), F.sum("residual").alias("seen"))
    sums = materialize(sums, "partial-scores")
    least = _best(sums, top, F.col("low").desc()).groupBy("item").agg(F.when(F.count("*") == top, F.min("low")).alias("least"))
    proof = terms.groupBy("item").agg(F.sum("residual").alias("unseen")).join(least, "item", "left").where("unseen = 0 OR unseen < least")
    proven = materialize(proof.select("item", "unseen", F.coalesce("least", F.lit(0)).alias("least")), "proven")
    can = sums.join(_small(proven), "item").where("low + unseen - seen >= least")
    can = materialize(can.select("item", "doc", "low", (F.col("unseen") > F.col("seen")).alias("open")), "candidates")
    drop(sums, reads, terms)
    wanted = can.where("open").select("item", "doc")
    if wanted.isEmpty():
        return proven, can.select("item", "doc", F.col("low").alias("score"))
    more = _looked_up(index, cells.where(F.col("level") > level).join(_small(proven), "item", "left_semi"), wanted)
    scores = materialize(can.select("item", "doc", "low").unionAll(more).groupBy("item", "doc").agg(F.sum("low").alias("score")), "scores")
    drop(can, more)
    return proven, scores


def search(index: Index, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents with a score above 0; ties by doc_id."""
    folded = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))
    asked = materialize(items.select(F.col(id_col).alias("item_id"), terms.alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    cells, scores = _cells(index, asked), []
    for level in range(len(LEFT)):
        proven, found = _level(index, cells, level, top)
        scores.append(found)
        left = materialize(cells.join(_small(proven), "item", "left_anti"), "unproven-cells")
        drop(cells, proven)
        cells = left
        if cells.isEmpty():
            break
    drop(cells)
    all_scores = materialize(reduce(DataFrame.unionAll, scores).where("score > 0"), "all-scores")
    drop(*scores)
    named = index.documents().join(_small(all_scores), "doc")
    best = _best(named, top, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("doc"))
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
