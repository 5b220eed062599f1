"""Bounded labelled samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

HELD_OUT = 1  # rows whose crc32 of the doc_id, as text, leaves this remainder by 3 are never trained on


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, classes: int = 16, sample_mb: float = 32.0) -> DataFrame:
    """doc_id, text, y of at most ``per_class`` training rows of each label value, by a hash of the id.

    With more than ``classes`` values all of them stay, and ``classes * per_class`` is shared out among them.
    Rows beyond ``sample_mb`` of text of their class don't enter (its first row always does), so that the
    sample is bounded in bytes too. Texts are taken whole.
    Only the ids of the sample, a bounded number, are broadcast; texts aren't shuffled.
    A row labelled more than once counts with its largest label; null labels don't count.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    values = [r["y"] for r in rows.select("y").distinct().collect()]
    share = per_class if len(values) <= classes else max(1, classes * per_class // len(values))
    picked = None
    for y in sorted(values):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return id_text(docs.limit(0)).withColumn("y", F.lit(0))
    sizes = id_text(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "y", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("place"))
    left = {y: sample_mb * 1e6 * classes / max(classes, len(values)) for y in values}
    kept, first = [], set(values)
    for r in sorted(sizes.collect(), key=lambda r: (r["place"], r["doc_id"], r["size"])):  # as many rows as were picked
        left[r["y"]] -= r["size"]
        if left[r["y"]] >= 0 or r["y"] in first:
            kept.append((r["doc_id"], r["y"]))
        first.discard(r["y"])
    chosen = docs.sparkSession.createDataFrame(sorted(set(kept)), "doc_id long, y int")
    return id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")  # at most classes * per_class ids, or one of each value
