"""Training-data pipeline: quality, exact dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. A stage works on everything its predecessor kept. Decisions name rows by
a 128-bit hash of all their columns, not by doc_id: of rows equal in every column one stays, rows
without an id or with one id and different texts are decided each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import decontaminate, exact_dedup, pieces, quality, shingles, simhash
from lavra.llm.common import documents, drop, flagged, free_shuffles, materialize, release, row_key, written

ROW = "lavra_row"  # the column of the row's hash; no input table has it


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, row_key(docs))


def _settled(docs: DataFrame, fate: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``fate`` (hash, stays: a row for every row of ``docs``) lets go, rows equal in every column once.

    Only rows that go or repeat need looking up: what a bitmap of their hashes points to is shuffled, every other text stays where it is.
    """
    odd = fate.groupBy(ROW).agg(F.bool_or("stays").alias("lavra_stays"), F.count("*").alias("n")).where("not lavra_stays or n > 1")
    odd = materialize(odd.select(ROW, "lavra_stays"), "odd-rows")
    marked = flagged(_keyed(docs), F.xxhash64(ROW), odd.select(F.xxhash64(ROW).alias("k")), odd.count())
    rest = marked.where("lavra_flagged").dropDuplicates([ROW]).join(odd, ROW, "left").where("lavra_stays is null or lavra_stays")
    return marked.where("not lavra_flagged").select(*docs.columns).union(rest.select(*docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier doesn't reject.

    Null and empty texts have no tokens and are judged by a score of 0, like any other; a probability of
    exactly one half is kept; repeated rows all stay or all go; without labels of two grades, or an empty
    table, everything stays. Held-out rows are judged like the others.
    """
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, blanks aside, the row that stays: most code points, then smallest doc_id (null last), then row hash.

    Null counts as empty, so all empty texts are one; a row repeated in every column is one; an empty table stays empty.
    """
    return _settled(docs, exact_dedup.exact_dedup(_keyed(docs), keep=(ROW,)).select(ROW, F.col("kept").alias("stays")))


def one_of_each_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last), then row hash.

    First SimHash: fingerprints (op 5's: three words, 3 bits) link and one row of each component goes on. What
    fingerprints can't reach is linked by the exact check: five-word shingle sets of Jaccard similarity 0.8 or more.
    Null counts as empty; empty texts link to each other by their fingerprint; repeated rows are one; an empty
    table stays empty.
    """
    placed = materialize(simhash.near_duplicates(_keyed(docs), keep=(ROW,)).select("doc_id", ROW, F.col("first").alias("stays")), "placed-rows")
    free_shuffles(spark)
    first = placed.where("stays").select("doc_id", ROW).distinct()
    salt = 0
    while True:  # rows as longs; anew with another salt should two of them ever share one
        node = F.xxhash64(F.lit(salt), F.col(ROW))
        nodes = first.withColumn("node", node)
        if nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        salt += 1
    linked = shingles.near_copies(_keyed(_settled(docs, placed)).withColumn("node", node), id_col="node")
    linked = linked.select(F.col("doc_id").alias("node"), "component_id")
    members = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("component_id", "node"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    stay = members.groupBy("root").agg(F.min_by(ROW, rank).alias(ROW)).select(ROW, F.lit(True).alias("chosen"))
    out = _settled(docs, placed.join(stay, ROW, "left").select(ROW, F.coalesce("chosen", F.lit(False)).alias("stays")))
    drop(placed)
    free_shuffles(spark)
    return out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows all stay or all go; an empty benchmark removes nothing.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, sampled without replacement: doc_id, sample, piece ids, score, inclusion and whether they decode to the text.

    Null counts as empty, which has one segmentation without pieces; rows that repeat a doc_id draw alike; an empty
    table gives no rows.
    """
    return pieces.encode(docs, k=2, alpha=0.5, layout=1 << 19).select("doc_id", "sample", "n_pieces", "log_prob", "inclusion", "round_trip", "ids")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", one_of_each_text),
    ("near_dedup", one_of_each_component),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]

#: SQL has no way to express the fitted classifier, XXH64 fingerprints or sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written besides its result is deleted once that is stored.

    Tables that were there before the run stay: results built on them may still be waiting to be stored.
    """
    docs, before = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=(docs,), before=before)
    return STAGES[-1][1](spark, docs, sf_dir)
