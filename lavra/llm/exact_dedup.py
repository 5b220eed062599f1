"""Exact dedup over an extendible-hash index on shared files (DataFrame operations only).

The index is a log of entries (doc_id, 64-bit key, SHA-256, length) written once to the
shared folder. A directory of ``2**depth`` slots over the leading key bits is grown on the
driver from a slot histogram of bounded size: a bucket holding more than ``capacity``
repeated entries is split and, where its local depth has reached the global one, the
directory doubles. Buckets own contiguous key ranges.

Texts whose key is met twice travel, once per map task however many copies it holds: copies
collapse by their bytes before the shuffle. Each bucket is then dealt whole to one owner task, which
lays its texts in key order and chains those that share a key; an entry of a chain is a text unlike
the one before it, byte by byte. Entries are the classes: their copies were counted and their
best row chosen by bytes, and log entries find theirs by (key, SHA-256). A key that two texts share
makes a chain of two, nothing else; two texts of one chain that also shared a SHA-256 would be refused.

Which texts travel is told by a bitmap over the key, sized from the number of repeated keys up to
``FLAG_WORDS_MOST`` words (4 MB); beyond that more texts travel than need to, with the same result.
Classes that hold a thousandth of all rows, a thousand at most, are broadcast to the log, so that a
text in a third of all rows meets no single task.

Defined results: null text counts as empty; texts are equal when identical once every
character of ``[\\x20\\x09-\\x0D]`` is gone; of equal texts the one with the most code points
in the original, then the smallest doc_id (null last), then the largest of the columns in ``keep``
stays; repeated rows are members of their group like any other; very long texts are handled whole;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, id_text, materialize

BLANK = r"[\x20\x09-\x0D]+"
FLAG_WORDS_LEAST, FLAG_WORDS_MOST = 10, 18  # log2 of the number of 64-bit words in the bitmap


def normalized(text="text"):
    return F.regexp_replace(F.col(text), BLANK, "")


def grow_directory(histogram: dict[int, int], max_depth: int, capacity: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Extendible hashing: (global depth, [(first slot, end slot, local depth)]).

    ``histogram`` counts entries per slot of ``max_depth`` leading bits. Starts with one
    bucket; overfull buckets split until they fit or a slot can't be split further.
    """
    size = 1 << max_depth
    ends = [0] * (size + 1)
    for i in range(size):
        ends[i + 1] = ends[i] + histogram.get(i, 0)
    depth, done, todo = 0, [], [(0, size, 0)]
    while todo:
        lo, hi, local = todo.pop()
        if ends[hi] - ends[lo] > capacity and local < max_depth:
            depth = max(depth, local + 1)  # the directory doubles when local exceeds global
            mid = (lo + hi) // 2
            todo += [(mid, hi, local + 1), (lo, mid, local + 1)]
        else:
            done.append((lo, hi, local))
    return depth, sorted(done)


def _slot(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("key"), 64 - bits)


def _bit(words: int) -> str:
    """Which bit of its word a key has, after the ``words`` leading bits that name the word."""
    return f"cast(shiftrightunsigned(key, {58 - words}) & 63 as int)"


def _flagged(keyed: DataFrame, repeated: DataFrame, many: int) -> DataFrame:
    """The rows whose key may be a repeated one (all that are, and a few more)."""
    words = min(FLAG_WORDS_MOST, max(FLAG_WORDS_LEAST, (many // 8).bit_length()))
    flags = repeated.groupBy(_slot(words).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {_bit(words)})")).alias("bits"))
    joined = keyed.withColumn("word", _slot(words)).join(F.broadcast(flags), "word")  # 2**words rows of 16 bytes at most
    return joined.where(F.expr(f"(shiftrightunsigned(bits, {_bit(words)}) & 1) = 1")).drop("word", "bits")


def chains(owned: DataFrame) -> DataFrame:
    """Adds ``place`` to the distinct texts of an owner's buckets: which entry of its key's chain a text is.

    Texts come in key order; a text opens an entry if its bytes differ from those before it.
    """
    along = Window.partitionBy("bucket", "key").orderBy("norm")
    opens = ~F.col("norm").eqNullSafe(F.lag("norm").over(along))
    return owned.withColumn("opens", opens.cast("int")).withColumn("place", F.sum("opens").over(along)).drop("opens")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 20_000,
    max_depth: int = 14,
    keep: tuple[str, ...] = (),
    key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the columns in ``keep``.

    ``capacity`` is the number of repeated entries a bucket holds before it splits; ``max_depth``
    bounds the directory (``2**max_depth`` slots reach the driver). With ``keep`` at most one row of a
    group is kept per value of those columns, which then decide among equals. ``key`` gives the 64-bit key.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col, *keep)
    order = F.struct(
        F.length("text").cast("long").alias("points"), F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("neg"),
        *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    keyed = texts.withColumn("norm", normalized()).withColumn("key", key(F.col("norm"))).withColumn("rank", order)
    log = materialize(keyed.select("doc_id", "key", F.sha2("norm", 256).alias("sha"), "rank", *keep), "dedup-index")
    repeated = materialize(log.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated-keys")

    slots = repeated.groupBy(_slot(max_depth).alias("slot")).agg(F.sum("n").alias("n"))
    histogram = {int(r["slot"]): int(r["n"]) for r in slots.collect()}
    _, buckets = grow_directory(histogram, max_depth, capacity)
    directory = spark.createDataFrame(
        [(slot, number) for number, (lo, hi, _) in enumerate(buckets) for slot in range(lo, hi)], "slot long, bucket int"
    )  # 2**max_depth rows
    sent = _flagged(keyed.select("key", "norm", "rank"), repeated, sum(histogram.values()))
    sent = sent.withColumn("slot", _slot(max_depth)).join(F.broadcast(directory), "slot")
    # Copies collapse by their bytes, map-side first; then every bucket goes whole to its owner.
    distinct = sent.groupBy("bucket", "key", "norm").agg(F.count("*").alias("n"), F.max("rank").alias("best"))
    owned = chains(distinct.repartition("bucket").sortWithinPartitions("bucket", "key", "norm"))
    entries = owned.select("bucket", "key", "place", F.sha2("norm", 256).alias("sha"), "n", "best")
    same = Window.partitionBy("bucket", "key", "sha")
    entries = entries.withColumn("n", F.when(F.max("place").over(same) == F.min("place").over(same), F.col("n")).otherwise(F.raise_error(F.lit("texts that differ share key and SHA-256"))))
    classes = materialize(entries.where("n > 1").select("key", "sha", "n", "best"), "dedup-classes")

    many = max(HOT, log.count() / HOT)
    hot, plain = F.broadcast(classes.where(F.col("n") >= many)), classes.where(F.col("n") < many)  # hot: HOT rows at most
    placed = log.join(hot, ["key", "sha"]).unionByName(log.join(hot, ["key", "sha"], "left_anti").join(plain, ["key", "sha"], "left"), allowMissingColumns=True)
    best = F.coalesce("best", "rank")
    return placed.select(
        "doc_id",
        (-best["neg"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (best == F.col("rank") if keep else best["neg"].eqNullSafe(F.col("rank.neg"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *keep,
    )
