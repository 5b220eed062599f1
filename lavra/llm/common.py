"""Helpers shared by the corpus operators: shared-folder tables and input hygiene."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 1_000  # a value that holds one row of so many is hot; there can't be more of them than this
FLAG_WORDS_LEAST, FLAG_WORDS_MOST = 10, 18  # log2 of the number of 64-bit words in a bitmap of keys


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Only in a local session without the setting (as in tests) is a folder of this machine used,
    and it is then set as the checkpoint folder too; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="lavra-checkpoint-")
            spark.sparkContext.setCheckpointDir(found)
        path = found
    return path.rstrip("/")


_written: list[str] = []  # tables of this process that still exist


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Cuts the lineage; the files outlive any executor. They go by :func:`drop` or :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(schema).parquet(path)
    out._lavra_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_lavra_path", None)
        if path in _written:
            _delete(t.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do puts off for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def released(run):
    """``run`` over a task's batches, after which freed memory goes back to the system.

    Workers are kept for the tasks to come, and what their allocators hold on to would be lost to those.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return wrapped


def written() -> frozenset[str]:
    """The tables of this process that exist now."""
    return frozenset(_written)


def release(spark: SparkSession, keep: tuple[DataFrame, ...] = (), before: frozenset[str] = frozenset()) -> None:
    """Delete every table this process has materialized but ``keep``; results read from them must be stored by then.

    Those in ``before`` (see :func:`written`) belong to others, whose results may not be stored yet, and stay.
    """
    kept = {getattr(t, "_lavra_path", None) for t in keep} | before
    for path in [p for p in _written if p not in kept]:
        _delete(spark, path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the identifier and the text, null text as the empty one, and the columns named in ``more``.

    Dropping all other columns first makes any extra or clashing name harmless.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def row_key(docs: DataFrame) -> Column:
    """128 bits of hash over all columns, so that a decision names a row, not an id that others may share.

    Rows with one key are equal in every column, so which of them stays makes no difference.
    """
    cols = [c for name in docs.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(salt), *cols)), 16, "0") for salt in (1, 2)])


def flagged(rows: DataFrame, key: Column, keys: DataFrame, many: int, name: str = "lavra_flagged") -> DataFrame:
    """Adds ``name``: whether ``key`` may be among ``keys``, about ``many`` longs in one column. It is true of all that are, and of a few more.

    Told by a bitmap of at most ``2**FLAG_WORDS_MOST`` words (4 MB), broadcast; rows stay where they are. With more keys
    than that is good for more rows are flagged, so the flagged have to be looked up exactly.
    """
    words = min(FLAG_WORDS_MOST, max(FLAG_WORDS_LEAST, (many // 8).bit_length()))

    def word(k: Column) -> Column:
        return F.shiftrightunsigned(k, 64 - words)

    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k, 58 - words).bitwiseAND(F.lit(63)).cast("int"))

    k = F.col(keys.columns[0])
    bits = keys.groupBy(word(k).alias("lavra_word")).agg(F.bit_or(bit(k)).alias("lavra_bits"))
    marked = rows.withColumn("lavra_key", key).withColumn("lavra_word", word(F.col("lavra_key"))).join(F.broadcast(bits), "lavra_word", "left")
    hit = F.coalesce(F.col("lavra_bits").bitwiseAND(bit(F.col("lavra_key"))) != 0, F.lit(False))
    return marked.withColumn(name, hit).drop("lavra_key", "lavra_word", "lavra_bits")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
