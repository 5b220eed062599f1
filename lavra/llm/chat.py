"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

Chat logs are often written once per turn, each time with the whole history. A rolling hash
over the turns gives every prefix of every conversation a 128-bit value (the XOR of two
position-keyed 64-bit hashes, so that one more turn is one more XOR); a conversation whose
full value is that of a proper prefix of a longer one is a snapshot of it and goes by an
anti-join. Of identical conversations the one with the smallest conv_id stays. The maximal
ones are rendered.

Scale: texts move once, by conversation; only hashes are compared. Prefix hashes collapse
map-side before the anti-join (a first turn common to a third of all conversations is one
row per map task), and the narrow join that gives each conversation its class can be split
where one class is large. A conversation is rendered as one value, as a document is.

Defined results: rows are ordered by turn (null first), then role, then text; exact repeats
of a row inside a conversation count once; null role and null text render as empty and hash
like empty; rows without a conv_id are one conversation; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PREFIX = ["h1", "h2", "pos"]


def _turns(turns: DataFrame) -> DataFrame:
    """One row per distinct turn, with its position, the hash of the prefix it ends, and whether it is the last."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    same = F.struct("turn", "role", "text")
    rows = rows.withColumn("again", same.eqNullSafe(F.lag(same).over(w))).where("not again").drop("again")
    rows = rows.withColumn("pos", F.row_number().over(w).cast("long"))
    for name, salt in (("h1", 1), ("h2", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "pos", F.length("role"), "role", "text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("last", F.lead("pos").over(w).isNull())


def render(turns: Column) -> Column:
    """The conversation in a chat markup, one block per turn; a text can't open or close a block."""

    def guarded(x):
        return F.replace(F.replace(x, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))

    return F.concat_ws(
        "",
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), guarded(t["role"]), F.lit("\n"), guarded(t["text"]), F.lit(CLOSE + "\n"))),
    )


def collapse(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, status (kept / copy / prefix), rendered (kept only)."""
    rows = _turns(turns)
    proper = rows.where("not last").select(*PREFIX).distinct()
    ends = rows.where("last").select("conv", "conv_id", *PREFIX)
    maximal = ends.groupBy(*PREFIX).agg(F.min_by("conv", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("first")).join(proper, PREFIX, "left_anti")
    decided = ends.join(maximal, PREFIX, "left").select(
        "conv", "conv_id", F.col("pos").alias("n_turns"),
        F.when(F.col("first").isNull(), "prefix").when(F.col("first") == F.col("conv"), "kept").otherwise("copy").alias("status"),
    )
    texts = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    return texts.join(decided, "conv").select(
        "conv_id", "n_turns", "status", F.when(F.col("status") == "kept", render(F.col("turns"))).alias("rendered")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Only the maximal conversations, rendered: conv_id, n_turns, rendered."""
    return collapse(turns).where("status = 'kept'").select("conv_id", "n_turns", "rendered")
