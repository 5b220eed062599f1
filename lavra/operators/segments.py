"""Addressable segment rows, ids, prefixes and text conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hierarchy

# The id token of each rendering and whether section numbers go on after what stands before them; legal ids.
TOKENS = {"generico": ("agr", True), "generico-aninhado": ("agh", False)}
ID = r"^[A-Za-z_][A-Za-z0-9_.-]*$"
ROW = "struct<id:string,kind:string,level:int,label:string,heading:string,breadcrumb:array<string>,paras:array<struct<text:string,quoted:boolean>>,path:array<int>>"


def is_legal_id(ident: Column) -> Column:
    return ident.rlike(ID)


def segment_id(path: Column, emitter: str = "generico", start: Column | None = None, root: Column | str = "pp1") -> Column:
    """``pp1_agrN_agrM``: one token per step of the path; the first step is moved on by ``start``."""
    root = F.lit(root) if isinstance(root, str) else root
    token, goes_on = TOKENS[emitter]
    moved = F.lit(0) if start is None or not goes_on else start
    steps = F.transform(path, lambda p, i: F.concat(F.lit(f"_{token}"), (p + F.when(i == 0, moved).otherwise(0)).cast("string")))
    return F.concat(root, F.array_join(steps, ""))


def id_faults(ids: Column) -> Column:
    """Why ids can't be published together: each one that isn't legal or comes more than once; empty if they can."""
    bad = F.transform(F.filter(F.array_distinct(ids), lambda i: ~is_legal_id(i)), lambda i: F.concat(F.lit("not a legal id: "), i))
    order = F.array_sort(ids)
    again = F.zip_with(F.slice(order, F.lit(2), F.size(order)), order, lambda b, a: F.when(b == a, a))  # one longer: the last is null
    return F.concat(bad, F.transform(F.array_distinct(F.filter(again, lambda i: i.isNotNull())), lambda i: F.concat(F.lit("duplicate id: "), i)))


def named_rows(runs: Column, token: str, root: Column | str = "pp1") -> Column:
    """A row for each of array<struct<name, lines>>, which takes the ordinals of ``token`` below the root from 1 on."""
    root, none = F.lit(root) if isinstance(root, str) else root, F.lit(None).cast("string")
    return F.transform(runs, lambda r, i: F.struct(
        F.concat(root, F.lit(f"_{token}"), (i + 1).cast("string")).alias("id"), r["name"].alias("kind"), F.lit(0).alias("level"), none.alias("label"), none.alias("heading"),
        F.array().cast("array<string>").alias("breadcrumb"), F.transform(r["lines"], lambda t: F.struct(t.alias("text"), F.lit(False).alias("quoted"))).alias("paras"), F.array().cast("array<int>").alias("path"),
    ).cast(ROW))


def laid_out(outlined: DataFrame, emitter: str = "generico", reserved: Column | None = None, root: Column | str = "pp1") -> DataFrame:
    """Adds ``rows`` (array of ROW, in reading order): what stands before the first section, then every section.

    A flat document is one row that holds all its text. No join: a section's paragraphs are the blocks up to the next header.
    Ids are given out below ``root`` by token in reading order; the first ``reserved`` ordinals of ``agr`` are taken already.
    """
    reserved = F.lit(0) if reserved is None else reserved
    at_root = F.lit(root) if isinstance(root, str) else root
    hs = F.when(F.col("flat"), F.slice("hs", 1, 0)).otherwise(F.col("hs"))
    out = outlined.withColumn("hs", hs)
    size = F.size("blocks")
    lead = hierarchy.paragraphs(F.slice("blocks", F.lit(1), F.coalesce(F.try_element_at("hs", F.lit(1))["pos"], size)))
    out = out.withColumn("lead", lead)
    start = reserved + F.when(F.size("lead") > 0, 1).otherwise(0)
    none = F.lit(None).cast("string")
    first = F.struct(
        F.concat(at_root, F.lit("_agr"), (reserved + 1).cast("string")).alias("id"), F.lit("texto").alias("kind"), F.lit(0).alias("level"), none.alias("label"), none.alias("heading"),
        F.array().cast("array<string>").alias("breadcrumb"), F.col("lead").alias("paras"), F.array().cast("array<int>").alias("path"),
    )

    def row(h: Column, i: Column) -> Column:
        until = F.coalesce(F.try_element_at("hs", i + 2)["pos"], size)
        return F.struct(
            segment_id(h["path"], emitter, start, at_root).alias("id"), h["kind"].alias("kind"), h["depth"].alias("level"), h["label"].alias("label"), h["heading"].alias("heading"),
            h["breadcrumb"].alias("breadcrumb"), hierarchy.own_text(h, until, F.col("blocks")).alias("paras"), h["path"].alias("path"),
        )

    rows = F.concat(F.when(F.size("lead") > 0, F.array(first.cast(ROW))).otherwise(F.array().cast(f"array<{ROW}>")), F.transform("hs", row).cast(f"array<{ROW}>"))
    return out.withColumn("rows", rows).drop("lead")


def segments(outlined: DataFrame, urn: Column, emitter: str = "generico") -> DataFrame:
    """One row per section with its own text, and one for what stands before the first section; no document is left out."""
    rows = laid_out(outlined, emitter).select("doc_id", F.posexplode_outer("rows").alias("order", "r")).where("r is not null")  # a plain explode would test the size of rows first, and so make them twice
    return rows.select(
        "doc_id", "r.id", "r.kind", "r.level", "r.label", "r.heading", "r.breadcrumb", F.array_join("r.paras.text", " ").alias("text"), "r.path", "order",
    ).withColumn("urn", F.concat(urn, F.lit("!"), F.col("id")))


def prefixes(ident: Column) -> Column:
    """Every proper prefix of an id, cut at its underscores, shortest first."""
    parts = F.split(ident, "_")
    return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))


def missing_prefixes(ids: DataFrame, root: str = "pp1") -> DataFrame:
    """doc_id, prefix: proper prefixes below the root that no row has as its id."""
    inside = ids.where(F.col("id").startswith(f"{root}_"))
    wanted = inside.select("doc_id", F.explode(prefixes(F.col("id"))).alias("id")).where(F.length("id") > len(root)).distinct()
    return wanted.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti").withColumnRenamed("id", "prefix")


def parents(ids: DataFrame) -> DataFrame:
    """doc_id, id, parent: the longest proper prefix that is itself an id; null for roots."""
    known = ids.select("doc_id", "id").distinct()
    steps = known.select("doc_id", "id", F.explode(prefixes(F.col("id"))).alias("prefix"))
    found = steps.join(known.select("doc_id", F.col("id").alias("prefix")), ["doc_id", "prefix"]).groupBy("doc_id", "id").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return known.join(found, ["doc_id", "id"], "left")


def ordinals(rows: DataFrame, *within: str, by: str = "idx") -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*within).orderBy(by)).cast("long"))


def word_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, word, surplus (copies in left minus copies in right), where they differ.

    Both sides add up in one aggregation, so no join and no row per copy is needed.
    """

    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select("doc_id", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word"), F.lit(sign).alias("n"))

    return counted(left, 1).union(counted(right, -1)).groupBy("doc_id", "word").agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def usable_references(refs: Column, length: Column) -> Column:
    """References inside the text, by start and then longest first, each one that doesn't reach into a kept one."""
    kept = F.filter(refs, lambda r: (F.coalesce(r["urn"], F.lit("")) != "") & (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= length))
    ranked = F.array_sort(F.transform(kept, lambda r: F.struct(r["start"].alias("start"), (-r["end"]).alias("neg"), r["urn"].alias("urn"))))
    empty = F.array().cast("array<struct<start:int,neg:int,urn:string>>")
    folded = F.aggregate(
        ranked, F.struct(F.lit(0).alias("reach"), empty.alias("out")),
        lambda a, r: F.when(r["start"] >= a["reach"], F.struct((-r["neg"]).alias("reach"), F.concat(a["out"], F.array(r)).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return F.transform(folded, lambda r: F.struct(r["start"].alias("start"), (-r["neg"]).alias("end"), r["urn"].alias("urn")))


def csv_columns(rows: DataFrame) -> DataFrame:
    """The columns of the CSV sink."""
    return rows.select(
        F.col("kind").alias("Tipo"), F.col("level").alias("Nivel"), F.coalesce("heading", F.lit("")).alias("Rotulo"),
        F.concat_ws(" | ", F.filter("breadcrumb", lambda x: x != "")).alias("Breadcrumb"), F.col("text").alias("Texto"), "urn",
    )
