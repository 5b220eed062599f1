"""Where outside answers come in: a referee's verdicts and a linker's references, both as cached tables.

Nothing here calls out. A table of answers is joined by key; without one nothing is consulted and no result changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, truncated

# The questions a referee knows, and how much of a paragraph and its context it is shown.
QUESTIONS = ("heading", "own_articulation", "route", "quotation_boundary")
EXCERPT, CONTEXT, NOTHING = 1200, 600, "(nenhum)"
REFERENCES = "array<struct<start:int,end:int,urn:string>>"


def prompt(template: str, excerpt: Column, before: Column, after: Column) -> Column:
    """The template with {excerpt}, {ctx} and {next} filled in, each cut to its length."""
    def shown(x: Column, limit: int) -> Column:
        return F.coalesce(F.nullif(truncated(x, limit), F.lit("")), F.lit(NOTHING))

    out = F.lit(template)
    for name, value in (("{excerpt}", F.coalesce(truncated(excerpt, EXCERPT), F.lit(""))), ("{ctx}", shown(before, CONTEXT)), ("{next}", shown(after, CONTEXT))):
        out = F.replace(out, F.lit(name), value)
    return out


def question_key(model: Column, kind: Column, excerpt: Column, before: Column, after: Column | None = None) -> Column:
    """The key an answer is filed under; the following paragraph counts only where it was shown."""
    return cache_key(model, kind, excerpt, before, *([] if after is None else [after]))


def verdicts(questions: DataFrame, answers: DataFrame | None) -> DataFrame:
    """The questions (with ``key``) and verdict, confidence; null where no answer is filed, or there is no referee."""
    if answers is None:
        return questions.withColumn("verdict", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    return questions.join(answers.select("key", "verdict", "confidence").dropDuplicates(["key"]), "key", "left")


def link_key(context_urn: Column, text: Column) -> Column:
    return cache_key(context_urn, text)


def linked(paragraphs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """doc_id, context_urn, text, ... with ``refs`` and ``link_status``: off, miss (nothing filed), none (filed as empty) or hit.

    ``answers``: key, refs. References that don't name their stretch of the text (``text`` in the answer) are dropped.
    """
    if answers is None:
        return paragraphs.withColumn("refs", F.array().cast(REFERENCES)).withColumn("link_status", F.lit("off"))
    found = paragraphs.withColumn("key", link_key(F.col("context_urn"), F.col("text"))).join(answers.select("key", F.col("refs").alias("filed")).dropDuplicates(["key"]), "key", "left")
    true = F.filter("filed", lambda r: F.substr(F.col("text"), r["start"] + 1, r["end"] - r["start"]) == r["text"])
    refs = F.transform(true, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["urn"].alias("urn")))
    status = F.when(F.col("filed").isNull(), "miss").when(F.size("filed") == 0, "none").otherwise("hit")
    return found.withColumn("refs", F.coalesce(refs, F.array().cast(REFERENCES))).withColumn("link_status", status).drop("key", "filed")


def link_report(linked_rows: DataFrame) -> DataFrame:
    return linked_rows.groupBy("link_status").agg(F.count("*").alias("n"), F.sum(F.size("refs")).alias("n_references")).orderBy("link_status")


def merged_runs(runs: Column) -> Column:
    """Neighbouring runs of one formatting as one, empty ones dropped, blanks squeezed, the outer edges trimmed."""
    marks = ("bold", "italic", "sup", "sub", "href")
    clean = F.filter(F.transform(runs, lambda r: r.withField("text", F.regexp_replace(r["text"], r"(?U)\s+", " "))), lambda r: r["text"] != "")

    def step(a: Column, r: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        same = F.size(a) > 0
        for m in marks:
            same = same & last[m].eqNullSafe(r[m])
        joined = last.withField("text", F.regexp_replace(F.concat(last["text"], r["text"]), " {2,}", " "))
        return F.when(same, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(r)))

    merged = F.aggregate(clean, F.slice(clean, 1, 0), step)
    n = F.size(merged)
    trimmed = F.transform(merged, lambda r, i: r.withField("text", F.regexp_replace(F.regexp_replace(r["text"], F.when(i == 0, "^ +").otherwise("^(?!)"), F.lit("")), F.when(i == n - 1, " +$").otherwise("^(?!)"), F.lit(""))))
    return F.filter(trimmed, lambda r: r["text"] != "")


def split_runs(runs: Column, offset: Column) -> Column:
    """The runs from a character on; the run it falls in is cut."""
    ends = F.transform(runs, lambda r, i: F.aggregate(F.slice(runs, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x["text"])))
    cut = F.zip_with(runs, ends, lambda r, e: r.withField("text", F.substr(r["text"], F.greatest(F.lit(1), offset - e + F.length(r["text"]) + 1), F.length(r["text"]))))
    return F.filter(cut, lambda r: r["text"] != "")
