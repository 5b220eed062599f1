"""Marked-up paragraph text as XML, and the warnings about a document, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let
from .segments import usable_references

# Marks from the outermost in, the warning codes in order, and the confidence below which one is given.
MARKS = (("bold", "b"), ("italic", "i"), ("sup", "sup"), ("sub", "sub"))
WARNINGS = ("empty_document", "incomplete_urn", "flat_fallback", "low_confidence", "statutory_fallback", "annexes_not_written", "invalid_output")
LOW_CONFIDENCE = 0.60


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _link(tag: str, target: Column) -> Column:
    return F.concat(F.lit(f'<{tag} xlink:href="'), F.replace(escaped(target), F.lit('"'), F.lit("&quot;")), F.lit('">'))


def _marked(p: Column) -> Column:
    out = escaped(p["text"])
    for name, tag in reversed(MARKS):
        out = F.when(F.coalesce(p[name], F.lit(False)), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return F.when(p["href"].isNotNull() & p["urn"].isNull(), F.concat(_link("a", p["href"]), out, F.lit("</a>"))).otherwise(out)


def pieces(runs: Column, references: Column) -> Column:
    """The runs cut where a reference starts or ends, each piece with the urn of the reference over it.

    References are first cut down to those inside the text that don't overlap.
    """

    def made(refs: Column) -> Column:
        def of(run: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, r: a + F.length(r["text"]))
            return let(start, lambda s: cut(run, s, s + F.length(run["text"])))

        def cut(run: Column, s: Column, e: Column) -> Column:
            ends = F.flatten(F.transform(refs, lambda r: F.array(r["start"], r["end"])))
            places = F.array_sort(F.array_distinct(F.concat(F.array(s, e), F.filter(ends, lambda x: (x > s) & (x < e)))))
            return let(places, lambda at: F.transform(F.slice(at, F.lit(2), F.size(at)), lambda hi, k: piece(run, s, F.get(at, k), hi)))

        def piece(run: Column, s: Column, lo: Column, hi: Column) -> Column:
            over = F.filter(refs, lambda r: (r["start"] <= lo) & (r["end"] >= hi))
            marks = [run[name].alias(name) for name, _ in MARKS]
            return F.struct(F.substr(run["text"], lo - s + 1, hi - lo).alias("text"), *marks, F.nullif(run["href"], F.lit("")).alias("href"), F.get(over, F.lit(0))["urn"].alias("urn"))

        return F.filter(F.flatten(F.transform(runs, of)), lambda p: p["text"] != "")

    whole = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r["text"]))
    return let(usable_references(references, whole), made)


def render_inlines(runs: Column, references: Column | None = None) -> Column:
    """XML of array<struct<text,bold,italic,sup,sub,href>>: link, reference, bold, italic, raised, lowered, from the outside in.

    Neighbouring pieces under one reference share its element, unless their hyperlinks differ.
    """
    none = F.array().cast("array<struct<start:int,end:int,urn:string>>")

    def step(a: Column, p: Column) -> Column:
        change = ~p["urn"].eqNullSafe(a["urn"]) | (p["urn"].isNotNull() & ~p["href"].eqNullSafe(a["href"]))
        opened = F.when(p["urn"].isNull(), "").otherwise(F.concat(F.coalesce(_link("a", p["href"]), F.lit("")), _link("Remissao", p["urn"])))
        closing = F.when(p["urn"].isNull(), "").when(p["href"].isNull(), "</Remissao>").otherwise("</Remissao></a>")
        return F.struct(
            F.concat(a["out"], F.when(change, F.concat(a["closing"], opened)).otherwise(""), _marked(p)).alias("out"), p["urn"].alias("urn"),
            F.when(change, p["href"]).otherwise(a["href"]).alias("href"), F.when(change, closing).otherwise(a["closing"]).alias("closing"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("urn"), F.lit(None).cast("string").alias("href"), F.lit("").alias("closing"))
    return F.aggregate(pieces(runs, none if references is None else references), start, step, lambda a: F.concat(a["out"], a["closing"]))


def warnings(
    n_blocks: Column, complete: Column, flat: Column, confidence: Column, wanted: Column, emitter: Column, n_annexes: Column, wrote_annexes: Column, valid: Column
) -> Column:
    """The codes that hold for a document, in order; a null input says nothing."""
    holds = (n_blocks == 0, ~complete, flat, confidence < LOW_CONFIDENCE, (wanted == "norma") & (emitter != "norma"), (n_annexes > 0) & ~wrote_annexes, ~valid)
    return F.array_compact(F.array(*[F.when(test, code) for code, test in zip(WARNINGS, holds, strict=True)]))
