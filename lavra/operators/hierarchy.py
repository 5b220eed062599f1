"""From labelled paragraphs to a section tree.

Columns say what each paragraph could head: its form, the series it would continue, its heading.
A document is then one ordered array of blocks. Depth depends on which sections are open, which no
window expresses, so one Arrow function walks a document's candidates once and returns depth, parent,
path and breadcrumb together; confidence and all texts are array expressions on the same row. Nothing
is joined back, and the blocks are shuffled once, by document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import labels as L
from ..functions.arrow import values
from ..functions.text import fold
from . import articulation
from .profiles import profiles
from .quotation import analyse, in_order
from .regions import placed
from .reports import adjudicate
from .routing import census_counts, covered
from .seams import question_key

# Weights, limits, section kinds.
W_STYLE, W_SERIES, W_UNIT, W_SOLO, W_DECLARED = 0.9, 0.85, 0.8, 0.25, 0.8
RULE_PROSE = 0.55  # how sure the rule is that a line without label or style is no heading
SIBLING_GAP, MIN_RUN, MIN_SERIES, FULL_SECTIONS, FLAT_BELOW = 3, 4, 3, 3, 0.5
SEQUENCES = ("roman", "alpha", "compound", "ordinal")
BY_DEPTH = ("secao", "subsecao", "item")
BY_KIND = {
    "roman": "inciso", "alpha": "alinea", "compound": "alinea", "unit": "item", "capitulo": "capitulo", "secao": "secao",
    "subsecao": "subsecao", "titulo": "titulo", "livro": "livro", "parte": "parte", "ordinal": "item",
}
_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
HEADER = T.StructType([T.StructField(name, kind) for name, kind in (
    ("pos", _INT), ("idx", _LONG), ("depth", _INT), ("kind", _TEXT), ("label_kind", _TEXT), ("label", _TEXT), ("heading", _TEXT), ("rest", _TEXT),
    ("score", T.DoubleType()), ("style", _INT), ("prose", T.BooleanType()), ("parent_idx", _LONG), ("path", T.ArrayType(_INT)), ("breadcrumb", T.ArrayType(_TEXT)),
)])


# --- unit series ---------------------------------------------------------------------------

def _unit_lines(blocks: DataFrame) -> DataFrame:
    """unit_head and unit_no of ``X nº N`` lines (null on others)."""
    t = L.stripped(F.col("text"))
    head = F.regexp_replace(fold(F.regexp_extract(t, L.UNIT, 1)), r"^[ \-–—.:]+|[ \-–—.:]+$", "")
    rows = blocks.withColumn("unit_head", F.when(L.ends_in_digit(t) & t.rlike(L.UNIT), head))
    rows = rows.withColumn("unit_head", F.nullif("unit_head", F.lit("")))
    return rows.withColumn("unit_no", F.when(F.col("unit_head").isNotNull(), F.regexp_extract(t, L.UNIT, 2).try_cast("int")))


def _in_unit_series(lines: DataFrame) -> DataFrame:
    """Adds unit_lines, the length of the series a line belongs to: three lines or more, numbers strictly increasing; else null."""
    series = Window.partitionBy("doc_id", "unit_head")
    step = F.coalesce(F.col("unit_no") > F.lag("unit_no").over(series.orderBy("idx")), F.lit(True))
    rising = lines.withColumn("unit_step", step)
    n = F.count("unit_no").over(series)
    return rising.withColumn("unit_lines", F.when(F.col("unit_head").isNotNull() & (n >= MIN_SERIES) & F.min("unit_step").over(series), n)).drop("unit_step")


def unit_heads(blocks: DataFrame) -> DataFrame:
    """doc_id, head, n_lines of each unit series."""
    lines = _in_unit_series(_unit_lines(blocks).where("unit_head is not null")).where("unit_lines is not null")
    return lines.groupBy("doc_id", F.col("unit_head").alias("head")).agg(F.first("unit_lines").alias("n_lines"))


# Why a tree is flat, in the order in which one excludes the next.
EMPTY_BODY, NO_CANDIDATE, ALL_REJECTED, TOO_FEW = "empty_body_span", "no_candidate", "all_rejected", "too_few_sections"


# --- candidates ----------------------------------------------------------------------------

def candidates(analysed: DataFrame, section_patterns: tuple[str, ...] = (), units: bool = True) -> DataFrame:
    """The blocks with ``form``: how a block could head a section (null: it can't), and what the walk needs to know.

    declared: a heading the genre names, by its patterns or a column ``declared``; style: a style or outline level; top, sub: numbers of one or several
    components; series: any other label, which continues the open one of its ``series``.
    """
    rows, label = analysed, F.col("label")
    if units:
        rows = _in_unit_series(_unit_lines(rows))
        label = L.with_unit(label, F.col("text"), F.when(F.col("unit_lines").isNotNull(), F.col("unit_head")))
    folded, declared = fold(L.stripped(F.col("text"))), F.lit(False)
    for p in section_patterns:
        declared = declared | folded.rlike(p)
    if "declared" in rows.columns:
        declared = declared | F.coalesce("declared", F.lit(False))
    rows = rows.withColumn("label", label).withColumn("level", L.style_level(F.col("style"), F.col("outline_level")))
    kind, value, rest = F.col("label.kind"), F.col("label.value"), F.coalesce(L.stripped(F.col("label.rest")), F.lit(""))
    form = (
        F.when(F.col("quoted"), None).when(F.col("level").isNotNull(), "style").when(declared, "declared").when(kind.isin("artigo", "paragrafo"), None)
        .when(kind == "numeric", F.when(F.size(value) == 1, "top").otherwise("sub")).when(kind.isNotNull(), "series")
    )
    # step by step: what is written out within another expression is written as often as that names it, and
    # the JVM doesn't compile a stage whose one method is over 8,000 bytes
    rows = rows.withColumn("form", form).withColumn("rest", rest).withColumn("clean", L.stripped(F.col("text")))
    form, rest, text = F.col("form"), F.col("rest"), F.col("clean")
    series = F.when(kind == "compound", F.concat(kind, F.lit(" "), value[0].cast("string"))).when(kind == "unit", F.concat(kind, F.lit(" "), F.col("label.unit_head"))).otherwise(kind)
    whole = form.isin("style", "declared")
    named = F.when(whole, F.nullif(text, F.lit(""))).when((rest != "") & L.looks_like_heading(rest), rest)
    raw = F.when(~whole & kind.isNotNull(), F.substr(text, F.lit(1), F.length(text) - F.length(rest)))
    rows = rows.withColumns({"named": F.when(form.isNotNull(), named), "raw": raw})
    named, raw = F.col("named"), L.stripped(F.col("raw"))
    return rows.withColumn("head", F.when(form.isNotNull(), F.struct(
        kind.alias("kind"), series.alias("series"), value.alias("value"), F.col("level").alias("level"), named.alias("heading"),
        F.when(named.isNull(), F.nullif(rest, F.lit(""))).alias("rest"), raw.alias("label"), text.rlike("[0-9]").alias("numbered"),
    ))).drop("label", "level", "rest", "named", "clean", "raw")


# --- the walk ------------------------------------------------------------------------------

@dataclass
class _Walk:
    """What is known of the whole document, and what is open: by depth, the series there and the value it has come to."""

    ranks: dict[int, int]
    top_holds: bool
    lone: set[str]
    open: dict[int, tuple[str, tuple[int, ...]]] = field(default_factory=dict)
    last: int = 0

    @classmethod
    def of(cls, rows: list[dict]) -> _Walk:
        tops = [r["value"][0] for r in rows if r["form"] == "top"]
        steps = [b - a for a, b in zip(tops, tops[1:], strict=False)]
        met = Counter(r["series"] for r in rows if r["form"] == "series" and r["kind"] in SEQUENCES)
        levels = sorted({r["level"] for r in rows if r["form"] == "style"})
        holds = not tops or (len(tops) > 1 and tops[0] <= 2 and all(0 < s <= 3 for s in steps))
        return cls({v: i for i, v in enumerate(levels, 1)}, holds, {s for s, n in met.items() if n == 1})

    def deepest(self, test: Callable[[str, tuple], bool]) -> int | None:
        """The innermost depth whose series and value pass the test."""
        return max((d for d, (series, value) in self.open.items() if test(series, value)), default=None)

    def enter(self, depth: int, series: str, value: tuple[int, ...]) -> None:
        """Closes what lies at this depth or below and opens the series there."""
        self.open = {d: x for d, x in self.open.items() if d < depth} | {depth: (series, value)}
        self.last = depth


def _below(depth: int | None) -> int:
    return 1 if depth is None else depth + 1


def _declared(w: _Walk, r: dict) -> int | None:
    return _below(w.deepest(lambda series, _: series == "style"))


def _style(w: _Walk, r: dict) -> int | None:
    return w.ranks[r["level"]]


def _top(w: _Walk, r: dict) -> int | None:
    return _below(w.deepest(lambda series, _: series == "declared")) if w.top_holds else None


def _sub(w: _Walk, r: dict) -> int | None:
    above = tuple(r["value"][:-1])
    found = w.deepest(lambda series, value: series == "numeric" and value == above)
    return None if found is None else found + 1


def _series(w: _Walk, r: dict) -> int | None:
    if r["series"] in w.lone:
        return None
    found = w.deepest(lambda series, _: series == r["series"])
    if found is None:
        return min(len(w.open), w.last) + 1
    step = r["value"][-1] - w.open[found][1][-1]
    return found if 0 < step and (r["kind"] == "unit" or step <= SIBLING_GAP) else None


#: By form: the depth a candidate takes (None: it doesn't fit), and the name its series has while open.
RULES = {"declared": _declared, "style": _style, "top": _top, "sub": _sub, "series": _series}
OPENS = {"declared": "declared", "style": "style", "top": "numeric", "sub": "numeric"}


def _weight(w: _Walk, r: dict) -> float:
    if r["form"] in ("style", "declared"):
        return W_STYLE if r["form"] == "style" else W_DECLARED
    if r["kind"] == "unit":
        return W_UNIT
    return W_SOLO if r["kind"] == "ordinal" or (r["kind"] == "numeric" and not w.top_holds) else W_SERIES


def unify(rows: list[dict]) -> list[dict]:
    """A document's sections, in order: depth, kind, score and place in the tree of each candidate that fits."""
    w, out = _Walk.of(rows), []
    for r in rows:
        depth = RULES[r["form"]](w, r)
        if depth is None:
            continue
        w.enter(depth, OPENS.get(r["form"], r["series"]), tuple(r["value"] or ()))
        kind = None if r["form"] == "declared" else r["kind"]
        named = BY_DEPTH[min(depth, 3) - 1] if kind in (None, "numeric") else BY_KIND[kind] if kind in BY_KIND else "agrupamento"
        out.append({
            "pos": r["pos"], "idx": r["idx"], "depth": depth, "kind": named, "label_kind": kind, "label": r["label"], "heading": r["heading"], "rest": r["rest"],
            "score": _weight(w, r), "style": r["level"], "prose": r["form"] == "declared", "numbered": r["numbered"],
        })
    _demote(out)
    return _placed(out)


def _demote(sections: list[dict]) -> None:
    """Of a run of four or more styled headings of one depth, led by a numbered one, the unnumbered go one deeper."""
    runs = groupby([s for s in sections if not s["prose"]], key=lambda s: (s["depth"], s["style"] is not None))
    for run in [list(g) for (_, styled), g in runs if styled]:
        count = sum(s["numbered"] for s in run)
        if len(run) >= MIN_RUN and run[0]["numbered"] and 2 <= count < len(run):
            for s in run:
                if not s["numbered"]:
                    s["depth"], s["kind"] = s["depth"] + 1, "subsecao"


def _placed(sections: list[dict]) -> list[dict]:
    """Adds parent, path (ordinals from the root) and breadcrumb; the parent is the last section of smaller depth."""
    above: list[dict] = []
    children: Counter = Counter()
    for s in sections:
        above = [a for a in above if a["depth"] < s["depth"]]
        parent = above[-1] if above else None
        up = parent["idx"] if parent else None
        children[up] += 1
        s |= {"parent_idx": up, "path": [*(parent["path"] if parent else ()), children[up]], "breadcrumb": [a["heading"] or "" for a in above]}
        above.append(s)
    return sections


@F.arrow_udf(T.ArrayType(HEADER))
def _walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = to_arrow_type(T.ArrayType(HEADER))
    for documents in batches:
        yield pa.array([unify(rows) for rows in values(documents)], kind)


# a filter on what comes of the walk isn't pushed below it, which would walk every document twice
_walked = _walk.asNondeterministic()


def outlines(analysed: DataFrame, section_patterns: tuple[str, ...] = (), units: bool = True, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per document, with the aggregates ``more`` of its blocks: doc_id, blocks (idx, text, quoted in order), hs (its sections), n_sections,
    confidence, flat, rejected (places of the candidates that head none) and flat_cause ("" if it isn't flat).

    Confidence is the mean score, damped below three sections; a flat document's sections don't count.
    """
    rows = candidates(analysed, section_patterns, units)
    packed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text", "quoted", "form", "head"))).alias("bs"), *more)
    kept = [c for c in packed.columns if c not in ("doc_id", "bs")]
    known = F.filter(F.transform("bs", lambda b, i: F.struct(
        i.alias("pos"), b["idx"].alias("idx"), b["form"].alias("form"), *[b["head"][c].alias(c) for c in ("kind", "series", "value", "level", "heading", "rest", "label", "numbered")],
    )), lambda c: c["form"].isNotNull())
    out = packed.select("doc_id", F.transform("bs", lambda b: F.struct(b["idx"].alias("idx"), b["text"].alias("text"), b["quoted"].alias("quoted"))).alias("blocks"), _walked(known).alias("hs"), F.transform(known, lambda c: c["idx"]).alias("candidates"), *kept)
    n = F.size("hs")
    mean = F.aggregate("hs", F.lit(0.0), lambda a, h: a + h["score"]) / F.nullif(n, F.lit(0))
    out = out.withColumn("n_sections", n.cast("long")).withColumn("confidence", F.coalesce(F.round(mean * F.least(F.lit(1.0), n / FULL_SECTIONS), 4), F.lit(0.0)))
    out = out.withColumn("flat", F.col("confidence") < FLAT_BELOW).withColumn("rejected", F.array_except("candidates", F.col("hs")["idx"]))
    cause = F.when(F.size("candidates") == 0, NO_CANDIDATE).when(n == 0, ALL_REJECTED).otherwise(TOO_FEW)
    return out.withColumn("flat_cause", F.when(F.col("flat"), cause).otherwise("")).drop("candidates")


def headers(outlined: DataFrame) -> DataFrame:
    """doc_id, idx, depth, kind, label_kind, heading, score, style, prose of every accepted section header."""
    return outlined.select("doc_id", F.explode_outer("hs").alias("h")).where("h is not null").select("doc_id", *[f"h.{c}" for c in ("idx", "depth", "kind", "label_kind", "heading", "score", "style", "prose")])


def document_confidence(outlined: DataFrame) -> DataFrame:
    """doc_id, n_sections, confidence, flat of documents with any header."""
    return outlined.where("n_sections > 0").select("doc_id", "n_sections", "confidence", "flat")


def sections(outlined: DataFrame) -> DataFrame:
    """doc_id, idx, depth, kind, ..., parent_idx, path, breadcrumb of the sections of documents that aren't flat."""
    return outlined.where("not flat").select("doc_id", F.explode_outer("hs").alias("h")).where("h is not null").select("doc_id", "h.*").drop("pos")


def own_text(h: Column, until: Column, blocks: Column) -> Column:
    """What stands below a header and before place ``until``, as array<struct<text, quoted>>: the prose its label opens, then the paragraphs."""
    below = paragraphs(F.slice(blocks, h["pos"] + 2, F.greatest(until - h["pos"] - 1, F.lit(0))))
    opened = F.struct(h["rest"].alias("text"), F.lit(False).alias("quoted"))
    return F.when(h["rest"].isNull(), below).otherwise(F.concat(F.array(opened), below))


def paragraphs(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), b["quoted"].alias("quoted")))


def tree_of(blocks: DataFrame, section_patterns: tuple[str, ...] = ()) -> DataFrame:
    """The section rows of documents given as blocks."""
    return sections(outlines(analyse(blocks), section_patterns))


def prose_headers(analysed: DataFrame, answers: DataFrame | None, model: str) -> DataFrame:
    """Adds ``declared``: unlabelled, unstyled lines that look like headings and that a referee's filed answer confirms.

    A line nobody confirmed is no heading, so without answers there are none. Those declared before stay.
    """
    known = F.coalesce("declared", F.lit(False)) if "declared" in analysed.columns else F.lit(False)
    if answers is None:
        return analysed.withColumn("declared", known)
    text = L.stripped(F.col("text"))
    shown = [F.coalesce(f(text).over(in_order()), F.lit("")) for f in (F.lag, F.lead)]
    key = question_key(F.lit(model), F.lit("heading"), text, *shown)
    asked = analysed.select("doc_id", "idx", key.alias("key"), L.is_prose_header(F.col("text"), F.col("style"), F.col("outline_level"), F.col("quoted")).alias("asked")).where("asked")
    questions = asked.select("doc_id", "idx", "key", F.lit("heading").alias("kind"), F.lit("nao").alias("rule_verdict"), F.lit(RULE_PROSE).alias("rule_confidence"))
    said = adjudicate(questions, answers.dropDuplicates(["key"])).where(F.col("final") == "secao").select("doc_id", "idx", F.lit(True).alias("said"))
    return analysed.withColumn("declared", known).join(said, ["doc_id", "idx"], "left").withColumn("declared", F.col("declared") | F.coalesce("said", F.lit(False))).drop("said")


def forest(docs: DataFrame) -> DataFrame:
    """The outlines of :func:`outlines` for every body (annex 0) and every annex, which is a document of its own.

    ``docs``: rows of ``parts.located``; the genre's section names count in the body only. The line that names an annex
    belongs to no tree. All passes run by (doc_id, annex), shuffled once. ``counts``: the census of the tree's articles;
    ``plain``: whether it is free of tables and list items; ``units``: the articulation of a body whose articles rise, null if it has none.
    """
    named, folded = F.lit(False), fold(L.stripped(F.col("text")))
    for p in profiles():
        for pattern in p.sections:
            named = named | ((F.col("profile") == p.name) & folded.rlike(pattern))
    rows = placed(docs).where(F.col("region") >= 0)
    rows = rows.withColumn("declared", F.coalesce(named & (F.col("region") == 0), F.lit(False))).drop("profile")
    # by number, as many tasks as asked for: few bytes, much work
    keyed = rows.withColumn("doc_id", F.struct("doc_id", F.col("region").alias("annex"))).drop("region").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    plain = [(F.col("kind") != "table"), F.col("num_id").isNull()] if {"kind", "num_id"} <= set(keyed.columns) else [F.lit(True)]
    marked = articulation.marked(covered(analyse(keyed))).withColumn("is_plain", plain[0] if len(plain) == 1 else plain[0] & plain[1])
    units = articulation.gathered(F.col("monotonic") & (F.col("doc_id.annex") == 0))
    out = outlines(marked, more=(F.struct(*census_counts()).alias("counts"), F.bool_and("is_plain").alias("plain"), *units))
    read = articulation.read(F.col("units"), F.col("ahead")).alias("units")
    return out.select("doc_id.doc_id", "doc_id.annex", "blocks", "hs", "n_sections", "confidence", "flat", "flat_cause", "counts", "plain", read)


__all__ = ["candidates", "document_confidence", "forest", "headers", "outlines", "own_text", "paragraphs", "prose_headers", "sections", "tree_of", "unify", "unit_heads"]
