"""Own versus quoted: indent bands, the quotation guard and its passes, and quoted runs.

All passes are windows over (doc_id, idx), so they share one hash partitioning by document.
Input: blocks with doc_id, idx, text, style, outline_level, indent_direct, indent_effective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

# Fixed values.
INDENT_MARGIN, DECLARED_TOLERANCE, MIN_BAND = 300, 64, 3
SERIES_START, SERIES_GAP = 2, 3
CLOSERS = ("numeric", "unit", "capitulo", "secao", "subsecao", "titulo", "livro", "parte")

def by_doc():
    return Window.partitionBy("doc_id")


def in_order():
    return by_doc().orderBy("idx")


def before():
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def non_empty(blocks: DataFrame) -> DataFrame:
    return blocks.where(L.has_text(F.col("text")))


def quote_bands(blocks: DataFrame) -> DataFrame:
    """doc_id, modal_indent, rule (deviation / declared / none), band_low, band_high over non-empty blocks.

    One count per document and pair of indents, and windows over these few rows; all of it keeps the blocks'
    partitioning by document. The mode of equals is the one met first: a maximum by (count, earliest place).
    Empty blocks are counted out, not filtered: a filter on the text would be pushed into what makes the text.
    """
    filled = L.has_text(F.col("text"))
    cells = blocks.groupBy("doc_id", F.col("indent_effective").alias("eff"), F.col("indent_direct").alias("own")).agg(F.count_if(filled).alias("n"), F.min(F.when(filled, F.col("idx"))).alias("first")).where("n > 0")
    cells = cells.withColumn("wide", F.col("own") >= INDENT_MARGIN)
    for name in ("eff", "own"):
        same = Window.partitionBy("doc_id", name)
        cells = cells.withColumn(f"{name}_rank", F.struct(F.sum("n").over(same).alias("n"), (-F.min("first").over(same)).alias("first")))
    cells = cells.withColumn("modal", F.max_by("eff", F.when(F.col("eff").isNotNull(), F.col("eff_rank"))).over(by_doc()))
    cells = cells.withColumn("centre", F.max_by("own", F.when(F.col("wide"), F.col("own_rank"))).over(by_doc()))
    high, at_mode = F.col("eff") >= F.col("modal") + INDENT_MARGIN, F.col("eff") == F.col("modal")
    near = F.col("wide") & (F.abs(F.col("own") - F.col("centre")) <= DECLARED_TOLERANCE)

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    out = cells.groupBy("doc_id").agg(
        F.first("modal").alias("modal_indent"), total(F.col("eff").isNotNull()).alias("n_blocks"),
        total(high).alias("n_high"), F.min(F.when(high, F.col("eff"))).alias("low"), F.max(F.when(high, F.col("eff"))).alias("top"),
        (total(at_mode & F.col("own").isNull()) / total(at_mode)).alias("inherited"),
        total(near).alias("n_near"), F.min(F.when(near, F.col("own"))).alias("near_low"), F.max(F.when(near, F.col("own"))).alias("near_top"),
    ).where("modal_indent is not null")
    deviation = (F.col("n_blocks") >= MIN_BAND) & (F.col("n_high") >= MIN_BAND)
    declared = (F.col("n_blocks") >= MIN_BAND) & (F.col("inherited") > 0.5) & (F.col("n_near") >= MIN_BAND)
    return out.select(
        "doc_id", "modal_indent",
        F.when(deviation, "deviation").when(declared, "declared").otherwise("none").alias("rule"),
        F.when(deviation, F.col("low")).when(declared, F.col("near_low")).alias("band_low"),
        F.when(deviation, F.col("top")).when(declared, F.col("near_top")).alias("band_high"),
    )


def is_monotonic(values: Column) -> Column:
    """Two values or more, the first at most 2, each larger than the one before by at most 3."""
    steps = F.zip_with(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: (b > a) & (b - a <= SERIES_GAP))
    return (F.size(values) >= 2) & (F.element_at(values, 1) <= SERIES_START) & F.forall(steps, lambda x: x)


def analyse(blocks: DataFrame) -> DataFrame:
    """The non-empty blocks with label, is_article, article_no, monotonic, omissis, antecedent, in_band, rule and quoted."""
    text = F.col("text")
    rows = blocks.join(quote_bands(blocks).select("doc_id", "rule", "band_low", "band_high"), "doc_id")
    rows = rows.withColumn("heading", L.is_style_heading(F.col("style"), F.col("outline_level"))).withColumn("article_no", L.article_number(text))
    rows = rows.withColumn("is_article", F.col("article_no").isNotNull())
    indent = F.when(F.col("rule") == "declared", F.col("indent_direct")).otherwise(F.col("indent_effective"))
    rows = rows.withColumn("in_band", F.coalesce((F.col("rule") != "none") & indent.between(F.col("band_low"), F.col("band_high")), F.lit(False)))
    # the series test, as window aggregates: first value, and every step from the article before. Empty blocks number
    # nothing, so they may go after it: a test of the text below it would work out every text twice
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    body = rows.withColumns({
        "prior": F.last("article_no", ignorenulls=True).over(before()), "first_no": F.first("article_no", ignorenulls=True).over(whole), "n_articles": F.count("article_no").over(whole),
    }).where(L.stripped(text) != "")
    step_ok = F.when(F.col("is_article") & F.col("prior").isNotNull(), (F.col("article_no") > F.col("prior")) & (F.col("article_no") - F.col("prior") <= SERIES_GAP))
    body = body.withColumn("step_ok", step_ok).withColumn("names", L.names_norm(text))
    numbered = body.withColumns({"rising": F.min("step_ok").over(whole), "announced": F.lag("names").over(in_order())})
    numbered = numbered.withColumn("monotonic", (F.col("n_articles") >= 2) & F.coalesce(F.col("first_no") <= SERIES_START, F.lit(False)) & F.coalesce("rising", F.lit(False)))
    numbered = numbered.withColumn("omissis", ~F.col("heading") & (L.is_omissis(text) | L.carries_omissis(text)))
    numbered = numbered.withColumn("antecedent", ~F.col("heading") & F.coalesce("announced", F.lit(False)))
    strong = F.col("in_band") | L.opens_with_quote(text) | F.col("omissis")
    weak = F.col("antecedent") & F.col("is_article") & ~F.col("monotonic")
    marked = numbered.withColumn("q1", ~F.col("heading") & (strong | weak))
    # excerpts without a band run on after a quoted article or elision until a structural label
    marked = marked.withColumn("label", L.parse_label(F.col("text")))
    label = F.col("label")
    closes = F.col("heading") | F.coalesce(label["kind"].isin(*CLOSERS) | (label["kind"].isin("roman", "alpha", "compound") & L.looks_like_heading(label["rest"])), F.lit(False))
    event = F.when(F.col("q1"), F.when(F.col("is_article") | L.is_omissis(text), F.lit(1))).when(closes, F.lit(0))
    marked = marked.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(so_far()), F.lit(0)) == 1)
    runs_on = (F.col("rule") == "none") & (F.col("n_articles") > 0) & ~F.col("monotonic")
    marked = marked.withColumn("q2", F.col("q1") | (runs_on & F.col("inside") & ~F.col("heading")))
    # a paragraph that names a norm and its article right before quoted text introduces it
    head = L.quotation_head(text)
    follows = F.coalesce(F.lead("q2").over(in_order()), F.lit(False))
    marked = marked.withColumn("norm", head).withColumn("quoted", F.col("q2") | (follows & ~F.col("heading") & head.isNotNull()))
    return marked.drop("band_low", "band_high", "prior", "first_no", "step_ok", "names", "rising", "announced", "q1", "q2", "inside")


def numbered_runs(analysed: DataFrame) -> DataFrame:
    """Adds ``run`` and ``before``: quoted stretches, each cut where a paragraph names the next norm, and the last unquoted
    paragraph above (idx, names). Unquoted blocks have no run."""
    opens = F.col("quoted") & (~F.coalesce(F.lag("quoted").over(in_order()), F.lit(False)) | F.col("norm").isNotNull())
    announced = F.last(F.when(~F.col("quoted"), F.struct("idx", L.names_norm(F.col("text")).alias("names"))), ignorenulls=True).over(before())
    rows = analysed.withColumn("before", announced).withColumn("run", F.sum(opens.cast("int")).over(so_far()).cast("long"))
    return rows.withColumn("run", F.when(F.col("quoted"), F.col("run")))


def islands(analysed: DataFrame) -> DataFrame:
    """doc_id, run, first_idx, last_idx, n_blocks, antecedent_idx, norm of each quotation.

    A quoted stretch is one quotation, or as many as norms are named in it. A head that introduces nothing but itself
    is a run without a norm. The antecedent is that of the stretch.
    """
    found = numbered_runs(analysed).where("quoted").groupBy("doc_id", "run").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_blocks"), F.min_by("before", "idx").alias("before"), F.min_by("norm", "idx").alias("named"),
    )
    return found.select(
        "doc_id", "run", "first_idx", "last_idx", "n_blocks", F.when(F.col("before.names"), F.col("before.idx")).alias("antecedent_idx"), F.when(F.col("n_blocks") > 1, F.col("named")).alias("norm"),
    )
