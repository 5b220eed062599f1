"""The registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import articulation as statutes
from ..operators import bundles, corpus, hierarchy, parts, profiles, quotation, regions, rendering, reports, routing, seams, segmentation, segments, xml
from ..sources import readers
from . import oracle as O
from .corpus import LEGAL, PLACED, legal_blocks, page_blocks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _analysed(spark: SparkSession, sf: str) -> DataFrame:
    return quotation.analyse(legal_blocks(spark, sf))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return routing.route(routing.census(_analysed(spark, sf)))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- routing -------------------------------------------------------------------------------

@query(f"WITH {O.CENSUS} SELECT route, count(*) AS n FROM routed GROUP BY route")
def route_counts(spark, sf):
    """Documents by route: blocks, quotation guard, census, gates."""
    return reports.ranked(_routed(spark, sf), "route")


@query(f"WITH {O.CENSUS} SELECT doc_id, n_body, n_found, n_quoted, n_own, monotonic, n_covered FROM census")
def article_census(spark, sf):
    return routing.census(_analysed(spark, sf)).drop("first_own")


@query(f"WITH {O.CENSUS} SELECT doc_id, coverage, coverage >= 0.6 AS passes FROM routed")
def coverage_gate(spark, sf):
    return _routed(spark, sf).select("doc_id", "coverage", (F.col("coverage") >= routing.COVERAGE_MIN).alias("passes"))


@query(f"WITH {O.CENSUS} SELECT doc_id, route, p_norma, CASE WHEN route = 'norma' THEN p_norma ELSE round(1 - p_norma, 4) END AS confidence, array_to_string(blockers, ',') AS blockers FROM routed")
def route_evidence(spark, sf):
    return _routed(spark, sf).select("doc_id", "route", "p_norma", "confidence", F.concat_ws(",", "blockers").alias("blockers"))


@query(f"WITH {O.CENSUS} SELECT unnest(blockers) AS blocker, count(*) AS n FROM routed GROUP BY 1")
def ranked_blockers(spark, sf):
    return reports.ranked(_routed(spark, sf).select(F.explode("blockers").alias("blocker")), "blocker")


# --- quotation -----------------------------------------------------------------------------

@query(f"WITH {O.ANALYSED} SELECT doc_id, CAST(modal_indent AS INTEGER) AS modal_indent, rule FROM bands")
def quote_bands(spark, sf):
    return quotation.quote_bands(legal_blocks(spark, sf)).select("doc_id", F.col("modal_indent").cast("int").alias("modal_indent"), "rule")


@query(f"WITH {O.ANALYSED} SELECT doc_id, idx, quoted, antecedent, elision OR elided_end AS omissis, in_band FROM analysed")
def quoted_blocks(spark, sf):
    return _analysed(spark, sf).select("doc_id", "idx", "quoted", "antecedent", "omissis", "in_band")


@query(f"""WITH {O.ANALYSED}, marked AS (SELECT *, quoted AND (norm_head OR NOT coalesce(lag(quoted) OVER w, false)) AS opens_run FROM analysed WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
runs AS (SELECT *, sum(CAST(opens_run AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM marked),
spans AS (SELECT doc_id, CAST(run AS BIGINT) AS run, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_blocks FROM runs WHERE quoted GROUP BY ALL)
SELECT s.*, CASE WHEN {O.names_norm(O.strip('a.text'))} THEN a.idx END AS antecedent_idx,
  CASE WHEN n_blocks > 1 AND h.norm_head THEN nullif({O.cut(O.group(O.strip('h.text'), L.NORM_HEAD, 1), '[ ,;:–—"“”-]+$')}, '') END AS norm
FROM spans s JOIN analysed h ON h.doc_id = s.doc_id AND h.idx = s.first_idx LEFT JOIN analysed a
ON a.doc_id = s.doc_id AND a.idx = (SELECT max(b.idx) FROM analysed b WHERE b.doc_id = s.doc_id AND b.idx < s.first_idx AND NOT b.quoted)""")
def quoted_islands(spark, sf):
    return quotation.islands(_analysed(spark, sf))


@query(f"WITH {O.ANALYSED} SELECT doc_id, n_articles, monotonic FROM monotony")
def monotonic_series(spark, sf):
    """The series test on each document's article numbers, as an array."""
    rows = legal_blocks(spark, sf).withColumn("n", L.article_number(F.col("text"))).where("n is not null")
    packed = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("v"))
    return packed.select("doc_id", F.size("v").cast("long").alias("n_articles"), quotation.is_monotonic(F.col("v")).alias("monotonic"))


@query(f"""WITH {O.ANALYSED} SELECT doc_id, idx, CASE WHEN NOT quoted THEN CASE WHEN monotonic THEN 0.9 ELSE 0.6 END
  WHEN in_band THEN CASE WHEN elision OR elided_end OR opens OR antecedent THEN 0.95 ELSE 0.9 END WHEN elision OR elided_end THEN 0.85 WHEN opens THEN 0.8 WHEN antecedent THEN 0.55 ELSE 0.5 END::DOUBLE AS confidence
  FROM analysed WHERE article_no IS NOT NULL""")
def quotation_confidence(spark, sf):
    rows = _analysed(spark, sf).where("is_article")
    return rows.select("doc_id", "idx", routing.quotation_confidence(F.col("quoted"), F.col("in_band"), F.col("omissis"), L.opens_with_quote(F.col("text")), F.col("antecedent"), F.col("monotonic")).alias("confidence"))


@query(f"""WITH legal AS ({LEGAL}), t AS (SELECT doc_id, idx, {O.names_norm(O.strip('text'))} AS names, text FROM legal)
SELECT doc_id, idx, coalesce(last_value(CASE WHEN names THEN text END IGNORE NULLS) OVER w, last_value(text IGNORE NULLS) OVER w) AS carried
FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def context_carry_forward(spark, sf):
    """The last text that announced a norm, else the text before."""
    rows = legal_blocks(spark, sf)
    w = quotation.before()
    return rows.select("doc_id", "idx", F.coalesce(F.last(F.when(L.names_norm(F.col("text")), F.col("text")), True).over(w), F.last("text", True).over(w)).alias("carried"))


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, idx, lag(text) OVER w AS before, lead(text) OVER w AS after FROM legal WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def prev_next_context(spark, sf):
    w = quotation.in_order()
    return quotation.non_empty(legal_blocks(spark, sf)).select("doc_id", "idx", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


# --- labels --------------------------------------------------------------------------------

@query(f"WITH {O.LABELLED} SELECT kind, count(*) AS n FROM labels WHERE kind IS NOT NULL GROUP BY kind")
def label_kinds(spark, sf):
    return reports.ranked(legal_blocks(spark, sf).select(L.parse_label(F.col("text"))["kind"].alias("kind")), "kind")


@query(f"WITH {O.LABELLED} SELECT doc_id, idx, kind, value, opens AS quoted FROM labels WHERE kind IS NOT NULL")
def label_values(spark, sf):
    rows = legal_blocks(spark, sf).withColumn("l", L.parse_label(F.col("text"))).where("l is not null")
    return rows.select("doc_id", "idx", F.col("l.kind").alias("kind"), F.array_join(F.col("l.value").cast("array<string>"), ".").alias("value"), F.col("l.quoted").alias("quoted"))


_UNIT = rf"""WITH legal AS ({LEGAL}), lines AS (SELECT doc_id, idx, {O.cut(O.fold(O.group(O.strip('text'), L.UNIT, 1)), r'^[ \-–—.:]+|[ \-–—.:]+$', 'g')} AS head, CAST({O.group(O.strip('text'), L.UNIT, 2)} AS INTEGER) AS n
FROM legal WHERE {O.has(O.strip('text'), L.UNIT)}), steps AS (SELECT *, n > lag(n) OVER (PARTITION BY doc_id, head ORDER BY idx) AS up FROM lines WHERE head <> '')
SELECT doc_id, head, count(*) AS n_lines FROM steps GROUP BY ALL HAVING count(*) >= 3 AND bool_and(coalesce(up, true))"""


@query(_UNIT)
def unit_series(spark, sf):
    return hierarchy.unit_heads(legal_blocks(spark, sf))


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, idx, {O.heading(O.strip('text'))} AS heading, round(coalesce({O.count('text', r'\p{Lu}')} / nullif({O.count('text', r'\p{L}')}, 0), 0), 6) AS upper_ratio FROM legal")
def heading_shape(spark, sf):
    return legal_blocks(spark, sf).select("doc_id", "idx", L.looks_like_heading(F.col("text")).alias("heading"), F.round(T.upper_ratio(F.col("text")), 6).alias("upper_ratio"))


# --- segmentation --------------------------------------------------------------------------

@query(f"WITH legal AS ({LEGAL}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rank FROM legal) SELECT doc_id, idx, text, rank FROM r WHERE rank <= 12")
def head_window(spark, sf):
    return segmentation.head_window(legal_blocks(spark, sf)).select("doc_id", "idx", "text", "rank")


_MARKER = f"({O.n_words(O.strip('text'))} <= 5 AND {O.has(O.fold(O.strip('text')), segmentation.ANNEX)})"


@query(f"""WITH legal AS ({LEGAL}), e AS (SELECT *, max(idx) OVER (PARTITION BY doc_id) AS last FROM legal), m AS (SELECT * FROM e WHERE {_MARKER})
SELECT doc_id, row_number() OVER w AS ordinal, text AS label, idx AS first_idx, coalesce(lead(idx) OVER w - 1, last) AS last_idx FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def annex_spans(spark, sf):
    return segmentation.annexes(legal_blocks(spark, sf))


_CLOSING = f"({O.has(O.strip('text'), segmentation.CLOSING)})"
_SPAN = f"""ends AS (SELECT doc_id, min(idx) AS first_idx, max(idx) AS fin, min(idx) FILTER (WHERE {_MARKER}) AS annex, max(idx) FILTER (WHERE {_CLOSING}) AS closing FROM legal GROUP BY doc_id),
cuts AS (SELECT *, least(fin, coalesce(annex - 1, fin)) AS c FROM ends),
spans AS (SELECT doc_id, first_idx, CASE WHEN closing IS NOT NULL AND closing <= c THEN closing - 1 ELSE c END AS last_idx FROM cuts)"""


@query(f"WITH legal AS ({LEGAL}), {_SPAN} SELECT doc_id, first_idx, last_idx FROM spans WHERE last_idx >= first_idx")
def body_spans(spark, sf):
    return segmentation.body_span(legal_blocks(spark, sf))


@query(f"WITH legal AS ({LEGAL}), {_SPAN} SELECT l.doc_id, l.idx, l.text FROM legal l JOIN spans s ON l.doc_id = s.doc_id AND l.idx BETWEEN s.first_idx AND s.last_idx")
def span_block_join(spark, sf):
    """Interval join: the equality on the document keeps it a hash or sort-merge join."""
    blocks = legal_blocks(spark, sf)
    spans = segmentation.body_span(blocks)
    return blocks.join(spans, "doc_id").where(F.col("idx").between(F.col("first_idx"), F.col("last_idx"))).select("doc_id", "idx", "text")


@query(f"""WITH legal AS ({LEGAL}), {_SPAN}, free AS (SELECT l.doc_id, l.idx FROM legal l LEFT JOIN spans s ON l.doc_id = s.doc_id AND s.last_idx >= s.first_idx AND l.idx BETWEEN s.first_idx AND s.last_idx WHERE s.doc_id IS NULL),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM free) SELECT doc_id, min(idx) AS first_idx, max(idx) AS last_idx FROM g GROUP BY doc_id, island""")
def gap_islands(spark, sf):
    blocks = legal_blocks(spark, sf)
    return segmentation.unclaimed(blocks, segmentation.body_span(blocks))


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, idx, text = 'JOÃO DA SILVA' AS person, {_CLOSING} AS closing FROM legal WHERE text = 'JOÃO DA SILVA' OR {_CLOSING}")
def signature_lines(spark, sf):
    rows = legal_blocks(spark, sf)
    t = F.col("text")
    marked = rows.select("doc_id", "idx", segmentation.is_person_name(t).alias("person"), segmentation.is_closing(t).alias("closing"))
    return marked.where("person or closing")


@query()
def signature_blocks(spark, sf):
    return segmentation.signatures(legal_blocks(spark, sf))


# --- identity ------------------------------------------------------------------------------

_Y, _M, _D = O.date_parts("text")


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, idx, {_Y} AS year, {_M} AS month, {_D} AS day FROM legal WHERE {_Y} IS NOT NULL")
def pt_dates(spark, sf):
    return legal_blocks(spark, sf).select("doc_id", "idx", T.pt_date(F.col("text")).alias("d")).where("d is not null").select("doc_id", "idx", "d.*")


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, idx, {O.slug('text')} AS slug, {O.fold('text')} AS folded FROM legal")
def slugify(spark, sf):
    return legal_blocks(spark, sf).select("doc_id", "idx", T.slugify(F.col("text")).alias("slug"), T.fold(F.col("text")).alias("folded"))


_RAW = "'00' || substr(CAST(o_orderkey AS VARCHAR), 1, 1) || '.' || o_custkey || '/' || o_orderkey"


@query(f"SELECT o_orderkey, {O.plain_number(_RAW)} AS number FROM orders")
def number_normalise(spark, sf):
    raw = F.concat(F.lit("00"), F.substring(F.col("o_orderkey").cast("string"), 1, 1), F.lit("."), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    return _table(spark, sf, "orders").select("o_orderkey", T.plain_number(raw).alias("number"))


_URN = "'urn:lex:br:' || CASE o_custkey % 5 WHEN 0 THEN 'Federal' ELSE lower(replace(o_orderpriority, ' ', '.')) END || ':portaria:' || CASE WHEN o_orderkey % 3 = 0 THEN '0000' ELSE strftime(o_orderdate, '%Y-%m-%d') END || ';' || o_orderkey"


@query(rf"""WITH u AS (SELECT o_orderkey, {_URN} AS urn FROM orders)
SELECT o_orderkey, urn, {O.has('urn', T.URN)} AS valid, nullif({O.group('urn', T.URN, 2)}, '') AS authority, nullif({O.group('urn', T.URN, 4)}, '') AS date, nullif({O.group('urn', T.URN, 5)}, '') AS number FROM u""")
def urn_build_parse(spark, sf):
    o = _table(spark, sf, "orders")
    authority = F.when(F.col("o_custkey") % 5 == 0, "Federal").otherwise(F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("."))))
    date = F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.day("o_orderdate").alias("day")))
    rows = o.select("o_orderkey", T.build_urn(F.lit("br"), authority, F.lit("portaria"), date, F.col("o_orderkey").cast("string")).alias("urn")).withColumn("p", T.parse_urn(F.col("urn")))
    return rows.select("o_orderkey", "urn", F.col("p").isNotNull().alias("valid"), "p.authority", "p.date", "p.number")


@query("SELECT o_orderkey, substr(sha256('m' || chr(31) || 'heading' || chr(31) || o_orderpriority || chr(31) || o_orderkey), 1, 32) AS key FROM orders")
def cache_key(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", T.cache_key(F.lit("m"), F.lit("heading"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("key"))


_SOURCE = "replace(lower(c_mktsegment), 'e', '_') || '_' || c_nationkey || '_x' || c_custkey || '.docx'"


@query(rf"""WITH s AS (SELECT c_custkey, {_SOURCE} AS source FROM customer) SELECT c_custkey, regexp_extract(source, '^(.*?)(_[0-9].*)$', 1) AS genre FROM s""")
def genre_of(spark, sf):
    c = _table(spark, sf, "customer")
    source = F.concat(F.replace(F.lower("c_mktsegment"), F.lit("e"), F.lit("_")), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("_x"), F.col("c_custkey").cast("string"), F.lit(".docx"))
    return c.select("c_custkey", T.genre(source).alias("genre"))


@query(f"""WITH legal AS ({LEGAL}), h AS (SELECT doc_id, {O.fold('text')} AS f, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rank FROM legal),
s AS (SELECT doc_id, bool_or(rank <= 6 AND {O.has('f', r'^\s*parecer\b')}) AS e, bool_or({O.has('f', r'^\s*parecer\b')}) AS a FROM h WHERE rank <= 30 GROUP BY doc_id)
SELECT doc_id, CASE WHEN e OR a THEN 'parecer' ELSE 'generic' END AS profile, CASE WHEN e THEN 0.9 WHEN a THEN 0.5 ELSE 0.05 END::DOUBLE AS score FROM s""")
def profile_selected(spark, sf):
    return profiles.selected(profiles.scores(legal_blocks(spark, sf)))


@query()
def profile_scores(spark, sf):
    return profiles.scores(legal_blocks(spark, sf))


@query()
def document_identity(spark, sf):
    out = profiles.identity(legal_blocks(spark, sf))
    return out.select("doc_id", "profile", "authority", "doc_type", "number", "urn", F.concat_ws(",", "missing").alias("missing"))


def _parts(spark, sf):
    blocks = legal_blocks(spark, sf)
    known = profiles.identity(blocks).select("doc_id", "profile", "epigraph_idx")
    return blocks, parts.parts(blocks, known)


@query()
def document_parts(spark, sf):
    """Front matter, body, closing matter and annexes of every document, and what they hold."""
    return _parts(spark, sf)[1]


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, count(*) AS n_blocks FROM legal GROUP BY doc_id")
def part_blocks(spark, sf):
    """Blocks of each document that lie in some region or annex: all of them."""
    blocks, found = _parts(spark, sf)
    regions = found.where(F.col("part").isin("front", "body", "back", "annex"))
    held = blocks.join(regions.select("doc_id", "first_idx", "last_idx"), "doc_id").where(F.col("idx").between(F.col("first_idx"), F.col("last_idx")))
    return held.select("doc_id", "idx").distinct().groupBy("doc_id").agg(F.count("*").alias("n_blocks"))


@query()
def region_trees(spark, sf):
    """Section trees of every body and, apart, of every annex."""
    blocks = legal_blocks(spark, sf)
    known = profiles.identity(blocks).select("doc_id", "profile", "epigraph_idx")
    found = hierarchy.forest(corpus.kept(parts.located(blocks, known)))  # read twice: the blocks and their indents
    return found.select("doc_id", "annex", F.size("blocks").cast("long").alias("n_blocks"), "n_sections", "confidence", "flat")


# --- regions and bundles -------------------------------------------------------------------

_WORDS = f"WITH legal AS ({LEGAL}) SELECT doc_id, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS"


@query(f"""WITH legal AS ({LEGAL}), claims AS (SELECT doc_id, idx AS a, idx + 1 AS b, 1 AS pri, 'fecho' AS owner FROM legal WHERE {_CLOSING} UNION ALL SELECT doc_id, idx, idx + 2, 2, 'anexo' FROM legal WHERE {_MARKER}),
owned AS (SELECT l.doc_id, l.idx, coalesce(arg_min(c.owner, c.pri * 1000000 + c.a), 'resto') AS owner FROM legal l LEFT JOIN claims c ON c.doc_id = l.doc_id AND l.idx BETWEEN c.a AND c.b GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - row_number() OVER (PARTITION BY doc_id, owner ORDER BY idx) AS island FROM owned)
SELECT doc_id, owner, min(idx) AS first_idx, max(idx) AS last_idx FROM g GROUP BY doc_id, owner, island""")
def owner_runs(spark, sf):
    """Every document dealt out among claims of closing lines with the line after, then of annex markers with the two after."""
    t, at = F.col("text"), F.col("idx").cast("long")
    claims = [F.when(test, F.struct(F.lit(owner).alias("owner"), at.alias("first_idx"), (at + more).alias("last_idx"))) for owner, test, more in (("fecho", segmentation.is_closing(t), 1), ("anexo", segmentation.is_annex_marker(t), 2))]
    by_place = [F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(c["first_idx"].alias("at"), c.alias("c"))))) for c in claims]
    docs = legal_blocks(spark, sf).groupBy("doc_id").agg(F.struct(F.min(at).alias("first_idx"), F.max(at).alias("last_idx")).alias("hull"), F.concat(*[F.transform(x, lambda y: y["c"]) for x in by_place]).alias("claims"))
    return docs.select("doc_id", F.inline(regions.owner_runs(F.col("hull"), F.col("claims").cast(f"array<{regions.CLAIM}>"), "resto")))


def _bundled(spark, sf, emitter="generico"):
    blocks = legal_blocks(spark, sf)
    known = corpus.kept(profiles.identity(blocks).select("doc_id", "profile", "epigraph_idx", "urn"))
    docs = corpus.kept(parts.located(blocks, known))
    return bundles.routed(bundles.assembled(docs, emitter)).join(known.select("doc_id", "urn"), "doc_id")


@query()
def region_runs(spark, sf):
    """Front and closing matter of every document as named runs of blocks."""
    blocks = legal_blocks(spark, sf)
    docs = regions.with_runs(parts.located(blocks, profiles.identity(blocks)))

    def listed(side):
        return F.transform(f"{side}_runs", lambda r, i: F.struct(F.lit(side).alias("side"), i.alias("run"), *[r[c].alias(c) for c in ("owner", "first_idx", "last_idx")]))

    # both sides from one reading of the documents; outer, since a plain generator's filter would work the runs out twice
    return docs.select("doc_id", F.explode_outer(F.concat(listed("front"), listed("back"))).alias("r")).where("r is not null").select("doc_id", "r.*")


@query()
def bundle_gates(spark, sf):
    """How every document is published, and the gates that stop those routed as statutes."""
    out = bundles.published(_bundled(spark, sf), F.col("urn"), own_units=True)
    return out.select("doc_id", "profile", "route", "emitter", F.concat_ws(",", "gate").alias("gate"), F.size("files").alias("n_files"))


@query(f"{_WORDS} n_words FROM legal GROUP BY doc_id")
def bundle_words(spark, sf):
    """Words read back from all files of each document's bundle in the nested form."""
    files = bundles.files(bundles.published(_bundled(spark, sf, "generico-aninhado"), F.col("urn"), emitter="generico-aninhado"))
    return files.groupBy("doc_id").agg(F.sum(xml.n_words(F.col("xml"))).alias("n_words"))


@query()
def bundle_segments(spark, sf):
    """The segment rows of every bundle: front matter, sections, closing matter, and those of each annex."""
    return bundles.segment_rows(_bundled(spark, sf)).select("doc_id", "fragment", "order", "id", "kind", "level", "text", "urn")


# --- tree and segments ---------------------------------------------------------------------

def _outlines(spark, sf):
    return hierarchy.outlines(_analysed(spark, sf))


@query()
def unify_levels(spark, sf):
    return hierarchy.headers(_outlines(spark, sf))


@query()
def flat_causes(spark, sf):
    """Why each flat document is flat, with the candidates that came to nothing."""
    return _outlines(spark, sf).where("flat").select("doc_id", "flat_cause", F.size("rejected").cast("long").alias("n_rejected"), "n_sections")


@query()
def document_confidence(spark, sf):
    return hierarchy.document_confidence(_outlines(spark, sf))


@query()
def section_tree(spark, sf):
    return hierarchy.sections(_outlines(spark, sf)).select("doc_id", "idx", "depth", "kind", "parent_idx", F.concat_ws(".", F.col("path").cast("array<string>")).alias("path"), F.concat_ws(" | ", "breadcrumb").alias("breadcrumb"))


def _urn():
    return F.concat(F.lit("urn:lex:br:federal:documento:0000;"), F.col("doc_id").cast("string"))


@query()
def segment_rows(spark, sf):
    """Every document's text as addressable rows; a flat document is one."""
    return segments.segments(_outlines(spark, sf), _urn()).drop("path").withColumn("breadcrumb", F.concat_ws(" | ", "breadcrumb"))


def _n_words(*columns):
    return F.size(F.filter(F.split(F.concat_ws(" ", *columns), r"\s+"), lambda w: w != ""))


@query(f"{_WORDS} n_words FROM legal GROUP BY doc_id")
def segment_words(spark, sf):
    """Words in all rows of a document, labels and headings too: as many as its blocks have."""
    rows = segments.segments(_outlines(spark, sf), _urn())
    return rows.groupBy("doc_id").agg(F.sum(_n_words("label", "heading", "text")).alias("n_words"))


def _xml(spark, sf, emitter):
    return xml.rendered(segments.laid_out(_outlines(spark, sf), emitter), _urn(), emitter)


def _read_words(documents):
    return documents.select("doc_id", xml.n_words(F.col("xml")).alias("n_words"))


@query(f"{_WORDS} n_words FROM legal GROUP BY doc_id")
def xml_flat_words(spark, sf):
    """Words read back from the flat rendering of every document."""
    return _read_words(_xml(spark, sf, "generico"))


@query(f"{_WORDS} n_words FROM legal GROUP BY doc_id")
def xml_nested_words(spark, sf):
    return _read_words(_xml(spark, sf, "generico-aninhado"))


def _published(spark, sf):
    # one walk: census and units are aggregates beside the blocks; only a series that rises can be routed as a statute
    rows = statutes.marked(routing.covered(_analysed(spark, sf)))
    docs = hierarchy.outlines(rows, more=(F.struct(*routing.census_counts()).alias("counts"), *statutes.gathered(F.col("monotonic"))))
    docs = segments.laid_out(docs).select("doc_id", "rows", "counts.*", statutes.read(F.col("units"), F.col("ahead")).alias("units"))
    return xml.published(routing.route(docs), _urn())


@query(f"{_WORDS} n_words FROM legal GROUP BY doc_id")
def xml_published_words(spark, sf):
    """Words of each document as published: statutory where its route and words allow, else flat."""
    return _read_words(_published(spark, sf))


@query()
def xml_published(spark, sf):
    return _published(spark, sf)


@query()
def xml_segments(spark, sf):
    """Segment rows read back from the nested rendering."""
    return xml.segments_of(_xml(spark, sf, "generico-aninhado")).drop("path").withColumn("breadcrumb", F.concat_ws(" | ", "breadcrumb"))


@query(r"SELECT o_orderkey, regexp_matches(lower(replace(o_orderpriority, '-', '_')) || '_' || o_orderkey, '^[A-Za-z_][A-Za-z0-9_.-]*$') AS legal FROM orders")
def legal_ids(spark, sf):
    ident = F.concat(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))), F.lit("_"), F.col("o_orderkey").cast("string"))
    return _table(spark, sf, "orders").select("o_orderkey", segments.is_legal_id(ident).alias("legal"))


_LINKED = f"""WITH legal AS ({LEGAL}), p AS (SELECT doc_id, idx, text, substr(sha256('urn:x' || chr(31) || text), 1, 32) AS key FROM legal),
a AS (SELECT DISTINCT text, CASE WHEN text LIKE 'Lei%' THEN 1 ELSE 0 END AS refs FROM legal WHERE length(text) % 3 <> 0)
SELECT CASE WHEN a.refs IS NULL THEN 'miss' WHEN a.refs = 0 THEN 'none' ELSE 'hit' END AS link_status, count(*) AS n, CAST(coalesce(sum(a.refs), 0) AS BIGINT) AS n_references FROM p LEFT JOIN a USING (text) GROUP BY 1"""


@query(_LINKED)
def linked_references(spark, sf):
    """Cached answers of a linker joined by key: hits, empty answers and misses."""
    rows = legal_blocks(spark, sf).select("doc_id", "idx", "text", F.lit("urn:x").alias("context_urn"))
    known = rows.where(F.length("text") % 3 != 0).select("text").distinct()
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("urn:lex:br:federal:lei:0000;0").alias("urn"), F.lit("Lei").alias("text")))
    refs = F.when(F.col("text").startswith("Lei"), one).otherwise(F.slice(one, 1, 0))
    return seams.link_report(seams.linked(rows, known.select(seams.link_key(F.lit("urn:x"), F.col("text")).alias("key"), refs.alias("refs"))))


@query()
def flatness_by_genre(spark, sf):
    flat = _outlines(spark, sf).select("doc_id", "flat")
    outcomes = profiles.selected(profiles.scores(legal_blocks(spark, sf))).select("doc_id", F.col("profile").alias("genre")).join(flat, "doc_id", "left")
    return reports.flatness(outcomes.withColumn("ok", F.lit(True)).withColumn("flat", F.coalesce("flat", F.lit(True))))


_IDS = f"""ids AS (SELECT DISTINCT doc_id, 'pp1_agr' || l_linenumber || CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_agr' || (l_suppkey % 3 + 1) ELSE '_agr' || (l_suppkey % 3 + 1) || '_agr' || (l_partkey % 2 + 1) END AS id FROM ({PLACED}) p)"""
_PREFIXES = "steps AS (SELECT doc_id, id, array_to_string(list_slice(string_split(id, '_'), 1, n), '_') AS prefix FROM (SELECT doc_id, id, unnest(range(1, len(string_split(id, '_')))) AS n FROM ids))"


def _ids(spark, sf):
    sql = f"WITH {_IDS} SELECT * FROM ids".replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(sql, lineitem=_table(spark, sf, "lineitem"))


@query(f"WITH {_IDS}, {_PREFIXES} SELECT DISTINCT s.doc_id, prefix FROM steps s WHERE length(prefix) > 3 AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.doc_id = s.doc_id AND i.id = s.prefix)")
def missing_id_prefixes(spark, sf):
    return segments.missing_prefixes(_ids(spark, sf))


@query(f"WITH {_IDS}, {_PREFIXES}, f AS (SELECT s.doc_id, s.id, arg_max(prefix, length(prefix)) AS parent FROM steps s JOIN ids i ON i.doc_id = s.doc_id AND i.id = s.prefix GROUP BY ALL) SELECT ids.doc_id, ids.id, parent FROM ids LEFT JOIN f USING (doc_id, id)")
def flat_parent_prefix(spark, sf):
    return segments.parents(_ids(spark, sf))


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, indent, idx, row_number() OVER (PARTITION BY doc_id, indent ORDER BY idx) AS ordinal FROM legal")
def sibling_ordinals(spark, sf):
    rows = legal_blocks(spark, sf).withColumn("indent", F.col("indent_effective"))
    return segments.ordinals(rows, "doc_id", "indent").select("doc_id", "indent", "idx", "ordinal")


@query(f"""WITH legal AS ({LEGAL}), w AS (SELECT doc_id, indent, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM legal), c AS (SELECT doc_id, word, sum(CASE WHEN indent = 0 THEN 1 ELSE -1 END) AS surplus FROM w WHERE word <> '' GROUP BY ALL)
SELECT doc_id, word, CAST(surplus AS BIGINT) AS surplus FROM c WHERE surplus <> 0""")
def multiset_difference(spark, sf):
    """Words of plain blocks against those of indented blocks, as multisets."""
    rows = legal_blocks(spark, sf)
    return segments.word_difference(rows.where("indent_effective = 0"), rows.where("indent_effective <> 0"))


_REFS = "SELECT l_orderkey AS doc_id, CAST(l_suppkey % 40 AS INTEGER) AS s, CAST(l_suppkey % 40 + l_linenumber * 3 AS INTEGER) AS e, l_partkey FROM lineitem"


@query(f"""WITH RECURSIVE refs AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, 'urn' || l_partkey) AS rn, 'urn' || l_partkey AS urn FROM ({_REFS}) r WHERE e <= 50 AND s < e),
walk AS (SELECT doc_id, rn, s, e, urn, true AS kept, e AS reach FROM refs WHERE rn = 1 UNION ALL
 SELECT r.doc_id, r.rn, r.s, r.e, r.urn, r.s >= w.reach, CASE WHEN r.s >= w.reach THEN r.e ELSE w.reach END FROM walk w JOIN refs r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)
SELECT doc_id, s AS "start", e AS "end", urn FROM walk WHERE kept""")
def reference_overlap(spark, sf):
    """Greedy choice of references that don't overlap, one ordered fold per document."""
    li = _table(spark, sf, "lineitem")
    start = (F.col("l_suppkey") % 40).cast("int")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.struct(start.alias("start"), (start + F.col("l_linenumber") * 3).cast("int").alias("end"), F.concat(F.lit("urn"), F.col("l_partkey").cast("string")).alias("urn")).alias("r"))
    packed = rows.groupBy("doc_id").agg(F.collect_list("r").alias("refs"))
    return packed.select("doc_id", F.explode(segments.usable_references(F.col("refs"), F.lit(50))).alias("r")).select("doc_id", "r.*")


# --- articulation, lists, fields -----------------------------------------------------------

_ARTICLES = f"""WITH {O.LABELLED}, l AS (SELECT doc_id, idx, text, coalesce(kind, '') AS kind, value, {O.has('b', L.SOLE_PARAGRAPH)} AS sole FROM labels),
a AS (SELECT *, max(CASE WHEN kind = 'artigo' THEN idx END) OVER w AS article_at FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
b AS (SELECT a.*, 'art' || h.value AS article, max(CASE WHEN a.kind = 'paragrafo' THEN a.idx END) OVER (PARTITION BY a.doc_id, article_at ORDER BY a.idx) AS par_at FROM a LEFT JOIN l h ON h.doc_id = a.doc_id AND h.idx = article_at),
c AS (SELECT b.*, article || '_par' || CASE WHEN p.sole THEN '1u' ELSE p.value END AS par FROM b LEFT JOIN l p ON p.doc_id = b.doc_id AND p.idx = par_at),
d AS (SELECT *, coalesce(par, article || '_cpt') AS holder, count(*) FILTER (WHERE kind = 'roman') OVER (PARTITION BY doc_id, article_at, par_at ORDER BY idx) AS nth FROM c),
e AS (SELECT *, CASE kind WHEN 'artigo' THEN article WHEN 'paragrafo' THEN par WHEN 'roman' THEN holder || '_inc' || nth END AS id FROM d),
bad AS (SELECT doc_id FROM e WHERE article_at IS NULL UNION SELECT doc_id FROM e WHERE id IS NOT NULL GROUP BY doc_id, id HAVING count(*) > 1)
SELECT doc_id, idx, CASE kind WHEN 'artigo' THEN 'artigo' WHEN 'paragrafo' THEN 'paragrafo' WHEN 'roman' THEN 'inciso' ELSE 'texto' END AS role, id,
  CASE kind WHEN 'artigo' THEN NULL WHEN 'paragrafo' THEN article ELSE holder END AS parent FROM e WHERE doc_id NOT IN (SELECT doc_id FROM bad)"""


@query(_ARTICLES)
def articulation(spark, sf):
    return statutes.articulation(legal_blocks(spark, sf))


@query(f"""WITH {O.LABELLED}, s AS (SELECT doc_id, idx, kind, CASE WHEN length(text) % 3 <> 0 THEN 'L' || (length(text) % 2) END AS num_id, length(text) % 4 AS ilvl FROM labels),
c AS (SELECT *, CASE WHEN num_id IS DISTINCT FROM lag(num_id) OVER (PARTITION BY doc_id ORDER BY idx) THEN 1 ELSE 0 END AS change FROM s),
r AS (SELECT *, CAST(sum(change) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS run FROM c),
l AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, run ORDER BY ilvl) - 1 AS level, row_number() OVER (PARTITION BY doc_id, run ORDER BY idx) AS place FROM r WHERE num_id IS NOT NULL)
SELECT doc_id, idx, run, place, min(CASE WHEN place = 1 THEN 0 ELSE level END - place) OVER (PARTITION BY doc_id, run ORDER BY idx) + place AS depth,
  bool_or(coalesce(kind IN ('numeric', 'roman', 'alpha', 'compound'), false)) OVER (PARTITION BY doc_id, run) AS ordered FROM l""")
def list_items(spark, sf):
    """List properties derived from the texts' lengths, since the derived corpus has none."""
    n = F.length("text")
    rows = legal_blocks(spark, sf).withColumn("num_id", F.when(n % 3 != 0, F.concat(F.lit("L"), (n % 2).cast("string")))).withColumn("ilvl", n % 4)
    return statutes.lists(rows)


@query(rf"""WITH legal AS ({LEGAL}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rank FROM legal),
g AS (SELECT doc_id, idx, trim({O.group('text', statutes.FIELD, 1)}) AS label, trim({O.group('text', statutes.FIELD, 2)}) AS value FROM f WHERE rank <= 40),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {O.fold('label')}, {O.fold('value')} ORDER BY idx) AS nth FROM g
  WHERE label <> '' AND value <> '' AND ((regexp_matches(label, '\p{{Lu}}') AND NOT regexp_matches(label, '\p{{Ll}}') AND {O.n_words('label')} <= 4) OR {O.fold('label')} = 'ementa'))
SELECT doc_id, idx, label, value FROM h WHERE nth = 1""")
def front_fields(spark, sf):
    return statutes.fields(legal_blocks(spark, sf), ("ementa",))


# --- rendering and warnings ----------------------------------------------------------------

_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH legal AS ({LEGAL}), t AS (SELECT doc_id, idx, {_XML.format('text')} AS x FROM legal), i AS (SELECT *, CASE WHEN idx % 3 = 0 THEN '<i>' || x || '</i>' ELSE x END AS y FROM t)
SELECT doc_id, idx, CASE WHEN idx % 2 = 0 THEN '<b>' || y || '</b>' ELSE y END || '<a xlink:href="#n' || idx || '"><sup>' || idx || '</sup></a>' AS xml FROM i""")
def rendered_runs(spark, sf):
    """Each block as a run that is bold or in italics by its place, and a raised note number with a link."""
    no, i = F.lit(False), F.col("idx")

    def run(text, bold, italic, sup, href):
        return F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic"), sup.alias("sup"), no.alias("sub"), href.alias("href"))

    runs = F.array(run(F.col("text"), i % 2 == 0, i % 3 == 0, no, F.lit(None).cast("string")), run(i.cast("string"), no, no, F.lit(True), F.concat(F.lit("#n"), i.cast("string"))))
    return legal_blocks(spark, sf).select("doc_id", "idx", rendering.render_inlines(runs).alias("xml"))


@query(f"""WITH {O.CENSUS}, k AS (SELECT doc_id, count(*) AS n FROM legal WHERE {_MARKER} GROUP BY doc_id),
d AS (SELECT CASE WHEN route = 'norma' THEN p_norma ELSE round(1 - p_norma, 4) END AS confidence, k.n FROM routed LEFT JOIN k USING (doc_id)),
c AS (SELECT CASE WHEN confidence < 0.6 THEN 'low_confidence' END AS code FROM d UNION ALL SELECT CASE WHEN n > 0 THEN 'annexes_not_written' END FROM d)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code""")
def warning_counts(spark, sf):
    """Warnings of a run that rendered every document as routed and wrote no annexes."""
    annexes = segmentation.annexes(legal_blocks(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_annexes"))
    docs = _routed(spark, sf).join(annexes, "doc_id", "left")
    yes, nothing = F.lit(True), F.lit(None).cast("boolean")
    codes = rendering.warnings(F.lit(1), yes, nothing, F.col("confidence"), F.col("route"), F.col("route"), F.col("n_annexes"), ~yes, yes)
    return reports.ranked(docs.select(F.explode(codes).alias("code")), "code")


# --- reports -------------------------------------------------------------------------------

_DECISIONS = """SELECT event_id, event_type AS kind, user_id AS doc, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'quoted' END AS rule_verdict, round((event_id % 100) / 100.0, 2)::DOUBLE AS rule_confidence,
 CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'own' WHEN 2 THEN 'own' ELSE 'quoted' END AS verdict, round((event_id % 11) / 11.0, 4)::DOUBLE AS confidence FROM events"""
_ADJUDICATED = f"""d AS ({_DECISIONS}), a AS (SELECT *, rule_confidence < 0.6 AS flagged FROM d),
j AS (SELECT *, flagged AS consulted, flagged AND verdict IS NULL AS abstained, flagged AND verdict IS NOT NULL AND confidence >= 0.6 AND verdict <> rule_verdict AS overridden, flagged AND coalesce(verdict = rule_verdict, false) AS agreed FROM a)"""
_SUMMARY = f"""WITH {_ADJUDICATED}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT flagged) AS rule_only, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE consulted) AS consulted,
 count(*) FILTER (WHERE agreed) AS agreed, count(*) FILTER (WHERE overridden) AS overrode, count(*) FILTER (WHERE consulted AND NOT abstained AND NOT overridden AND NOT agreed) AS overruled, count(*) FILTER (WHERE abstained) AS abstained FROM j)"""


def _decisions(spark, sf):
    e = F.col("event_id")
    rows = _table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("doc"), F.when(e % 3 == 0, "own").otherwise("quoted").alias("rule_verdict"), F.round((e % 100) / 100.0, 2).alias("rule_confidence"), e.cast("string").alias("key")
    )
    answers = _table(spark, sf, "events").where(e % 7 != 0).select(e.cast("string").alias("key"), F.when((e % 7).isin(1, 2), "own").otherwise("quoted").alias("verdict"), F.round((e % 11) / 11.0, 4).alias("confidence"))
    return reports.adjudicate(rows, answers)


@query(f"WITH {_ADJUDICATED} SELECT event_id, consulted, overridden, agreed, CASE WHEN overridden THEN verdict ELSE rule_verdict END AS final FROM j")
def adjudication(spark, sf):
    return _decisions(spark, sf).select("event_id", "consulted", "overridden", "agreed", "final")


@query(f"{_SUMMARY} SELECT *, round(100.0 * flagged / total, 1) AS flagged_pct, round(100.0 * rule_only / total, 1) AS rule_only_pct, round(100.0 * agreed / consulted, 1) AS agreed_pct, round(100.0 * overrode / consulted, 1) AS overrode_pct FROM c")
def decisions_summary(spark, sf):
    return reports.summary(_decisions(spark, sf))


@query(f"{_SUMMARY} SELECT total, rule_only + flagged = total AND agreed + overrode + overruled + abstained = consulted AND consulted <= flagged AS balanced FROM c")
def reconciliation(spark, sf):
    return reports.reconciled(reports.summary(_decisions(spark, sf))).select("total", "balanced")


@query(f"WITH {_ADJUDICATED} SELECT kind, count(*) AS n FROM j WHERE overridden GROUP BY kind")
def overrides_by_kind(spark, sf):
    return reports.ranked(_decisions(spark, sf), "kind", F.col("overridden"))


# --- sources -------------------------------------------------------------------------------

@query(r"""WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r\n?', E'\n', 'g'), '\n(?:[ \t\x0B\f]*\n)+') AS p FROM documents)
SELECT doc_id, CAST(len(list_filter(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) AS BIGINT) AS n FROM d""")
def txt_paragraphs(spark, sf):
    docs = _table(spark, sf, "documents")
    blocks = readers.txt_blocks(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(blocks, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query()
def html_blocks(spark, sf):
    return page_blocks(spark, sf).select("doc_id", "idx", "kind", "text", "style", "outline_level", "num_id", "ilvl", "error")


@query()
def html_inline_xml(spark, sf):
    """Every paragraph of the pages with its formatting and links."""
    pages = _table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    return readers.html_runs(pages).select("doc_id", "idx", rendering.render_inlines(F.col("runs")).alias("xml"))


@query()
def html_outline(spark, sf):
    """Sections of the pages by their heading levels."""
    blocks = page_blocks(spark, sf).where("error is null and kind = 'para'")
    return hierarchy.document_confidence(hierarchy.outlines(quotation.analyse(blocks), units=False))


@query()
def styled_json(spark, sf):
    blocks = page_blocks(spark, sf).where("error is null")
    return readers.styled_json(blocks.withColumn("idx", F.col("idx").cast("long")))


@query(f"WITH legal AS ({LEGAL}) SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM legal GROUP BY doc_id QUALIFY row_number() OVER (ORDER BY doc_id) <= 50")
def corpus_limit(spark, sf):
    """The first 50 documents in order: a limit that is the feature."""
    return legal_blocks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").limit(50)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_counts(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "entry"]
