"""The same semantics in DuckDB SQL, written apart from the Spark plans, to check them against."""

from __future__ import annotations

from ..functions import labels as L
from ..functions.text import FOLD_MANY, FOLD_ONE, FOLD_ONE_TO, MONTHS, SLUG_STOP, URN
from .corpus import LEGAL


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A pattern literal for a regex engine without Unicode flags or look-around."""
    return q(pattern.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)").replace("(?U)", "").replace(r"[\w\s.\-()]", r"[\pL\w\s.\-()]").replace(r"\w+\s+de", r"[\pL\w]+\s+de"))


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"


def group(x: str, pattern: str, i: int) -> str:
    return f"regexp_extract({x}, {rx(pattern)}, {i})"


def cut(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {rx(pattern)}, ''{flags and ', ' + q(flags)})"


def fold(x: str) -> str:
    for c, t in FOLD_MANY.items():
        if c in "…ªº½¼¾ĳŉǆǉǌǳ":
            x = f"replace({x}, {q(c)}, {q(t)})"
    pairs = [(a, b) for a, b in zip(FOLD_ONE, FOLD_ONE_TO, strict=True)]
    return f"lower(regexp_replace(translate({x}, {q(''.join(a for a, _ in pairs))}, {q(''.join(b for _, b in pairs))}), '[^\\x00-\\x7F]', '', 'g'))"


def strip(x: str) -> str:
    return cut(x, r"^\s+|\s+$", "g")


def n_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(regexp_split_to_array({x}, '\\s+')) END"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern)}))"


def heading(x: str) -> str:
    shouted = f"coalesce({count(x, r'\p{Lu}')} / nullif({count(x, r'\p{L}')}, 0), 0) > 0.8"
    return f"({x} <> '' AND NOT ({has(x, '[.;:,]$')} AND {n_words(x)} > 3) AND {n_words(x)} <= 12 AND ({shouted} OR ({n_words(x)} <= 6 AND NOT {has(x, r'\.$')})))"


def names_norm(x: str) -> str:
    return f"(({has(fold(x), L.NORM)} OR {has(x, L.ARTICLE_REFERENCE)}) AND ({has(x, '[:–—-]$')} OR {has(x, '(?i)[\"“]\\s*art')}))"


def roman(x: str) -> str:
    value = "CASE substr(upper({x}), {i}, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END"
    here, after = value.format(x=x, i="i"), value.format(x=x, i="i + 1")
    strict = has(f"upper({x})", r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    return f"CASE WHEN {x} <> '' AND {strict} THEN CAST(list_sum([{here} * CASE WHEN {here} < {after} THEN -1 ELSE 1 END for i in range(1, length({x}) + 1)]) AS INTEGER) END"


LABELLED = f"""
legal AS ({LEGAL}),
body0 AS (SELECT *, {strip(cut('text', '^\\s*[\"“' + "'" + '«]\\s*'))} AS b, {has('text', '^\\s*[\"“' + "'" + '«]')} AS opens FROM legal),
body1 AS (SELECT *, {fold('b')} AS fb FROM body0),
body2 AS (SELECT *, regexp_extract(fb, '^({"|".join(L.DIVISIONS)})', 1) AS division FROM body1),
body3 AS (SELECT *, {cut('substr(b, length(division) + 1)', r'^[ \t\-–—.:]+')} AS tail FROM body2),
body4 AS (SELECT *, {cut("regexp_extract(tail, '^(\\S+)', 1)", '[.\\-–—]+$')} AS bare, regexp_extract(tail, '^(\\S+)', 1) AS word FROM body3),
body5 AS (SELECT *, coalesce({roman('bare')}, CASE WHEN {has('bare', '^[0-9]+$')} THEN CAST(bare AS INTEGER) END) AS ordinal, {cut(group(fold('b'), r'^\s*(\S+)', 1), '^[,.;:]+|[,.;:]+$', 'g')} AS head FROM body4),
label0 AS (SELECT *, CASE
  WHEN b = '' THEN NULL
  WHEN {has('b', L.SOLE_PARAGRAPH)} OR {has('b', L.PARAGRAPH)} THEN 'paragrafo'
  WHEN {has('b', L.ARTICLE)} THEN 'artigo'
  WHEN division <> '' AND ({has(fold('tail'), '^unic[oa]')} OR ordinal IS NOT NULL OR {has('tail', r'^\p{Lu}')}) THEN division
  WHEN head IN ({', '.join(map(q, L.CITATION_HEADS))}) OR {has('b', L.DATE_LIKE)} OR {has('b', L.YEAR_SUFFIX)} THEN NULL
  WHEN {has('b', L.COMPOUND)} THEN 'compound'
  WHEN {has('b', L.NUMERIC_ONLY)} THEN CASE WHEN {has(group('b', L.NUMERIC_ONLY, 1), r'^[1-9][0-9]*(\.[1-9][0-9]*)*$')} AND NOT {has(group('b', L.NUMERIC_ONLY, 1), L.GROUPED)} THEN 'numeric' END
  WHEN {has('b', L.NUMERIC)} THEN CASE WHEN {has(group('b', L.NUMERIC, 1), r'^[1-9][0-9]*(\.[1-9][0-9]*)*$')} AND NOT {has(group('b', L.NUMERIC, 1), L.GROUPED)}
     AND NOT ({group('b', L.NUMERIC, 2)} = '' AND NOT contains({group('b', L.NUMERIC, 1)}, '.') AND NOT {heading(strip(cut('b', L.NUMERIC)))}) THEN 'numeric' END
  WHEN {has('b', L.ROMAN)} AND {roman(group('b', L.ROMAN, 1))} IS NOT NULL THEN 'roman'
  WHEN NOT {has('b', L.ROMAN)} AND {has('b', L.ROMAN_ONLY)} AND {roman(group('b', L.ROMAN_ONLY, 1))} IS NOT NULL THEN 'roman'
  WHEN {has('b', L.ALPHA)} OR {has('b', L.ALPHA_ONLY)} THEN 'alpha'
  WHEN {has('b', L.ORDINAL_ONLY)} OR {has('b', L.ORDINAL)} THEN 'ordinal' END AS kind FROM body5),
labels AS (SELECT *, CASE kind
  WHEN 'paragrafo' THEN CASE WHEN {has('b', L.SOLE_PARAGRAPH)} THEN '1' ELSE CAST(CAST({group('b', L.PARAGRAPH, 1)} AS INTEGER) AS VARCHAR) END
  WHEN 'artigo' THEN CAST(CAST({group('b', L.ARTICLE, 1)} AS INTEGER) AS VARCHAR)
  WHEN 'compound' THEN (ascii({group('b', L.COMPOUND, 1)}) - 96) || '.' || CAST({group('b', L.COMPOUND, 2)} AS INTEGER)
  WHEN 'numeric' THEN {group('b', r'^\s*([0-9]{1,3}(?:\.[0-9]{1,3})*)', 1)}
  WHEN 'roman' THEN CAST({roman(group('b', r'(?i)^\s*([IVXLCDM]{1,7})', 1))} AS VARCHAR)
  WHEN 'alpha' THEN CAST(ascii(substr(b, 1, 1)) - 96 AS VARCHAR)
  WHEN 'ordinal' THEN CAST(CAST({group('b', r'^\s*([0-9]{1,3})', 1)} AS INTEGER) AS VARCHAR)
  ELSE CASE WHEN kind IS NOT NULL THEN CASE WHEN {has(fold('tail'), '^unic[oa]')} THEN '1' ELSE coalesce(CAST(ordinal AS VARCHAR), '1') END END END AS value,
  CASE kind WHEN 'roman' THEN {strip(cut('b', L.ROMAN))} WHEN 'alpha' THEN {strip(cut('b', L.ALPHA))} WHEN 'compound' THEN {strip(cut('b', L.COMPOUND))} END AS rest FROM label0)"""

ANALYSED = f"""{LABELLED},
modes AS (SELECT doc_id, indent, count(*) AS n, min(idx) AS f FROM legal GROUP BY ALL),
modal AS (SELECT doc_id, arg_max(indent, n * 1000000 - f) AS modal_indent, sum(n) AS n_blocks FROM modes GROUP BY doc_id),
bands AS (SELECT m.doc_id, any_value(modal_indent) AS modal_indent,
  CASE WHEN any_value(n_blocks) >= 3 AND coalesce(sum(n) FILTER (WHERE indent >= modal_indent + 300), 0) >= 3 THEN 'deviation' ELSE 'none' END AS rule,
  min(indent) FILTER (WHERE indent >= modal_indent + 300) AS low, max(indent) FILTER (WHERE indent >= modal_indent + 300) AS top
  FROM modes JOIN modal m USING (doc_id) GROUP BY m.doc_id),
articles AS (SELECT doc_id, idx, CAST(nullif({group(strip('text'), L.ARTICLE, 1)}, '') AS INTEGER) AS article_no FROM legal),
series AS (SELECT doc_id, idx, article_no, lag(article_no) OVER (PARTITION BY doc_id ORDER BY idx) AS prior, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM articles WHERE article_no IS NOT NULL),
monotony AS (SELECT doc_id, count(*) AS n_articles, count(*) >= 2 AND max(CASE WHEN rn = 1 THEN article_no END) <= 2 AND bool_and(prior IS NULL OR (article_no > prior AND article_no - prior <= 3)) AS monotonic FROM series GROUP BY doc_id),
cues AS (SELECT l.*, a.article_no, bands.rule, coalesce(n_articles, 0) AS n_articles, coalesce(monotonic, false) AS monotonic,
  rule = 'deviation' AND indent BETWEEN low AND top AS in_band,
  {has(strip('text'), L.OMISSIS_BRACKETED)} OR {has(strip('text'), L.OMISSIS)} AS elision, {has(strip('text'), L.OMISSIS_TRAILING)} AS elided_end,
  coalesce({names_norm(strip('lag(text) OVER (PARTITION BY l.doc_id ORDER BY l.idx)'))}, false) AS antecedent
  FROM labels l JOIN articles a USING (doc_id, idx) JOIN bands USING (doc_id) LEFT JOIN monotony USING (doc_id)),
first_pass AS (SELECT *, in_band OR opens OR elision OR elided_end OR (antecedent AND article_no IS NOT NULL AND NOT monotonic) AS q1,
  kind IN ({', '.join(map(q, ('numeric', 'unit', 'capitulo', 'secao', 'subsecao', 'titulo', 'livro', 'parte')))}) OR (kind IN ('roman', 'alpha', 'compound') AND {heading('rest')}) AS closes FROM cues),
events AS (SELECT *, CASE WHEN q1 THEN CASE WHEN article_no IS NOT NULL OR elision THEN 1 END WHEN coalesce(closes, false) THEN 0 END AS event FROM first_pass),
second_pass AS (SELECT *, q1 OR (rule = 'none' AND n_articles > 0 AND NOT monotonic AND
  coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1) AS q2 FROM events),
heads AS (SELECT *, {group(strip('text'), L.NORM_HEAD, 1)} <> '' AND {has(f"substr({strip('text')}, length({group(strip('text'), L.NORM_HEAD, 0)}) + 1, 14)", L.HEAD_ARTICLE)} AS norm_head FROM second_pass),
analysed AS (SELECT *, q2 OR (norm_head AND coalesce(lead(q2) OVER (PARTITION BY doc_id ORDER BY idx), false)) AS quoted FROM heads)"""

CENSUS = f"""{ANALYSED},
own AS (SELECT doc_id, min(idx) FILTER (WHERE article_no IS NOT NULL AND NOT quoted) AS first_own FROM analysed GROUP BY doc_id),
census AS (SELECT doc_id, count(*) AS n_body, count(article_no) AS n_found, count(*) FILTER (WHERE article_no IS NOT NULL AND quoted) AS n_quoted,
  count(*) FILTER (WHERE article_no IS NOT NULL AND NOT quoted) AS n_own, bool_or(monotonic) AS monotonic, count(*) FILTER (WHERE idx >= first_own) AS n_covered
  FROM analysed JOIN own USING (doc_id) GROUP BY doc_id),
gated AS (SELECT *, CASE WHEN n_own > 0 THEN round(n_covered / n_body, 4) ELSE 0 END AS coverage FROM census),
blocked AS (SELECT *, list_filter([CASE WHEN n_found = 0 THEN 'no_articles' END, CASE WHEN n_found > 0 AND n_own = 0 THEN 'all_articles_quoted' END,
  CASE WHEN n_found > 0 AND NOT monotonic THEN 'non_monotonic_series' END, CASE WHEN n_own > 0 AND coverage < 0.6 THEN 'low_coverage' END], lambda x: x IS NOT NULL) AS blockers FROM gated),
routed AS (SELECT *, CASE WHEN n_own >= 1 AND monotonic AND coverage >= 0.6 AND len(blockers) = 0 THEN 'norma' ELSE 'generico' END AS route,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(0.30::DOUBLE + CASE WHEN n_own > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN n_own >= 2 THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN n_found > 0 THEN CASE WHEN monotonic THEN 0.15::DOUBLE ELSE -0.20::DOUBLE END ELSE 0 END + CASE WHEN n_found > 0 AND n_own = 0 THEN -0.35::DOUBLE ELSE 0 END
  + CASE WHEN n_own > 0 THEN round(0.20::DOUBLE * (coverage - 0.6::DOUBLE) / 0.4::DOUBLE, 4) ELSE 0 END + round(-0.05::DOUBLE * len(blockers), 4), 4))) AS p_norma FROM blocked)"""


def slug(x: str) -> str:
    words = f"regexp_split_to_array({fold(x)}, '[^a-z0-9]+')"
    return f"array_to_string([w for w in {words} if w <> '' AND w NOT IN ({', '.join(map(q, SLUG_STOP))})], '.')"


def plain_number(x: str) -> str:
    digits = f"regexp_extract(regexp_replace(split_part({x}, '/', 1), '[.,\\s]', '', 'g'), '^([0-9]+)', 1)"
    return f"CASE WHEN {digits} = '' THEN NULL ELSE coalesce(nullif(regexp_replace({digits}, '^0+', ''), ''), '0') END"


def date_parts(x: str) -> tuple[str, str, str]:
    f = fold(x)
    long, slashed, iso, year = r"([0-9]{1,2})\s*[o]?\s*de\s+([a-z]+)\s+de\s+([0-9]{4})", r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\b", r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", r"\bde\s+([0-9]{4})\b"
    month = f"nullif(coalesce(list_position([{', '.join(map(q, MONTHS))}], {group(f, long, 2)}), 0), 0)"

    def pick(a, b, c, d):
        return f"CASE WHEN {has(f, long)} AND {month} IS NOT NULL THEN {a} WHEN {has(f, slashed)} THEN {b} WHEN {has(f, iso)} THEN {c} WHEN {has(f, year)} THEN {d} END"

    def n(p, i):
        return f"CAST(nullif({group(f, p, i)}, '') AS INTEGER)"

    return pick(n(long, 3), n(slashed, 3), n(iso, 1), n(year, 1)), pick(f"CAST({month} AS INTEGER)", n(slashed, 2), n(iso, 2), "NULL"), pick(n(long, 1), n(slashed, 1), n(iso, 3), "NULL")


__all__ = ["ANALYSED", "CENSUS", "LABELLED", "URN"]
