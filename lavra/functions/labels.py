"""The label grammar of headings as one CASE expression, and predicates on single paragraphs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let, roman, upper_ratio

# Opening quotes, label shapes, words that start a citation or name a norm.
QUOTES = "[\"“'«]"
BLANKS = " \t\n\x0b\f\r"
ARTICLE = r"(?i)^\s*[\"“'«]?\s*Art\.?\s*([0-9]+)\s*[ºo°]?\s*(-\s*[A-Z])?\s*[.\-–—)]?\s*"
PARAGRAPH = r"^\s*[\"“'«]?\s*§\s*([0-9]+)\s*[ºo°]?\s*(-\s*[A-Z])?\s*[.\-–—)]?\s*"
SOLE_PARAGRAPH = r"(?iu)^\s*[\"“'«]?\s*par[áa]grafo\s+[úu]nico\s*[.\-–—:]?\s*"
NUMERIC = r"^\s*([0-9]{1,3}(?:\.[0-9]{1,3})*)\s*([.)\-–—])?\s+"
NUMERIC_ONLY = r"^\s*([0-9]{1,3}(?:\.[0-9]{1,3})*)\s*([.)\-–—])?\s*$"
ROMAN = r"(?i)^\s*([IVXLCDM]{1,7})\s*([.)\-–—])\s+"
ROMAN_ONLY = r"^\s*([IVXLCDM]{1,7})\s*([.)\-–—])\s*$"
ALPHA = r"^\s*([a-z])\s*([.)])\s+"
ALPHA_ONLY = r"^\s*([a-z])\s*([.)])\s*$"
COMPOUND = r"^\s*([a-z])\s*[.)]\s*([0-9]{1,3})\s*([.)])\s+"
ORDINAL = r"^\s*([0-9]{1,3})\s*[ºo°ª]\s*([.)\-–—])?\s+"
ORDINAL_ONLY = r"^\s*([0-9]{1,3})\s*[ºo°ª]\s*([.)\-–—])?\s*$"
UNIT = r"(?iu)^\s*([^0-9\n]{2,60}?)\s*(?:n[ºo°]\.?|n\.)\s*([0-9]{1,4})\s*$"
LETTERED = r"^[A-Za-z]{1,7}\s*[.)\-–—]"  # how any label of letters starts
DATE_LIKE = r"^\s*[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\s*[.\-–—]?\s*$"
YEAR_SUFFIX = r"^\s*[0-9]{1,4}\s*/\s*[0-9]{4}"
GROUPED = r"[0-9]\.[0-9]{3}([^0-9]|$)"
DIVISIONS = ("subsecao", "secao", "capitulo", "titulo", "livro", "parte")
CITATION_HEADS = (
    "lei", "leis", "decreto", "decretos", "decreto-lei", "medida", "emenda", "constituicao", "portaria", "instrucao", "resolucao",
    "ato", "parecer", "acordao", "processo", "recurso", "agravo", "sumula", "oficio", "nota", "circular",
)
NORM_WORDS = (
    "lei", "leis", "decreto", "decreto-lei", "medida provisoria", "emenda constitucional", "constituicao", "constitucional", "constitucionais",
    "portaria", "instrucao normativa", "resolucao", "ato declaratorio", "codigo", "estatuto", "regimento", "sumula", "acordao",
)
NORM = r"\b(" + "|".join(NORM_WORDS) + r")\b"
ARTICLE_REFERENCE = r"(?i)\bart(?:igo)?s?\.?\s*[0-9]"
OMISSIS = r"^[\s.·…]*(?:\.\s*){4,}[\s.·…]*$"
OMISSIS_BRACKETED = r"^\s*[\(\[]\s*(?:\.{2,}|…)\s*[\)\]]\s*$"
OMISSIS_TRAILING = r"(?:\.\s*){6,}\s*$|…\s*$|\(\s*(?:\.{3}|…)\s*\)\s*$"
NORM_NAMES = (
    r"leis?", r"decretos?(?:[-\s]leis?)?", r"medidas?\s+provis[oó]rias?", r"emendas?\s+constitucionais?", r"constitui[cç][aã]o", r"portarias?",
    r"instru[cç][oõ]es?\s+normativas?", r"instru[cç][aã]o\s+normativa", r"resolu[cç][oõ]es?", r"resolu[cç][aã]o", r"atos?\s+declarat[oó]rios?",
    r"c[oó]digos?", r"estatutos?", r"regimentos?", r"s[uú]mulas?", r"ac[oó]rd[aã]os?",
)
NORM_HEAD = (
    r"(?iuU)^[\s\"“”'«]*((?:" + "|".join(NORM_NAMES) + r")(?:\s+complementar(?:es)?)?[\s,]*(?:n[oº°]?\.?\s*)?[0-9][0-9.]*(?:[º°]|-[A-Z])?"
    r"(?:\s*,?\s*de\s+[0-9]{1,2}\s+de\s+\w+\s+de\s+[0-9]{4}|\s*,?\s*de\s+[0-9]{4})?)"
)
NORM_FIRST = "acdeilmprs"  # how the names above start
HEAD_ARTICLE = r"(?iu)^[\s,;:.\-–—\"“”']*art(?:igo)?\.?\s*[0-9]"
HEAD_WINDOW = 14
MAX_HEADING_WORDS, MAX_PROSE_WORDS, MAX_PROSE_CHARS, MIN_UPPER = 12, 7, 60, 0.85


def stripped(text: Column) -> Column:
    """Without blanks at either end; ``btrim`` takes a whole text apart, so it sees only those that may have some."""
    blank = (F.ascii(text) <= ord(" ")) | reduce(or_, [text.endswith(c) for c in BLANKS])
    return F.when(blank, F.btrim(text, F.lit(BLANKS))).otherwise(text)


def has_text(text: Column) -> Column:
    """Whether a text holds anything but blanks. It names the text once: as a filter it is pushed into what makes the text, written out as often as it is named."""
    return text.rlike(f"[^{BLANKS}]")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, rf"^\s*{QUOTES}\s*", "")


def n_words(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+")))


def looks_like_heading(text: Column) -> Column:
    def shape(t: Column) -> Column:
        n = n_words(t)
        return (t != "") & ~(t.rlike("[.;:,]$") & (n > 3)) & (n <= MAX_HEADING_WORDS) & (((n <= 6) & ~t.rlike(r"\.$")) | (upper_ratio(t) > 0.8))

    return F.coalesce(let(stripped(text), shape), F.lit(False))


def _starts(t: Column, marks: str) -> Column:
    """Whether a text starts with one of the characters: what this rules out, no pattern need search."""
    return reduce(or_, [t.startswith(c) for c in marks])


def _ends(t: Column, marks: str) -> Column:
    """Whether a text ends with one of the characters, or with a line end beyond ASCII, before which ``$`` holds too."""
    return reduce(or_, [t.endswith(c) for c in marks + "\x85\u2028\u2029"])


def ends_in_digit(t: Column) -> Column:
    """Whether a stripped text may end in a digit, as ``$`` has it."""
    return _ends(t, "0123456789")


def opens_with_quote(text: Column) -> Column:
    return text.rlike(rf"^\s*{QUOTES}")


def is_omissis(text: Column) -> Column:
    t = stripped(text)
    return (t != "") & ((_starts(t, "([") & t.rlike(OMISSIS_BRACKETED)) | (_starts(t, ".·…") & t.rlike(OMISSIS)))


def carries_omissis(text: Column) -> Column:
    t = stripped(text)
    return (t != "") & _ends(t, ".…)") & t.rlike(OMISSIS_TRAILING)


def names_norm(text: Column) -> Column:
    """Announces a norm: names one, or an article, and ends in a colon or dash or opens a quoted article."""
    whole = stripped(text)
    likely = _ends(whole, ":–—-") | whole.contains("\"") | whole.contains("“")
    return likely & let(whole, lambda t: (t.rlike("[:–—-]$") | t.rlike("(?i)[\"“]\\s*art")) & (t.rlike(ARTICLE_REFERENCE) | fold(t).rlike(NORM)))


def quotation_head(text: Column) -> Column:
    """The norm a paragraph names right before one of its articles, else null."""
    t = stripped(text)
    first = F.ascii(t)  # beyond ASCII it may be a blank, a quote or a letter in another case
    likely = (first >= 128) | first.isin(*(ord(c) for c in "\"'" + NORM_FIRST + NORM_FIRST.upper()))
    return F.when(likely & t.rlike("[0-9]"), let(t, _norm_head))


def _norm_head(t: Column) -> Column:
    norm = F.regexp_extract(t, NORM_HEAD, 1)
    lead = F.length(F.regexp_extract(t, NORM_HEAD, 0))
    after = F.substring(t, lead + 1, F.lit(HEAD_WINDOW))
    return F.when((norm != "") & after.rlike(HEAD_ARTICLE), F.nullif(F.regexp_replace(norm, "[ ,;:\\-–—\"“”]+$", ""), F.lit("")))


def is_citation(text: Column) -> Column:
    head = F.regexp_extract(fold(unquoted(text)), r"^\s*(\S+)", 1)
    return F.regexp_replace(head, "^[,.;:]+|[,.;:]+$", "").isin(*CITATION_HEADS)


def article_number(text: Column) -> Column:
    return F.when(_starts(stripped(text), "aA\"“'«"), let(stripped(text), lambda t: F.nullif(F.regexp_extract(t, ARTICLE, 1), F.lit("")).try_cast("int")))


def parse_label(text: Column, unit_heads: Column | None = None) -> Column:
    """struct<kind, value array<int>, rest, separator, unit_head, quoted>, or null for no label."""
    quoted = opens_with_quote(text)
    return let(stripped(unquoted(text)), lambda body: _label(body, quoted, unit_heads))


def with_unit(label: Column, text: Column, head: Column) -> Column:
    """A label parsed without unit series, once the line is known to belong to the series of ``head`` (null: to none)."""
    body = stripped(unquoted(text))
    is_unit = head.isNotNull() & body.rlike(UNIT) & (stripped(fold(F.regexp_extract(body, UNIT, 1))) == head) & ~F.coalesce(label["kind"].isin("paragrafo", "artigo", *DIVISIONS), F.lit(False))
    unit = _made("unit", F.array(F.regexp_extract(body, UNIT, 2).try_cast("int")), F.lit(""), opens_with_quote(text), None, head)
    return F.when(F.coalesce(is_unit, F.lit(False)), unit).otherwise(label)


def _made(kind, value, rest, quoted, separator=None, head=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"), rest.alias("rest"),
        (none if separator is None else separator).alias("separator"), (none if head is None else head).alias("unit_head"), quoted.alias("quoted"),
    )


def _division(body: Column, folded: Column, quoted: Column) -> Column:
    """Títulos, capítulos, seções: a numeral, ``único``, or a name in capitals after the unit's name."""
    division = F.regexp_extract(folded, "^(" + "|".join(DIVISIONS) + ")", 1)
    one = F.array(F.lit(1))

    def named(tail: Column) -> Column:
        word = F.regexp_extract(tail, r"^(\S+)", 1)
        after = stripped(F.substring(tail, F.length(word) + 1, F.length(tail)))
        return let(
            F.regexp_replace(word, "[.\\-–—]+$", ""),
            lambda bare: F.when(tail.rlike("(?iu)^[úu]nic[oa]"), _made(division, one, after, quoted))
            .when(bare.rlike("(?i)^[ivxlcdm]+$") & roman(bare).isNotNull(), _made(division, F.array(roman(bare)), after, quoted))
            .when(bare.rlike("^[0-9]+$"), _made(division, F.array(bare.try_cast("int")), after, quoted))
            .when(tail.rlike(r"^\p{Lu}"), _made(division, one, stripped(tail), quoted)),
        )

    tail = F.regexp_replace(F.substring(body, F.length(division) + 1, F.length(body)), r"^[ \t\-–—.:]+", "")
    return F.when(division != "", let(tail, named))


def _numeric(body: Column, quoted: Column, pattern: str, only: bool) -> Column:
    def made(digits: Column) -> Column:
        separator = F.nullif(F.regexp_extract(body, pattern, 2), F.lit(""))
        parts = F.split(digits, r"\.")
        rest = F.lit("") if only else stripped(F.regexp_replace(body, pattern, ""))
        valid = digits.rlike(r"^[1-9][0-9]*(\.[1-9][0-9]*)*$") & ~digits.rlike(GROUPED)
        loose = F.lit(False) if only else separator.isNull() & (F.size(parts) == 1) & ~looks_like_heading(rest)
        return F.when(valid & ~loose, _made("numeric", parts.try_cast("array<int>"), rest, quoted, separator))

    return let(F.regexp_extract(body, pattern, 1), made)


def _label(body: Column, quoted: Column, unit_heads: Column | None) -> Column:
    def group(pattern, i):
        return F.regexp_extract(body, pattern, i)

    def number(pattern, i):
        return F.array(group(pattern, i).try_cast("int"))

    def rest_of(pattern):
        return stripped(F.regexp_replace(body, pattern, ""))

    def letter(pattern):
        return F.ascii(group(pattern, 1)) - 96

    def plain(kind, pattern, value, only=False):
        return _made(kind, value, F.lit("") if only else rest_of(pattern), quoted, F.nullif(group(pattern, 2), F.lit("")))

    # what the first character rules out isn't searched for; beyond ASCII it may fold to anything or nothing
    first = F.ascii(body)

    def opens(letters: str) -> Column:
        return first.isin(*(ord(c) for c in letters + "\"“'«"))

    two = F.substring(body, 1, 2)
    named = (F.octet_length(two) > F.length(two)) | F.lower(two).isin(*sorted({d[:2] for d in DIVISIONS}))
    division = F.when(named, let(fold(body), lambda folded: _division(body, folded, quoted)))
    start = (
        F.when(body == "", None)
        .when(opens("pP") & body.rlike(SOLE_PARAGRAPH), _made("paragrafo", F.array(F.lit(1)), rest_of(SOLE_PARAGRAPH), quoted))
        .when(opens("§") & body.rlike(PARAGRAPH), _made("paragrafo", number(PARAGRAPH, 1), rest_of(PARAGRAPH), quoted))
        .when(opens("aA") & body.rlike(ARTICLE), _made("artigo", number(ARTICLE, 1), rest_of(ARTICLE), quoted))
        .otherwise(division)
    )
    unit = F.lit(None)
    if unit_heads is not None:
        head = stripped(fold(group(UNIT, 1)))
        unit = F.when(body.rlike(UNIT) & F.array_contains(unit_heads, head), _made("unit", number(UNIT, 2), F.lit(""), quoted, None, head))
    digits = (
        F.when(body.rlike(DATE_LIKE) | body.rlike(YEAR_SUFFIX), None)
        .when(body.rlike(NUMERIC_ONLY), _numeric(body, quoted, NUMERIC_ONLY, True))
        .when(body.rlike(NUMERIC), _numeric(body, quoted, NUMERIC, False))
        .when(body.rlike(ORDINAL_ONLY), plain("ordinal", ORDINAL_ONLY, number(ORDINAL_ONLY, 1), True))
        .when(body.rlike(ORDINAL), plain("ordinal", ORDINAL, number(ORDINAL, 1)))
    )
    letters = (
        F.when(is_citation(F.regexp_extract(body, r"^\S+", 0)), None)  # a letter comes first here, so the first word decides
        .when(body.rlike(COMPOUND), _made("compound", F.array(letter(COMPOUND), group(COMPOUND, 2).try_cast("int")), rest_of(COMPOUND), quoted, group(COMPOUND, 3)))
        .when(body.rlike(ROMAN) & roman(group(ROMAN, 1)).isNotNull(), plain("roman", ROMAN, F.array(roman(group(ROMAN, 1)))))
        .when(~body.rlike(ROMAN) & body.rlike(ROMAN_ONLY) & roman(group(ROMAN_ONLY, 1)).isNotNull(), plain("roman", ROMAN_ONLY, F.array(roman(group(ROMAN_ONLY, 1))), True))
        .when(body.rlike(ALPHA), plain("alpha", ALPHA, F.array(letter(ALPHA))))
        .when(body.rlike(ALPHA_ONLY), plain("alpha", ALPHA_ONLY, F.array(letter(ALPHA_ONLY)), True))
    )
    is_letter = first.between(ord("A"), ord("Z")) | first.between(ord("a"), ord("z"))
    series = F.when(first.between(ord("0"), ord("9")), digits).when(is_letter & body.rlike(LETTERED), letters)
    return F.coalesce(start, series) if unit_heads is None else F.coalesce(start, unit, series)


def style_level(style: Column, outline: Column) -> Column:
    n = F.nullif(F.regexp_extract(fold(style), r"^(heading|titulo|header)\s*([0-9]+)", 2), F.lit("")).try_cast("int")
    return F.coalesce(outline, n - 1)


def is_style_heading(style: Column, outline: Column) -> Column:
    return F.coalesce(outline.isNotNull() | fold(style).rlike("^(heading|titulo)"), F.lit(False))


def is_prose_header(text: Column, style: Column, outline: Column, quoted: Column) -> Column:
    t = stripped(text)
    return (
        ~quoted & outline.isNull() & style_level(style, outline).isNull() & (t != "") & (F.length(t) <= MAX_PROSE_CHARS)
        & (n_words(t) <= MAX_PROSE_WORDS) & t.rlike(r"\p{L}") & (upper_ratio(t) >= MIN_UPPER) & parse_label(t).isNull()
    )
