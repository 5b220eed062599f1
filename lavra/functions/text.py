"""Text functions as columns: folding, slugs, numbers, dates and names of documents.

Everything here is a Catalyst expression, pushed with the projection it sits in; what stands in a
lambda (``let``, and so most of the label grammar) is interpreted rather than compiled. ``fold_exact`` is
the one Arrow function, for text beyond the Latin and punctuation blocks.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _ascii(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


# Latin letters and general punctuation, by rule: what NFKD leaves in ASCII.
_FOLDED = {chr(i): _ascii(chr(i)) for r in (range(0x80, 0x250), range(0x2000, 0x2070)) for i in r}
FOLD_ONE = "".join(c for c, t in _FOLDED.items() if len(t) == 1)
FOLD_ONE_TO = "".join(_FOLDED[c] for c in FOLD_ONE)
FOLD_MANY = {c: t for c, t in _FOLDED.items() if len(t) > 1}

USUAL = "…ªº½¼¾ĳŉǆǉǌǳ"  # of those that fold to several letters, the ones ``fold`` knows
BEYOND = r"[^\x{0}-\x{24F}\x{2000}-\x{206F}]|[" + "".join(c for c in FOLD_MANY if c not in USUAL) + "]"

# Words a slug leaves out, month names, the URN grammar.
SLUG_STOP = ("da", "de", "do", "das", "dos", "e", "a", "o", "as", "os", "em", "no", "na")
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
URN_PART = "[a-z0-9]+(?:[.-][a-z0-9]+)*(?:;[a-z0-9]+(?:[.-][a-z0-9]+)*)*"
URN = f"^urn:lex:({URN_PART}):({URN_PART}):({URN_PART}):([0-9]{{4}}(?:-[0-9]{{2}}-[0-9]{{2}})?);([0-9]+(?:-[0-9]+)?|[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*)(?:!([a-z0-9_]+))?$"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: keeps long expressions small where x occurs in them often."""
    return F.element_at(F.transform(F.array(x), f), 1)


def fold_any(x: Column) -> Column:
    """NFKD, ASCII only, lower case, for any text: columns where they cover it, one Arrow function for the other rows."""
    covered = F.coalesce(~x.rlike(BEYOND), F.lit(True))
    return F.when(covered, fold(x)).otherwise(fold_exact(F.when(~covered, x)))


def fold(x: Column) -> Column:
    """NFKD, ASCII only, lower case, of ASCII, Latin letters and general punctuation; ``fold_any`` takes any text.

    A text of as many bytes as characters is ASCII already.
    """
    wide = x
    for c, t in FOLD_MANY.items():
        if c in USUAL:  # of the rest only the usual ones; others drop to nothing below
            wide = F.replace(wide, F.lit(c), F.lit(t))
    wide = F.regexp_replace(F.translate(wide, FOLD_ONE, FOLD_ONE_TO), r"[^\x00-\x7F]+", "")
    return F.lower(F.when(F.octet_length(x) == F.length(x), x).otherwise(wide))


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii").str.lower()


def squeeze(x: Column) -> Column:
    """No-break spaces and line ends count as blanks; runs of blanks become one."""
    return F.regexp_replace(x, r"(?U)\s+", " ")


def slugify(x: Column) -> Column:
    words = F.split(fold(x), "[^a-z0-9]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*SLUG_STOP)), ".")


def plain_number(x: Column) -> Column:
    """The digits before a slash, without separators and leading zeros; null if there are none."""
    digits = F.regexp_extract(F.regexp_replace(F.split_part(x, F.lit("/"), F.lit(1)), r"[.,\s]", ""), "^([0-9]+)", 1)
    return F.when(digits != "", F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")))


def pt_date(x: Column) -> Column:
    """struct<year, month, day> of the first date form that matches; partial dates are legal, so no DATE."""
    return let(fold(x), _pt_date)


def _pt_date(f: Column) -> Column:
    long = r"(\d{1,2})\s*[o]?\s*de\s+([a-z]+)\s+de\s+(\d{4})"
    slashed, iso, year = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\bde\s+(\d{4})\b"

    def part(pattern, group):
        return F.regexp_extract(f, pattern, group).try_cast("int")

    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(f, long, 2)), F.lit(0)).try_cast("int")

    def made(y, m, d):
        return F.struct(y.alias("year"), m.alias("month"), d.alias("day"))

    none = F.lit(None).try_cast("int")
    return (
        F.when(f.rlike(long) & month.isNotNull(), made(part(long, 3), month, part(long, 1)))
        .when(f.rlike(slashed), made(part(slashed, 3), part(slashed, 2), part(slashed, 1)))
        .when(f.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(f.rlike(year), made(part(year, 1), none, none))
    )


def urn_date(d: Column) -> Column:
    full = F.format_string("%04d-%02d-%02d", d["year"], d["month"], d["day"])
    return F.when(d.isNull(), "0000").when(d["month"].isNull(), F.format_string("%04d", d["year"])).otherwise(full)


def build_urn(locality: Column, authority: Column, kind: Column, date: Column, number: Column, fragment: Column | None = None) -> Column:
    """The document's name; null without authority or kind."""
    base = F.concat(F.lit("urn:lex:"), locality, F.lit(":"), F.nullif(authority, F.lit("")), F.lit(":"), F.nullif(kind, F.lit("")), F.lit(":"), urn_date(date), F.lit(";"), F.coalesce(F.nullif(number, F.lit("")), F.lit("0")))
    return base if fragment is None else F.concat(base, F.when(F.coalesce(fragment, F.lit("")) == "", "").otherwise(F.concat(F.lit("!"), fragment)))


def parse_urn(urn: Column) -> Column:
    """struct of the parts, or null where the grammar doesn't hold."""
    t = F.trim(urn)
    names = ("locality", "authority", "doc_type", "date", "number", "fragment")
    parts = [F.nullif(F.regexp_extract(t, URN, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)]
    return F.when(t.rlike(URN), F.struct(*parts))


def filename_date(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1)
    y, m, d = (F.substring(found, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    return F.when((found != "") & m.between(1, 12) & d.between(1, 31), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def filename_number(name: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^[A-Za-z_]+?_(\d+)(?:_(?:\d{8}|\d{4}))?$", 1)
    return F.when(digits != "", F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")))


def genre(source: Column) -> Column:
    """The leading words of a file's stem, up to the first that starts with a digit; else the whole stem."""
    stem = F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    firsts = F.transform(parts, lambda w: w.rlike("^[0-9]"))
    at = F.array_position(firsts, True)
    head = F.array_join(F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).try_cast("int"))).otherwise(parts), "_")
    return F.when(head == "", stem).otherwise(head)


def truncated(x: Column, limit: int) -> Column:
    flat = F.trim(squeeze(x))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def cache_key(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def upper_ratio(x: Column) -> Column:
    letters, upper = (F.length(F.regexp_replace(x, pattern, "")) for pattern in (r"\P{L}+", r"\P{Lu}+"))
    return F.when(letters == 0, 0.0).otherwise(upper / letters)


def roman(x: Column) -> Column:
    """The value of a strict Roman numeral in either case, or null."""
    return let(F.upper(x), _roman)


def _roman(up: Column) -> Column:
    strict = r"^(?=[MDCLXVI])M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
    total = F.lit(0)
    for letter, value in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True):
        total = total + value * (F.length(up) - F.length(F.replace(up, F.lit(letter), F.lit(""))))
    for before, value in (("IV|IX", 1), ("XL|XC", 10), ("CD|CM", 100)):
        total = total - F.when(up.rlike(before), 2 * value).otherwise(0)
    return F.when(up.rlike(strict), total)
