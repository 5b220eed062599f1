r"""Secret scan (DataFrame operations only): fixed shapes, then a randomness test battery.

Base spans are the leftmost non-overlapping matches of three shapes: ``assign`` (a keyword,
a separator and a value of 12 or more characters; the span is the whole match), ``access``
(``AKIA`` and 14 or more of ``[A-Z0-9]``) and ``hex`` (16 or more of ``[0-9a-f]``).

The battery adds spans of kind ``random``: runs of 20 or more of ``[A-Za-z0-9+/_=-]`` holding
a letter and a digit, or what base spans leave of such a run if that is as long. Their encoding is inferred as the
smallest alphabet holding every character (hex, base32, alphanumeric, base64 standard or URL-safe; a run
that mixes the last two has none and isn't random). Against the hypothesis
that the characters are uniform draws from that alphabet, three tests are run: chi-squared
uniformity of the alphabet (Wilson-Hilferty from five draws a letter on; below that its equivalent, the number
of equal pairs, which is then nearly Poisson), runs above and below the alphabet's middle, and
lag-one serial correlation. The smallest of the three p-values, times three, is the token's
p-value. Within each length stratum a Benjamini-Hochberg step at ``q`` over the tokens of the
whole corpus rejects the hypothesis; tokens it doesn't reject are random and so reported.
Stratifying by length keeps short, weak tests from deciding for the long ones. The step works
on a histogram of p-values (rounded up to a third of an octave, down to 1e-300, so that no
more is rejected than by exact p-values).

Texts are scanned twice, for the histogram and for the spans; only the thresholds, one number a
stratum, pass between, so nothing found is ever written and no row leaves its task.

Positions come from the pieces between matches: a match starts where the pieces and matches
before it end. They count code points and ends are exclusive.

Defined results: null text counts as empty and has no spans; an empty table gives no rows;
rows that repeat, or share an id, are reported each for itself; spans of one start are ordered by kind; extra
columns are ignored; whole texts are scanned, very long ones too, matches being located in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text

# The three shapes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex")
# Alphabets in the order they are tried.
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", ALNUM),
    ("base64", ALNUM + "+/"),
    ("base64url", ALNUM + "-_"),
)
LEAST = 20  # characters of a token
BINS = 2_990  # p-value bins of a third of an octave each, down to 1e-300
STRATA = (20, 24, 32, 40, 48, 64, 96, 128)
CHUNK = 512  # matches located by one fold
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"


def spans_of(text: str, pattern: str, kind: str, order: int, least: str | None = None) -> Column:
    """array<struct<start, ord, end, kind, value>> of the pattern's matches; ``least``: a condition on ``m``."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    keep = f"filter(spans, s -> {least})" if least else "spans"
    return F.expr(
        f"""case when {text} rlike '{p}' then
        transform({keep.replace('spans', _located(text, p))},
          s -> named_struct('start', s.start, 'ord', {order}, 'end', s.start + length(s.m), 'kind', '{kind}', 'value', s.m))
        else cast(array() as array<struct<start:int,ord:int,end:int,kind:string,value:string>>) end"""
    )


def _located(text: str, p: str) -> str:
    """array<struct<start, m>> of the matches: gaps and matches are added up within chunks, then chunks are moved
    on by what lies before them, so that long lists aren't copied once a match."""
    pieces = f"""element_at(transform(array(regexp_extract_all({text}, '{p}', 0)), ms ->
        zip_with(slice(split({text}, '{p}', -1), 1, size(ms)), ms, (g, m) -> named_struct('g', length(g), 'm', m))), 1)"""
    within = """aggregate(c, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,m:string>>)),
        (a, x) -> named_struct('at', a.at + x.g + length(x.m), 'out', concat(a.out, array(named_struct('start', a.at + x.g, 'm', x.m)))))"""
    return f"""element_at(transform(array({pieces}), ps -> element_at(transform(array(
          transform(transform(sequence(0, cast((size(ps) - 1) div {CHUNK} as int)), i -> slice(ps, i * {CHUNK} + 1, {CHUNK})), c -> {within})), cs ->
        flatten(aggregate(cs, named_struct('at', 0, 'out', cast(array() as array<array<struct<start:int,m:string>>>)),
          (a, c) -> named_struct('at', a.at + c.at, 'out', concat(a.out, array(transform(c.out, x -> named_struct('start', x.start + a.at, 'm', x.m))))),
          a -> a.out))), 1)), 1)"""


def _base(text: str = "text") -> list[Column]:
    value = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    return [
        spans_of(text, ASSIGN, "assign", 0, f"length(regexp_extract(s.m, '{value}', 2)) >= 12"),
        spans_of(text, ACCESS, "access", 1),
        spans_of(text, HEX, "hex", 2),
    ]


def _normal_sf(z: Column) -> Column:
    """P(Z > z) for z >= 0 (Abramowitz and Stegun 26.2.17, error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def tested(value: Column) -> Column:
    """struct<encoding, chi_p, runs_p, serial_p, p> of a token; null if no alphabet holds it."""
    stripped = F.rtrim(value, F.lit("="))
    return let(F.when(F.length(stripped) > 1, stripped).otherwise(value), _encoded)


def _encoded(body: Column) -> Column:
    which = F.lit(None).cast("int")
    for i in reversed(range(len(ALPHABETS))):
        which = F.when(F.translate(body, ALPHABETS[i][1], "") == "", i).otherwise(which)
    names = F.array(*[F.lit(name) for name, _ in ALPHABETS])
    letters = F.array(*[F.lit(x) for _, x in ALPHABETS])

    def of(i: Column) -> Column:
        alphabet = F.get(letters, i)
        x = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
        return F.when(i.isNotNull(), let(x, lambda x: _statistics(F.get(names, i), x, F.length(alphabet).cast("double"))))

    return let(which, of)


def _statistics(name: Column, x: Column, k: Column) -> Column:
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(x) - F.size(F.array_remove(x, v)), F.lit(2)))
    steps = F.sequence(F.lit(1), F.size(x) - 1)
    changes = F.size(F.filter(steps, lambda i: (F.get(x, i) >= k / 2) != (F.get(x, i - 1) >= k / 2))).cast("double")
    mid = (k - 1) / 2
    serial = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(x, i) - mid) * (F.get(x, i - 1) - mid))
    counts = F.struct(F.size(x).cast("double").alias("n"), k.alias("k"), squares.alias("squares"), changes.alias("changes"), serial.alias("serial"))
    return let(counts, lambda c: let(_p_values(c), lambda t: F.struct(
        name.alias("encoding"), t["chi_p"].alias("chi_p"), t["runs_p"].alias("runs_p"), t["serial_p"].alias("serial_p"),
        F.least(F.lit(1.0), 3 * F.least(t["chi_p"], t["runs_p"], t["serial_p"])).alias("p"),
    )))


def _p_values(c: Column) -> Column:
    n, k, squares = c["n"], c["k"], c["squares"]
    # chi-squared over the letters, dense: Wilson-Hilferty
    df = k - 1
    dense = (F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # sparse: P(Poisson >= equal pairs) = P(chi-squared of twice as many degrees <= twice the mean), by the same formula
    pairs, mean = (squares - n) / 2, n * (n - 1) / (2 * k)
    sparse = (1 - 1 / (9 * pairs) - F.pow(mean / pairs, F.lit(1 / 3))) * 3 * F.sqrt(pairs)
    z = F.when(n >= 5 * k, dense).when(pairs >= 1, sparse)
    chi_p = let(z, lambda z: F.when(z.isNull(), F.lit(1.0)).otherwise(_upper(z)))
    # runs: changes between the lower and the upper half are Binomial(n - 1, 1/2) under the hypothesis
    runs_p = let(F.abs(c["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4), lambda z: F.least(F.lit(1.0), 2 * _normal_sf(z)))
    # serial correlation: the lag-one sum of centred values has variance (n - 1) s^4
    serial_p = let(F.abs(c["serial"]) / (F.sqrt(n - 1) * (k * k - 1) / 12), lambda z: F.least(F.lit(1.0), 2 * _normal_sf(z)))
    return F.struct(chi_p.alias("chi_p"), runs_p.alias("runs_p"), serial_p.alias("serial_p"))


def _upper(z: Column) -> Column:
    return F.when(z > 0, _normal_sf(z)).otherwise(1 - _normal_sf(-z))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, chi_p, runs_p, serial_p and p to rows with a ``value`` column; rows outside all alphabets go."""
    return tokens.withColumn("t", tested(F.col("value"))).where("t is not null").select(*[c for c in tokens.columns if c != "t"], "t.*")


def _stratum(value: Column) -> Column:
    out = F.lit(STRATA[0])
    for least in STRATA[1:]:
        out = F.when(F.length(value) >= least, F.lit(least)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * 3)).cast("int")


def thresholds(bins: DataFrame, q: float) -> DataFrame:
    """Per stratum the smallest bin whose tokens a Benjamini-Hochberg step rejects (bins run towards small p)."""
    hist = bins.groupBy("stratum", "bin").agg(F.count("*").alias("n"))  # at most len(STRATA) * (BINS + 1) rows
    below = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = hist.withColumn("rank", F.sum("n").over(below)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    upper = F.pow(F.lit(2.0), -F.col("bin") / 3)  # the largest p of the bin
    return ranked.where(upper <= q * F.col("rank") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("cut"))


def _outside(token: Column, base: Column) -> Column:
    """What base spans (in order) leave of a token, as spans."""
    over = F.filter(base, lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))

    def rest(cut: Column) -> Column:
        ends = F.concat(F.transform(cut, lambda b: b["start"]), F.array(token["end"]))
        starts = F.transform(ends, lambda e, i: F.greatest(token["start"], F.array_max(F.transform(F.slice(cut, F.lit(1), i), lambda b: b["end"]))))
        spans = F.zip_with(starts, ends, lambda a, e: F.struct(
            a.alias("start"), token["ord"].alias("ord"), e.alias("end"), token["kind"].alias("kind"),
            F.substr(token["value"], a - token["start"] + 1, F.greatest(e - a, F.lit(0))).alias("value"),
        ))
        return F.filter(spans, lambda s: (s["end"] - s["start"] >= LEAST) & s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))

    return let(over, lambda cut: F.when(F.size(cut) == 0, F.array(token)).otherwise(rest(cut)))


def _scanned(texts: DataFrame) -> DataFrame:
    """``base`` (array of SPAN, in order) and ``loose`` (tokens outside them) of each row."""
    found = texts
    for name, col in zip(("a", "b", "c"), _base(), strict=True):
        found = found.withColumn(name, col)
    found = found.withColumn("base", F.array_sort(F.concat("a", "b", "c"))).drop("a", "b", "c")
    loose = spans_of("text", TOKEN, "random", 3, "s.m rlike '[0-9]' and s.m rlike '[A-Za-z]'")
    return found.withColumn("loose", loose).withColumn("loose", F.flatten(F.transform("loose", lambda s: _outside(s, F.col("base")))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (arrays of SPAN), and the columns in ``keep``, one row per input row.

    ``spans`` holds ``base`` and the tokens the battery finds random, by start and then kind.
    """
    found = _scanned(id_text(docs, id_col, text_col, *keep))
    tokens = found.select(F.explode("loose").alias("s")).select(_stratum(F.col("s.value")).alias("stratum"), tested(F.col("s.value"))["p"].alias("p"))
    cuts = thresholds(tokens.where("p is not null").withColumn("bin", _bin(F.col("p"))), q).collect()  # len(STRATA) rows at most

    def random(s: Column) -> Column:
        def below(p: Column) -> Column:
            cut = F.lit(BINS + 1)
            for r in cuts:
                cut = F.when(_stratum(s["value"]) == r["stratum"], r["cut"]).otherwise(cut)
            return p.isNotNull() & (_bin(p) < cut)

        return let(tested(s["value"])["p"], below)

    return found.withColumn("random", F.filter("loose", random)).select(
        "doc_id", *keep, "base", F.array_sort(F.concat("base", "random")).alias("spans"),
    )


def span_string(spans: str) -> Column:
    return F.concat_ws(",", F.expr(f"transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end))"))


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", q: float = 0.01) -> DataFrame:
    """doc_id and text with every span replaced by ``mark`` (spans that touch are merged first), row by row."""
    own = id_text(docs, id_col, text_col).withColumn("original", F.col("text"))
    pieces = F.expr(
        """aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<struct<at:int,n:int>>)),
        (a, s) -> case when s.end <= a.at then a
          when s.start < a.at then named_struct('at', s.end, 'out', a.out)
          else named_struct('at', s.end, 'out', concat(a.out, array(named_struct('at', a.at, 'n', s.start - a.at)))) end,
        a -> concat(a.out, array(named_struct('at', a.at, 'n', length(original) - a.at))))"""
    )
    found = find_secrets(own, "doc_id", "text", q, keep=("original",)).withColumn("pieces", pieces)
    cut = F.array_join(F.transform("pieces", lambda p: F.substr(F.col("original"), p["at"] + 1, p["n"])), mark)
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("original")).otherwise(cut).alias("text"))
