r"""PII: format-preserving Feistel pseudonyms.

Finds e-mail addresses, IBANs, IPv4 addresses, dates, US social security numbers, phone
numbers and payment cards, validates them (mod 97, octets, calendar, issuing rules, Luhn) and
replaces each by another valid value of the same format, by a keyed permutation of the set
of all values of that format: a balanced Feistel network on the value's number, walked along
its cycle until it falls inside the set. The permutation depends on key, kind and format
only, so equal values get equal pseudonyms in every document, two values never share one, and
the owner of the key can turn it back (``restore``). Separators, case and lengths stay.

One pass over whole texts without a shuffle; each row stands for itself. Where kinds claim
overlapping stretches the earlier one in ``KINDS`` wins.

IBANs and cards may run on into digits or words behind them ("4111 ... 1111 12/25"). Of such a
stretch each reading that ends at a separator is tried, for an IBAN its country's length first,
then from the longest down, then those from the next blank on. A pseudonym is walked on until
it is read at the same place, so it comes back; two cards so close that one reading spans parts
of both are found, but may not come back.

Defined results: null text counts as empty; a text without findings is returned as it is;
numbers that fail validation are left alone; of kinds that tie for a stretch the earlier in ``KINDS`` wins; repeated
rows are treated alike; very long texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])([\w.+-]{1,64})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![0-9]|[./-][0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    "phone": re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){11,17}[0-9](?![0-9A-Za-z]|[.-][0-9])"),
}
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 "
    "RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
LONGEST = 70  # characters of the longest reading of an IBAN or a card, rounded up
ROUNDS = 10
FIRST_DAY, DAYS = dt.date(1800, 1, 1).toordinal(), dt.date(2200, 1, 1).toordinal() - dt.date(1800, 1, 1).toordinal()
# Alphabets of single characters that stay within their kind.
LETTERS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
)


class Feistel:
    """A keyed permutation of range(n) for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = b"%b|%d|%d|%x" % (tweak, bits, i, x)
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(data + b"|%d" % len(out), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, tweak: bytes, x: int, half: int, back: bool) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(tweak, i, left, half), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(tweak, i, right, half)
        return left << half | right

    def permute(self, tweak: str, x: int, n: int, back: bool = False) -> int:
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        x = self._once(tweak.encode(), x, half, back)
        while x >= n:  # walk the cycle; the set is over a quarter of the domain
            x = self._once(tweak.encode(), x, half, back)
        return x


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def _digits(text: str) -> str:
    return "".join(c for c in text if c in LETTERS[0])


def _refill(text: str, fresh: str, keep: str = LETTERS[0]) -> str:
    """``text`` with its characters out of ``keep`` replaced by ``fresh`` in turn."""
    it = iter(fresh)
    return "".join(next(it) if c in keep else c for c in text)


def _mixed(f: Feistel, kind: str, text: str, back: bool) -> str:
    """Each character permuted within its alphabet, all together as one mixed-radix number."""
    alphabets = [next((a for a in LETTERS if c in a), None) for c in text]
    x, n = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    shape = "".join(str(LETTERS.index(a)) if a else "." for a in alphabets)
    x, out = f.permute(f"{kind}:{shape}", x, n, back), []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            x, r = divmod(x, len(a))
            c = a[r]
        out.append(c)
    return "".join(reversed(out))


def _number(f: Feistel, kind: str, digits: str, back: bool) -> str:
    n = len(digits)
    return str(f.permute(f"{kind}:{n}", int(digits), 10**n, back)).zfill(n) if n else ""


def _iban_value(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _checks(kind: str, text: str) -> bool:
    """Whether an IBAN's or a card's check digits hold."""
    if kind == "iban":
        flat = text.replace(" ", "")
        return 15 <= len(flat) <= 34 and _iban_value(flat) == 1
    digits = _digits(text)
    return not _luhn(digits) and len(set(digits)) > 1


def _read(kind: str, text: str, at: int, end: int, taken: list[tuple[int, int]]) -> re.Match | None:
    """The first IBAN or card from ``at`` on that clears ``taken``."""
    pattern = PATTERNS[kind]
    while m := pattern.search(text, at, end):
        lo, hi = m.span()
        ends = [hi, *(i for i in range(hi - 1, lo, -1) if text[i] in " -")]
        if kind == "iban":
            size = IBAN_LENGTH.get(text[lo : lo + 2])
            ends.sort(key=lambda i: len(text[lo:i].replace(" ", "")) != size)
        for i in ends:
            r = pattern.fullmatch(text, lo, i)
            if r and _checks(kind, r[0]) and all(i <= a or b <= lo for a, b in taken):
                return r
        at = lo + 1
    return None


def _read_again(kind: str, text: str, at: int, lo: int, hi: int, taken: list[tuple[int, int]]):
    """Tells whether a value put in place of ``text[lo:hi]`` is read there too, searching from ``at``."""
    first, last = max(0, min(lo, max(at, lo - LONGEST)) - 1), min(len(text), hi + LONGEST)
    start = max(at, lo - LONGEST) - first
    near = [(a - first, b - first) for a, b in taken if a < last and b > first]

    def fits(fresh: str) -> bool:
        m = _read(kind, text[first:lo] + fresh + text[hi:last], start, last - first, near)
        return m is not None and m.span() == (lo - first, hi - first)

    return fits


def _day(m: re.Match) -> tuple[int, str] | None:
    """A date's day and which way round it is written; null for no date of the range."""
    year, month, day = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
    for order, mo, d in (("year first" if m[1] else "day first", month, day), *([] if m[1] else [("month first", day, month)])):
        try:
            found = dt.date(int(year), int(mo), int(d)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        return (found, order) if 0 <= found < DAYS else None
    return None


def valid(kind: str, m: re.Match) -> bool:
    """Whether a match is a value of its kind."""
    text = m[0]
    if kind in ("iban", "card"):
        return _checks(kind, text)
    if kind == "ip":
        return all(int(x) <= 255 and (x == "0" or x[0] != "0") for x in text.split("."))
    if kind == "date":
        return _day(m) is not None
    if kind == "ssn":
        area, group, serial = (int(x) for x in text.split("-"))
        return 1 <= area <= 899 and area != 666 and bool(group) and bool(serial)
    return True


def pseudonym(f: Feistel, kind: str, m: re.Match, back: bool = False, fits=lambda fresh: True) -> str | None:
    """The replacement of a match, or None where validation fails; of an IBAN or a card one that ``fits`` its place."""
    text = m[0]
    if not valid(kind, m):
        return None
    if kind == "email":
        local = m[1]
        fresh = _mixed(f, "email", local, back)
        return fresh + text[len(local) :]
    if kind == "iban":
        flat = text.replace(" ", "")
        body = flat[4:]
        while True:
            body = _mixed(f, "iban:" + flat[:2], body, back)
            check = 98 - _iban_value(flat[:2] + "00" + body)
            fresh = _refill(text, flat[:2] + f"{check:02d}" + body, LETTERS[0] + LETTERS[2])
            if fits(fresh):
                return fresh
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        x = f.permute("ip", int.from_bytes(bytes(octets), "big"), 1 << 32, back)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "date":
        day_number, order = _day(m)
        # Every day of a value written month first has to read as month first again: days over 12 only.
        while True:
            day_number = f.permute("date", day_number, DAYS, back)
            new = dt.date.fromordinal(FIRST_DAY + day_number)
            if order != "month first" or new.day > 12:
                break
        y, mo, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        if m[1]:
            return m[2].join((y, mo, d))
        return m[6].join((mo, d, y) if order == "month first" else (d, mo, y))
    digits = _digits(text)
    if kind == "ssn":
        area, group, serial = (int(x) for x in text.split("-"))
        rank = area - 1 - (area > 666)
        x = f.permute("ssn", (rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, back)
        x, serial = divmod(x, 9999)
        rank, group = divmod(x, 99)
        return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "phone":
        return _refill(text, digits[:-10] + _number(f, "phone", digits[-10:], back))
    n = 10 ** (len(digits) - 2)  # the first digit tells the network and the last one checks
    tweak, x = f"card:{digits[0]}:{len(digits)}", int(digits[1:-1])
    while True:
        x = f.permute(tweak, x, n, back)
        body = digits[0] + str(x).zfill(len(digits) - 2)
        fresh = body + str((10 - _luhn(body + "0")) % 10)
        if len(set(fresh)) > 1 and fits(_refill(text, fresh)):
            return _refill(text, fresh)


def find(text: str) -> list[tuple[int, int, str, re.Match, Callable[[str], bool]]]:
    """What is found, by place, and what tells whether a value fits there; of overlapping ones the earlier kind's."""
    out: list[tuple[int, int, str, re.Match, Callable[[str], bool]]] = []
    taken: list[tuple[int, int]] = []  # in order; they don't overlap

    def free(lo: int, hi: int) -> bool:
        i = bisect.bisect_left(taken, (lo, lo))
        return (i == 0 or taken[i - 1][1] <= lo) and (i == len(taken) or hi <= taken[i][0])

    for kind in KINDS:
        if kind == "email" and "@" not in text:
            continue
        if kind in ("iban", "card"):
            at, before = 0, list(taken)
            while m := _read(kind, text, at, len(text), before):
                lo, hi = m.span()
                out.append((lo, hi, kind, m, _read_again(kind, text, at, lo, hi, before)))
                bisect.insort(taken, (lo, hi))
                at = hi
            continue
        for m in PATTERNS[kind].finditer(text):
            lo, hi = m.span()
            if free(lo, hi) and valid(kind, m):
                out.append((lo, hi, kind, m, lambda fresh: True))
                bisect.insort(taken, (lo, hi))
    return sorted(out, key=lambda x: x[:2])


ANY_DIGIT = re.compile(r"[0-9@]")


def pseudonymize(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    if not ANY_DIGIT.search(text):
        return text, []
    parts, at, spans = [], 0, []
    for lo, hi, kind, m, fits in find(text):
        parts += [text[at:lo], pseudonym(f, kind, m, back, fits)]
        spans.append((lo, hi, kind))
        at = hi
    return "".join(parts) + text[at:], spans


def protect(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """Needs a key of 16 bytes or more; whoever has it can turn the pseudonyms back.

    doc_id, text (pseudonyms in place), spans ``kind:start:end`` in the input's code points, n_<kind> of each kind."""

    if len(key) < 16:
        raise ValueError("the key has to have 16 bytes or more")

    def run(batches):
        f = Feistel(key)
        for b in batches:
            done = [pseudonymize(t.as_py(), f, back) for t in b.column(1)]
            cols = [
                b.column(0),
                pa.array([t for t, _ in done], pa.string()),
                pa.array([",".join(f"{k}:{lo}:{hi}" for lo, hi, k in s) for _, s in done], pa.string()),
                *[pa.array([sum(x[2] == k for x in s) for _, s in done], pa.int64()) for k in KINDS],
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "spans", *[f"n_{k}" for k in KINDS]])

    schema = "doc_id long, text string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def restore(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverse of :func:`protect` for the same key."""
    return protect(docs, key, id_col, text_col, back=True)
