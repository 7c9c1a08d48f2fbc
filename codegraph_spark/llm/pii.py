"""Format-preserving Feistel pseudonyms for personal data (operator 3).

A value is found by its form and validated (Luhn, mod 97, octets, calendar, number ranges); its digits and letters are one number
of mixed radix, split in two halves that a keyed Feistel network of ten rounds adds into each other. The result has
the same form and is valid again; equal values have equal pseudonyms in all documents; different values stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

ROUNDS = 10
#: Letters and digits that are permuted as one number.
MOST_DIGITS = 256
#: Days that dates are permuted within.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of ranges, told apart by a label."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, label: str, i: int, x: int, most: int) -> int:
        data, size = f"{label}|{i}|{x}".encode(), max(16, (most.bit_length() + 71) // 8)
        digest = hashlib.blake2b(data, key=self.key, digest_size=size).digest() if size <= 64 else hashlib.shake_256(self.key + data).digest(size)
        return int.from_bytes(digest, "big") % most

    def split(self, label: str, left: int, right: int, a: int, b: int, back: bool = False) -> tuple[int, int]:
        """Permute (left, right) of [0, a) x [0, b)."""
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(label, i, left, b)) % b
            else:
                left = (left + sign * self._round(label, i, right, a)) % a
        return left, right

    def number(self, label: str, x: int, size: int, back: bool = False) -> int:
        """Permute [0, size), walking the cycle of the surrounding square until inside."""
        a = math.isqrt(max(0, size - 1)) + 1
        while True:
            left, right = self.split(label, x // a, x % a, a, a, back)
            x = left * a + right
            if x < size:
                return x

    def digits(self, label: str, values: list[int], radices: list[int], back: bool = False) -> list[int]:
        """Permute a number given by its digits, each of its own radix; of more than MOST_DIGITS, part by part."""
        if len(values) > MOST_DIGITS:
            parts = [self.digits(f"{label}|{at}", values[at : at + MOST_DIGITS], radices[at : at + MOST_DIGITS], back) for at in range(0, len(values), MOST_DIGITS)]
            return [x for part in parts for x in part]
        half = len(values) // 2
        if not half:
            return [self.number(label, values[0], radices[0], back)] if values else []

        def pack(v: list[int], r: list[int]) -> int:
            n = 0
            for x, radix in zip(v, r, strict=True):
                n = n * radix + x
            return n

        a, b = math.prod(radices[:half]), math.prod(radices[half:])
        label = f"{label}|{a}|{b}"
        out = []
        for n, r in zip(self.split(label, pack(values[:half], radices[:half]), pack(values[half:], radices[half:]), a, b, back), (radices[:half], radices[half:]), strict=True):
            part = []
            for radix in reversed(r):
                n, x = divmod(n, radix)
                part.append(x)
            out += part[::-1]
        return out

    def characters(self, label: str, text: str, back: bool = False) -> str:
        """Permute letters and digits (ASCII) within their classes; all else stays."""
        ranges = [next(((ord(lo), n) for lo, n in (("0", 10), ("a", 26), ("A", 26)) if 0 <= ord(c) - ord(lo) < n), None) for c in text]
        moved = iter(self.digits(label, [ord(c) - r[0] for c, r in zip(text, ranges, strict=True) if r], [r[1] for r in ranges if r], back))
        return "".join(chr(r[0] + next(moved)) if r else c for c, r in zip(text, ranges, strict=True))


def luhn(digits: str) -> int:
    """Luhn sum modulo ten."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _fill(form: str, digits: str) -> str:
    """Put characters into the places of the form's letters and digits."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _card(f: Feistel, s: str, back: bool = False) -> str | None:
    d = re.sub(r"[ -]", "", s)
    if not 13 <= len(d) <= 19 or luhn(d) or len(set(d)) == 1:
        return None
    body = f.characters("card", d[:-1], back)
    return _fill(s, body + str(-luhn(body + "0") % 10))


def _iban(f: Feistel, s: str, back: bool = False) -> str | None:
    t = s.replace(" ", "")
    if not 15 <= len(t) <= 34 or iban_rest(t) != 1:
        return None
    body = f.characters(f"iban{t[:2]}", t[4:], back)
    return _fill(s, f"{t[:2]}{98 - iban_rest(t[:2] + '00' + body):02d}{body}")


def _ip(f: Feistel, s: str, back: bool = False) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, f.digits("ip", [int(p) for p in parts], [256] * 4, back)))


def _ssn(f: Feistel, s: str, back: bool = False) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area, group, serial = f.digits("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], back)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Country codes of one and of two digits; all others have three.
CODES_1, CODES_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone(f: Feistel, s: str, back: bool = False) -> str | None:
    """The country code stays; a national number goes on beginning with 2 to 9."""
    d = re.sub("[^0-9]", "", s)
    if s[0] == "+":
        keep = 1 if d[0] in CODES_1 else 2 if d[:2] in CODES_2 else 3
        if not 8 <= len(d) <= 15:
            return None
        return "+" + _fill(s[1:], d[:keep] + f.characters("phone", d[keep:], back))
    if len(d) != 10 or d[0] in "01":
        return None
    first, *rest = f.digits("phone", [int(d[0]) - 2, *map(int, d[1:])], [8] + [10] * 9, back)
    return _fill(s, "".join(map(str, [first + 2, *rest])))


def _date(f: Feistel, s: str, back: bool = False) -> str | None:
    iso = s[4] == "-"
    a, b, c = map(int, re.split(r"[-./]", s))
    orders = [(a, b, c)] if iso else [(c, b, a)] if "." in s else [(c, a, b), (c, b, a)]
    for k, (y, m, d) in enumerate(orders):
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # days up to the 12th and later ones are permuted among themselves, in every spelling: so a result in
        # day/month/year is read in that order again, and one day has one pseudonym however it is written
        while True:
            day = FIRST_DAY + f.number("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back)
            x = datetime.date.fromordinal(day)
            if (x.day > 12) == (d > 12):
                break
        if len(orders) == 1:
            return x.isoformat() if iso else f"{x.day:02d}.{x.month:02d}.{x.year:04d}"
        # month/day/year where that is a date, else day/month/year
        return f"{x.month:02d}/{x.day:02d}/{x.year:04d}" if k == 0 else f"{x.day:02d}/{x.month:02d}/{x.year:04d}"
    return None


def _email(f: Feistel, s: str, back: bool = False) -> str | None:
    local, _, domain = s.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{f.characters('mail', local, back)}@{f.characters('host', name, back)}.{top}"


#: kind, form, transformation; digits are 0 to 9, other scripts' digits are no part of a value. At one start the first that validates is taken.
KINDS = (
    ("ip", re.compile(rf"(?<![\w.-])[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}(?![\w-]|\.[0-9])"), _ip),
    ("date", re.compile(rf"(?<![\w./-])(?:[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]|[0-9][0-9]([./])[0-9][0-9]\1[0-9]{{4}})(?:(?![\w-]|[./][0-9])|(?<=-[0-9][0-9])(?=T[0-9][0-9](?::?[0-9][0-9]|(?!\w))))"), _date),
    ("ssn", re.compile(rf"(?<![\w-])[0-9]{{3}}-[0-9][0-9]-[0-9]{{4}}(?![\w-])"), _ssn),
    ("phone", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){4,13}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![\w-])"), _phone),
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_GROUP = re.compile(r"[0-9]+")
_RUN = re.compile(r"(?<![\w-])[0-9]+(?:[ -][0-9]+)*")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-])")
_DIGITS = re.compile(r"[0-9]{2}")


def card_spans(text: str):
    """Spans of 13 to 19 digits that start and end at digit groups of a run of groups."""
    for run in _RUN.finditer(text):
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in _GROUP.finditer(run[0])]
        after = text[run.end() : run.end() + 1]
        if after and (after.isalnum() or after in "_-"):
            groups.pop()
        for i, (start, _) in enumerate(groups):
            n = 0
            for low, end in groups[i:]:
                n += end - low
                if n > 19:
                    break
                if n >= 13:
                    yield start, end


def iban_spans(text: str):
    """Spans of the IBAN's form, and their shorter ones that end where a group of letters and digits does."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        yield m.span()
        for gap in re.finditer(" ", m[0]):
            yield m.start(), m.start() + gap.start()


def pseudonymise(text: str, f: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with validated values replaced, and how many of each kind.

    Of the card and IBAN candidates at one start the longest that validates is taken. Where a card has digits beside it, its
    pseudonym may form a longer valid card with them; going back then reads that one.
    """
    found = []
    if "@" in text:
        for i in [m.start() for m in re.finditer("@", text)]:
            low = i
            while low and (text[low - 1].isascii() and text[low - 1].isalnum() or text[low - 1] in "._%+-"):
                low -= 1
            if m := _MAIL.match(text, low):
                found.append((m.start(), -m.end(), 0, "email", _email))
    if _DIGITS.search(text):
        for n, (kind, form, change) in zip((1, 2, 3, 5), KINDS, strict=True):
            found += [(m.start(), -m.end(), n, kind, change) for m in form.finditer(text)]
        found += [(start, -end, 4, "card", _card) for start, end in card_spans(text)]
        found += [(start, -end, 9, "iban", _iban) for start, end in iban_spans(text)]
    parts, last, counts = [], 0, {}
    for start, end, _, kind, change in sorted(found, key=lambda x: (x[0], x[2], x[1])):
        if start >= last and (new := change(f, text[start:-end], back)) is not None:
            parts += [text[last:start], new]
            last = -end
            counts[kind] = counts.get(kind, 0) + 1
    return ("".join([*parts, text[last:]]) if parts else text), counts


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_pii, kinds map<string, long>), one row per row of docs.

    Null text stays null with n_pii 0. Null and repeated ids pass through; an empty table gives no rows; other columns are
    ignored. Whole texts are read, and whole local parts of addresses, however long. Emails, phone numbers, cards, IBANs, IPv4 addresses, social security numbers and dates are replaced where valid.
    """

    def make():
        f = Feistel(key)

        def one(batch: pa.RecordBatch):
            done = [(None, {}) if t is None else pseudonymise(t, f) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([sum(c.values()) for _, c in done], pa.int64()), pa.array([sorted(c.items()) for _, c in done], pa.map_(pa.string(), pa.int64()))], ["doc_id", "text", "n_pii", "kinds"])

        return one

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, text string, n_pii long, kinds map<string,long>")
