"""Pseudonyms for personal data that keep its format.

What is found and valid (card and account numbers by their check digits, addresses by their range, dates by the
calendar of the years 1 to 9999, telephone and social security numbers by their numbering rules, mail addresses by the
lengths that their parts may have) is numbered within all values of its format; a Feistel network with a secret key permutes these numbers, walking on until it meets one of the format.
Equal values get equal pseudonyms in every document, and different ones stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")
_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the numbers below ``size``: a Feistel network on a square around them, walked along the
    cycle until it is back in range (four steps are expected at most)."""
    if size < 2:
        return value
    half = (size - 1).bit_length() + 1 >> 1
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            h = hashlib.blake2b(tweak + bytes([i]) + right.to_bytes(width, "big"), key=key, digest_size=min(64, width + 8)).digest()
            f = int.from_bytes(h, "big")
            if width + 8 > 64:
                f = int.from_bytes(hashlib.shake_256(h).digest(width + 8), "big")
            left, right = right, left ^ f & mask
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(template: str, digits: str) -> str:
    """The template with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in template)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in _DIGITS)


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or len(set(d)) == 1 or int(d[-1]) != luhn(d[:-1]):
        return None
    size = 10 ** (len(d) - 2)
    body = d[0] + str(permute(int(d[1:-1]), size, key, b"card%d%s" % (len(d), d[0].encode()))).zfill(len(d) - 2)
    return _refill(s, body + str(luhn(body)))


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return None
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _within(flat[4:], key, b"iban" + flat[:2].encode())
    check = 98 - number(body + flat[:2] + "00") % 97
    it = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


def _within(s: str, key: bytes, tweak: bytes) -> str:
    """Digits, small and capital letters permuted within their classes; other characters stay."""
    classes = [next((a for a in (_DIGITS, _SMALL, _LARGE) if c in a), "") for c in s]
    value, size = 0, 1
    for c, a in zip(s, classes):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, tweak + "".join({10: "9", 0: "-"}.get(len(a), a[0]) if a else c for c, a in zip(s, classes)).encode())
    out = []
    for c, a in zip(reversed(s), reversed(classes)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.partition("@")
    return _within(local, key, b"mail" + domain.lower().encode()) + "@" + domain


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def _ssn(s: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in re.split("[- ]", s))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    v = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn")
    v, serial = divmod(v, 9999)
    area, group = divmod(v, 99)
    return f"{area + 1 + (area >= 665):03d}{s[3]}{group + 1:02d}{s[6]}{serial + 1:04d}"


def _phone(s: str, key: bytes) -> str | None:
    d = _digits(s)
    national = d[1:] if len(d) == 11 and d[0] == "1" else d
    if len(national) == 10 and (len(d) == 10 or len(d) == 11) and (s[0] != "+" or d[0] == "1"):
        if national[0] < "2":
            if s[0] not in "+(":  # by its look a plain number
                return None
            v = permute(int(national), 2 * 10**9, key, b"phone0")  # no such numbers are given out; they stay among themselves
            return _refill(s, d[: len(d) - 10] + str(v).zfill(10))
        v = permute((int(national[0]) - 2) * 10**9 + int(national[1:]), 8 * 10**9, key, b"phone1")
        return _refill(s, d[: len(d) - 10] + str(v + 2 * 10**9))
    if s[0] != "+" or not 8 <= len(d) <= 15:
        return None
    body = str(permute(int(d[3:]), 10 ** (len(d) - 3), key, b"phone" + d[:3].encode() + bytes([len(d)]))).zfill(len(d) - 3)
    return _refill(s, d[:3] + body)


def _date(s: str, key: bytes) -> str | None:
    """Dates are permuted among those that are written with the same order and as many digits, in all years."""
    a, b, c = re.split("[-/.]", s)
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        at = dict(zip(order, (a, b, c)))
        try:
            day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"]))
        except ValueError:
            continue
        # What reads as day-month first is taken so; the other way are only days above 12, which stay above 12.
        days = Days(len(at["m"]), len(at["d"]), 13 if order == "mdy" else 1)
        new = days.day(permute(days.place(day), days.before(10_000), key, b"date%s%d%d" % (order.encode(), len(at["m"]), len(at["d"]))))
        return s[len(a)].join({"y": f"{new[0]:04d}", "m": str(new[1]).zfill(len(at["m"])), "d": str(new[2]).zfill(len(at["d"]))}[k] for k in order)
    return None


class Days:
    """The days of the years 1 to 9999 whose month and day of at least ``least`` fit so many digits, by their numbers."""

    def __init__(self, month_digits: int, day_digits: int, least: int = 1):
        self.plain, self.leap = _year(month_digits, day_digits, least, 2001), _year(month_digits, day_digits, least, 2000)

    def before(self, year: int) -> int:
        """Days in the years before this one."""
        n = year - 1
        return n * len(self.plain) + (n // 4 - n // 100 + n // 400) * (len(self.leap) - len(self.plain))

    def _of(self, year: int) -> list[tuple[int, int]]:
        return self.leap if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else self.plain

    def place(self, day: datetime.date) -> int:
        """A day's number."""
        return self.before(day.year) + bisect_right(self._of(day.year), (day.month, day.day)) - 1

    def day(self, place: int) -> tuple[int, int, int]:
        """The year, month and day with a number."""
        year = bisect_right(range(1, 10_000), place, key=self.before)
        return (year, *self._of(year)[place - self.before(year)])


@lru_cache(maxsize=None)  # 16 at most
def _year(month_digits: int, day_digits: int, least: int, year: int) -> list[tuple[int, int]]:
    every = (datetime.date(year, 1, 1) + datetime.timedelta(i) for i in range(365 + (year == 2000)))
    return [(d.month, d.day) for d in every if d.month < 10**month_digits and least <= d.day < 10**day_digits]


_LOCAL = "".join((_DIGITS, _SMALL, _LARGE, "._%+-"))
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}")
_NUMBER = re.compile(
    r"(?P<date>(?<![\w/.\-])(?:\d{4}-\d\d?-\d\d?|\d{4}/\d\d?/\d\d?|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\w/\-]|\.\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}([- ])\d\d\4\d{4}(?![\w\-]))"
    r"|(?P<card>(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+])\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\w))"
)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_MAKERS = {"card": _card, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date}
_ANY_DIGIT = re.compile(r"\d")
_GROUP = re.compile(r"\+?\(?\d+")
_RUN = re.compile(r"[+(]*\d(?:[ ().+/\-]*\d)*")
#: Characters of a number, at most: 19 digits with separators.
MOST = 40


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Where mail addresses begin and end, found from their @ outwards; local parts have 64 characters at most, domains 255."""
    low, at = 0, text.find("@")
    while at >= 0:
        low, m = max(low, at - 65), _DOMAIN.match(text, at)
        n = at - low - len(text[low:at].rstrip(_LOCAL))
        if m and 0 < n <= 64 and m.end() - at <= 256:
            yield at - n, m.end()
            low = at = m.end()
        else:
            low = at = at + 1
        at = text.find("@", at)


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}

    def swap(kind: str, made: str | None, old: str) -> str:
        if made is None:
            return old
        counts[kind] = counts.get(kind, 0) + 1
        return made

    def number(m: re.Match) -> str | None:
        kind = m.lastgroup or next(k for k in _MAKERS if m[k])
        made = _MAKERS[kind](m[0], key)
        if made is None and kind in ("ssn", "card"):
            kind, made = "phone", _phone(m[0], key)
        return None if made is None else swap(kind, made, m[0])

    def numbers(a: int, b: int) -> str:
        part = text[a:b]
        return _replaced(part, number) if _ANY_DIGIT.search(part) else part

    def rest(a: int, b: int) -> str:
        """What has no mail address; what a rule has replaced is not looked at by the next one."""
        out, at = [], a
        for m in _IBAN.finditer(text, a, b):
            if (made := _iban(m[0], key)) is not None:
                out += [numbers(at, m.start()), swap("iban", made, m[0])]
                at = m.end()
        return "".join(out) + numbers(at, b)

    out, at = [], 0
    for a, b in _mails(text):
        out += [rest(at, a), swap("email", _email(text[a:b], key), text[a:b])]
        at = b
    return "".join(out) + rest(at, len(text)), counts


def _replaced(text: str, number, start: int = 0, stop: int | None = None) -> str:
    """Numbers of a part of the text replaced; where one is not valid, the longest valid run of digit groups that starts in it."""
    out, at, stop = [], start, len(text) if stop is None else stop
    failed: set[tuple[int, int]] = set()  # spans that were tried; matches overlap, and each span is tried once
    while m := _NUMBER.search(text, start, stop):
        (a, b), made = m.span(), number(m)
        if made is None:
            starts = [g.start() for g in _GROUP.finditer(text, *m.span())]
            last = _RUN.match(text, m.start(), min(stop, m.end() + MOST)).end()
            ends = [i for i in range(m.start() + 7, last) if text[i] == " "]
            ends.append(last)
            if len(failed) > 4096:
                failed = {s for s in failed if s[0] >= m.start()}
            failed.add(m.span())
            spans = [(x - y, x, y) for x in starts for y in ends if 6 < y - x <= MOST and (x, y) not in failed]
            for _, a, b in sorted(spans):
                if (inner := _NUMBER.fullmatch(text, a, b)) and (made := number(inner)) is not None:
                    break
                failed.add((a, b))
        if made is not None:
            out += [text[at : m.start()], _replaced(text, number, m.start(), a) if a > m.start() else "", made]
            at = start = b
        elif following := _GROUP.search(text, _GROUP.search(text, m.start()).end(), stop):
            start = following.start()  # a value may start here and end beyond this match
        else:
            break
    return "".join(out) + text[at:stop]


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and the columns n_replaced and n_<kind> (long) for each of KINDS.

    The key has 1 to 64 bytes; whoever has it can link and undo pseudonyms.  Null and empty texts stay as they are.
    Columns of the added names are replaced, others stay; rows are independent of each other, so order, repeated rows
    and missing ids make no difference.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("a key has 1 to 64 bytes")
    names = [f"n_{k}" for k in KINDS]

    @F.arrow_udf(f"struct<text: string, {', '.join(f'{n}: long' for n in names)}>")
    def replaced(texts: pa.Array) -> pa.Array:
        done = [(None, {}) if t is None else pseudonymise(t, key) for t in texts.to_pylist()]
        columns = [pa.array([d[0] for d in done], pa.string()), *(pa.array([d[1].get(k, 0) for d in done], pa.int64()) for k in KINDS)]
        return pa.StructArray.from_arrays(columns, ["text", *names])

    rows = without(docs, "n_replaced", "__new", *names)
    new = rows.withColumn("__new", replaced(F.col("text").cast("string")))
    total = sum((F.col(f"__new.{n}") for n in names[1:]), F.col(f"__new.{names[0]}"))
    return new.select(*[F.col("__new.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in rows.columns], total.alias("n_replaced"), *[F.col(f"__new.{n}").alias(n) for n in names])
