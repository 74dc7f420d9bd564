r"""PII: format-preserving Feistel pseudonyms.

Validated values in whole texts are replaced by keyed permutations of themselves within their format: cards (Luhn), IBANs
(mod 97), US social security numbers, phone numbers (North American plan or + and 8 to 15 digits), IPv4 addresses, dates,
local parts of e-mail addresses, and access keys. A value is read as an integer below the number of values of its form;
a Feistel network over that range, with cycle walking where not every integer is a valid value, permutes it, and check
digits are computed anew. So separators, lengths and validity stay, different values stay different, and equal values,
of one kind, get equal pseudonyms in all documents: dates even across date formats. A pseudonym depends on the value and the key alone.

What belongs to a card or an IBAN is told from itself, not from what stands beside it: an IBAN has the length of its country; a number written
with separators has the lengths of its issuer, by its first digits, and ends with one of its groups; digits without a separator are one
number. So a card keeps its pseudonym beside a security code, an expiry date or a quantity.

With the key it can be undone: pseudonymise() returns where the values stand in the new text, and that, not another search, is
what it is undone by.

Scale: one pass over Arrow batches, no shuffle, linear in the text. Texts without a digit, @ or AKIA hold no value and are passed through.

Defined cases: null text stays null, empty text empty. Repeated rows give equal results. Values inside longer runs of
digits or word characters are left alone, as are numbers that fail their check. Digits are 0 to 9; those of other scripts are
neither replaced nor counted. Columns of the input other than id and text,
whatever their names, stay as they are in pseudonymise(). An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands in for the deployment's secret.
DEMO_KEY = b"fragloom demonstration key"
ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "key")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Feistel:
    """Keyed permutations of [0, n) for any n, one for each name."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, name: str, n: int, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{name}/{n}/{i}/{half}".encode(), key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int, n: int, name: str, back: bool) -> int:
        a = isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._f(name, n, i, left)) % b
            else:
                left = (left + sign * self._f(name, n, i, right)) % a
        return left * b + right

    def permute(self, x: int, n: int, name: str, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Where x goes, walking on until the value is below n and valid: a permutation of the valid values."""
        while True:
            x = self._once(x, n, name, back)
            if x < n and valid(x):
                return x


def _alphabets(text: str) -> list[str]:
    """The alphabet of each character that has one; the others stay."""
    return [a for c in text for a in (_DIGITS, _LOWER, _UPPER) if c in a]


def _number(text: str) -> tuple[int, int]:
    """Its characters with an alphabet as one integer, and the number of such integers."""
    x, kinds = 0, _alphabets(text)
    for c, a in zip((c for c in text if c.isascii() and c.isalnum()), kinds):
        x = x * len(a) + a.index(c)
    return x, prod(map(len, kinds))


def _written(x: int, like: str) -> str:
    out = []
    for c in reversed(like):
        a = next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None)
        if a:
            x, r = divmod(x, len(a))
            c = a[r]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit of a card number's other digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def card_ok(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


_DATES = (
    (re.compile(r"([0-9]{4})([-/.])([0-9][0-9])\2([0-9][0-9])"), (1, 3, 4), "{0:04d}{s}{1:02d}{s}{2:02d}"),
    (re.compile(r"([0-9][0-9])(/)([0-9][0-9])\2([0-9]{4})"), (4, 1, 3), "{1:02d}{s}{2:02d}{s}{0:04d}"),
    (re.compile(r"([0-9][0-9])([-/.])([0-9][0-9])\2([0-9]{4})"), (4, 3, 1), "{2:02d}{s}{1:02d}{s}{0:04d}"),
)


def _date(text: str) -> tuple[int, int, str] | None:
    """(day since FIRST_DAY, format, separator) of the first format that makes it a date."""
    for k, (pattern, order, _) in enumerate(_DATES):
        if m := pattern.fullmatch(text):
            try:
                day = datetime.date(*(int(m[i]) for i in order)).toordinal()
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                return day - FIRST_DAY, k, m[2]
    return None


def _ssn_ok(n: int) -> bool:
    area, rest = divmod(n, 10**6)
    return area not in (0, 666) and area < 900 and rest >= 10**4 and rest % 10**4 > 0


def _us_ok(n: int) -> bool:
    return n // 10**9 >= 2 and n // 10**6 % 10 >= 2


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _run(self, x: int, n: int, name: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        return self.feistel.permute(x, n, name, valid, self.back)

    def card(self, text: str) -> str | None:
        if not card_ok(text):
            return None
        digits = re.sub("[^0-9]", "", text)
        body = f"{self._run(int(digits[:-1]), 10 ** (len(digits) - 1), 'card'):0{len(digits) - 1}d}"
        return _written(int(body + str(luhn(body))), text)

    def iban(self, text: str) -> str | None:
        if not iban_ok(text):
            return None
        plain = text.replace(" ", "")
        country, rest = plain[:2], plain[4:]
        x, n = _number(rest)
        new = _written(self._run(x, n, "iban" + country), rest)
        letters = iter(country + iban_check(country, new) + new)
        return "".join(c if c == " " else next(letters) for c in text)

    def ssn(self, text: str) -> str | None:
        n = int(text.replace("-", ""))
        return _written(self._run(n, 10**9, "ssn", _ssn_ok), text) if _ssn_ok(n) else None

    def phone(self, text: str) -> str | None:
        digits = re.sub("[^0-9]", "", text)
        us = len(digits) == 10 and text[0] != "+" or len(digits) == 11 and text.startswith("+1")
        if us:
            n = int(digits[-10:])
            ok = _us_ok(n)
            if not ok and text[0] != "+":
                return None
            # Numbers outside the plan, written as international ones, stay outside of it.
            new = self._run(n, 10**10, "phone", lambda m: _us_ok(m) == ok)
            return _written(int(f"{digits[:-10]}{new:010d}"), text)
        if text[0] != "+" or not 8 <= len(digits) <= 15:
            return None
        return _written(int(digits[:2] + f"{self._run(int(digits[2:]), 10 ** (len(digits) - 2), 'phone+' + digits[:2]):0{len(digits) - 2}d}"), text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self._run(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        if not (read := _date(text)):
            return None
        day, kind, separator = read

        def written(d: int) -> str:
            made = datetime.date.fromordinal(FIRST_DAY + d)
            return _DATES[kind][2].format(made.year, made.month, made.day, s=separator)

        if kind == 2 and separator == "/":  # day first, as the month cannot be
            return written(self._run(day, LAST_DAY - FIRST_DAY + 1, "day first", lambda d: _date(written(d)) == (d, kind, separator)))
        return written(self._run(day, LAST_DAY - FIRST_DAY + 1, "date"))

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        x, n = _number(local)
        form = re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", local)))
        return f"{_written(self._run(x, n, f'email {form}@{domain.lower()}'), local)}@{domain}" if n > 1 else None

    def key(self, text: str) -> str | None:
        x, n = _number(text[4:])
        form = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", text))
        return text[:4] + _written(self._run(x, n, "key " + form), text[4:])


#: What a value of each kind looks like, before it is validated; tried in this order at each place.
_LOOKS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+(?:[Xx][Nn]--[A-Za-z0-9-]{0,58}[A-Za-z0-9]|[A-Za-z]{2,63})(?!\w)",
    "key": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}[0-9][0-9](?: ?[0-9A-Z]+){1,32}",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9][0-9]\1[0-9][0-9]|[0-9][0-9]([-/.])[0-9][0-9]\2[0-9]{4})(?!\w|[./-][0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9][0-9]-[0-9]{4}(?!\w|-[0-9])",
    "card": r"(?<![\w-])(?<![0-9]\.)[0-9]+(?:[ -][0-9]+)*(?!\w)",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w|-[0-9])",
}
_FIND = {kind: re.compile(p) for kind, p in _LOOKS.items()}
#: What every value has: a digit or @, or the start of an access key, which may be of letters alone.
_SOME = re.compile("[0-9@]|AKIA")


#: Lengths of IBANs. Fixed values.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: First digits of card issuers, longest first, with the lengths of their numbers in the order in which they are tried. Fixed values.
ISSUERS = (
    ("34", (15,)), ("37", (15,)), ("30", (14, 16)), ("36", (14, 16)), ("38", (14, 16)), ("39", (14, 16)), ("35", (16, 19)),
    ("22", (16,)), ("23", (16,)), ("24", (16,)), ("25", (16,)), ("26", (16,)), ("27", (16,)),
    ("51", (16,)), ("52", (16,)), ("53", (16,)), ("54", (16,)), ("55", (16,)),
    ("50", (16, 19, 18, 17, 15, 14, 13)), ("56", (16, 19, 18, 17, 15, 14, 13)), ("57", (16, 19, 18, 17, 15, 14, 13)), ("58", (16, 19, 18, 17, 15, 14, 13)),
    ("4", (16, 13, 19)), ("6", (16, 19, 18, 17, 15, 14, 13)),
)
#: Of other numbers.
ANY_LENGTH = (16, 15, 14, 19, 13, 18, 17)
_GROUP = re.compile("[0-9]+")


def _lengths(digits: str, sizes: list[int]) -> tuple[int, ...]:
    """The lengths that a number of these first digits, written in groups of these sizes, may have."""
    known = next((lengths for first, lengths in ISSUERS if digits.startswith(first)), ())
    return (13, *(n for n in known if n != 13)) if sizes == [4, 4, 4, 1] and 13 in known else known


def _card_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Cards in a run of groups of digits. First numbers of known issuers that begin with a group of four digits or more, then any others
    with one kind of separator."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    used = [False] * len(groups)
    for known in (True, False):
        i = 0
        while i < len(groups):
            a, b = groups[i]
            if used[i]:
                i += 1
                continue
            if b - a >= 13:
                if known and b - a <= 19 and card_ok(text[a:b]):
                    used[i] = True
                    yield a, b
                i += 1
                continue
            ends, n, j = {}, 0, i  # by digits: the group that a number of so many ends with
            while j < len(groups) and not used[j] and n < 19 and (known or j < i + 2 or text[groups[j][0] - 1] == text[groups[i + 1][0] - 1]):
                n += groups[j][1] - groups[j][0]
                ends[n] = j
                j += 1
            lengths = (_lengths(text[a:b], [q - p for p, q in groups[i : i + 4]]) if b - a >= 4 else ()) if known else ANY_LENGTH
            last = next((ends[n] for n in lengths if n in ends and card_ok(text[a : groups[ends[n]][1]])), None)
            if last is None:
                i += 1
                continue
            used[i : last + 1] = [True] * (last + 1 - i)
            yield a, groups[last][1]
            i = last + 1


def _iban_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The IBAN that begins at start: as long as its country has it, else the longest that is valid and ends with a word."""
    length, n, found = IBAN_LENGTHS.get(text[start : start + 2]), 0, None
    for m in re.finditer("[0-9A-Z]+", text[start:end]):
        n += len(m[0])
        if n > 34:
            break
        stop = start + m.end()
        if (n == length or length is None) and not (stop < len(text) and (text[stop].isalnum() or text[stop] == "_")) and iban_ok(text[start:stop]):
            found = stop
    if found:
        yield start, found


_SPANS = {"card": _card_spans, "iban": _iban_spans}


def find(text: str, made: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values, none overlapping, earlier kinds of _LOOKS first."""
    spans: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def take(start: int, end: int, kind: str) -> bool:
        if taken.find(1, start, end) >= 0 or (new := getattr(made, kind)(text[start:end])) is None:
            return False
        spans.append((start, end, kind, new))
        taken[start:end] = b"\1" * (end - start)
        return True

    for kind, pattern in _FIND.items():
        if kind == "email" and "@" not in text:
            continue
        if kind not in _SPANS:
            for m in pattern.finditer(text):
                take(m.start(), m.end(), kind)
            continue
        at = 0
        while m := pattern.search(text, at):
            own = [end for start, end in _SPANS[kind](text, m.start(), m.end()) if take(start, end, kind)]
            at = m.end() if kind == "card" else max([m.start() + 1, *own])
    return sorted(spans)


def replaced(text: str, made: Pseudonyms, spans: list[tuple[int, int, str]] | None = None) -> tuple[str, dict[str, int], list[tuple[int, int, str]]]:
    """(new text, number of values of each kind, where they stand in it). spans: where the values stand, else they are searched for."""
    counts = dict.fromkeys(KINDS, 0)
    if spans is None:
        values = find(text, made) if _SOME.search(text) else []
    else:
        values = [(start, end, kind, getattr(made, kind)(text[start:end])) for start, end, kind in spans]
    out, at, length, places = [], 0, 0, []
    for start, end, kind, new in values:
        out += [text[at:start], new]
        length += start - at
        places.append((length, length + len(new), kind))
        length += len(new)
        at = end
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts, places


def replace(text: str, made: Pseudonyms) -> tuple[str, dict[str, int]]:
    return replaced(text, made)[:2]


_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """Per row: doc_id, text (with pseudonyms), n_<kind> for each of KINDS, and spans: start, end and kind of the values in it. With spans_col, such a
    column of docs, and the same key, the values at these places are turned back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key, spans_col is not None)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [None if spans is None else [(s["start"], s["end"], s["kind"]) for s in spans] for spans in batch.column(2).to_pylist()] if spans_col else [None] * len(texts)
            done = [(None, dict.fromkeys(KINDS, 0), []) if t is None else replaced(t, made, (s or []) if spans_col else None) for t, s in zip(texts, known)]
            places = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for _, _, x in done], _PLACES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _, _ in done], pa.string()), *(pa.array([c[k] for _, c, _ in done], pa.int64()) for k in KINDS), places], names=["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else []))
    return rows.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans array<struct<start:int,end:int,kind:string>>")
