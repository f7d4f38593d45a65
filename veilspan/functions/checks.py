"""Checksums of identifiers, as Column expressions and as plain functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check weights and letters of national identifiers.
CNPJ_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(d: Column, at) -> Column:
    return F.substr(d, at if isinstance(at, Column) else F.lit(at), F.lit(1)).try_cast("int")


def _weighted(d: Column, weights) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + _digit(d, i) * w
    return total


def _once(value: Column, test: Callable[[Column], Column]) -> Column:
    """``test`` of a value that is worked out once, however often the test names it."""
    return F.coalesce(F.get(F.transform(F.array(value), test), F.lit(0)), F.lit(False))


def is_cpf(value: Column) -> Column:
    """Eleven digits, not all equal, whose last two check the others."""

    def check(d: Column, n: int) -> Column:
        return (_weighted(d, range(n + 1, 1, -1)) * 10 % 11 % 10) == _digit(d, n + 1)

    return _once(digits(value), lambda d: (F.length(d) == 11) & ~d.rlike(r"^([0-9])\1+$") & check(d, 9) & check(d, 10))


def is_cnpj(value: Column) -> Column:
    """Fourteen digits, not all equal, whose last two check the others."""

    def check(d: Column, n: int) -> Column:
        return _once(_weighted(d, CNPJ_WEIGHTS[-n:]) % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest) == _digit(d, n + 1))

    return _once(digits(value), lambda d: (F.length(d) == 14) & ~d.rlike(r"^([0-9])\1+$") & check(d, 12) & check(d, 13))


def is_card(value: Column) -> Column:
    d = digits(value)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def is_iban(value: Column) -> Column:
    """The first four characters moved behind the rest, letters as 10 to 35: 1 modulo 97."""
    compact = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    letters = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.coalesce(F.aggregate(letters, F.lit(0), step) == 1, F.lit(False))


def is_dni(value: Column) -> Column:
    """Seven or eight digits, perhaps behind X, Y or Z, and the letter that their rest modulo 23 names."""
    compact = F.upper(F.regexp_replace(value, r"[\s.-]", ""))
    rx = "^([XYZ]?)([0-9]{7,8})([A-Z])$"
    lead = F.translate(F.regexp_extract(compact, rx, 1), "XYZ", "012")
    number = F.concat(lead, F.regexp_extract(compact, rx, 2)).try_cast("long")
    letter = F.substr(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))
    return F.coalesce(compact.rlike(rx) & (letter == F.regexp_extract(compact, rx, 3)), F.lit(False))


def not_year_range(value: Column) -> Column:
    return ~value.rlike("^(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}$") & not_leading_year(value)


def not_leading_year(value: Column) -> Column:
    return ~value.rlike(r"^(?:19|20)[0-9]{2}[\s-]")


# ---------------------------------------------------------------- the same for one value, inside Python workers


def _same(d: str) -> bool:
    return len(set(d)) == 1


def _sum(d: str, weights) -> int:
    return sum(map(mul, map(int, d), weights))


_OTHERS, _BLANK = re.compile("[^0-9]"), re.compile(r"\s")


def cpf(value: str) -> bool:
    d = _OTHERS.sub("", value)
    return len(d) == 11 and not _same(d) and all(_sum(d, range(n + 1, 1, -1)) * 10 % 11 % 10 == int(d[n]) for n in (9, 10))


def cnpj(value: str) -> bool:
    d = _OTHERS.sub("", value)
    rests = [(n, _sum(d, CNPJ_WEIGHTS[-n:]) % 11) for n in (12, 13)] if len(d) == 14 and not _same(d) else []
    return bool(rests) and all(int(d[n]) == (0 if r < 2 else 11 - r) for n, r in rests)


#: A digit as the sum of its double's digits.
_TWICE = str.maketrans("0123456789", "0246813579")


def card(value: str) -> bool:
    d = _OTHERS.sub("", value)[::-1]
    return 13 <= len(d) <= 19 and (sum(map(int, d[::2])) + sum(map(int, d[1::2].translate(_TWICE)))) % 10 == 0


def iban(value: str) -> bool:
    v = _BLANK.sub("", value).upper()
    return bool(v) and int("".join(c if c.isdigit() else str(ord(c) - 55) for c in v[4:] + v[:4])) % 97 == 1


def dni(value: str) -> bool:
    m = re.fullmatch("([XYZ]?)([0-9]{7,8})([A-Z])", re.sub(r"[\s.-]", "", value).upper())
    return bool(m) and DNI_LETTERS[int((str("XYZ".index(m[1])) if m[1] else "") + m[2]) % 23] == m[3]


def phone_a(value: str) -> bool:
    return not re.match("(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}$", value) and phone_b(value)


def phone_b(value: str) -> bool:
    return not re.match(r"(?:19|20)[0-9]{2}[\s-]", value)
