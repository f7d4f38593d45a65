"""Patterns of personal data, as rows: add one to extend them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from veilspan.functions import checks

# Month names and street words.
MONTHS = {
    "en": "january|february|march|april|may|june|july|august|september|october|november|december",
    "es": "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre",
    "pt": "janeiro|fevereiro|mar[cç]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro",
}
STREETS = r"R\.|Rua|Av\.|Avda\.?|Avenida|Alameda|Al\.|Travessa|Trav\.|Pra[cç]a|Rodovia|Estrada|Calle|Carrera|Paseo|Plaza"

_ANY = "|".join(MONTHS[k] for k in ("en", "es", "pt"))


@dataclass(frozen=True)
class Pattern:
    """``rx``: \\b, \\d and \\s as ASCII word edges, ASCII digits and Unicode white space, group 1 the covered value if ``value``."""

    id: str
    label: str
    rx: str
    fold: bool = False
    value: bool = False
    verify: str | None = None
    need: str = "digit"


# The patterns.
PATTERNS = (
    Pattern("email", "private_email", r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.\p{L}{2,}", fold=True, need="@"),
    Pattern("cpf", "account_number", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b", verify="cpf"),
    Pattern("cnpj", "account_number", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b|\b\d{14}\b", verify="cnpj"),
    Pattern("iban", "account_number", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b", verify="iban"),
    Pattern("dni", "account_number", r"\b[XYZ]?\d{7,8}[\-\s]?[A-Z]\b", verify="dni"),
    Pattern("card", "account_number", r"\b(?:\d[ \-]?){12,18}\d\b", verify="card"),
    Pattern("rg", "account_number", r"\bRG[.:]?\s?(\d{1,2}\.?\d{3}\.?\d{3}-?[\dX])\b", value=True),
    Pattern("cnh", "account_number", r"\b(?:CNH|[Rr]egistro)[.:]?\s?(\d{9,11})\b", value=True),
    Pattern("cep", "private_address", r"\bCEP[.:]?\s?(\d{5}-?\d{3})\b", value=True),
    Pattern("street", "private_address", rf"\b(?:{STREETS})\s+\p{{L}}[\p{{L}}\p{{N}}\s.'\-]{{2,44}}?,?\s*(?:n[º°.]?\s*)?\d{{1,5}}\b", fold=True),
    Pattern("date", "private_date", r"\b(?:0?[1-9]|[12]\d|3[01])/(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}\b"),
    Pattern("written_date", "private_date", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:de\s+)?(?:{_ANY})\b(?:\s+(?:de\s+)?(?:19|20)\d{{2}})?", fold=True),
    Pattern("month_first", "private_date", rf"\b(?:{_ANY})\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?:,?\s+(?:19|20)\d{{2}})?", fold=True),
    Pattern("phone_a", "private_phone", r"\+\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{3,5}[\s\-]?\d{3,5}|\(\d{2,4}\)\s?\d{3,5}[\s\-]\d{3,5}|\b\d{3,4}-\d{4}\b", verify="phone_a"),
    Pattern("phone_b", "private_phone", r"\b\d{3}-\d{3}-\d{4}\b|\b\d{2}\s9?\d{4}-\d{4}\b|\b9\d{4}-\d{4}\b", verify="phone_b"),
)

#: JavaScript-like white space, as code points.
SPACES = (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)


def _spell(rx: str, edge: str, digit: str, spaces: str) -> str:
    """The pattern in another dialect: word edges, digits and white space in and out of classes."""
    out, inside, i = [], False, 0
    while i < len(rx):
        two = rx[i : i + 2]
        if two == r"\b":
            out.append(edge)
        elif two == r"\d":
            out.append("0-9" if inside else digit)
        elif two == r"\s":
            out.append(spaces if inside else f"[{spaces}]")
        elif rx[i] == "\\":
            out.append(two)
        else:
            inside = rx[i] == "[" or (inside and rx[i] != "]")
            out.append(rx[i])
            i += 1
            continue
        i += 2
    return "".join(out)


#: A word edge before a word, at the head of an alternative, and behind one: in the patterns each \\b is one of the two.
_HEAD, _TAIL = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def java(p: Pattern) -> str:
    spaces = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    rx = re.sub(r"(^|\|)\\b", lambda m: m[1] + _HEAD, p.rx)
    if p.need == "@":  # a run of characters is tried from its head only, or from where the last match ended
        run = rx[: rx.index("+@")]
        rx = rf"(?:\G|(?<!{run})){run}+{rx[len(run):]}"
    return ("(?iu)" if p.fold else "") + _spell(rx, _TAIL, "[0-9]", spaces)


def python(p: Pattern):
    import regex

    spaces = "".join(f"\\u{c:04x}" for c in SPACES)
    if p.fold:  # the letters fold as Unicode has it, so word edges are spelled out: one before the first word, else behind one
        first = r"(?<![A-Za-z0-9_])" if p.rx.startswith(r"\b") else ""
        return regex.compile(first + _spell(p.rx.removeprefix(r"\b"), "(?![A-Za-z0-9_])", "[0-9]", spaces), regex.IGNORECASE)
    return (re if p.verify else regex).compile(_spell(p.rx, r"\b", "[0-9]", spaces), re.ASCII if p.verify else regex.ASCII)


def outwards(p: Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    """The matches of a pattern around an @, from each @ to both sides: no run of characters is tried more than once."""
    import regex

    head, tail = p.rx.split("@")
    before, behind = regex.compile("(?r)" + head, regex.IGNORECASE), regex.compile("@" + tail, regex.IGNORECASE)

    def found(text: str) -> Iterator[tuple[int, int]]:
        done, at = 0, text.find("@")
        while at >= 0:
            a = before.match(text, done, at)
            b = a and behind.match(text, at)
            if b:
                done = b.end()
                yield a.start(), done
            at = text.find("@", max(at + 1, done))

    return found


def re2(p: Pattern) -> str:
    """For DuckDB: word edges are ASCII there, and so is white space."""
    return ("(?i)" if p.fold else "") + p.rx


VERIFY: dict[str, Callable[[str], bool]] = {"cpf": checks.cpf, "cnpj": checks.cnpj, "iban": checks.iban, "dni": checks.dni, "card": checks.card, "phone_a": checks.phone_a, "phone_b": checks.phone_b}
VERIFY_COLUMN = {"cpf": checks.is_cpf, "cnpj": checks.is_cnpj, "iban": checks.is_iban, "dni": checks.is_dni, "card": checks.is_card, "phone_a": checks.not_year_range, "phone_b": checks.not_leading_year}


def by_id(name: str) -> Pattern:
    return next(p for p in PATTERNS if p.id == name)
