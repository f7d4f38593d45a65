"""Text functions of the span model, as Column expressions over code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.dimensions import MASK, PREVIEW

#: White space as the patterns mean it, in a Java character class.
WS = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _latin() -> tuple[str, str]:
    """Precomposed letters of the Latin blocks, and the letters without their marks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def plain(value: Column) -> Column:
    """Without marks: combining ones dropped, precomposed Latin letters replaced."""
    return F.regexp_replace(F.translate(value, *_latin()), r"\p{M}", "")


def normalise(value: Column) -> Column:
    """Trimmed, runs of white space as one blank."""
    return F.regexp_replace(F.regexp_replace(value, f"^[{WS}]+|[{WS}]+$", ""), f"[{WS}]+", " ")


def folded(value: Column) -> Column:
    return F.lower(normalise(value))


def as_term(value: Column) -> Column:
    """Folded, without one leading article of a supported language."""
    return F.regexp_replace(folded(value), r"(?iu)^(?:the|an?|el|l[ao]s?|un[ao]?|[ao]s?)[" + WS + "]+", "")


def value_key(value: Column, accents: bool = False) -> Column:
    """What makes two values one: letters and numbers only, in lower case, and without marks unless ``accents`` tell values apart."""
    return F.lower(F.regexp_replace(value if accents else plain(value), r"[^\p{L}\p{N}]", ""))


def field_key(name: Column) -> Column:
    """A field's name as the field table has it."""
    return F.regexp_replace(F.lower(plain(name)), "[^a-z0-9]", "")


def preview(value: Column, graphemes: int = PREVIEW) -> Column:
    return F.regexp_extract(value, r"^\X{0," + str(graphemes) + "}", 0)


def blocks(value: Column, breaks: bool = True) -> Column:
    """One block a grapheme, line breaks kept; without ``breaks`` each of their characters is a block too."""
    return F.regexp_replace(value, (r"(?![\r\n\x{2028}\x{2029}])" if breaks else r"[\r\n]|") + r"\X", MASK)


def is_masked(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit(MASK), F.lit("")), f"[{WS}]", "") == ""


def escaped(value: Column) -> Column:
    """As a regular expression that matches the value itself."""
    return F.regexp_replace(value, r"([$*+.?^\\/()\[\]{|}])", r"\\$1")


def slice_of(text: Column, start, end) -> Column:
    """Characters start (from 0) up to end."""
    at = start if isinstance(start, Column) else F.col(start)
    to = end if isinstance(end, Column) else F.col(end)
    return F.substr(text, (at + 1).cast("int"), (to - at).cast("int"))


def to_utf16(text: Column, offset: Column) -> Column:
    """A code point offset as one of UTF-16 code units: characters outside the basic plane before it count twice."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return offset + F.length(before) - F.length(F.regexp_replace(before, r"[\x{10000}-\x{10FFFF}]", ""))


def offsets(pieces: Column, gap: int = 0, size=F.length) -> Column:
    """array<int>: where each piece begins when they stand in a row, ``gap`` characters apart, and where the last one ends. One
    pass carries the offset along."""
    zero = F.array(F.lit(0)).cast("array<int>")
    return F.aggregate(pieces, zero, lambda at, x: F.concat(at, F.array((F.element_at(at, -1) + size(x) + F.lit(gap)).cast("int"))))
