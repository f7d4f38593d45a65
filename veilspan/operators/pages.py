"""Small helpers for pages inside Python workers."""

from __future__ import annotations

import unicodedata

from veilspan.functions.dimensions import MIN_CONFIDENCE, MIN_HITS, STOPWORDS


def vote(text: str) -> str | None:
    """The language whose stopwords outvote the others', if there are enough."""
    import regex

    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()
    tokens = regex.findall(r"[\p{L}']+", bare)
    hits = {lang: sum(t in own for t in tokens) for lang, own in ((k, set(v)) for k, v in STOPWORDS.items())}
    top, second = sorted(hits.values())[::-1][:2]
    if top <= second or top / sum(hits.values()) * min(1, sum(hits.values()) / MIN_HITS) < MIN_CONFIDENCE:
        return None
    return max(hits, key=hits.get)
