"""A span model's codec: words and prompts to padded inputs, logits to candidates and spans.

Inputs and logits are numpy inside a Python worker; decoding is also there as expressions over arrays of logits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Special tokens of the prompt, and the three scores of a word.
ENTITY, SEPARATOR = "<<ENT>>", "<<SEP>>"
START, END, INSIDE = 0, 1, 2
CACHED_WORDS = 50_000

# Prompts of the two vocabularies, (label, prompt).
MULTI_PROMPTS = (
    ("private_person", "person"), ("private_person", "username"), ("private_address", "address"), ("private_address", "postal code"),
    ("private_email", "email"), ("private_phone", "phone number"), ("private_phone", "mobile phone number"), ("private_date", "date of birth"),
    ("private_date", "date"), ("account_number", "cpf"), ("account_number", "cnpj"), ("account_number", "driver's license number"),
    ("account_number", "passport number"), ("account_number", "identity card number"), ("account_number", "national id number"),
    ("account_number", "tax identification number"), ("account_number", "bank account number"), ("account_number", "iban"),
    ("account_number", "credit card number"), ("account_number", "social security number"), ("account_number", "health insurance number"),
    ("account_number", "license plate number"), ("private_url", "social media handle"), ("secret", "password"),
)
BASE_PROMPTS = (
    ("private_person", "name"), ("private_person", "username"), ("private_address", "location address"), ("private_address", "location street"),
    ("private_address", "location zip"), ("private_email", "email address"), ("private_phone", "phone number"), ("private_date", "dob"),
    ("private_date", "date"), ("account_number", "cpf"), ("account_number", "cnpj"), ("account_number", "driver license"),
    ("account_number", "passport number"), ("account_number", "ssn"), ("account_number", "account number"), ("account_number", "bank account"),
    ("account_number", "iban"), ("account_number", "credit card"), ("account_number", "healthcare number"), ("account_number", "vehicle id"),
    ("private_url", "social media handle"), ("secret", "password"),
)


@dataclass(frozen=True)
class Model:
    id: str
    decoding: str
    languages: tuple[str, ...]
    prompts: tuple[tuple[str, str], ...]
    max_prompts: int
    max_width: int = 12

    def __post_init__(self):
        if len(self.prompts) > self.max_prompts:
            raise ValueError(f"{self.id} takes at most {self.max_prompts} prompts")


#: Models by id: how they decode and what they are asked for. Weights are the user's own.
MODELS = {m.id: m for m in (Model("gliner-multi-pii", "span", ("en", "es", "pt"), MULTI_PROMPTS, 25), Model("gliner-pii-base", "span", ("en",), BASE_PROMPTS, 100), Model("gliner-pii-edge", "token", ("en",), BASE_PROMPTS, 100))}


def model(name: str) -> Model:
    if name not in MODELS:
        raise KeyError(f"no model is called {name}")
    return MODELS[name]


def prompt_table(spark) -> DataFrame:
    return spark.createDataFrame([(m.id, i, label, text) for m in MODELS.values() for i, (label, text) in enumerate(m.prompts)], "model string, ordinal int, label string, prompt string")


# ---------------------------------------------------------------- encoding


@dataclass
class Encoded:
    ids: list[int]
    words_mask: list[int]
    kept: list[tuple]
    span_index: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    span_mask: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def span_pairs(count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every span of up to ``width`` words from every word, ends held inside, and which are inside."""
    start = np.repeat(np.arange(count), width)
    end = start + np.tile(np.arange(width), count)
    return np.stack([start, np.minimum(end, count - 1)], axis=1), end < count


class Codec:
    """``tokenize(text, special)`` gives ids; an empty text with special tokens must give the opening and the closing one."""

    def __init__(self, spec: Model, tokenize: Callable[[str, bool], list[int]]):
        frame = tokenize("", True)
        if len(frame) != 2:
            raise TypeError("the tokenizer must frame an empty text by two tokens")
        self.spec, self.tokenize, self.frame, self.cache = spec, tokenize, frame, {}
        self.prompt = [i for _, p in spec.prompts for i in (*self.ids(ENTITY), *self.ids(p))] + self.ids(SEPARATOR)

    def ids(self, word: str) -> list[int]:
        if word not in self.cache:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = self.tokenize(word, False)
        return self.cache[word]

    def encode(self, words: Sequence[tuple]) -> Encoded | None:
        """``words``: (start, end, text[, line]). None if no word gives a token."""
        pieces = [(w, ids) for w in words if (ids := self.ids(w[2]))]
        if not pieces:
            return None
        head = [self.frame[0], *self.prompt]
        mask = [0] * len(head) + [n if i == 0 else 0 for n, (_, ids) in enumerate(pieces, 1) for i in range(len(ids))] + [0]
        out = Encoded([*head, *(i for _, ids in pieces for i in ids), self.frame[1]], mask, [w for w, _ in pieces])
        if self.spec.decoding == "span":
            out.span_index, out.span_mask = span_pairs(len(pieces), self.spec.max_width)
        return out

    def decode(self, inputs: Sequence[Encoded], logits: np.ndarray, threshold: float) -> list[tuple[int, int, str, float]]:
        out = []
        for item, own in enumerate(inputs):
            found = (span_candidates if self.spec.decoding == "span" else token_candidates)(logits, item, len(own.kept), len(self.spec.prompts), threshold, self.spec.max_width)
            out += [self.located(own.kept, c) for c in suppress(found)]
        return out

    def located(self, words: Sequence[tuple], c: tuple) -> tuple[int, int, str, float]:
        """A candidate at its characters; it ends with its last word on the first one's line."""
        start, end, entity, score = c
        if not (0 <= start < len(words) and 0 <= entity < len(self.spec.prompts)):
            raise IndexError(f"entity {entity} over words {start}-{end} is outside the input")
        line = lambda w: w[3] if len(w) > 3 else None
        last = [w for w in words[start : end + 1] if line(w) == line(words[start])][-1]
        return words[start][0], last[1], self.spec.prompts[entity][0], score


def batches(inputs: Sequence[Encoded], size: int, budget: int) -> list[list[Encoded]]:
    """Inputs in order, as many as ``size`` and as widest x count within ``budget`` allow; one alone always fits."""
    out: list[list[Encoded]] = []
    widest = 0
    for x in inputs:
        wider = max(widest, len(x.ids))
        if out and len(out[-1]) < size and wider * (len(out[-1]) + 1) <= budget:
            out[-1].append(x)
            widest = wider
        else:
            out.append([x])
            widest = len(x.ids)
    return out


def feeds(batch: Sequence[Encoded], wanted: Sequence[str]) -> dict[str, np.ndarray]:
    """Right-padded tensors under the names a graph declares."""
    width, spans = max(len(x.ids) for x in batch), max(len(x.span_mask) for x in batch)
    rows = lambda get, n: np.array([[*get(x), *[0] * (n - len(get(x)))] for x in batch], np.int64)
    have = {
        "input_ids": lambda: rows(lambda x: x.ids, width),
        "attention_mask": lambda: rows(lambda x: [1] * len(x.ids), width),
        "words_mask": lambda: rows(lambda x: x.words_mask, width),
        "text_lengths": lambda: np.array([[len(x.kept)] for x in batch], np.int64),
        "span_idx": lambda: np.stack([np.pad(x.span_index, ((0, spans - len(x.span_index)), (0, 0))) for x in batch]),
        "span_mask": lambda: np.stack([np.pad(x.span_mask, (0, spans - len(x.span_mask))) for x in batch]),
    }
    if unknown := set(wanted) - set(have):
        raise KeyError(f"the graph asks for unknown inputs: {sorted(unknown)}")
    return {name: have[name]() for name in wanted}


# ---------------------------------------------------------------- decoding


def sigmoid(x):
    return 1 / (1 + np.exp(-np.asarray(x, float)))


def _scores(logits: np.ndarray, item: int, entities: int, entity_axis: int) -> np.ndarray:
    if logits.dtype.kind not in "fiu":
        raise TypeError("logits must be numbers")
    if logits.shape[entity_axis] != entities:
        raise TypeError(f"{logits.shape[entity_axis]} entity types were scored where {entities} were asked for")
    if item >= logits.shape[0]:
        raise IndexError(f"item {item} is outside a batch of {logits.shape[0]}")
    return sigmoid(logits[item])


def span_candidates(logits: np.ndarray, item: int, words: int, entities: int, threshold: float, width: int = 12) -> list[tuple]:
    """(start, end, entity, score) of spans that reach the threshold and end inside the words, in order."""
    if logits.ndim not in (3, 4):
        raise TypeError("span logits have three or four dimensions")
    s = _scores(logits if logits.ndim == 4 else logits[None], item, entities, -1)
    start, wide, entity = np.nonzero(s >= threshold)
    sound = start + wide < words
    return [(int(a), int(a + w), int(e), float(s[a, w, e])) for a, w, e in zip(start[sound], wide[sound], entity[sound])]


def token_candidates(logits: np.ndarray, item: int, words: int, entities: int, threshold: float, width: int = 12) -> list[tuple]:
    """A span runs from a start to an end with every word inside it; it is as sure as its weakest score."""
    if logits.ndim != 4 or logits.shape[-1] != 3:
        raise TypeError("start, end and inside were expected for each word")
    s = _scores(logits, item, entities, 2)
    n, out = min(words, s.shape[0]), []
    for entity in range(entities):
        for start in np.flatnonzero(s[:n, entity, START] >= threshold).tolist():
            weakest = np.minimum(s[start, entity, START], np.minimum.accumulate(s[start : min(n, start + width), entity, INSIDE]))
            closing = s[start : start + len(weakest), entity, END]
            sound = np.logical_and.accumulate(s[start : start + len(weakest), entity, INSIDE] >= threshold) & (closing >= threshold)
            out += [(start, start + int(k), entity, float(min(weakest[k], closing[k]))) for k in np.flatnonzero(sound)]
    return out


def suppress(candidates: list[tuple]) -> list[tuple]:
    """The best first (of equals the earlier one), each only if it shares no word with one taken; sorted by start."""
    taken: list[tuple] = []
    for c in sorted(candidates, key=lambda c: -c[3]):
        if all(c[0] > t[1] or t[0] > c[1] for t in taken):
            taken.append(c)
    return sorted(taken, key=lambda c: c[0])


def span_rows(df: DataFrame, logits: Column, widths: int, entities: int, words: Column, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """Span decoding inside the JVM: rows (keep, at, start, end, entity, score) from flat logits [word, width, entity]."""
    rows = df.select(*keep, words.alias("__words"), F.posexplode(logits).alias("at", "logit"))
    score = 1 / (1 + F.exp(-F.col("logit").cast("double")))
    start = F.floor(F.col("at") / (widths * entities)).cast("int")
    end = (start + F.floor(F.col("at") / entities).cast("int") % widths).cast("int")
    rows = rows.withColumns({"start": start, "end": end, "entity": F.col("at") % entities, "score": score})
    return rows.where((F.col("score") >= threshold) & (F.col("end") < F.col("__words"))).select(*keep, "at", "start", "end", "entity", "score")


def detector(codec: Codec, run: Callable[[dict], np.ndarray], inputs: Sequence[str], size: int = 1, budget: int = 4096, floor: float = 0.15, max_words: int = 280, overlap: int = 24):
    """text -> spans with a model: chunks of words and of re-cased shouted lines, batched, decoded, merged, tightened."""
    from veilspan.operators.extract import absorb, find_patterns, tighten
    from veilspan.operators.words import chunk_list, shouted_words, split_words

    def find(text: str):
        jobs = []
        for chunk in chunk_list(split_words(text), max_words, overlap):
            lo, hi = chunk[0][0], chunk[-1][1]
            jobs += [codec.encode(chunk), codec.encode(shouted_words(text[lo:hi], lo))]
        found = [s for b in batches([j for j in jobs if j], size, budget) for s in codec.decode(b, run(feeds(b, inputs)), floor)]
        return tighten(sorted(absorb(found), key=lambda s: (s[0], s[1])), find_patterns(text), text)

    return find
