"""Toxicity by a weighted finite-state grammar over clauses.

Two layers of transducers are composed. The first reads words: a trie of entries of one to four words rewrites them to tags,
insults, threats, targets (whom it is said to), negations, verbs of reported speech, intents and intensifiers. Insults come from short
seed lists and from labelled rows: words, word beginnings and pairs of words that explain toxic texts no other entry explains.

The second reads tags, by five weighted transducers: insult patterns (an insult behind an intensifier or another insult is a
strong one), threat patterns (a threat is meant only behind an intent; a verb of violence alone weighs little), negation,
reported speech and targets. Each keeps a state of its own and puts a flag on an insult or threat; their composition is one machine
over tuples of states, which gives every insult or threat its reading and its weight. A clause's score is what its
machine adds up, so a word is judged by its clause and not alone. How much each reading counts is fitted on the sample.

Scoring looks up the hashes of all words and word beginnings at once and runs the machine over the clauses that hold an
insult or a threat. Training reads a bounded sample of labelled rows (``bound`` rows, ``labelled.BOUND_BYTES`` of text) in one task.

Defined cases: a null or empty text, or one without a matched clause, scores by the intercept alone; without labelled rows
the seeds and their default weights decide; repeated rows are scored each and teach once; ids labelled both ways teach nothing;
an entry does not reach over the end of a clause; a kept column that bears the score's name gives way to it.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C
from veilspan.llm.labelled import labelled_sample, learn

U64 = np.uint64
#: Labelled rows that are learnt from, at most; texts an entry must explain that none before it does; prefix lengths (bytes).
BOUND, NEWLY, PREFIXES = 8_000, 3, (4, 5, 6)
#: How many times likelier toxic texts must hold an entry than clean ones.
LEAST_ODDS = 25

#: Seeds of the lexicon. Fixed values.
INSULTS = "idiot moron stupid loser pathetic scum trash worthless clown disgusting dumb fool garbage vermin filth idiota imbecil basura estupido dummkopf abschaum idiote ordure debile".split()
THREATS = "kill hurt destroy attack murder beat burn shoot stab matar golpear toten verprugeln tuer frapper".split()
TARGETS = "you your yours yourself u he she they them him her his their tu usted vous toi votre du dich dein ihr sie ihn ellos ella ils elles".split()
NEGATIONS = "not no never n't isn't aren't don't doesn't nobody nunca jamas nicht kein keine nie pas jamais ne".split()
REPORTS = "said says say told called wrote claimed quoted reported accused dijo dicen sagte sagt schrieb dit disait affirme".split()
INTENTS = "will gonna shall should must deserve deserves hope want voy vais werde werden".split()
STRONG_WORDS = "such total complete absolute utter utterly fucking damn so very stupid muy tan tellement so sehr".split()
INSULT_PHRASES = ("piece of shit", "waste of space", "waste of oxygen", "go to hell", "drop dead", "hijo de puta", "ta gueule", "halt die klappe")
THREAT_PHRASES = ("watch your back", "burn in hell", "make you pay", "te voy a matar", "je vais te tuer", "ich bringe dich um")
TAGS = ("word", "insult", "threat", "target", "negation", "report", "intent", "strong")
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, STRONG = range(8)
#: Words an entry has at most.
LONGEST = 4
#: Words a negation reaches ahead, and a target reaches either way.
REACH = 3

#: What a text's clauses are summed up to: insults and threats by reading, strong insults, meant threats, the best clause.
READINGS = [k + "".join(x) for k in ("insult", "threat") for x in itertools.product(("", "+negated"), ("", "+reported"), ("", "+aimed"))] + ["strong", "meant", "best"]
#: The weights of an intercept and of these where nothing is learnt.
DEFAULTS = [-3.0, 1.5, 2.5, 0.8, 1.2, 0.3, 0.5, 0.2, 0.3, 0.5, 1.0, 0.2, 0.4, 0.1, 0.2, 0.1, 0.1, 0.5, 1.5, 2.5]


# ---------------------------------------------------------------- transducers


@dataclass
class Transducer:
    """States 0..n-1, from 0: (state, tag) gives the next state, the flags it puts on an insult or threat (so many bits), and a
    log weight."""

    states: int
    bits: int = 1
    step: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)


def insults(reach: int = 2, weight: float = 0.5) -> Transducer:
    """An insult is strong behind an intensifier, or another insult, so many words before."""
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for tag in range(len(TAGS)):
            strong = tag == INSULT and s > 0
            t.step[s, tag] = (reach if tag in (STRONG, INSULT) else max(0, s - 1), int(strong), weight if strong else 0.0)
    return t


def threats(reach: int = REACH, weight: float = 1.0) -> Transducer:
    """A threat is meant behind an intent; it weighs less without."""
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for tag in range(len(TAGS)):
            meant = tag == THREAT and s > 0
            t.step[s, tag] = (reach if tag == INTENT else max(0, s - 1), int(meant), weight if meant else -weight if tag == THREAT else 0.0)
    return t


def negation(reach: int = REACH, weight: float = -1.5) -> Transducer:
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for tag in range(len(TAGS)):
            t.step[s, tag] = (reach, 0, 0.0) if tag == NEGATION else (max(0, s - 1), int(s > 0), weight if s else 0.0)
    return t


def reported(weight: float = -0.7) -> Transducer:
    t = Transducer(2)
    for s in range(2):
        for tag in range(len(TAGS)):
            t.step[s, tag] = (1 if tag == REPORT else s, s, weight if s else 0.0)
    return t


def aimed(reach: int = REACH, weight: float = 0.7) -> Transducer:
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        for tag in range(len(TAGS)):
            t.step[s, tag] = (reach, 0, 0.0) if tag == TARGET else (max(0, s - 1), int(s > 0), weight if s else 0.0)
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same tags; flags are set side by side and weights add up."""
    t = Transducer(a.states * b.states, a.bits + b.bits)
    for (s, tag), (s2, f, w) in a.step.items():
        for r in range(b.states):
            r2, g, v = b.step[r, tag]
            t.step[s * b.states + r, tag] = (s2 * b.states + r2, f << b.bits | g, w + v)
    return t


def grammar() -> Transducer:
    """How what is said is meant: negation, reported speech, targets."""
    return compose(compose(negation(), reported()), aimed())


def machine() -> Transducer:
    """The whole grammar: patterns of insults and threats, and how they are meant."""
    return compose(compose(insults(), threats()), grammar())


def clause_readings(t: Transducer, tags: list[int], weights: list[float]) -> tuple[list[float], float]:
    """Summed weights by reading (READINGS without the last), and the clause's score."""
    state, sums, score = 0, [0.0] * (len(READINGS) - 1), 0.0
    for tag, w in zip(tags, weights):
        state_then, flags, log = t.step[state, tag]
        if tag in (INSULT, THREAT):
            sums[(flags & 7) + (8 if tag == THREAT else 0)] += w
            sums[16] += w * (flags >> 4 & 1)
            sums[17] += w * (flags >> 3 & 1)
            score += w * math.exp(log)
        state = state_then
    return sums, score


# ---------------------------------------------------------------- words


_STRIP = np.zeros(256, bool)
_STRIP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[33, 46, 58, 59, 63]] = True


@dataclass
class Words:
    """The words of several texts: the bytes, where each begins and ends without punctuation, clause ends, and texts' begins."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    breaks: np.ndarray
    at: np.ndarray


def split(column) -> Words:
    """Words are runs without white space or ASCII punctuation, apostrophes and hyphens inside them apart."""
    raw, off = C.text_bytes(column)
    low = C._LOWER[raw]
    solid = ~(C._SPACE[raw] | _STRIP[raw])
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = ((raw[1:-1] == 39) | (raw[1:-1] == 45)) & solid[:-2] & solid[2:]
    solid |= inner
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads = off[:-1][off[:-1] < len(raw)]
    first[heads] = solid[heads]
    tails = heads[heads > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    stop = np.r_[0, np.cumsum(_BREAK[raw] | (raw == 10))]
    breaks = stop[np.r_[starts[1:], len(raw)]] > stop[ends] if len(starts) else np.zeros(0, bool)
    return Words(low, starts, ends, breaks, np.searchsorted(starts, off))


def keys(w: Words) -> list[np.ndarray]:
    """Hashes of the words, and of their beginnings of each length (0: the word is shorter)."""
    out = [C.span_hashes(w.low, w.starts, w.ends)]
    for n in PREFIXES:
        h = C.span_hashes(w.low, w.starts, np.minimum(w.starts + n, w.ends)) ^ U64(n)
        out.append(np.where(w.ends - w.starts >= n, h, U64(0)))
    return out


def _then(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The trie's state behind ``state`` and one more word. The first word's hash is the state behind it."""
    return C.mix64(state * U64(0x9E3779B97F4A7C15) + (word << U64(29) | word >> U64(35)))


def text_numbers(w: Words) -> np.ndarray:
    """Which text each word stands in."""
    return np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))


def joined(w: Words) -> np.ndarray:
    """Whether each word and the one behind it stand in one clause."""
    text = text_numbers(w)
    return np.r_[(text[1:] == text[:-1]) & ~w.breaks[:-1], False] if len(text) else np.zeros(0, bool)


def pairs(w: Words, h: np.ndarray) -> np.ndarray:
    """States behind each word and the one before it (0: they stand in different clauses)."""
    out = np.zeros(len(h), U64)
    if len(h) > 1:
        out[1:] = np.where(joined(w)[:-1], _then(h[:-1], h[1:]), U64(0))
    return out


def word_key(word: str) -> int:
    """The trie's state behind an entry of one or more words."""
    state = None
    for x in word.split():
        raw = np.frombuffer(x.encode(), np.uint8)
        h = C.span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))
        state = h if state is None else _then(state, h)
    return int(state[0])


def _member(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where((table[at] == h) & (h != 0), at, -1)


@dataclass
class Grammar:
    """Entries (sorted states of the trie, tags, weights), the states that go on, and the readings' weights, behind an
    intercept; the last is the best clause's."""

    hashes: list[int]
    tags: list[int]
    weights: list[float]
    starts: list[int]
    readings: list[float]


def seeds() -> dict[int, tuple[int, float]]:
    out = {}
    for tag, own in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (INTENT, INTENTS), (STRONG, STRONG_WORDS), (THREAT, THREATS), (INSULT, INSULTS), (INSULT, INSULT_PHRASES), (THREAT, THREAT_PHRASES)):
        out.update({word_key(x): (tag, 1.0) for x in own})
    return out


def phrase_starts() -> set[int]:
    """States behind the beginnings of the seeds' entries of several words."""
    return {word_key(" ".join(x.split()[:n])) for x in (*INSULT_PHRASES, *THREAT_PHRASES) for n in range(1, len(x.split()))}


def tagged(w: Words, hashes: np.ndarray, tags: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first layer: each word's tag and weight. The longest entry that ends with a word decides, then the whole word's, then
    those of its beginnings."""
    tag, weight = np.zeros(len(w.starts), np.int64), np.zeros(len(w.starts))

    def put(where: np.ndarray, h: np.ndarray) -> None:
        at = _member(hashes, h)
        hit = at >= 0
        tag[where[hit]], weight[where[hit]] = tags[at[hit]], weights[at[hit]]

    own, every = keys(w), np.arange(len(w.starts))
    for h in reversed(own):
        put(every, h)
    on = joined(w)
    at, state = every, own[0]
    for _ in range(1, LONGEST):  # the trie goes on from the states that have successors
        go = (_member(starts, state) >= 0) & on[at]
        at = at[go] + 1
        state = _then(state[go], own[0][at])
        put(at, state)
    return tag, weight


def clause_features(w: Words, hashes: np.ndarray, tags: np.ndarray, weights: np.ndarray, starts: np.ndarray, t: Transducer) -> np.ndarray:
    """A row for each text: READINGS, the sums damped by a square root."""
    out = np.zeros((len(w.at) - 1, len(READINGS)))
    if not len(w.starts):
        return out
    tag, weight = tagged(w, hashes, tags, weights, starts)
    clause = np.r_[0, np.cumsum(w.breaks)[:-1]] + text_numbers(w)  # a text ends a clause
    bad = np.flatnonzero((tag == INSULT) | (tag == THREAT))
    for c in np.unique(clause[bad]).tolist():
        lo, hi = np.searchsorted(clause, [c, c + 1])
        sums, score = clause_readings(t, tag[lo:hi].tolist(), weight[lo:hi].tolist())
        row = out[np.searchsorted(w.at, lo, "right") - 1]
        row[:-1] += sums
        row[-1] = max(row[-1], score)
    out[:, :-1] = np.sqrt(out[:, :-1])
    return out


# ---------------------------------------------------------------- learning


def _held(texts, rows: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, whether of a pair) of the words, beginnings and pairs that those texts hold, each once a text; of ``only``
    if given."""
    out = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool))]
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        w = split(texts.take(pa.array(part)))
        own, text = keys(w), text_numbers(w)
        for pair, h in [*((False, h) for h in own), (True, pairs(w, own[0]))]:
            use = h != 0 if only is None else _member(only, h) >= 0
            own_text, own_key = text[use], h[use]
            once = np.unique(C.mix64(own_key ^ C.mix64(own_text.astype(U64))), return_index=True)[1]
            out.append((part[own_text[once]], own_key[once], np.full(len(once), pair)))
    return tuple(np.concatenate(x) for x in zip(*out))


def fit(texts, y: np.ndarray) -> Grammar:
    """Entries by greedy cover of the toxic texts, then the readings' weights by Newton's method."""
    first: dict[tuple, int] = {}
    for lo in range(0, len(y), 256):
        w = split(texts.slice(lo, 256))
        h = C.span_hashes(w.low, w.starts, w.ends)
        for i in range(len(w.at) - 1):
            own = h[w.at[i] : w.at[i + 1]]
            first.setdefault((len(own), int(C.span_hashes(own, [0], [len(own)])[0])), lo + i)
    one = np.zeros(len(y), bool)  # of texts with the same words one counts
    one[list(first.values())] = True
    toxic, fine = np.flatnonzero(one & (y > 0)), np.flatnonzero(one & ~(y > 0))
    known, starts = seeds(), phrase_starts()
    row, key, pair = _held(texts, toxic)
    u, back, dirty = np.unique(key, return_inverse=True, return_counts=True)
    is_pair = np.zeros(len(u), bool)
    is_pair[back] = pair
    often = dirty >= np.where(is_pair, 2 * NEWLY, NEWLY)
    looked = np.unique(np.concatenate([u[often], np.array(sorted(known), U64)]))  # only these are counted in clean texts
    _, seen, _ = _held(texts, fine, looked)
    clean_of = dict(zip(*(x.tolist() for x in np.unique(seen, return_counts=True))))
    clean = np.array([clean_of.get(int(k), 0) for k in u[often]], np.int64)
    share = max(len(toxic), 1) / max(len(fine), 1)
    good = (dirty[often] + 0.5) / (clean + 0.5) / share >= LEAST_ODDS
    entries = np.flatnonzero(often)[good]
    clean, counted = clean[good], dirty[entries]
    odds = (counted + 0.5) / (clean + 0.5) / share
    number = np.full(len(u), -1)
    number[entries] = np.arange(len(entries))
    pick = number[back] >= 0
    entry, holder = number[back[pick]], row[pick]
    left = np.zeros(len(y), bool)
    left[toxic] = True
    words_of = _pair_words(texts, toxic, u[entries][is_pair[entries]])
    while len(entries):
        gain = np.bincount(entry, left[holder], len(entries))
        best = int(np.lexsort((u[entries], counted, np.where(gain >= NEWLY, gain * np.minimum(1.0, odds / 1000), -1.0)))[-1])
        if gain[best] < NEWLY:
            break
        k = int(u[entries[best]])
        known[k] = (INSULT, float((counted[best] + 0.5) / (counted[best] + clean[best] + 1)))
        if k in words_of:
            starts.add(words_of[k])
        left[holder[entry == best]] = False
    # A seed that clean texts hold as often is none here.
    dirty_of = dict(zip(u.tolist(), dirty.tolist()))
    for k, (tag, _) in list(known.items()):
        n, bad = clean_of.get(k, 0), dirty_of.get(k, 0)
        if tag in (INSULT, THREAT) and n >= 3 and (bad + 0.5) / (n + 0.5) / share < 4:
            known[k] = (WORD, 0.0)
    g = _packed(known, starts, list(DEFAULTS))
    if not len(y) or y.min() == y.max():
        return g
    t = machine()
    x = np.concatenate([clause_features(split(texts.slice(lo, 256)), *_arrays(g), t) for lo in range(0, len(y), 256)])
    x = np.c_[np.ones(len(x)), x]
    g.readings = newton(x, y.astype(float)).tolist()
    return g


def _pair_words(texts, rows: np.ndarray, wanted: np.ndarray) -> dict[int, int]:
    """The first word of each of those pairs."""
    out: dict[int, int] = {}
    for lo in range(0, len(rows) if len(wanted) else 0, 256):
        w = split(texts.take(pa.array(rows[lo : lo + 256])))
        h = keys(w)[0]
        both = pairs(w, h)
        at = np.flatnonzero(_member(wanted, both) >= 0)
        out.update(zip(both[at].tolist(), h[at - 1].tolist()))
    return out


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression. Readings may not lower a score: a negative weight is set to none and the rest refitted."""
    free = np.ones(x.shape[1], bool)
    while True:
        b = np.zeros(x.shape[1])
        own = x[:, free]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(own @ b[free], -30, 30)))
            g = own.T @ (y - p) - ridge * b[free]
            h = (own * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ own + ridge * np.eye(own.shape[1])
            step = np.clip(np.linalg.solve(h, g), -3, 3)
            b[free] += step
            if np.abs(step).max() < 1e-8:
                break
        negative = (b < 0) & (np.arange(len(b)) > 0)
        if not negative.any():
            return b
        free &= ~negative


def _packed(known: dict[int, tuple[int, float]], starts: set[int], readings: list[float]) -> Grammar:
    order = sorted(known)
    return Grammar(order, [known[k][0] for k in order], [known[k][1] for k in order], sorted(starts), readings)


def _arrays(g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.array(g.hashes, U64), np.array(g.tags, np.int64), np.array(g.weights), np.array(g.starts, U64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND) -> Grammar:
    def one(texts, y):
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit(texts, y).__dict__)])], ["g"])

    for r in learn(labelled_sample(docs, labels, label, bound), one, "g string"):
        return Grammar(**json.loads(r["g"]))
    return fit(pa.chunked_array([pa.array([], pa.string())]), np.zeros(0, np.int64))


def score(docs: DataFrame, g: Grammar, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, 0 to 1."""
    keep = C.kept(keep, [name])
    rows, own_text = C.with_text(docs, keep, text)
    C.short_batches(docs.sparkSession)
    plain = dict(g.__dict__)

    def run(batches):
        own = Grammar(**plain)
        arrays, t, b0 = _arrays(own), machine(), np.array(own.readings)
        for b in C.slices(batches, own_text, 1 << 20):
            x = clause_features(split(b[own_text]), *arrays, t)
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(1 / (1 + np.exp(-np.clip(b0[0] + x @ b0[1:], -35, 35))))], [*keep, name])

    return rows.mapInArrow(run, C.typed(docs, keep, f"`{name}` double"))
