"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by array operations over code points (the same cuts as the tokenizer's pattern), and equal
pre-tokens are found by hash, so that each distinct one of a slice is looked up once:

1. a minimal perfect hash over the vocabulary's byte strings answers pre-tokens that are whole entries;
2. any other is merged by rank, with a heap of candidate pairs over a doubly linked list of bytes.

Answers are kept for later slices in two generations of bounded size. The ids of a text are gathered from the distinct
pre-tokens' ids; decoding gathers each id's bytes. Whatever is encoded is decoded at once, and a text whose bytes did not
come back, because two of its pre-tokens shared a hash, is encoded again without hashes.

Defined cases: a null or empty text has no ids; special tokens' names are ordinary text; lone code points, control
characters and white space of any kind are kept byte for byte; repeated rows are encoded each; a kept column that bears a
result's name gives way to the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C

U64 = np.uint64
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Pre-tokens the cache has room for, and ids it holds before it is emptied.
SLOTS, ARENA = 1 << 20, 1 << 23
#: Code points worked on at once.
PIECE = 1 << 17


#: Letters and numbers of Unicode 16 that Python's own tables may not know yet, as code point ranges.
#: Fixed values.
_LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def _classes() -> np.ndarray:
    """Each code point's class in the pattern: letter, number, white space or other."""
    import unicodedata

    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    out = np.full(0x110000, OTHER, np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = NUMBER
    for kind, ranges in ((LETTER, _LATER_LETTERS), (NUMBER, _LATER_NUMBERS)):
        for lo, hi in ranges:
            out[lo : hi + 1] = kind
    out[first == ord("Z")] = SPACE
    out[[*range(9, 14), 0x85]] = SPACE
    return out


_CLASS: list[np.ndarray] = []


def pretoken_starts(cp: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points ``cp``; ``heads``: sorted distinct beginnings of texts in them.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    if not _CLASS:
        _CLASS.append(_classes())
    n = len(cp)
    kind = _CLASS[0][cp]
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= head[:-1]
    space = kind == SPACE
    start = change.copy()
    # A run of white space gives its last character to what follows in the same text: a blank joins it, others stand alone.
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~head[1:]
    start |= last
    joined = last & (cp == 32)
    start[1:] &= ~joined[:-1]
    start[heads] = True
    # An apostrophe that is a pre-token of its own takes s, t, m, d, re, ve or ll from the letters after it.
    quote = np.flatnonzero((cp == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~head[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a = cp[quote + 1]
        inside = (quote + 2 < n) & ~head[np.minimum(quote + 2, n)]
        b = np.where(inside, cp[np.minimum(quote + 2, n - 1)], 0)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        one = np.isin(a, (115, 116, 109, 100))
        for hit, size in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            after = q + 1 + size
            after = after[after < n]
            start[after] |= (kind[after] == LETTER) & ~head[after]
    return np.flatnonzero(start)


class PerfectHash:
    """A minimal perfect hash: keys fall into buckets, and each bucket has the displacement that sends its keys to free slots."""

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        n = len(keys)
        self.buckets = max(1, n // 2)
        h = np.array([self.hash(k) for k in keys], U64)
        bucket = (h % U64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        self.move = np.zeros(self.buckets, np.int64)
        self.slot = np.full(n, -1, np.int64)
        free = [True] * n
        sizes = np.diff(cut)
        mask = (1 << 64) - 1
        hs = h.tolist()
        order = np.argsort(-sizes, kind="stable").tolist()
        alone = [b for b in order if sizes[b] == 1]
        for b in order[: int((sizes > 1).sum())]:
            own = by[cut[b] : cut[b + 1]].tolist()
            d = 0
            while True:
                at = [self._at(hs[i], d, n, mask) for i in own]
                if len(set(at)) == len(at) and all(free[x] for x in at):
                    break
                d += 1
            self.move[b] = d
            for x, i in zip(at, own):
                free[x], self.slot[x] = False, i
        for b, x in zip(alone, (x for x in range(n) if free[x])):  # a bucket of one key names its slot
            self.move[b], self.slot[x] = -1 - x, by[cut[b]]
        self.moves = self.move.tolist()
        self.slots = self.slot.tolist()

    @staticmethod
    def hash(key: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")

    @staticmethod
    def _at(h: int, d: int, n: int, mask: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & mask
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return (x ^ (x >> 32)) % n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.keys:
            return -1
        h = self.hash(key)
        d = self.moves[h % self.buckets]
        i = self.slots[-1 - d if d < 0 else self._at(h, d, len(self.keys), (1 << 64) - 1)]
        return i if self.keys[i] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until no pair is in the vocabulary."""
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        a = parts[i]
        j = nxt[i]
        if a is None or j >= n or get(both := a + parts[j]) != r:
            continue  # one of its sides has grown meanwhile
        parts[i], parts[j] = both, None
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
            if (r := get(both + parts[k])) is not None:
                heapq.heappush(heap, (r, i))
        p = prev[i]
        if p >= 0 and (r := get(parts[p] + both)) is not None:
            heapq.heappush(heap, (r, p))
    return [ranks[x] for x in parts if x is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file's byte strings and their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """A vocabulary with its perfect hash, and the ids of pre-tokens met lately."""

    def __init__(self, path: str, piece=None):
        """``piece``: another encoder of single pre-tokens, in place of the two tiers."""
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(list(self.ranks) if piece is None else [])
        if piece is not None:
            self.piece = piece
        self.numbers = list(self.ranks.values())
        self.names: list[bytes] = [b""] * (max(self.numbers) + 1)
        for k, v in self.ranks.items():
            self.names[v] = k
        self.kind = np.uint16 if len(self.names) <= 1 << 16 else np.uint32
        self.lengths = np.array([len(x) for x in self.names], np.int64)
        self._empty()

    def _empty(self) -> None:
        """A cache of two places for each hash: key, and where its ids stand in the arena. Key 0 is an empty place."""
        self.keys, self.begins, self.sizes = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.arena, self.used = np.zeros(1 << 16, self.kind), 0

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's two places."""
        return (h >> U64(44)).astype(np.int64), (h & U64(SLOTS - 1)).astype(np.int64)

    def _store(self, h: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Put distinct new hashes into the cache; where their ids stand."""
        sizes = np.array([len(x) for x in ids], np.int64)
        begins = np.cumsum(sizes) - sizes + self.used
        end = self.used + int(sizes.sum())
        if end > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(max(len(self.arena), end - len(self.arena)), self.kind)])
        self.arena[self.used : end] = np.fromiter((i for x in ids for i in x), self.kind, end - self.used)
        self.used = end
        a, b = self._places(h)
        at = np.where(self.keys[a] == 0, a, b)
        self.begins[at], self.sizes[at], self.keys[at] = begins, sizes, h
        # Two of them may have met in one place: the last one has it, as its key says.
        return begins, sizes

    def piece(self, raw: bytes) -> list[int]:
        at = self.whole.get(raw)
        return [self.numbers[at]] if at >= 0 else merge(raw, self.ranks)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin. Their bytes are the texts' bytes."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        for part, owners, heads in _pieces(texts):
            raw = part.encode("utf-8", "surrogatepass")
            got, n = self._encode(part, raw, heads)
            if self.decode(got.tolist()) != raw:
                own = [self.encode_plainly(part[a:b]) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(part)])]
                got, n = np.array([i for x in own for i in x], self.kind), np.array([len(x) for x in own])
            ids.append(got)
            np.add.at(counts, owners, n)
        return (np.concatenate(ids) if ids else np.zeros(0, self.kind)), np.r_[0, np.cumsum(counts)]

    def _encode(self, text: str, raw: bytes, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        starts = pretoken_starts(cp, heads)
        bounds = np.r_[starts, len(cp)]
        if len(raw) > len(cp):  # where the code points begin among the bytes
            bounds = np.r_[0, np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))][bounds]
        h = C.span_hashes(np.frombuffer(raw, np.uint8), bounds[:-1], bounds[1:])
        h[h == 0] = 1
        if self.used > ARENA:
            self._empty()
        a, b = self._places(h)
        at = np.where(self.keys[a] == h, a, b)
        begins, sizes = self.begins[at], self.sizes[at]
        missing = np.flatnonzero(self.keys[at] != h)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            first = missing[first]
            piece = self.piece
            ids = [piece(raw[s:e]) for s, e in zip(bounds[first].tolist(), bounds[first + 1].tolist())]
            where, size = self._store(new, ids)
            begins[missing], sizes[missing] = where[back], size[back]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        index = np.repeat(begins - total[:-1], sizes)
        index += np.arange(total[-1])
        return self.arena[index], np.diff(np.r_[total[np.searchsorted(starts, heads)], total[-1]])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))

    def encode_plainly(self, text: str) -> list[int]:
        """Without hashes of pre-tokens or arrays: the check behind the fast way."""
        import public_tokenizers
        import regex

        return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in self.piece(m.encode("utf-8", "surrogatepass"))]


def _pieces(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Text of about PIECE code points, the numbers of the texts in it, and where each begins. Long texts are cut where
    a white space follows something else: a pre-token always begins there."""
    import regex

    part, owners, heads, size = [], [], [], 0

    def out():
        return "".join(part), np.array(owners), np.array(heads)

    for i, t in enumerate(texts):
        at, n = 0, len(t or "")
        while at < n:
            to = n
            if n - at > 2 * PIECE:
                m = regex.compile(r"(?<=\S)\s").search(t, at + PIECE)
                to = m.start() if m else n
            part.append(t[at:to])
            owners.append(i)
            heads.append(size)
            size += to - at
            at = to
            if size >= PIECE:
                yield out()
                part, owners, heads, size = [], [], [], 0
    if part:
        yield out()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ids (array of int) and n_tokens."""
    keep = C.kept(keep, ["ids", "n_tokens"])
    own = C.free_name(keep, "__text")

    def run(batches):
        c = codec(vocabulary)
        for b in C.slices(batches, own):
            ids, at = c.encode(b[own].to_pylist())
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(np.diff(at))], [*keep, "ids", "n_tokens"])

    return df.select(*keep, F.col(text).alias(own)).mapInArrow(run, C.typed(df, keep, "ids array<int>, n_tokens long"))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with decoded (binary). Null ids: null."""
    keep = C.kept(keep, ["decoded"])
    own = C.free_name(keep, "__ids")

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array([None if x is None else c.decode(x) for x in b[own].to_pylist()], pa.binary())], [*keep, "decoded"])

    return df.select(*keep, F.col(ids).alias(own)).mapInArrow(run, C.typed(df, keep, "decoded binary"))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with n_tokens, and SHA-256 of the ids (little-endian, 32 bits each) and of the decoded bytes."""
    keep = C.kept(keep, ["n_tokens", "ids_sha256", "decoded_sha256"])
    own = C.free_name(keep, "__text")

    def run(batches):
        c = codec(vocabulary)
        for b in C.slices(batches, own, 4 << 20):
            ids, at = c.encode(b[own].to_pylist())
            four, every = ids.astype("<u4"), ids.tolist()
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist()))
            a = [hashlib.sha256(four[lo:hi]).hexdigest() for lo, hi in cuts]
            d = [hashlib.sha256(c.decode(every[lo:hi])).hexdigest() for lo, hi in cuts]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(np.diff(at).astype(np.int64)), pa.array(a), pa.array(d)], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(*keep, F.col(text).alias(own)).mapInArrow(run, C.typed(df, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
