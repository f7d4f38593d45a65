"""Line dedup by pairwise alignment.

A unit is a line, or a piece of one: lines are cut behind sentences, and sentences at words that they name themselves: of every
WINDOW words in a row the one whose hash is smallest begins a unit. So whole lines and sentences are cut alike wherever they
stand, and a passage inside longer ones is but for its first and last WINDOW - 1 words at most, even in lines without
punctuation; a word that repeats the one before it begins none, and a row of one word is cut by its length. A run is a stretch of units with ``block_words`` words or more
that would have fewer without its last unit, or without its first; every unit of a longer shared stretch lies in a run within
it. Every run's hash has an owner: the smallest id among the documents that hold it. A later document is paired with the
owners of its runs, never with all other holders, so a run in a thousand documents makes at most a thousand pairs, and none is
lost because single units of it stand in still earlier documents. Each pair's two sequences of
hashes are aligned by patience diff: common heads and tails, then units that are unique in both sides, in the longest order
they share, and the same between these. Aligned blocks of at least ``block_words`` words are deleted from the later document.
What has no unique anchor, such as a passage that either side repeats, is matched exactly by a suffix automaton of the owner:
every occurrence in the later document of a run that the owner holds goes, wherever in the owner it stands.

The hashes and owners of shared runs are sorted arrays in the shared folder, mapped where they are looked up. So are the units
to delete, by the documents that lose them: texts are read where they stand and never shuffled.

Defined cases: a null or empty text stays as it is; rows without an id stay whole; rows that share an id count as one
document, and lose nothing to each other; repeated rows lose the same units each; blank lines are no units, and go with the
unit before them where that is deleted; a document may lose its whole text; columns named removed_units or removed_words give
way to the results.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C

U64 = np.uint64
#: Words an aligned block must have to be deleted.
BLOCK_WORDS = 20
#: Words of which one at least begins a unit: a passage of 51 words holds whole units of 51 - 2 * 14 >= BLOCK_WORDS words.
WINDOW = 15
FLUSH = 3_000_000


# ---------------------------------------------------------------- units


def _rolling(x: np.ndarray, of) -> np.ndarray:
    """``of`` all of WINDOW neighbours, from each on."""
    size = 1
    while 2 * size <= WINDOW:
        x, size = of(x[:-size], x[size:]), 2 * size
    more = WINDOW - size
    return of(x[:-more], x[more:]) if more else x


def _named(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which words begin a unit by their hashes alone; ``line``: the number of each word's line or sentence."""
    out = np.zeros(len(h), bool)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    if len(h) >= WINDOW:
        # The smallest of each window that stands in one line; a word is named if it is that of any window it stands in.
        inside = np.where(line[WINDOW - 1 :] == line[: 1 - WINDOW], _rolling(h, np.minimum), U64(0))
        edge = np.zeros(WINDOW - 1, U64)
        out = _rolling(np.concatenate([edge, inside, edge]), np.maximum) == h
        out &= ~same
    at = np.arange(len(h))
    since = at - np.maximum.accumulate(np.where(same, 0, at))
    return out | (same & (since % WINDOW == 0))


def units(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, words, begins and ends (bytes) of all texts' units, and where each text's begin."""
    hashes, words, begins, ends = [], [], [], []
    for lo, hi in C._cuts(raw, off, 1 << 20):
        piece = raw[lo:hi]
        solid = ~C._SPACE[piece]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        a, b = np.searchsorted(off, [lo, hi])
        heads = off[a:b] - lo
        first[heads] = solid[heads]
        last[heads[heads > 0] - 1] = solid[heads[heads > 0] - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        lines = np.r_[0, np.cumsum(piece == 10)]
        new = np.ones(len(s), bool)
        new[1:] = (lines[s[1:]] > lines[e[:-1]]) | np.isin(piece[e[:-1] - 1], (33, 46, 63))
        at = np.searchsorted(s, heads)
        new[at[at < len(s)]] = True
        new |= _named(C.span_hashes(piece, s, e), np.cumsum(new))
        f = np.flatnonzero(new)
        start, end = s[f], e[np.r_[f[1:] - 1, len(s) - 1]]
        hashes.append(C.span_hashes(piece, start, end))
        words.append(np.diff(np.r_[f, len(s)]))
        begins.append(start + lo)
        ends.append(end + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none, np.zeros(len(off), np.int64)
    start = np.concatenate(begins)
    return np.concatenate(hashes), np.concatenate(words), start, np.concatenate(ends), np.searchsorted(start, off)


def runs(h: np.ndarray, words: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shortest runs of at least so many words, from each unit on and up to each unit, and where each text's
    begin."""
    total = np.r_[0, np.cumsum(words)]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    i = np.arange(len(h))
    on = np.searchsorted(total, total[:-1] + least)
    up = np.searchsorted(total, total[1:] - least, "right") - 1
    forth, back = on <= at[text + 1], up >= at[text]
    # A run that is shortest both ways comes once.
    back[back] = on[up[back]] != i[back] + 1
    lo, hi, text = np.r_[i[forth], up[back]], np.r_[on[forth], i[back] + 1], np.r_[text[forth], text[back]]
    order = np.argsort(text, kind="stable")
    return C.span_hashes(h, lo[order], hi[order]), np.searchsorted(text[order], np.arange(len(at)))


# ---------------------------------------------------------------- alignment


def _longest_order(xs: list[int]) -> list[int]:
    """Positions of a longest increasing run in ``xs`` by patience piles."""
    from bisect import bisect_left

    tops, at, back = [], [], []
    for i, x in enumerate(xs):
        p = bisect_left(tops, x)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[p], at[p] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences by patience diff, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        where: dict[int, int] = {}
        for x in range(k, m):
            where[b[x]] = -1 if b[x] in where else x
        seen: dict[int, int] = {}
        for x in range(i, j):
            seen[a[x]] = -1 if a[x] in seen else x
        both = [(x, where[h]) for h, x in seen.items() if x >= 0 and where.get(h, -1) >= 0]
        keep = _longest_order([y for _, y in both])
        if not keep:
            continue
        marks = [both[x] for x in keep]
        out += marks
        edges = [(i - 1, k - 1), *marks, (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]) if r > p + 1 and s > q + 1]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Positions of the first side in aligned blocks (both sides go on by one) of at least so many words."""
    out, run, size = [], [], 0
    for x, y in [*pairs, (-9, -9)]:
        if run and (x, y) != (run[-1][0] + 1, run[-1][1] + 1):
            if size >= least:
                out += [p for p, _ in run]
            run, size = [], 0
        run.append((x, y))
        size += words[x] if x >= 0 else 0
    return out


def repeats(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Positions of ``a`` inside runs of at least so many words that ``b`` holds as they stand, in linear time."""
    held = set(b)
    size = most = 0
    for x, w in zip(a, words):
        size = size + w if x in held else 0
        most = max(most, size)
    if most < least:
        return []
    go, link, length, last = [{}], [-1], [0], 0  # suffix automaton of b
    for x in b:
        new, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and x not in go[p]:
            go[p][x] = new
            p = link[p]
        if p >= 0:
            q = go[p][x]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(x) == q:
                    go[p][x] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    total = [0, *accumulate(words)]
    out, state, n, done = [], 0, 0, 0
    for i, x in enumerate(a):
        while state and x not in go[state]:
            state = link[state]
            n = length[state]
        state, n = (go[state][x], n + 1) if x in go[state] else (0, 0)
        if total[i + 1] - total[i + 1 - n] >= least:
            out += range(max(done, i + 1 - n), i + 1)
            done = i + 1
    return out


def without(raw: bytes, begins: list[int], ends: list[int], gone: list[int]) -> bytes:
    """The text without those units. What separates them goes too, but a line's end stays where its line does."""
    out, lost = [], set(gone)
    at = 0
    for i in range(len(begins)):
        nxt = begins[i + 1] if i + 1 < len(begins) else len(raw)
        if i not in lost:
            out.append(raw[at if i == 0 else begins[i] : nxt])
        elif out and b"\n" in raw[ends[i] : nxt] and b"\n" not in out[-1][-2:]:
            out[-1] = out[-1].rstrip() + b"\n"
    return b"".join(out).rstrip() if lost and len(begins) - 1 in lost else b"".join(out)


# ---------------------------------------------------------------- operator


def _owned(h: np.ndarray, ids: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of sorted ones, each one's smallest id, and whether other ids hold it too or ``more`` says so."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    lo = np.minimum.reduceat(ids, first)
    return h[first], lo, (lo < np.maximum.reduceat(ids, first)) | np.logical_or.reduceat(more, first)


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary for each text: its part of the values."""
    size = values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype("<i8").tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' unit hashes and words in a row, and where each text's begin."""
    raw, off = C.text_bytes(b["h"])
    return np.ascontiguousarray(raw).view(U64), np.ascontiguousarray(C.text_bytes(b["words"])[0]).view("<u4").astype(np.int64), off // 8


def deletions(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, t (the text's hash) and gone (sorted positions of units to delete) of the documents that lose any."""
    spark = docs.sparkSession
    C.short_batches(docs.sparkSession)
    shards, folder = C.shards_for(docs, [text]), C.new_folder(spark, "line-owners")
    docs = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))

    def cut(batches):
        for b in C.slices(batches, "text"):
            h, words, _, _, at = units(*C.text_bytes(b["text"]))
            yield pa.RecordBatch.from_arrays([b["id"], b["t"], _blobs(h, at), _blobs(words.astype("<u4"), at)], ["id", "t", "h", "words"])

    # Written, so that texts are cut once; what follows works on hashes.
    made = C.written(docs.mapInArrow(cut, "id long, t long, h binary, words binary"), "line-units")

    def collect(batches):
        have = []

        def out():
            h, lo, more = (np.concatenate([x[i] for x in have]) for i in range(3))
            have.clear()
            order = np.argsort(h, kind="stable")
            return _owned(h[order], lo[order], more[order])

        def blobs(h, lo, more):
            for s, part in C.split_by_shard(h, shards):
                own, n = lo[part], part.stop - part.start
                least, most = int(own.min()), int(own.max())
                ids = (own - least).astype("<u4") if most - least < 1 << 32 else own
                values = np.array([least], "<i8").tobytes() + np.packbits(more[part]).tobytes() + ids.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([h[part].tobytes()], pa.binary()), pa.array([values], pa.binary()), pa.array([n], pa.int64())], ["shard", "keys", "values", "n"])

        for b in C.slices(batches, "h", 1 << 20):
            u, words, at = _arrays(b)
            h, at = runs(u, words, at, block_words)
            if len(h):
                have.append((h, np.repeat(b["id"].to_numpy(), np.diff(at)), np.zeros(len(h), bool)))
            if sum(len(x[0]) for x in have) > FLUSH:
                have.append(out())
                if len(have[-1][0]) > FLUSH // 2:
                    yield from blobs(*out())
        if have:
            yield from blobs(*out())

    def merge(k, table):
        s = k[0].as_py()
        h = np.concatenate([np.frombuffer(x, U64) for x in table["keys"].to_pylist()])
        lo, more = [], []
        for raw, n in zip(table["values"].to_pylist(), table["n"].to_pylist()):
            bits = -(-n // 8)
            more.append(np.unpackbits(np.frombuffer(raw, "u1", bits, 8), count=n).astype(bool))
            if len(raw) == 8 + bits + 4 * n:
                lo.append(np.frombuffer(raw, "<u4", n, 8 + bits) + np.frombuffer(raw, "<i8", 1))
            else:
                lo.append(np.frombuffer(raw, "<i8", n, 8 + bits))
        order = np.argsort(h, kind="stable")
        h, lo, shared = _owned(h[order], np.concatenate(lo)[order], np.concatenate(more)[order])
        C.put_columns(folder, f"run-{s:06d}", [h[shared], lo[shared], np.ones(int(shared.sum()), np.uint8)])
        return pa.table({"shard": pa.array([s], pa.int32()), "shared": pa.array([int(shared.sum())], pa.int64())})

    done = made.select("id", "h", "words").mapInArrow(collect, "shard int, keys binary, values binary, n long").groupBy("shard").applyInArrow(merge, "shard int, shared long").collect()
    for s in set(range(shards)) - {r["shard"] for r in done}:
        C.put_columns(folder, f"run-{s:06d}", [np.zeros(0, U64)] * 3)

    def look_up(batches):
        table = C.ShardedArrays(folder, "run", shards, ["<u8", "<i8", "u1"])
        for b in C.slices(batches, "h", 1 << 20):
            u, words, at = _arrays(b)
            r, first = runs(u, words, at, block_words)
            distinct, back = np.unique(r, return_inverse=True)
            owner, shared = (x[back] for x in table.find(distinct))
            ids, rows, later = b["id"].to_numpy(), [], []
            for i in np.unique(np.searchsorted(first, np.flatnonzero(shared), "right") - 1).tolist():
                part = slice(first[i], first[i + 1])
                own = np.unique(owner[part][shared[part] > 0])
                rows.append(i)
                later.append(own[own < ids[i]].tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(rows)) for c in ("id", "t", "h", "words")), pa.array(later, pa.list_(pa.int64()))], ["id", "t", "h", "words", "owners"])

    held = C.written(made.mapInArrow(look_up, "id long, t long, h binary, words binary, owners array<long>"), "line-sharers")
    # Written, so that nothing but the join asks for rows by owner and a hot owner's pairs can be split.
    owners = C.written(held.groupBy("id").agg(F.max("h").alias("other")), "line-owned")
    pairs = held.where(F.size("owners") > 0).select(F.col("id").alias("later"), "t", "h", "words", F.explode("owners").alias("id")).join(owners, "id")

    def compare(batches):
        for batch in batches:
            rows = []
            for later, t, h, w, o in zip(*(batch[c].to_pylist() for c in ("later", "t", "h", "words", "other"))):
                words = np.frombuffer(w, "<u4").tolist()
                if h == o:
                    gone = list(range(len(words))) if sum(words) >= block_words else []
                else:
                    a, b = np.frombuffer(h, "<u8").tolist(), np.frombuffer(o, "<u8").tolist()
                    gone = blocks(align(a, b), words, block_words)
                    if len(gone) < len(a):
                        gone = sorted({*gone, *repeats(a, b, words, block_words)})
                if gone:
                    rows.append((later, t, gone))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["id", "t", "gone"])

    found = pairs.select("later", "t", "h", "words", "other").mapInArrow(compare, "id long, t long, gone array<int>")
    return found.groupBy("id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


class Deletions:
    """The units to delete by (id, text's hash), from sorted arrays in the shared folder; as many shards as the texts ask for."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.rows = C.ShardedArrays(folder, "gone", shards, ["<u8", "<i8", "<i8", "<i8", "<i8"])
        self.units = C.ShardedArrays(folder, "units", shards, ["<u4"])

    @classmethod
    def write(cls, gone: DataFrame, shards: int) -> Deletions:
        """From id, t and gone, of which no id and t come twice."""
        folder = C.new_folder(gone.sparkSession, "line-deletions")
        key = F.xxhash64("id", "t")
        # The shard that shard_bounds gives the key.
        shard = F.shiftright((F.shiftrightunsigned(key, 40) + 1) * shards - 1, 24).cast("int")

        def put(k, table):
            s = k[0].as_py()
            order = np.argsort(table["k"].to_numpy().view(U64), kind="stable")
            table = table.take(pa.array(order))
            lists = table["gone"].combine_chunks()
            end = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            C.put_columns(folder, f"units-{s:06d}", [lists.flatten().to_numpy().astype("<u4")])
            C.put_columns(folder, f"gone-{s:06d}", [*(table[c].to_numpy() for c in ("k", "id", "t")), np.r_[0, end[:-1]], end])
            return pa.table({"shard": pa.array([s], pa.int32())})

        rows = gone.select("id", "t", "gone", key.alias("k"), shard.alias("shard"))
        done = rows.groupBy("shard").applyInArrow(put, "shard int").collect()
        for s in set(range(shards)) - {r["shard"] for r in done}:
            C.put_columns(folder, f"units-{s:06d}", [np.zeros(0, "<u4")])
            C.put_columns(folder, f"gone-{s:06d}", [np.zeros(0, np.int64)] * 5)
        return cls(folder, shards)

    def find(self, keys: np.ndarray, ids: np.ndarray, t: np.ndarray) -> dict[int, list[int]]:
        """Row to units, of the rows that lose any. Keys only lead there: id and hash must be the row's own."""
        out, order = {}, np.argsort(keys, kind="stable")
        for s, part in C.split_by_shard(keys[order], self.shards):
            table, own, texts, start, end = self.rows.shard(s)
            rows = order[part]
            at = np.searchsorted(table, keys[rows])
            while len(rows):
                led = at < len(table)
                led[led] = table[at[led]] == keys[rows[led]]
                rows, at = rows[led], at[led]
                same = (own[at] == ids[rows]) & (texts[at] == t[rows])
                for row, i in zip(rows[same].tolist(), at[same].tolist()):
                    out[row] = self.units.shard(s)[0][start[i] : end[i]].tolist()
                rows, at = rows[~same], at[~same] + 1
        return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with shared blocks deleted from ``text``, and removed_units and removed_words behind its columns."""
    table = Deletions.write(deletions(docs, key, text, block_words), C.shards_for(docs, [text]))
    folder, shards = table.folder, table.shards
    names = C.kept(docs.columns, ["removed_units", "removed_words"])
    id_, t, k = (C.free_name(names, n) for n in ("__id", "__t", "__k"))
    # A null id or text has a hash too, but no row of the table.
    own = F.col(key).cast("long")
    rows = docs.select(*names, F.coalesce(own, F.lit(0)).alias(id_), F.xxhash64(text).alias(t), F.when(own.isNotNull() & F.col(text).isNotNull(), F.xxhash64(own, F.xxhash64(text))).alias(k))

    def delete(batches):
        gone = Deletions(folder, shards)
        for b in C.slices(batches, text):
            texts, n_units, n_words = b[text], np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            asked = np.flatnonzero(np.asarray(b[k].is_valid()))
            lists = gone.find(*(np.asarray(b[c].take(pa.array(asked))).view(x) for c, x in ((k, U64), (id_, np.int64), (t, np.int64))))
            lists = {int(asked[i]): lost for i, lost in lists.items()}
            hit = np.array(sorted(lists), np.int64)
            if len(hit):
                raw, off = C.text_bytes(texts.take(pa.array(hit)))
                _, words, s, e, at = units(raw, off)
                new = []
                for j, i in enumerate(hit.tolist()):
                    lost, part = lists[i], slice(at[j], at[j + 1])
                    n_units[i], n_words[i] = len(lost), int(words[part][lost].sum())
                    new.append(without(raw[off[j] : off[j + 1]].tobytes(), (s[part] - off[j]).tolist(), (e[part] - off[j]).tolist(), lost).decode("utf-8", "surrogatepass"))
                place = np.arange(b.num_rows)
                place[hit] = b.num_rows + np.arange(len(hit))
                texts = pa.concat_arrays([texts, pa.array(new, texts.type)]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*(texts if c == text else b[c] for c in names), pa.array(n_units), pa.array(n_words)], [*names, "removed_units", "removed_words"])

    return rows.mapInArrow(delete, C.typed(docs, names, "removed_units long, removed_words long"))
