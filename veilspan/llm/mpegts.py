"""Media columns: MPEG transport streams (ISO/IEC 13818-1) written to and read from a binary column.

The writer puts a payload of 8-bit samples into packetised elementary stream (PES) packets of a private stream, with a
presentation timestamp each, and these into 188-byte transport packets behind the program tables. The reader needs no
knowledge of the writer: it parses the program association and program map tables, checks continuity counters, takes
adaptation fields apart, reassembles elementary packets and keeps their timestamps and random-access points.

Defined cases: a null payload gives null media, and null media all-null columns; an empty payload gives tables and one
empty PES packet; bytes that are no transport stream, or a cut one, give what could be read and say so in ``error``;
packets repeated byte for byte (but for their clock) are dropped, lost ones counted, and a counter that jumps where the stream
announces a discontinuity is no loss. Tables may span packets, and program 0 names the network table, no program. Equal
payloads give equal media; a kept column that bears a result's name gives way to the result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import common as C

PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PROGRAM, MAP_PID, DATA_PID = 1, 0x1000, 0x0100
PRIVATE_TYPE, PRIVATE_ID = 0x06, 0xBD
#: Samples a second, payload bytes in a PES packet, PES packets between repeats of the tables.
RATE, UNIT, TABLES_EVERY = 8_000, 32_768, 16


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(raw: bytes) -> int:
    """The tables' CRC: 32 bits, most significant first, not inverted. 0 over a section with its CRC."""
    c = 0xFFFFFFFF
    for b in raw:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    raw = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\0\0" + body
    return raw + crc_mpeg(raw).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big")))
_PMT = _table_packet(MAP_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 0xE | 1, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``."""
    out, counter = [], 0
    units = range(0, max(1, len(payload)), UNIT)
    for i, at in enumerate(units):
        if i % TABLES_EVERY == 0:
            for table in (_PAT, _PMT):
                packet = table.copy()
                packet[3] |= i // TABLES_EVERY & 15
                out.append(packet.tobytes())
        part = payload[at : at + UNIT]
        t = at * CLOCK // RATE & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([PRIVATE_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + part
        clock = t.to_bytes(5, "big")  # 33 bits of the base go first, then 6 reserved and 9 of the extension
        pcr = (int.from_bytes(clock, "big") << 15 | 0x3F << 9).to_bytes(6, "big")
        first = PACKET - 12
        n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
        packets = np.zeros((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        packets[0, 1] |= 0x40
        rest = len(pes) - first - (n - 2) * (PACKET - 4) if n > 1 else len(pes)
        field = 7 + (first - rest if n == 1 else 0)
        packets[0, 3] |= 0x20
        packets[0, 4], packets[0, 5] = field, 0x50  # random access, clock reference
        packets[0, 6:12] = np.frombuffer(pcr, np.uint8)
        packets[0, 12 : 5 + field] = 0xFF
        body = np.frombuffer(pes, np.uint8)
        if n == 1:
            packets[0, 5 + field :] = body
        else:
            packets[0, 12:] = body[:first]
            full = n - 2
            packets[1 : 1 + full, 4:] = body[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
            spare = PACKET - 4 - rest
            if spare:  # stuffing: an adaptation field fills the last packet
                packets[-1, 3] |= 0x20
                packets[-1, 4] = spare - 1
                if spare > 1:
                    packets[-1, 5] = 0
                    packets[-1, 6 : 4 + spare] = 0xFF
            packets[-1, PACKET - rest :] = body[-rest:]
        out.append(packets.tobytes())
    return b"".join(out)


def _tables(raw: np.ndarray, pid: np.ndarray, at: np.ndarray, unit: np.ndarray, wanted: int, table: int) -> list[bytes]:
    """Distinct sound sections of one table: several in a packet, or one over several."""
    out: dict[bytes, None] = {}
    own = np.flatnonzero((pid == wanted) & (at < PACKET))
    heads = np.flatnonzero(unit[own])
    parsed = set()
    for k, h in enumerate(heads.tolist()):
        row = raw[own[h]].tobytes()[at[own[h]] :]
        if row in parsed:  # a table is repeated word for word; each wording is parsed once
            continue
        rest, to, alone = row[1 + row[0] :], h + 1, True
        while len(rest) > 2 and rest[0] != 0xFF:
            size = 3 + ((rest[1] & 15) << 8 | rest[2])
            while len(rest) < size and to < len(own):
                body, alone = raw[own[to]].tobytes()[at[own[to]] :], False
                rest += body[1 : 1 + body[0]] if unit[own[to]] else body
                if unit[own[to]]:
                    break
                to += 1
            section, rest = rest[:size], rest[size:]
            if len(section) == size > 11 and section[0] == table and crc_mpeg(section) == 0:
                out[section] = None
        if alone:
            parsed.add(row)
    return list(out)


def read_stream(media: bytes) -> dict:
    """The stream's tables, counters, timestamps and payload."""
    found = {"programs": [], "streams": [], "packets": 0, "continuity_errors": 0, "duplicates": 0, "timestamps": [], "random_access": [], "clocks": [], "unit_sizes": [], "payload": b"", "error": None}
    n = len(media) // PACKET
    raw = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    found["packets"] = n
    if not n or len(media) % PACKET or (raw[:, 0] != SYNC).any():
        found["error"] = "not a whole number of transport packets" if len(media) % PACKET or not n else "lost sync"
        sound = raw[:, 0] == SYNC
        raw = raw[sound]
    pid = (raw[:, 1] & 0x1F).astype(np.int32) << 8 | raw[:, 2]
    unit, control, counter = raw[:, 1] & 0x40 > 0, raw[:, 3] >> 4 & 3, raw[:, 3] & 15
    has = control & 1 > 0
    at = np.where(control & 2, 5 + raw[:, 4].astype(np.int32), 4)
    at[~has] = PACKET
    for s in _tables(raw, pid, at, unit, 0, 0):
        found["programs"] += [(int.from_bytes(s[i : i + 2], "big"), int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(s) - 4, 4)]
    for number, where in found["programs"]:
        for s in _tables(raw, pid, at, unit, where, 2) if number else []:  # program 0: the network table
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while i < len(s) - 4:
                found["streams"].append((int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF, s[i]))
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    found["programs"], found["streams"] = list(dict.fromkeys(found["programs"])), list(dict.fromkeys(found["streams"]))
    if not found["streams"]:
        found["error"] = found["error"] or "no program map"
    payloads = []
    for which, _ in found["streams"]:
        own = np.flatnonzero((pid == which) & has)
        step = counter[own[1:]] - counter[own[:-1]] & 15
        fields = (control[own] & 2 > 0) & (raw[own, 4] > 0)
        again = step == 0
        for i in np.flatnonzero(again).tolist():
            same = raw[own[i]] == raw[own[i + 1]]
            same[6:12] |= fields[i] and raw[own[i], 5] & 0x10 > 0  # a repeated packet has a clock of its own
            again[i] = same.all()
        announced = fields & (raw[own, 5] & 0x80 > 0)
        found["duplicates"] += int(again.sum())
        found["continuity_errors"] += int(((step != 1) & ~again & ~announced[1:]).sum())
        own = own[np.r_[True, ~again]] if len(own) else own
        if not len(own):
            continue
        start = np.minimum(at[own], PACKET)
        flags = (control[own] & 2 > 0) & (raw[own, 4] > 0)
        random = flags & (raw[own, 5] & 0x40 > 0)
        clock = flags & (raw[own, 5] & 0x10 > 0) & (raw[own, 4] >= 7)
        for r in own[clock].tolist():
            found["clocks"].append(int.from_bytes(raw[r, 6:12].tobytes(), "big") >> 15)
        size = PACKET - start
        body = raw[own][np.arange(PACKET) >= start[:, None]].tobytes()
        ends = np.cumsum(size)
        heads = np.flatnonzero(unit[own])
        for k, h in enumerate(heads.tolist()):
            lo = int(ends[h] - size[h])
            hi = int(ends[heads[k + 1]] - size[heads[k + 1]]) if k + 1 < len(heads) else len(body)
            pes = body[lo:hi]
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                found["error"] = found["error"] or "bad elementary packet"
                continue
            length = int.from_bytes(pes[4:6], "big")
            data = pes[9 + pes[8] : 6 + length if length else None]
            if length and len(pes) < 6 + length:
                found["error"] = found["error"] or "cut elementary packet"
            t = pes[9:14]
            found["timestamps"].append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 and len(t) == 5 else None)
            if random[h]:
                found["random_access"].append(int(own[h]))
            found["unit_sizes"].append(len(data))
            payloads.append(data)
    found["payload"] = b"".join(payloads)
    return found


def write_media(df: DataFrame, payload: str = "payload", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with the payload as a transport stream."""
    keep = C.kept(keep, [media])
    own = C.free_name(keep, "__payload")

    def run(batches):
        for b in C.slices(batches, own):
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array([None if p is None else write_stream(p) for p in b[own].to_pylist()], pa.binary())], [*keep, media])

    return df.select(*keep, F.col(payload).cast("binary").alias(own)).mapInArrow(run, C.typed(df, keep, f"`{media}` binary"))


READ_COLUMNS = "programs array<struct<number:int,pid:int>>, streams array<struct<pid:int,type:int>>, packets long, continuity_errors long, duplicates long, timestamps array<long>, random_access array<long>, clocks array<long>, unit_sizes array<long>, payload binary, error string"


def read_media(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with what READ_COLUMNS lists."""
    kinds = [pa.list_(pa.struct([("number", pa.int32()), ("pid", pa.int32())])), pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32())])), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4, pa.binary(), pa.string()]
    names = ["programs", "streams", "packets", "continuity_errors", "duplicates", "timestamps", "random_access", "clocks", "unit_sizes", "payload", "error"]
    keep = C.kept(keep, names)
    rows, own = C.with_text(df, keep, media)

    def run(batches):
        for b in C.slices(batches, own):
            got = [{} if m is None else read_stream(m) for m in b[own].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), *(pa.array([g.get(n) for g in got], t) for n, t in zip(names, kinds))], [*keep, *names])

    return rows.mapInArrow(run, C.typed(df, keep, READ_COLUMNS))


def padded(text) -> object:
    """UTF-8 bytes of a text column (null: empty), with bytes 0 up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    more = F.when(n == 0, 64).otherwise((64 - n % 64) % 64)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), more.cast("int"))))


_DIGESTS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "programs", "streams", "packets", "continuity_errors", "duplicates", "timestamps", "random_access", "clocks", "unit_sizes", "payload", "error"]


def digests(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every text as a stream, read back, with digests of both and of the features found."""
    keep = tuple(C.kept(keep, _DIGESTS))
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    media = write_media(df.select(*keep, size.alias("__n"), padded(F.col(text)).alias("__p")), "__p", "__m", [*keep, "__n"])
    back = read_media(media, "__m", [*keep, "__n", "__m"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("programs="), F.array_join(F.transform("programs", lambda x: F.concat_ws(":", x["number"], x["pid"])), ",")),
        F.concat(F.lit("streams="), F.array_join(F.transform("streams", lambda x: F.concat_ws(":", x["pid"], x["type"])), ",")),
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("continuity_errors="), F.col("continuity_errors")),
        F.concat(F.lit("timestamps="), F.size("timestamps"), F.lit(":"), F.array_min("timestamps"), F.lit("-"), F.array_max("timestamps")),
        F.concat(F.lit("random_access="), F.size("random_access"), F.lit(":"), F.crc32(joined(F.col("random_access")))),
        F.concat(F.lit("clocks="), F.crc32(joined(F.col("clocks")))),
        F.concat(F.lit("error="), F.coalesce("error", F.lit("none"))),
    )
    p = F.col("payload")
    return back.select(*keep, F.col("__n").alias("n_bytes"), F.octet_length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"), F.crc32(F.substring(p, -64, 64)).alias("tail_crc32"), F.octet_length("__m").cast("long").alias("media_bytes"), F.sha2("__m", 256).alias("media_sha256"), feature.alias("feature"))


def digest(payload: bytes) -> tuple[str, int]:
    """What ``digests`` says of a payload, computed plainly (for tests)."""
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
