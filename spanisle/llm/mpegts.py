"""Media columns as MPEG transport streams.

`mux` stores a payload of 8-bit samples as a transport stream: a program association and a program map table before each
random-access point, then one elementary stream of packets (PES) with presentation timestamps, a program clock reference and
the random-access flag.  `demux` parses any stream of this kind: tables with their checksums, continuity counters,
reassembled elementary packets, timestamps and random-access points.  `store` makes the media column with its index, `read` parses
what was stored; `digests` writes the column as a table and reads it back.

Cases: a null or empty text is stored as one padded unit; texts of any length are stored whole; equal texts give equal bytes;
rows with a null key and repeated rows are stored as any other and keep their key; an empty table gives an empty table; extra
columns are never read, whatever their names.  A stream with lost packets yields what can be put together and counts the gaps, but
for those that a discontinuity indicator announces; bytes that are no whole packets raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vec
from .common import enter, saved, wide

PACKET, UNIT, FRAMES, EVERY = 188, 192, 8, 8
PMT_PID, ES_PID, PRIVATE, STREAM_ID = 0x1000, 0x100, 0x06, 0xBD
#: Ticks of the 90 kHz clock for a unit of samples at 48 kHz.
TICKS = 90_000 * UNIT // 48_000


@lru_cache(256)
def crc(data: bytes) -> int:
    """The checksum of program tables: CRC-32 with polynomial 0x04C11DB7, high bit first, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c >> 31 else c << 1 & 0xFFFFFFFF
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    s = bytes([table, 0xB0, len(body) + 9, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return s + crc(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])))


def _times(pts: np.ndarray) -> np.ndarray:
    """Five bytes of each presentation timestamp, with their marker bits."""
    p = pts.astype(np.int64)
    return np.stack([0x21 | p >> 29 & 14, p >> 22 & 255, 1 | p >> 14 & 254, p >> 7 & 255, 1 | p << 1 & 254], axis=1).astype(np.uint8)


def _packets(samples: np.ndarray, pts: np.ndarray, access: bool) -> np.ndarray:
    """(units, packets, 188) of equally long units; counters are set later."""
    k, size = samples.shape
    pes = np.empty((k, 14 + size), np.uint8)
    length = size + 8
    pes[:, :9] = np.array([0, 0, 1, STREAM_ID, length >> 8, length & 255, 0x80, 0x80, 5], np.uint8)
    pes[:, 9:14] = _times(pts)
    pes[:, 14:] = samples
    total, at, made = pes.shape[1], 0, []
    while at < total:
        p = np.full((k, PACKET), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, (0x40 if at == 0 else 0) | ES_PID >> 8, ES_PID & 255
        adapt = 8 if access and at == 0 else 0
        room = PACKET - 4 - adapt
        take = min(room, total - at)
        adapt += room - take
        p[:, 3] = 0x30 if adapt else 0x10
        if adapt:
            p[:, 4] = adapt - 1
            if adapt > 1:
                p[:, 5] = 0
            if access and at == 0:
                base = pts.astype(np.int64)
                p[:, 5] = 0x50
                p[:, 6:12] = np.stack([base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, base * 0], axis=1)
        p[:, PACKET - take :] = pes[:, at : at + take]
        made.append(p)
        at += take
    return np.stack(made, axis=1)


def mux_many(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transport streams of consecutive payloads, one after the other, and their offsets; units of one size are made together."""
    length = np.diff(off)
    if (length <= 0).any() or (length % UNIT).any():
        raise ValueError("a payload must be a positive multiple of 192 bytes")
    size = UNIT * FRAMES
    units = -(-length // size)
    doc = np.repeat(np.arange(len(length)), units)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(units) - units, units)
    begin = off[:-1][doc] + nth * size
    bytes_of = np.minimum(size, off[1:][doc] - begin)
    access = nth % EVERY == 0
    pts = nth * (TICKS * FRAMES) & (1 << 33) - 1
    count = -(-(14 + bytes_of + 8 * access) // (PACKET - 4))
    slot = np.cumsum(count + 2 * access)
    first = slot - count
    out = np.empty((int(slot[-1]) if len(slot) else 0, PACKET), np.uint8)
    for n in np.unique(bytes_of).tolist():
        for flag in (True, False):
            m = np.flatnonzero((bytes_of == n) & (access == flag))
            if len(m):
                p = _packets(data[begin[m][:, None] + np.arange(n)], pts[m], flag)
                out[(first[m][:, None] + np.arange(p.shape[1])).ravel()] = p.reshape(-1, PACKET)
    m = np.flatnonzero(access)
    for k, table in ((2, _PAT), (1, _PMT)):
        out[first[m] - k] = table
        out[first[m] - k, 3] |= (nth[m] // EVERY & 15).astype(np.uint8)
    es = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    before = np.cumsum(count) - count
    of_doc = np.repeat(before[np.cumsum(units) - units], units)
    counter = np.arange(len(es)) - np.repeat(of_doc, count)
    out[es, 3] |= (counter & 15).astype(np.uint8)
    packets = np.bincount(doc, count + 2 * access, len(length)).astype(np.int64)
    return out.reshape(-1), np.concatenate(([0], np.cumsum(packets))) * PACKET


def mux(payload: bytes) -> bytes:
    """A transport stream; the payload's length is a positive multiple of 192."""
    return mux_many(np.frombuffer(payload, np.uint8), np.array([0, len(payload)]))[0].tobytes()


@dataclass
class Stream:
    program: int = 0
    pid: int = 0
    kind: int = 0
    packets: int = 0
    gaps: int = 0
    bad_tables: int = 0
    pts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    access: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # numbers of the units that start at a random-access point
    access_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # their packets' byte offsets
    payload: bytes = b""


def _sections(pk: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], int]:
    good, bad = [], 0
    for raw in {bytes(p[b:]): None for p, b in zip(pk, begin.tolist(), strict=True)}:
        s = raw[1 + raw[0] :] if raw else b""
        n = 3 + ((s[1] & 15) << 8 | s[2]) if len(s) > 3 else 0
        if 12 <= n <= len(s) and crc(s[:n]) == 0:
            good.append(s[:n])
        else:
            bad += 1
    return good, bad


def _discontinuous(pk: np.ndarray) -> np.ndarray:
    """Packets whose adaptation field says that the counter may jump here."""
    return (pk[:, 3] & 0x20 > 0) & (pk[:, 4] > 0) & (pk[:, 5] & 0x80 > 0)


def demux(media: bytes) -> Stream:
    """The first elementary stream of the first program."""
    if len(media) % PACKET:
        raise ValueError("a stream must be whole packets of 188 bytes")
    pk = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (pk[:, 0] != 0x47).any():
        raise ValueError("a packet lacks its sync byte")
    out = Stream(packets=len(pk))
    pid = (pk[:, 1] & 31).astype(np.int64) << 8 | pk[:, 2]
    first = (pk[:, 1] & 0x40) > 0
    control = pk[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + pk[:, 4].astype(np.int64), 4)
    has = (control & 1) > 0
    m = (pid == 0) & first & has
    pats, out.bad_tables = _sections(pk[m], begin[m])
    if not pats:
        return out
    entries = [(s[i] << 8 | s[i + 1], (s[i + 2] & 31) << 8 | s[i + 3]) for s in pats for i in range(8, len(s) - 4, 4)]
    programs = [e for e in entries if e[0]]
    if not programs:
        return out
    out.program, pmt = programs[0]
    m = (pid == pmt) & first & has
    pmts, bad = _sections(pk[m], begin[m])
    out.bad_tables += bad
    if not pmts:
        return out
    s = pmts[0]
    at = 12 + ((s[10] & 15) << 8 | s[11])
    if at + 5 > len(s) - 4:
        return out
    out.kind, out.pid = s[at], (s[at + 1] & 31) << 8 | s[at + 2]
    told = _discontinuous(pk)
    for p in (0, pmt, out.pid):
        m = (pid == p) & has
        step = np.diff((pk[m, 3] & 15).astype(np.int64)) & 15
        out.gaps += int(((step > 1) & ~told[m][1:]).sum())  # a step of 0 is a packet sent twice
    where = np.flatnonzero((pid == out.pid) & has)
    if len(where) > 1:
        again = np.concatenate(([False], (np.diff((pk[where, 3] & 15).astype(np.int64)) == 0) & ~told[where][1:]))
        where = where[~again]
    es, b, f = pk[where], begin[where], first[where]
    started = np.cumsum(f) > 0
    es, b, f, where = es[started], b[started], f[started], where[started]
    if not len(es):
        return out
    data = es[np.arange(PACKET) >= b[:, None]]
    begins = np.concatenate(([0], np.cumsum(PACKET - b)))
    unit = begins[:-1][f]
    data = np.concatenate((data, np.zeros(14, np.uint8)))  # a cut header can be read
    head = data[unit].astype(np.int64), data[unit + 1].astype(np.int64), data[unit + 2].astype(np.int64)
    if (head[0] | head[1]).any() or (head[2] != 1).any():
        raise ValueError("an elementary packet lacks its start code")
    length = data[unit + 4].astype(np.int64) << 8 | data[unit + 5]
    stop = np.append(unit[1:], begins[-1])
    stop = np.where(length > 0, np.minimum(stop, unit + 6 + length), stop)
    start = unit + 9 + data[unit + 8]
    t = data[unit[:, None] + np.arange(9, 14)].astype(np.int64)
    out.pts = np.where(data[unit + 7] & 0x80, (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | (t[:, 2] >> 1) << 15 | t[:, 3] << 7 | t[:, 4] >> 1, -1)
    flagged = (es[f, 3] & 0x20 > 0) & (es[f, 4] > 0) & (es[f, 5] & 0x40 > 0)
    out.access, out.access_at = np.flatnonzero(flagged), where[f][flagged] * PACKET
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.maximum(start, stop), -1)
    out.payload = data[np.cumsum(edge[:-1]) > 0].tobytes()
    return out


def demux_many(media: np.ndarray, off: np.ndarray) -> list[Stream]:
    """demux of consecutive streams; those that share their tables are parsed together, others one by one."""
    one_by_one = lambda: [demux(media[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    if (np.diff(off) % PACKET).any():
        return one_by_one()
    pk, n = media.reshape(-1, PACKET), len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off) // PACKET)
    pid = (pk[:, 1] & 31).astype(np.int64) << 8 | pk[:, 2]
    first = (pk[:, 1] & 0x40) > 0
    control = pk[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + pk[:, 4].astype(np.int64), 4)
    has = (control & 1) > 0
    if not n or (pk[:, 0] != 0x47).any() or not has.all() or _discontinuous(pk).any():
        return one_by_one()
    m = (pid == 0) & first
    pats, bad = _sections(pk[m], begin[m])
    if len(pats) != 1 or bad or len(pats[0]) != 16 or len(np.unique(doc[m])) < n:
        return one_by_one()
    program, pmt = pats[0][8] << 8 | pats[0][9], (pats[0][10] & 31) << 8 | pats[0][11]
    m = (pid == pmt) & first
    pmts, bad = _sections(pk[m], begin[m])
    if len(pmts) != 1 or bad or len(pmts[0]) != 21 or len(np.unique(doc[m])) < n:
        return one_by_one()
    kind, es_pid = pmts[0][12], (pmts[0][13] & 31) << 8 | pmts[0][14]
    gaps = np.zeros(n, np.int64)
    for p in (0, pmt, es_pid):
        at = np.flatnonzero(pid == p)
        step = np.diff((pk[at, 3] & 15).astype(np.int64)) & 15
        inside = np.diff(doc[at]) == 0
        if (inside & (step == 0)).any():
            return one_by_one()
        gaps += np.bincount(doc[at][1:], inside & (step > 1), n).astype(np.int64)
    where = np.flatnonzero(pid == es_pid)
    es, b, f, d = pk[where], begin[where], first[where], doc[where]
    lead = np.concatenate(([True], np.diff(d) > 0))
    if not f[lead].all() or len(np.unique(d)) < n:
        return one_by_one()
    data = es[np.arange(PACKET) >= b[:, None]]
    begins = np.concatenate(([0], np.cumsum(PACKET - b)))
    unit, owner = begins[:-1][f], d[f]
    data = np.concatenate((data, np.zeros(14, np.uint8)))
    if (data[unit] | data[unit + 1]).any() or (data[unit + 2] != 1).any():
        return one_by_one()
    length = data[unit + 4].astype(np.int64) << 8 | data[unit + 5]
    stop = np.append(unit[1:], begins[-1])
    stop = np.where(length > 0, np.minimum(stop, unit + 6 + length), stop)
    start = np.minimum(unit + 9 + data[unit + 8], stop)
    t = data[unit[:, None] + np.arange(9, 14)].astype(np.int64)
    pts = np.where(data[unit + 7] & 0x80, (t[:, 0] >> 1 & 7) << 30 | t[:, 1] << 22 | (t[:, 2] >> 1) << 15 | t[:, 3] << 7 | t[:, 4] >> 1, -1)
    flagged = (es[f, 3] & 0x20 > 0) & (es[f, 4] > 0) & (es[f, 5] & 0x40 > 0)
    edge = np.zeros(len(data) + 1, np.int8)  # a unit starts after its header, so no two edges meet
    edge[start] += 1
    edge[stop] -= 1
    payload = data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    cut = np.concatenate(([0], np.cumsum(np.bincount(owner, stop - start, n).astype(np.int64)))).tolist()
    u = np.searchsorted(owner, np.arange(n + 1)).tolist()
    packets, at = (np.diff(off) // PACKET).tolist(), where[f] * PACKET - off[owner]
    out = []
    for i in range(n):
        mine = slice(u[i], u[i + 1])
        out.append(Stream(program, es_pid, kind, packets[i], int(gaps[i]), 0, pts[mine], np.flatnonzero(flagged[mine]), at[mine][flagged[mine]], payload[cut[i] : cut[i + 1]]))
    return out


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text.ljust(n, b" ")


def feature(s: Stream) -> str:
    first, last = (int(s.pts.min()), int(s.pts.max())) if len(s.pts) else (-1, -1)
    return f"program={s.program} pid={s.pid} type={s.kind} packets={s.packets} gaps={s.gaps} units={len(s.pts)} access={len(s.access)} pts={first}-{last}"


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def _rows(cols: list, lists: list[np.ndarray], kind: pa.DataType | None = None) -> pa.Array:
    off = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32())
    return pa.ListArray.from_arrays(off, cols[0] if kind is None else pa.StructArray.from_arrays(cols, fields=list(kind)))


_POINT = pa.struct([("unit", pa.int64()), ("pts", pa.int64()), ("at", pa.int64())])


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary, pts array<long>, access array<struct<unit, pts, at>>): each text as a stream, with its index."""

    def run(batches):
        enter("mpegts")
        for b in batches:
            for i, n in vec.slices(b, "text", 1 << 20):
                part = b.slice(i, n)
                buf, off = vec.packed(part.column("text"))
                size = np.diff(off)
                full = np.maximum(1, -(-size // UNIT)) * UNIT
                to = np.concatenate(([0], np.cumsum(full)))
                data = np.full(int(to[-1]), 32, np.uint8)
                data[np.arange(len(buf)) + np.repeat(to[:-1] - off[:-1], size)] = buf
                media, at = mux_many(data, to)
                found = demux_many(media, at)
                unit, pts, place = (np.concatenate(x) for x in zip(*((s.access, s.pts[s.access], s.access_at) for s in found), strict=True))
                points = _rows([pa.array(unit), pa.array(pts), pa.array(place)], [s.access for s in found], _POINT)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(size), _binary(media, at), _rows([pa.array(np.concatenate([s.pts for s in found]))], [s.pts for s in found]), points], ["key", "n_bytes", "media", "pts", "access"])

    kind = df.schema[key].dataType.simpleString()
    return wide(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary, pts array<long>, access array<struct<unit:long,pts:long,at:long>>").withColumnRenamed("key", key)


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of stored streams, of what they are parsed to, and a line on their structure."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        enter("mpegts")
        for b in batches:
            for i, n in vec.slices(b, "media", 1 << 20):
                part = b.slice(i, n)
                media, at = vec.packed(part.column("media"))
                raw, rows = memoryview(media.tobytes()), []
                size, cut = part.column("n_bytes").to_pylist(), at.tolist()
                for j, s in enumerate(demux_many(media, at)):
                    own = raw[cut[j] : cut[j + 1]]
                    rows.append((size[j], len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(own), hashlib.sha256(own).hexdigest(), feature(s)))
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["key", *names])

    kind = files.schema[key].dataType.simpleString()
    return files.selectExpr(f"`{key}` AS key", "n_bytes", "media").mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("key", key)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What was stored of each text in a written media column, and what was read back, as digests."""
    return read(saved(store(df, key, text)), key)
