"""Vectorised work on packed UTF-8 text: many documents in one byte buffer, handled by numpy without a loop over characters."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Segments of more bytes than this are hashed by hashlib, one by one; there are few for each byte.
LONG = 128
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def words_of(buf: np.ndarray) -> np.ndarray:
    """The buffer as little-endian words of eight bytes, with two words of zeros behind it."""
    out = np.zeros((len(buf) + 7) // 8 * 8 + 16, np.uint8)
    out[: len(buf)] = buf
    return out.view("<u8")


class Segments:
    """Segments of a buffer as lanes of eight bytes each (the last one filled with zeros), and their hashes.

    Lanes are mixed one after the other by a bijection with two multiplications, so no sum or polynomial of bytes can be made to
    meet another; the lanes also serve to compare segments byte for byte."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray | None = None):
        self.size = (end - start).astype(np.int64)
        self.lanes = (self.size + 7) >> 3
        self.begin = np.cumsum(self.lanes) - self.lanes
        nth = np.arange(int(self.lanes.sum())) - np.repeat(self.begin, self.lanes)
        at = np.repeat(start, self.lanes) + 8 * nth
        words, shift = words_of(buf) if words is None else words, ((at & 7) << 3).astype(U64)
        i = at >> 3
        lane = words[i] >> shift
        lane |= words[i + 1] << (U64(64) - shift)  # a shift by 64 gives 0
        self.lane = lane & _MASK[np.minimum(np.repeat(end, self.lanes) - at, 8)]
        self._buf, self._start, self._end, self._hashes = buf, start, end, None

    def __len__(self) -> int:
        return len(self.size)

    @property
    def hashes(self) -> np.ndarray:
        """64-bit hashes; the length takes part."""
        if self._hashes is None:
            h = mix(self.size.astype(U64) * U64(0x9FB21C651E98DF25) + U64(0x632BE59BD9B4E019))
            live, j = np.flatnonzero((self.size > 0) & (self.size <= LONG)), 0
            while len(live):
                h[live] = mix(h[live] ^ self.lane[self.begin[live] + j])
                j += 1
                live = live[self.lanes[live] > j]
            for i in np.flatnonzero(self.size > LONG).tolist():
                h[i] = int.from_bytes(hashlib.blake2b(self._buf[self._start[i] : self._end[i]].tobytes(), digest_size=8).digest(), "little")
            self._hashes = h
        return self._hashes


def _differ(seg: Segments, i: np.ndarray, lane: np.ndarray, begin: np.ndarray, size: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = seg.size[i] != size[j]
    same = np.flatnonzero(~out)
    a, b, n = seg.begin[i[same]], begin[j[same]], seg.lanes[i[same]]
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    bad = seg.lane[np.repeat(a, n) + nth] != lane[np.repeat(b, n) + nth]
    if bad.any():
        out[same[np.repeat(np.arange(len(same)), n)[bad]]] = True
    return out


def kmers(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of a buffer, by their start; equal strings have equal hashes."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    words, h = words_of(buf), None
    for at in range(0, max(k - 7, 1), 8) if k % 8 == 0 or k < 8 else [*range(0, k - 8, 8), k - 8]:
        lane = np.ndarray((n,), "<u8", words, at, (1,))
        lane = lane & _MASK[k] if k < 8 else lane
        h = lane ^ U64(0x632BE59BD9B4E019) if h is None else np.bitwise_xor(h, lane, out=h)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow text array and the offsets of its rows; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int = (1 << 20) - 64):
    """(start, rows) of runs of rows with about `most` bytes of text; a longer text stands alone."""
    off = packed(batch.column(column))[1]
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j - i
        i = j


def runs(cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one class that stay inside one row."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    first = off[:-1]
    edge[first[first < n]] = True
    start = np.flatnonzero(edge)
    return start, np.append(start[1:], n)


def rows_of(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The row of each position; positions are ascending."""
    return np.searchsorted(off, start, "right") - 1


def ragged(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[begin:begin+length] of every entry, one after the other."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    at += np.arange(total)
    return flat[at]


def lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


class Memo:
    """What is known of each unit: a sorted array of hashes, the units' bytes, and numbers packed in one flat array.

    A unit is known only if its bytes equal the stored ones; another unit of the same hash is made anew each time.  It holds
    `most` units, and ROOM words of bytes and numbers, or one batch more; beyond that it starts anew, which costs time and
    changes no result."""

    ROOM = 1 << 23

    def __init__(self, dtype, most: int = 1_000_000):
        self.most, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.length = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text_at, self.text_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.text, self.text_used = np.zeros(1 << 16, U64), 0

    def _put(self, flat: np.ndarray) -> int:
        """Where flat now stands."""
        at, self.used = self.used, self.used + len(flat)
        self.flat = _held(self.flat, at, flat)
        return at

    def lookup(self, units: Segments, make) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers of each unit stand; make(indices of units) gives (flat, lengths) of new units."""
        if self.used > self.ROOM or self.text_used > self.ROOM:
            self.clear()
        keys, first, back = np.unique(units.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if len(self.keys) and (new := int((~known).sum())) and new + len(self.keys) > self.most:
            self.clear()
            known[:] = False
            at[:] = 0
        if not known.all():
            new = ~known
            flat, length = make(first[new])
            begin = self._put(flat) + np.concatenate(([0], np.cumsum(length)[:-1])).astype(np.int64)
            lane = ragged(units.lane, units.begin[first[new]], units.lanes[first[new]])
            text_at = self.text_used + np.cumsum(units.lanes[first[new]]) - units.lanes[first[new]]
            self.text, self.text_used = _held(self.text, self.text_used, lane), self.text_used + len(lane)
            put = at[new]
            self.keys = np.insert(self.keys, put, keys[new])
            self.begin = np.insert(self.begin, put, begin)
            self.length = np.insert(self.length, put, length)
            self.text_at = np.insert(self.text_at, put, text_at)
            self.text_size = np.insert(self.text_size, put, units.size[first[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[back]
        begin, length = self.begin[at], self.length[at]
        other = np.flatnonzero(_differ(units, np.arange(len(units)), self.text, self.text_at, self.text_size, at))
        if len(other):  # of the same hash, but not the same bytes
            flat, size = make(other)
            begin[other] = self._put(flat) + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
            length[other] = size
        return begin, length


def _held(room: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(room):
        grown = np.zeros(max(2 * len(room), used + len(more)), room.dtype)
        grown[:used] = room[:used]
        room = grown
    room[used : used + len(more)] = more
    return room
