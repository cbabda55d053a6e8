"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token.  Tier two: other
pre-tokens are merged with a heap of (rank, position) over a linked list of their bytes.  Pre-tokens are found by numpy on
packed bytes; each distinct one is resolved once and remembered with its bytes (`vec.Memo`, bounded).

Cases: rows with a null key and repeated rows are encoded as any other and keep their key; a null or empty text has no tokens and decodes to nothing; texts of any length are encoded whole; equal texts give
equal ids; an empty table gives an empty table; extra columns are never read or returned.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import units, vec
from .common import cache, enter, wide

#: White space as the Unicode property has it.
WHITE = r"\t-\r \u0085   -     　"


class PerfectHash:
    """Minimal perfect hash by hash and displace: buckets of two or more keys try displacements, single keys name a free slot."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        which = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(self.buckets + 1)).tolist()
        self.shift = np.zeros(self.buckets, np.int64)
        taken, slot_of, single = np.zeros(n, bool), np.zeros(n, np.int64), []
        for b in np.argsort(-np.diff(cuts), kind="stable").tolist():
            members = order[cuts[b] : cuts[b + 1]]
            if len(members) == 1:
                single.append((b, members[0]))
            if len(members) < 2:
                continue
            tried, found = 0, None
            while found is None:
                slots = self._slots(keys[members][:, None], np.arange(tried, tried + 32))
                for j in np.flatnonzero(~taken[slots].any(axis=0)).tolist():
                    if len(set(slots[:, j].tolist())) == len(members):
                        found = j
                        break
                else:
                    tried += 32
                    if tried > 100 * n + 10_000:
                        raise ValueError("two tokens have the same hash")
            self.shift[b] = tried + found
            taken[slots[:, found]] = True
            slot_of[members] = slots[:, found]
        for (b, m), s in zip(single, np.flatnonzero(~taken).tolist(), strict=True):
            slot_of[m] = s
            self.shift[b] = -1 - s
        self.stored = np.zeros(n, np.uint64)
        self.value = np.zeros(n, np.int64)
        self.stored[slot_of] = keys
        self.value[slot_of] = np.arange(n)

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (vec.mix(keys ^ shift.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        d = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slots(keys, np.maximum(d, 0)))
        return np.where(self.stored[slot] == keys, self.value[slot], -1)


class Codec:
    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
        tokens = sorted(ranks, key=ranks.get)
        self.ranks, self.ids = ranks, np.array([ranks[t] for t in tokens], np.uint32)
        self.longest = max(map(len, tokens))
        size = int(self.ids[-1]) + 1
        length = np.zeros(size, np.int64)
        length[self.ids] = [len(t) for t in tokens]
        self.token_length, self.token_begin = length, np.cumsum(length) - length
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        end = np.cumsum([len(t) for t in tokens])
        self.known = PerfectHash(vec.Segments(self.token_bytes, np.concatenate(([0], end[:-1])), end).hashes)
        self.tokens = tokens
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s+(?!\S)", f"[{WHITE}]+(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")).findall
        self.memo = vec.Memo(np.uint32, 500_000)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: the pair of least rank, leftmost first, is joined until none is in the vocabulary."""
        get, n, longest = self.ranks.get, len(piece), self.longest
        after, before = list(range(1, n + 2)), list(range(-1, n))
        rank = [get(piece[i : i + 2]) for i in range(n - 1)]
        rank.append(None)
        heap = [(r << 32) | i for i, r in enumerate(rank) if r is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), 1 << 32)
            if rank[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i], rank[j], rank[i] = k, None, None
            if k < n:
                before[k] = i
                e = after[k]
                if e - i <= longest and (r := get(piece[i:e])) is not None:
                    rank[i] = r
                    heappush(heap, (r << 32) | i)
            p = before[i]
            if p >= 0:
                rank[p] = r = get(piece[p:k]) if k - p <= longest else None
                if r is not None:
                    heappush(heap, (r << 32) | p)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _resolve(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, and how many each has: tier one for those that are tokens, tier two for the rest."""
        stop = np.cumsum([len(p) for p in pieces])
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        found = self.known.find(vec.Segments(joined, np.concatenate(([0], stop[:-1])), stop).hashes).tolist() if pieces else []
        out, length = [], np.ones(len(pieces), np.int64)
        for n, (piece, no) in enumerate(zip(pieces, found, strict=True)):
            if no >= 0 and self.tokens[no] == piece:
                out.append(int(self.ids[no]))
            else:
                ids = self.merge(piece)
                out += ids
                length[n] = len(ids)
        return np.array(out, np.uint32), length

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of packed texts, and how many each has."""
        start, end, plain = units.cut(buf, off, spaces=True)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        data = buf.tobytes()

        def make(new):
            pieces, per = [], []
            for a, e, whole in zip(start[new].tolist(), end[new].tolist(), plain[new].tolist(), strict=True):
                found = [data[a:e]] if whole else [x.encode() for x in self.split(data[a:e].decode())]
                pieces += found
                per.append(len(found))
            ids, length = self._resolve(pieces)
            total = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(per, dtype=np.int64)))]
            return ids, np.diff(total)

        begin, length = self.memo.lookup(vec.Segments(buf, start, end), make)
        counts = np.bincount(vec.rows_of(start, off), length, len(off) - 1).astype(np.int64)
        return vec.ragged(self.memo.flat, begin, length), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of consecutive groups of ids, and the groups' offsets in them."""
        length = self.token_length[ids]
        at = np.concatenate(([0], np.cumsum(length)))
        return vec.ragged(self.token_bytes, self.token_begin[ids], length), at[np.concatenate(([0], np.cumsum(counts)))]


_codecs: dict[tuple[str, str], Codec] = cache("bpe", {})


def codec(path: str, pattern: str) -> Codec:
    """One a worker process; building it takes under a second."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text."""

    def run(batches):
        enter("bpe")
        c = codec(path, pattern)
        for b in batches:
            for i, n in vec.slices(b, "text"):
                part = b.slice(i, n)
                ids, counts = c.encode(*vec.packed(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return wide(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes) of every list of ids; a null list gives no bytes."""

    def run(batches):
        enter("bpe")
        c = codec(path, pattern)
        for b in batches:
            for row in range(b.num_rows):
                one = b.column("ids").slice(row, 1)
                flat = one.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                out, _ = c.decode(flat, np.array([len(flat)]))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(row, 1), pa.array([out.tobytes()], pa.binary())], ["key", "bytes"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids").mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every whole text is encoded, and the ids are decoded again, in one pass."""

    def run(batches):
        enter("bpe")
        c = codec(path, pattern)
        for b in batches:
            for i, n in vec.slices(b, "text"):
                part = b.slice(i, n)
                ids, counts = c.encode(*vec.packed(part.column("text")))
                back, at = c.decode(ids, counts)
                raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                cut = (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
                at = at.tolist()
                digest = lambda v, o: pa.array([hashlib.sha256(v[o[j] : o[j + 1]]).hexdigest() for j in range(n)], pa.string())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts), digest(raw, cut), digest(back, at)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return wide(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
