"""Exact removal of repeated passages by a distributed merge sort of suffixes that knows common prefixes.

Every byte is removed that is covered by a string of `length` bytes which also starts in a document with a smaller key.

Anchors.  Of each window of `length` bytes the k-byte string with the least half of a hash (leftmost if equal) is its anchor.  Equal
windows have equal anchors, so windows are compared only where anchors agree; the windows of one anchor are neighbours.
1. Shards of documents send the hashes of their anchors; only anchors that occur in two documents go on.
2. For each shared anchor the shard has a suffix that starts there, as far as its windows reach, and the bytes before it.
   Equal ones are kept once with their least key.  Suffixes at an anchor that a shard has very often are dealt by the bytes
   beside it too, so no receiver gets all of them.  Sorted suffixes travel as front-coded runs: the length of the prefix
   shared with the suffix before, then the rest.
3. A receiver decodes the runs and merges them with a loser tree that carries the known common prefixes: strings are compared
   only from where their prefixes with the last winner end, and most comparisons look at two lengths alone.  From the common
   prefixes of the merged order, and those of the bytes before the anchors in theirs, equal windows and the least key of each
   follow exactly, without hashes.  Each shard gets a bit for each of its windows.
4. Shards turn bits into covered bytes.

A shard sends an equal suffix once, so a passage that a third of all documents share costs a receiver a row for each shard.
Texts are shuffled once (the exchange by shard is used by all steps), and the answers go back by shard.  Rows of an exchange come in
another order each time they are read on a cluster, and answers name suffixes by their place, so each step first orders its rows.

Cases: a null or empty text, or one shorter than `length`, loses nothing; texts of any length are treated whole; rows that
share a key count as one document and lose nothing to each other; an empty table gives an empty table; extra columns are never
read.  Keys that are no integers raise TypeError; rows with a null key count as one last document, and the key 2^63 - 1 as the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import dealt, enter, integer, parts, sharded

U = np.uint64
PIECE = 1 << 20
#: An anchor that one shard has more often than this is hot for all shards.
HEAVY = 256


class LoserTree:
    """Merges runs of sorted byte strings, given the common prefix of each string with the one before it in its run."""

    def __init__(self, strings: list[list[bytes]], common: list[list[int]]):
        self.strings, self.common = strings, common
        self.k = 1 << max(0, len(strings) - 1).bit_length()

    def merged(self) -> tuple[list[int], list[int], list[int]]:
        """(run, common prefix with the string before, place in the run) in ascending order."""
        k, runs = self.k, len(self.strings)
        text = [s[0] if r < runs and (s := self.strings[r]) else b"" for r in range(k)]
        # the common prefix of each run's string with the last winner; -1 for a run that has ended
        know = [0 if r < runs and self.strings[r] else -1 for r in range(k)]
        loser, at = [0] * k, [0] * k
        ends = [len(s) for s in self.strings] + [0] * (k - runs)
        winner = list(range(k)) * 2

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser) of two runs; the loser's known prefix is then one with the winner."""
            if know[a] != know[b]:
                return (a, b) if know[a] > know[b] else (b, a)
            if know[a] < 0:
                return a, b
            s, t, d = text[a], text[b], know[a]
            if s == t:
                know[b] = len(t)
                return a, b
            m = min(len(s), len(t))
            if d < m and s[d] == t[d]:  # the first byte that differs, by the highest bit of an exclusive or
                d = m - (((int.from_bytes(s[d:m]) ^ int.from_bytes(t[d:m])).bit_length() + 7) >> 3)
            if d == m:
                a, b = (a, b) if len(s) < len(t) else (b, a)
            elif s[d] > t[d]:
                a, b = b, a
            know[b] = d
            return a, b

        for node in range(k - 1, 0, -1):
            left, right = (winner[2 * node], winner[2 * node + 1]) if 2 * node < k else (2 * node - k, 2 * node + 1 - k)
            winner[node], loser[node] = play(left, right)
        w = winner[1] if k > 1 else 0
        out_run, out_common, out_place = [], [], []
        strings, common = self.strings, self.common
        while know[w] >= 0:
            i = at[w]
            out_run.append(w)
            out_common.append(know[w])
            out_place.append(i)
            i += 1
            at[w] = i
            if i < ends[w]:
                text[w], know[w] = strings[w][i], common[w][i]
            else:
                know[w] = -1
            node = (w + k) >> 1
            while node:
                c = loser[node]
                a, b = know[w], know[c]
                if a < b:
                    loser[node], w = w, c
                elif a == b and a >= 0:
                    w, loser[node] = play(w, c)
                node >>= 1
        return out_run, out_common, out_place


def _anchors(buf: np.ndarray, off: np.ndarray, length: int, k: int, whole: bool) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, anchor) of the anchors in packed texts, ascending; if `whole`, also a hash of all bytes
    from the first window's start to the last one's end and the anchor's place in them, else zeros."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return np.zeros(0, U), none, none, none, np.zeros(0, U)
    value = vec.kmers(buf, k)
    # least by the upper half of the hash, leftmost if equal: a place has 32 bits, as an Arrow text has no more
    low = (value & U(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=U)
    reach, left = 1, length - k + 1
    while reach < left:
        step = min(reach, left - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    start = np.zeros(len(at), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= length:
            start[a : b - length + 1] = True
    s = np.flatnonzero(start)
    if not len(s):
        return np.zeros(0, U), none, none, none, np.zeros(0, U)
    a = at[s]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1))))
    last = np.append(head[1:], len(s)) - 1
    # least hashes crowd at the low end, so they are mixed again before they are dealt to buckets
    lo, hi, a = s[head], s[last], a[head]
    all_ = np.zeros(len(a), U)
    if whole:
        all_ = (hi - lo).astype(U) << U(32) | (a - lo).astype(U)
        for j in range(0, 2 * length - k + 1, k):  # k-byte strings that cover all
            all_ = vec.mix(all_ ^ value[np.minimum(lo + j, hi + length - k)])
    return vec.mix(value[a] ^ U(0x2545F4914F6CDD1D)), lo, hi, a, all_


class Shard:
    """Texts of a shard with their anchors."""

    def __init__(self, rows: pa.Table, length: int, k: int, whole: bool = False):
        rows = _ordered(rows)
        self.keys, self.missing, self.length, self.k = rows.column("key").to_numpy(), rows.column("missing").combine_chunks(), length, k
        self.buf, self.off = vec.packed(rows.column("text"))
        found = []
        for i, j in self.pieces():
            base = self.off[i]
            h, lo, hi, a, all_ = _anchors(self.buf[base : self.off[j]], self.off[i : j + 1] - base, length, k, whole)
            found.append((h, *((x + base).astype(np.int32 if len(self.buf) < 2**31 else np.int64) for x in (lo, hi, a)), all_))
        joined = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, U)] + [np.zeros(0, np.int32)] * 3 + [np.zeros(0, U)]
        found.clear()
        self.hash, self.lo, self.hi, self.at, self.all = joined
        self.row = vec.rows_of(self.lo, self.off).astype(np.int32)
        self.unique, self.back = np.unique(self.hash, return_inverse=True)

    @property
    def doc(self) -> np.ndarray:
        return self.keys[self.row]

    def pieces(self):
        """Ranges of rows with about PIECE bytes."""
        i, n = 0, len(self.keys)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + PIECE, "right")) - 1)
            yield i, j
            i = j

    def several(self) -> np.ndarray:
        """Which unique anchors occur in two documents of this shard."""
        low, high = np.full(len(self.unique), np.iinfo(np.int64).max), np.full(len(self.unique), np.iinfo(np.int64).min)
        np.minimum.at(low, self.back, self.doc)
        np.maximum.at(high, self.back, self.doc)
        return low < high

    def heavy(self) -> np.ndarray:
        """The unique anchors that occur more than HEAVY times in this shard."""
        return np.flatnonzero(np.bincount(self.back, minlength=len(self.unique)) > HEAVY)

    def _segments(self, at: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray):
        """Parts of about 65536 of the segments that `at` names."""
        for i in range(0, max(len(at), 1), 65536):
            c = at[i : i + 65536]
            yield vec.Segments(self.buf, start[c].astype(np.int64), end[c].astype(np.int64), words)

    def suffixes(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """The distinct ones among occurrences of shared anchors: equal bytes from the first window's start to the last one's end,
        with the anchor in the same place.  Hashes find them and bytes decide; `first` is the one in the least document."""
        use = shared[self.back]
        self.hot = hot[self.back[use]]
        self.lo, self.hi, self.at, self.row, self.hash, h = (x[use] for x in (self.lo, self.hi, self.at, self.row, self.hash, self.all))
        self.back = self.unique = self.all = None
        words, end = vec.words_of(self.buf), self.hi + self.length
        order = np.lexsort((self.doc, h))
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        mate = np.empty(len(order), np.int64)
        mate[order] = order[new][np.cumsum(new) - 1]
        size, before = end - self.lo, self.at - self.lo
        other = (size != size[mate]) | (before != before[mate])
        for i in range(0, len(other), 65536):
            c = np.flatnonzero(~other[i : i + 65536] & (mate[i : i + 65536] != np.arange(i, min(i + 65536, len(mate))))) + i
            a, b = (vec.Segments(self.buf, self.lo[x].astype(np.int64), end[x].astype(np.int64), words) for x in (c, mate[c]))
            bad = a.lane != b.lane
            if bad.any():
                other[c[np.repeat(np.arange(len(c)), a.lanes)[bad]]] = True
        mate[other] = np.flatnonzero(other)  # of one hash but other bytes: each stands for itself
        self.first, self.which = np.unique(mate, return_inverse=True)

    def sort(self, n: int) -> None:
        """Entries for the merge, ordered by bucket and bytes; `of` is the distinct suffix of each.

        A suffix is one entry, in the bucket of its anchor.  At a hot anchor it is two: one for windows with more than half of
        their other bytes behind the anchor, in a bucket by the anchor and those bytes, and one for windows with more before it."""
        L, k = self.length, self.k
        half = (L - k) // 2
        f = self.first
        hot = self.hot[f]
        at, before, size = self.at[f].astype(np.int64), (self.at[f] - self.lo[f]).astype(np.int64), (self.hi[f] + L - self.at[f]).astype(np.int64)
        cool, right, left = np.flatnonzero(~hot), np.flatnonzero(hot & (size >= L - half)), np.flatnonzero(hot & (before > half))
        words = vec.words_of(self.buf)
        beside = lambda x, a, b: vec.mix(self.hash[f[x]] ^ np.concatenate([s.hashes for s in self._segments(x, a, b, words)]))
        of = np.concatenate((cool, right, left))
        h = np.concatenate((self.hash[f[cool]], beside(right, at + k, at + L - half), beside(left, at - half - 1, at)))
        before = np.concatenate((before[cool], np.minimum(before[right], half), before[left]))
        size = np.concatenate((size[cool], size[right], np.minimum(size[left], L - half - 1)))
        m = np.zeros((len(of), L + 1), np.uint8)
        idx = np.arange(L)
        for i in range(0, len(of), 65536):
            c = slice(i, i + 65536)
            m[c, :L] = np.where(idx < size[c, None], self.buf[np.minimum(at[of[c], None] + idx, max(len(self.buf) - 1, 0))], 0)
        m[:, L] = size
        bucket = bucket_of(h, n)
        by_bytes = np.argsort(m.view(f"S{L + 1}").ravel(), kind="stable") if len(of) else np.zeros(0, np.int64)
        order = by_bytes[np.argsort(bucket[by_bytes], kind="stable")]
        self.matrix, self.size, self.before, self.bucket, self.of = m[order], size[order], before[order], bucket[order], of[order]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> U(32)).astype(np.int64) * n >> 32


def _run(shard: Shard, a: int, b: int) -> bytes:
    """Suffixes a to b of a shard, front-coded; before each part its size."""
    m, size = shard.matrix[a:b, :-1], shard.size[a:b]
    common = np.zeros(b - a, np.int64)
    differ = m[1:] != m[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    rest = m[(np.arange(m.shape[1]) >= common[:, None]) & (np.arange(m.shape[1]) < size[:, None])]
    f, before = shard.first[shard.of[a:b]], shard.before[a:b]
    head = vec.ragged(shard.buf, shard.at[f] - before, before)
    out = [np.array([b - a], "<i8").tobytes()]
    for x in (common.astype(np.uint8), size.astype(np.uint8), before.astype(np.uint8), shard.doc[f].astype("<i8"), rest, head):
        x = x.tobytes()
        out += [np.array([len(x)], "<i8").tobytes(), x]
    return b"".join(out)


def _parse_run(raw: bytes) -> tuple[np.ndarray, ...]:
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in (np.uint8, np.uint8, np.uint8, np.dtype("<i8"), np.uint8, np.uint8):
        size = int(np.frombuffer(raw, "<i8", 1, at)[0])
        out.append(np.frombuffer(raw[at + 8 : at + 8 + size], kind))
        at += 8 + size
    assert len(out[0]) == n
    return tuple(out)


def _decode(common: np.ndarray, size: np.ndarray, rest: np.ndarray) -> list[bytes]:
    out, last, at, raw = [], b"", 0, rest.tobytes()
    for c, n in zip(common.tolist(), size.tolist(), strict=True):
        last = last[:c] + raw[at : at + n - c]
        at += n - c
        out.append(last)
    return out


def _repeated(runs: list[bytes], length: int) -> list[np.ndarray]:
    """For each suffix of each run: bit o is set if its window with o bytes before the anchor also starts in a lesser document."""
    parsed = [_parse_run(r) for r in runs]
    run, common, place = LoserTree([_decode(p[0], p[1], p[4]) for p in parsed], [p[0].tolist() for p in parsed]).merged()
    begin = np.concatenate(([0], np.cumsum([len(p[0]) for p in parsed])))
    source = begin[np.array(run, np.int64)] + np.array(place, np.int64)
    common = np.array(common, np.int64)
    size, before, doc = (np.concatenate([p[i] for p in parsed])[source] for i in (1, 2, 3))
    size, before = size.astype(np.int64), before.astype(np.int64)
    head = np.concatenate([p[5] for p in parsed])
    end = np.cumsum(np.concatenate([p[2] for p in parsed]).astype(np.int64))[source]
    n, reach = len(source), int(before.max(initial=0))
    # the bytes before the anchor, from the anchor backwards, sorted; and their common prefixes
    back = np.zeros((n, reach + 1), np.uint8)
    for j in range(reach):
        m = before > j
        back[m, j] = head[end[m] - 1 - j]
    back[:, reach] = before + 1
    order = np.argsort(back.view(f"S{reach + 1}").ravel(), kind="stable")
    b = back[order]
    known = np.zeros(n, np.int64)
    if reach:
        differ = b[1:, :reach] != b[:-1, :reach]
        known[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
        known[1:] = np.minimum(known[1:], np.minimum(before[order][1:], before[order][:-1]))
    bits = np.zeros(n, np.int64)
    for o in range(reach + 1):
        alike = common >= length - o  # with the one before: a window without a neighbour of this prefix is alone
        has = np.flatnonzero((before >= o) & (size >= length - o) & (alike | np.append(alike[1:], False)))
        if len(has) < 2:
            continue
        right = np.cumsum(~alike)
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(known < o) if o else 0
        key = right[has] * (n + 1) + left[has]
        by = np.argsort(key, kind="stable")
        k, d = key[by], doc[has[by]]
        first = np.concatenate(([True], k[1:] != k[:-1]))
        least = np.minimum.reduceat(d, np.flatnonzero(first))[np.cumsum(first) - 1]
        bits[has[by[d > least]]] |= 1 << o
    out = np.empty(n, np.int64)
    out[source] = bits
    return [out[begin[i] : begin[i + 1]].astype("<u8") for i in range(len(runs))]


def _ordered(t: pa.Table) -> pa.Table:
    """Rows by key and text, whatever order they came in."""
    t = t.set_column(t.column_names.index("text"), "text", t.column("text").cast(pa.large_binary())).select(["key", "missing", "text"])
    key = t.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    twice = key[order][1:] == key[order][:-1]
    return t.take(pa.array(order) if not twice.any() else pc.sort_indices(t, sort_keys=[(c, "ascending") for c in t.column_names]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_EMPTY = pa.table({"key": pa.array([], pa.int64()), "missing": pa.array([], pa.bool_()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.binary()), "spans": pa.array([], _SPANS)})


def _cut(s: Shard, i: int, j: int, base: int, own: slice, take: np.ndarray) -> pa.Table:
    """Rows i to j without the bytes that their repeated windows cover; `own` are their suffixes."""
    buf, off = s.buf[base : s.off[j]], s.off[i : j + 1] - base
    cover = np.zeros(len(buf) + 1, np.int32)
    for o in range(s.length - s.k + 1):
        at = s.at[own] - o
        m = (take[own] >> o & 1 > 0) & (at >= s.lo[own]) & (at <= s.hi[own])
        np.add.at(cover, at[m] - base, 1)
        np.add.at(cover, at[m] - base + s.length, -1)
    gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
    start, end = vec.runs(gone.astype(np.uint8), off)
    hit = gone[start] if len(start) else np.zeros(0, bool)
    start, end = start[hit], end[hit]
    row = vec.rows_of(start, off)
    count = np.bincount(row, minlength=j - i)
    kept = buf[~gone].tobytes()
    removed = np.bincount(row, end - start, j - i).astype(np.int64)
    size = np.diff(off)
    cut = np.concatenate(([0], np.cumsum(size - removed))).tolist()
    texts = [kept[cut[k] : cut[k + 1]] for k in range(j - i)]
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.StructArray.from_arrays([pa.array(start - off[row]), pa.array(end - off[row])], ["start", "end"]))
    return pa.table({"key": pa.array(s.keys[i:j]), "missing": s.missing[i:j], "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(count), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), "kept": pa.array(texts, pa.binary()), "spans": spans})


def remove(df: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept binary, spans array<struct<start, end>>); bytes are counted from 0."""
    k = length // 2 - 1
    integer(df, key)
    if not 8 <= length <= 64:
        raise ValueError("the length must be from 8 to 64")
    n = parts(df)
    own = F.col(f"`{key}`").cast("long")
    texts = df.select(F.coalesce(own, F.lit(2**63 - 1)).alias("key"), own.isNull().alias("missing"), F.col(f"`{text}`").alias("text"))
    texts = sharded(texts, n, "key")

    def made(t: pa.Table, whole: bool) -> Shard:
        return Shard(t, length, k, whole)

    def answers(t: pa.Table) -> dict[int, bytes]:
        return dict(zip(t.column("part").to_pylist(), t.column("block").to_pylist(), strict=True))

    def rows(shard: int, cut: list[int], block) -> pa.Table:
        some = [p for p in range(n) if cut[p + 1] > cut[p]]
        return pa.table({"part": pa.array(some, pa.int32()), "shard": pa.array([shard] * len(some), pa.int32()), "block": pa.array([block(cut[p], cut[p + 1]) for p in some], pa.binary())})

    def ask_anchors(group, t):
        enter("suffixdedup")
        s = made(t, False)
        flag, heavy = s.several(), s.heavy()
        low = s.unique.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        own = lambda a, b: heavy[np.searchsorted(heavy, a) : np.searchsorted(heavy, b)] - a
        block = lambda a, b: np.array([b - a], "<u4").tobytes() + low[a:b].tobytes() + np.packbits(flag[a:b]).tobytes() + own(a, b).astype("<u4").tobytes()
        return rows(group[0].as_py(), np.searchsorted(bucket_of(s.unique, n), np.arange(n + 1)).tolist(), block)

    def meet_anchors(batches):
        came = [(b.column("part")[i].as_py(), b.column("shard")[i].as_py(), b.column("block")[i].as_py()) for b in batches for i in range(b.num_rows)]
        enter("suffixdedup")
        for part in sorted({c[0] for c in came}):
            mine = [c for c in came if c[0] == part]
            keys, flags, heavy, total = [], [], [], 0
            for _, _, raw in mine:
                m = int(np.frombuffer(raw, "<u4", 1)[0])
                full = np.zeros((m, 8), np.uint8)
                full[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, 4).reshape(m, 6)
                bits = 4 + 6 * m + -(-m // 8)
                keys.append(full.view("<u8").ravel())
                flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-m // 8), 4 + 6 * m), count=m).astype(bool))
                heavy.append(np.frombuffer(raw, "<u4", offset=bits).astype(np.int64) + total)
                total += m
            _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            shared, hot = count > 1, np.zeros(len(count), bool)
            shared[back[np.concatenate(flags)]] = True
            hot[back[np.concatenate(heavy)]] = True
            hit, warm, at = shared[back], hot[back], 0
            for (_, shard, _), kx in zip(mine, keys, strict=True):
                own = slice(at, at + len(kx))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([np.packbits(hit[own]).tobytes() + np.flatnonzero(warm[own]).astype("<u4").tobytes()], pa.binary())], ["shard", "part", "block"])
                at += len(kx)

    def narrowed(t: pa.Table, reply: pa.Table) -> Shard:
        s, got = made(t, True), answers(reply)
        cut = np.searchsorted(bucket_of(s.unique, n), np.arange(n + 1)).tolist()
        shared, hot = np.zeros(len(s.unique), bool), np.zeros(len(s.unique), bool)
        for p in range(n):
            if (m := cut[p + 1] - cut[p]) > 0:
                shared[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(got[p], np.uint8, -(-m // 8)), count=m)
                hot[cut[p] + np.frombuffer(got[p], "<u4", offset=-(-m // 8)).astype(np.int64)] = True
        s.suffixes(shared, hot)
        s.sort(n)
        return s

    def send_runs(group, t, reply):
        enter("suffixdedup")
        s = narrowed(t, reply)
        return rows(group[0].as_py(), np.searchsorted(s.bucket, np.arange(n + 1)).tolist(), lambda a, b: _run(s, a, b))

    def merge_runs(batches):
        came = [(b.column("part")[i].as_py(), b.column("shard")[i].as_py(), b.column("block")[i].as_py()) for b in batches for i in range(b.num_rows)]
        enter("suffixdedup")
        for part in sorted({c[0] for c in came}):
            mine = sorted((c for c in came if c[0] == part), key=lambda c: c[1])
            for (_, shard, _), bits in zip(mine, _repeated([c[2] for c in mine], length), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["shard", "part", "block"])

    def finish(group, t, reply):
        enter("suffixdedup")
        kinds = reply.column("kind").to_numpy()
        one = lambda v: reply.filter(pa.array(kinds == v)).select(["shard", "part", "block"])
        s, got = narrowed(t, one(1)), answers(one(2))
        bits = np.zeros(len(s.first), np.int64)
        np.bitwise_or.at(bits, s.of, np.frombuffer(b"".join(got[p] for p in sorted(got)), "<i8"))
        doc = s.doc
        # windows of a document that isn't the least with this suffix in the shard are all repeated
        take = np.where(doc > doc[s.first][s.which], -1, bits[s.which]) if len(doc) else np.zeros(0, np.int64)
        out, m = [], 0
        for i, j in s.pieces():
            base, end = int(s.off[i]), int(np.searchsorted(s.lo, s.off[j]))
            out.append(_cut(s, i, j, base, slice(m, end), take))
            m = end
        return pa.concat_tables(out) if out else _EMPTY

    asked = texts.groupBy("shard").applyInArrow(ask_anchors, "part int, shard int, block binary")
    reply = dealt(asked, n, "part").mapInArrow(meet_anchors, "shard int, part int, block binary")
    runs = texts.groupBy("shard").cogroup(reply.groupBy("shard")).applyInArrow(send_runs, "part int, shard int, block binary")
    bits = dealt(runs, n, "part").mapInArrow(merge_runs, "shard int, part int, block binary")
    both = reply.withColumn("kind", F.lit(1)).union(bits.withColumn("kind", F.lit(2)))
    out = texts.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(finish, "key long, missing boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>")
    return out.withColumn("key", F.when(~F.col("missing"), F.col("key"))).drop("missing").withColumnRenamed("key", key)
