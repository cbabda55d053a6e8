"""Token-ID output in word-aligned Simple-8b coding, in ascending order of the documents.

A word of 64 bits holds a selector in its top four bits and as many ids of one width as fit in the other 60.  Selector 0 is
the escape: the next word holds one value of up to 64 bits.  Ids are coded in blocks of 256; a block starts at a word, and
its offset is kept, so blocks are coded and decoded side by side by numpy.

A token file is a table of images (Parquet with one binary column), because executors and driver share no local folders and
only Spark's writers reach every store: `part` is the file, `seq` its place in the file; an image holds whole documents.

Cases: a null or empty text has the end id alone; equal keys keep all their rows; texts of any length stay in one image; an
empty table gives empty files; extra columns are never read.  A null key sorts first; keys that are no integers raise TypeError.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units, vec
from .common import cache, enter, integer, parts, saved

BLOCK = 256
#: How many ids of how many bits a word holds, by selector from 1 on.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
U = np.uint64
#: Stands for a null key in the files.
NO_KEY = -(2**63)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block in them) of unsigned 64-bit values."""
    values = values.astype(U)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, U), np.zeros(1, np.int64)
    width = np.zeros((blocks, BLOCK + 60), np.int8)
    exact = np.frexp(values.astype(np.float64))[1].astype(np.int8)
    small = values < U(1 << 52)
    exact[~small] = [int(v).bit_length() for v in values[~small].tolist()]
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = exact
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = np.zeros((blocks, BLOCK), np.int8)
    top, c = width[:, :BLOCK].copy(), 1
    for s in range(len(COUNTS), 0, -1):
        while c < COUNTS[s - 1]:
            np.maximum(top, width[:, c : c + BLOCK], out=top)
            c += 1
        best[top <= BITS[s - 1]] = s
    step = np.concatenate(([1], COUNTS))
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    found_block, found_at, found_sel, found_nth = [], [], [], []
    nth = np.zeros(blocks, np.int64)
    while len(live):
        sel = best[live, at[live]]
        found_block.append(live)
        found_at.append(at[live])
        found_sel.append(sel)
        found_nth.append(nth[live])
        nth[live] += np.where(sel == 0, 2, 1)
        at[live] += step[sel]
        live = live[at[live] < size[live]]
    offsets = np.concatenate(([0], np.cumsum(nth)))
    block, pos, sel, k = (np.concatenate(x) for x in (found_block, found_at, found_sel, found_nth))
    words = np.zeros(int(offsets[-1]), U)
    padded = np.zeros(blocks * BLOCK + 60, U)
    padded[:n] = values
    where, first = offsets[block] + k, block * BLOCK + pos
    for s in range(1, len(COUNTS) + 1):
        m = np.flatnonzero(sel == s)
        if len(m):
            w = np.full(len(m), s << 60, U)
            left = size[block[m]] - pos[m]
            for j in range(COUNTS[s - 1]):
                w |= np.where(j < left, padded[first[m] + j], U(0)) << U(j * BITS[s - 1])
            words[where[m]] = w
    m = np.flatnonzero(sel == 0)
    words[where[m] + 1] = padded[first[m]]
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values; words of one selector are decoded together."""
    out = np.zeros(n, U)
    if not n:
        return out
    sel = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0).tolist():  # an escape's second word may look like one
        if not raw[i]:
            raw[i + 1] = True
    head = np.flatnonzero(~raw)
    sel = sel[head]
    step = np.concatenate(([1], COUNTS))[sel]
    block = np.searchsorted(offsets, head, "right") - 1
    run = np.cumsum(step) - step
    first_of_block = np.searchsorted(head, offsets[:-1])
    start = block * BLOCK + run - run[first_of_block][block]
    end = np.minimum(n, (block + 1) * BLOCK)
    for s in range(1, len(COUNTS) + 1):
        m = np.flatnonzero(sel == s)
        for j in range(COUNTS[s - 1] if len(m) else 0):
            at = start[m] + j
            ok = at < end[m]
            out[at[ok]] = ((words[head[m]] >> U(j * BITS[s - 1])) & U((1 << int(BITS[s - 1])) - 1))[ok]
    m = np.flatnonzero(sel == 0)
    out[start[m]] = words[head[m] + 1]
    return out


def image(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Header of four counts, then keys, lengths, block offsets and words, all little-endian and eight bytes wide."""
    words, offsets = pack(ids)
    head = np.array([0x73387069, len(keys), len(ids), len(offsets)], "<u8")
    return b"".join(x.tobytes() for x in (head, keys.astype("<i8"), lengths.astype("<i8"), offsets.astype("<i8"), words.astype("<u8")))


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(data, "<u8")
    magic, n, total, blocks = a[:4].tolist()
    if magic != 0x73387069:
        raise ValueError("not a token file")
    cut = np.cumsum([4, n, n, blocks])
    offsets = a[cut[2] : cut[3]].astype(np.int64)
    return a[4 : cut[1]].astype(np.int64), a[cut[1] : cut[2]].astype(np.int64), unpack(a[cut[3] :], offsets, total)


class Encoder:
    """A tokenizer of the `tokenizers` library asked once for each distinct unit between spaces and changes of class.

    Strings of added tokens span units, so rows that hold one, in letters of any case, go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo = vec.Memo(np.uint32)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = [self.lower[np.frombuffer(t.content.encode(), np.uint8)].tobytes() for t in self.tok.get_added_tokens_decoder().values()]

    def quoting(self, data: bytes, off: np.ndarray) -> np.ndarray:
        """Rows of lower-case text that hold the string of an added token."""
        hit = []
        for a in self.added:
            at = data.find(a)
            while at >= 0:
                hit.append((at, at + len(a)))
                at = data.find(a, at + 1)
        s, e = np.array(hit, np.int64).reshape(-1, 2).T
        row = vec.rows_of(s, off)
        return np.unique(row[e <= off[row + 1]])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, buf = buf, self.lower[buf]  # the tokenizer lowers letters itself; fewer units differ this way
        start, end, plain = units.cut(buf, off, spaces=False)
        data = buf.tobytes()
        whole = self.quoting(data, off)
        if len(whole):
            rest = ~np.isin(vec.rows_of(start, off), whole)
            ids, counts = self._by_units(buf, data, off, start[rest], end[rest], plain[rest])
            said = [self.tok.encode(raw[off[r] : off[r + 1]].tobytes().decode(), add_special_tokens=False).ids for r in whole.tolist()]
            size = np.array([len(x) for x in said])
            ids = np.insert(ids, np.repeat(np.cumsum(counts)[whole], size), np.array([i for x in said for i in x], np.uint32))
            counts[whole] = size
            return ids, counts
        return self._by_units(buf, data, off, start, end, plain)

    def _by_units(self, buf, data: bytes, off, start, end, plain) -> tuple[np.ndarray, np.ndarray]:
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)

        def make(first):
            said = [data[a:e].decode() for a, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            # a run of letters or of punctuation is one word, whose last id alone ends a word: many go into one call
            word = plain[first] & ((buf[start[first]] < 48) | (buf[start[first]] > 57))
            flat, length = [], np.zeros(len(first), np.int64)
            some = np.flatnonzero(word)
            for i in range(0, len(some), 4096):
                ids = np.array(self.tok.encode_batch_fast([" ".join([said[j] for j in some[i : i + 4096].tolist()])], add_special_tokens=False)[0].ids, np.uint32)
                flat.append(ids)
                length[some[i : i + 4096]] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            rest = np.flatnonzero(~word)
            got = [x.ids for x in self.tok.encode_batch_fast([said[j] for j in rest.tolist()], add_special_tokens=False)]
            flat.append(np.array([i for x in got for i in x], np.uint32))
            length[rest] = [len(x) for x in got]
            order = np.concatenate((some, rest))
            at = np.zeros(len(first), np.int64)
            at[order] = np.cumsum(length[order]) - length[order]
            return vec.ragged(np.concatenate(flat), at, length), length

        begin, length = self.memo.lookup(vec.Segments(buf, start, end), make)
        counts = np.bincount(vec.rows_of(start, off), length, len(off) - 1).astype(np.int64)
        return vec.ragged(self.memo.flat, begin, length), counts


_encoders: dict[str, Encoder] = cache("tokenfile", {})


def _encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, and writes the token files; returns their table (part, seq, before, n_docs, n_ids, image).

    Rows are dealt by ranges of the key, so the files in order of `part` hold the keys in ascending order."""
    integer(df, key)
    n = parts(df)

    def run(batches):
        from pyspark import TaskContext

        import os

        enter("tokenfile")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, part, seq, before = _encoder(path), TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for i, m in vec.slices(b, "text"):
                rows = b.slice(i, m)
                ids, counts = enc.encode(*vec.packed(rows.column("text")))
                at = np.cumsum(counts) + np.arange(1, m + 1)
                full = np.full(len(ids) + m, end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[at - 1] = False
                full[keep] = ids
                data = image(rows.column("key").to_numpy(zero_copy_only=False), counts + 1, full)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([m], pa.int64()), pa.array([len(full)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "before", "n_docs", "n_ids", "image"])
                seq += 1
                before += len(full)

    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("key"), F.col(f"`{text}`").alias("text")).repartitionByRange(n, "key").sortWithinPartitions("key")
    return saved(rows.mapInArrow(run, "part int, seq int, before long, n_docs long, n_ids long, image binary"))


def starts(files: DataFrame) -> DataFrame:
    """files with `start`, the number of ids in all images before.

    Images know what comes before them in their part; the parts' totals are a row for each partition of the writer, a count
    that the session fixes, so they may be broadcast."""
    from pyspark.sql import Window

    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("of_part"))
    return files.join(F.broadcast(before), "part").withColumn("start", F.col("of_part") + F.col("before"))


def read(files: DataFrame, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document from the files: (key, start, n_tokens, ids_crc32), and the ids themselves if asked for."""

    def run(batches):
        for b in batches:
            for data, start in zip(b.column("image"), b.column("start").to_pylist(), strict=True):
                keys, lengths, values = parse(data.as_py())
                at = np.concatenate(([0], np.cumsum(lengths)))
                values = values.astype("<u4")
                raw, o = memoryview(values.tobytes()), (4 * at).tolist()
                cols = [pa.array(keys, mask=keys == NO_KEY), pa.array(start + at[:-1]), pa.array(lengths), pa.array([zlib.crc32(raw[o[j] : o[j + 1]]) for j in range(len(keys))], pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["key", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    out = starts(files).select("image", "start").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    return out.withColumnRenamed("key", key)
