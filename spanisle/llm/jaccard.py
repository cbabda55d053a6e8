"""N-gram Jaccard join: documents whose sets of word shingles are alike, by T-occurrence search over inverted lists.

1. Each text becomes its set of hashed shingles; texts with equal sets are one class from here on.
2. Who may meet.  Two similar sets of sizes up to n agree on so much that of their rarest shingles (n - ceil(t * n) + 1 of them,
   in one order for all sets) one is common to both; so only short inverted lists need to be met on, and long ones never
   are.  Shards of texts send their distinct shingles, packed and truncated, to be counted; they get back a rank by document
   frequency (a byte each), and send the rarest ones that are not of one document alone.  A list with several classes yields a
   star of edges.  Components of those edges are clusters, outside of which no set has a link.
3. Search.  Each set of a cluster queries inverted lists with DivideSkip: it must occur on T of them, so the longest are set aside,
   the short ones are merged by a heap that skips what can't occur often enough, and what is left is looked up in the long
   ones by binary search.  First the lists hold one set for each group joined so far, so copies cost a look at a few lists.  Then
   those sets that share one of their rarest shingles with another group query the lists of all.
4. Clusters too large for one task are searched in blocks, each within itself; then representatives of the groups so found, a block
   at a time, until that joins no more.  If several groups are left, all members but those of the largest group query the members of
   all blocks: a family of copies is never paired block by block, and no task holds a whole large cluster.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer words than a
shingle is one shingle; repeated rows share a class; an empty table gives an empty table; extra columns are never read; texts
of any length are read whole.  Keys that are no integers raise TypeError; a row with a null key joins the class of equal sets, if
other rows have one, and leads none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, vec
from .common import dealt, enter, integer, parts, saved, sharded, split_by, wide

U = np.uint64
_WHITE = vec.lut(bytes([0x20, *range(9, 14)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Sets and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 120_000


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, ascending, one text after the other; and the texts' offsets in them."""
    buf, off = vec.packed(texts)
    buf, n = _LOWER[buf], len(off) - 1
    s, e = vec.runs(_WHITE[buf], off)
    keep = ~_WHITE[buf[s]] if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    h, row = vec.Segments(buf, s, e).hashes, vec.rows_of(s, off)
    count = np.bincount(row, minlength=n)
    last = np.cumsum(count)
    left = last[row] - np.arange(len(row))  # words from here to the end of the text
    size = np.minimum(count[row], words)
    head = (left >= size) & ((count[row] >= words) | (left == count[row]))
    at = np.flatnonzero(head)
    sh = np.zeros(len(at), U)
    for j in range(words):
        inside = j < size[at]
        sh = np.where(inside, vec.mix(sh * U(0x9E3779B97F4A7C15) + h[np.minimum(at + j, max(len(h) - 1, 0))] + U(j + 1)), sh) if len(at) else sh
    row = row[at]
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])
    row, sh = row[new], sh[new]
    return sh, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))


def set_hashes(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, as signed integers."""
    out = []
    for c in (0x51ED270B, 0xA0761D6478BD642F):
        sums = np.zeros(len(sh) + 1, U)
        np.cumsum(vec.mix(sh ^ U(c)), out=sums[1:])
        out.append(vec.mix(sums[off[1:]] - sums[off[:-1]]).view(np.int64))
    return out[0], out[1]


def _least(size: int, p: int) -> int:
    return -(-p * size // 100)


def merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """(number, on how many lists) of the numbers on t or more of the ascending lists, by a heap of their heads.

    Where the least number is on too few lists, t - 1 lists are moved on to the head that is then the least: no number before
    it can be on t lists."""
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapify(heap)
    place = [0] * len(lists)
    while len(heap) >= t:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heappop(heap)[1])
        if len(out) >= t:
            yield top, len(out)
            for k in out:
                place[k] += 1
                if place[k] < len(lists[k]):
                    heappush(heap, (lists[k][place[k]], k))
            continue
        while len(out) < t - 1:
            out.append(heappop(heap)[1])
        to = heap[0][0]
        for k in out:
            place[k] = at = bisect_left(lists[k], to, place[k])
            if at < len(lists[k]):
                heappush(heap, (lists[k][at], k))


def divide_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(number, on how many lists) of the numbers on `need` or more lists."""
    if len(lists) < need:
        return
    lists.sort(key=len)
    # how many long lists are only probed: the more, the fewer numbers are merged, and the more are candidates
    aside = min(need - 1, int(need / (0.01 * np.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for number, count in merge_skip(short, need - aside):
        left = aside
        for x in reversed(long):
            if count + left < need:
                break
            at = bisect_left(x, number)
            left -= 1
            count += at < len(x) and x[at] == number
        else:
            if count >= need:
                yield number, count


class Groups:
    """Sets and which of them links have joined; `links` are the links that joined two groups."""

    def __init__(self, sets: list[np.ndarray], per_cent: int, group: list[int] | None = None):
        self.sets, self.p, self.links = [s.tolist() for s in sets], per_cent, []
        self.arrays = sets
        self.root = list(range(len(sets)))
        first: dict[int, int] = {}
        for k, g in enumerate(group or []):
            self.root[k] = first.setdefault(g, k)

    def find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def _alike(self, a: int, b: int, common: int) -> bool:
        return 100 * common >= self.p * (len(self.sets[a]) + len(self.sets[b]) - common)

    def _join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.links.append((a, b))
            self.root[y] = x

    def by_representatives(self) -> None:
        """Joins every set with the groups whose representative it is similar to; a set of no group represents a new one."""
        index: dict[int, list[int]] = {}
        for k, q in enumerate(self.sets):
            need = max(1, _least(len(q), self.p))
            found = [x for s in q if (x := index.get(s)) is not None]
            alike = [r for r, c in divide_skip(found, need) if self._alike(k, r, c)]
            for r in alike:
                self._join(r, k)
            if not alike and self.find(k) == k:
                for s in q:
                    index.setdefault(s, []).append(k)

    def by_lists(self, index: list[int], queries: list[int]) -> None:
        """Joins each query with the similar sets of the index.  Sets of one group need no further search, so a query that shares
        none of its rarest shingles with a set of another group is left out."""
        if not index or not queries:
            return
        token = np.concatenate([self.arrays[k] for k in index])
        doc = np.repeat(index, [len(self.sets[k]) for k in index])
        order = np.lexsort((doc, token))
        doc = doc[order]
        unique, begin = np.unique(token[order], return_index=True)
        if not len(unique):
            return
        end = np.append(begin[1:], len(order))
        roots = np.array([self.find(k) for k in range(len(self.sets))])
        low, high = np.minimum.reduceat(roots[doc], begin), np.maximum.reduceat(roots[doc], begin)
        size = np.array([len(self.sets[k]) for k in queries])
        asked, row = np.concatenate([self.arrays[k] for k in queries]), np.repeat(np.arange(len(queries)), size)
        at = np.minimum(np.searchsorted(unique, asked), len(unique) - 1)
        inside = unique[at] == asked
        order = np.lexsort((asked, np.where(inside, (end - begin)[at], 0), row))
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        rare = order[place < (size - -(-self.p * size // 100) + 1)[row]]
        own = roots[np.array(queries)][row[rare]]
        other = inside[rare] & ((low[at[rare]] != own) | (high[at[rare]] != own))
        cut = np.concatenate(([0], np.cumsum(size))).tolist()
        lists: dict[int, list[int]] = {}

        def postings(t: int) -> list[int]:
            if t not in lists:
                lists[t] = doc[begin[t] : end[t]].tolist()
            return lists[t]

        for i in np.unique(row[rare[other]]).tolist():
            k = queries[i]
            hit = slice(cut[i], cut[i + 1])
            found = [postings(t) for t in at[hit][inside[hit]].tolist()]
            for d, c in divide_skip(found, max(1, _least(len(self.sets[k]), self.p))):
                if self.find(d) != self.find(k) and self._alike(k, d, c):
                    self._join(d, k)


def links_within(sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets."""
    g = Groups(sets, per_cent)
    g.by_representatives()
    if len({g.find(k) for k in range(len(sets))}) > 1:
        g.by_lists(list(range(len(sets))), list(range(len(sets))))
    return g.links


def sets_of(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(id, n, s1, s2): size and hashes of every document's set."""

    def run(batches):
        enter("jaccard")
        for b in batches:
            for i, n in vec.slices(b, "text"):
                part = b.slice(i, n)
                sh, off = shingles(part.column("text"), words)
                s1, s2 = set_hashes(sh, off)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off)), pa.array(s1), pa.array(s2)], ["id", "n", "s1", "s2"])

    return wide(df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))).mapInArrow(run, "id long, n long, s1 long, s2 long")


class Tokens:
    """The shingle sets of a shard's texts, with its distinct shingles in order."""

    def __init__(self, texts: pa.Array, words: int):
        batch, found = pa.RecordBatch.from_arrays([texts], ["text"]), []
        for i, m in vec.slices(batch, 0):
            sh, off = shingles(batch.slice(i, m).column(0), words)
            found.append((sh, np.diff(off), set_hashes(sh, off)[0]))
        self.sh, self.size, self.node = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.unique, self.back, self.count = np.unique(self.sh, return_inverse=True, return_counts=True)

    def rarest(self, rank: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, class) for the rarest shingles of each set, as many as two similar sets can't both differ in; lone ones are left out."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        rank = rank[self.back]
        order = np.lexsort((self.sh, rank, row))
        place = np.arange(len(order)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        take = order[place < (self.size - -(-per_cent * self.size // 100) + 1)[row]]
        take = take[rank[take] > 0]
        return self.sh[take], self.node[row[take]]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> U(40)).astype(np.int64) * n >> 24


def _low(h: np.ndarray, width: int) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _whole(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").ravel()


def _candidates(df: DataFrame, words: int, per_cent: int, key: str, text: str) -> DataFrame:
    """(a, b): classes, by their first hash, whose sets have a rare shingle in common; k classes on a list give k - 1 edges."""
    n = parts(df)
    texts = sharded(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), n, "key").select("shard", "text")

    def rows(shard, part, block) -> pa.Table:
        return pa.table({"shard": pa.array(shard, pa.int32()), "part": pa.array(part, pa.int32()), "block": pa.array(block, pa.binary())})

    def ask(group, t):
        enter("jaccard")
        s = Tokens(t.column("text").combine_chunks(), words)
        low, count = _low(s.unique, 5), np.minimum(s.count, 255).astype(np.uint8)
        cut = np.searchsorted(_bucket(s.unique, n), np.arange(n + 1)).tolist()
        some = [p for p in range(n) if cut[p + 1] > cut[p]]
        return rows([group[0].as_py()] * len(some), some, [low[cut[p] : cut[p + 1]].tobytes() + count[cut[p] : cut[p + 1]].tobytes() for p in some])

    def answer(batches):
        came = [(b.column("part")[i].as_py(), b.column("shard")[i].as_py(), b.column("block")[i].as_py()) for b in batches for i in range(b.num_rows)]
        for part in sorted({c[0] for c in came}):
            mine = [c for c in came if c[0] == part]
            raw = [np.frombuffer(c[2], np.uint8) for c in mine]
            size = [len(r) // 6 for r in raw]
            _, back = np.unique(np.concatenate([_whole(r[: 5 * m], 5) for r, m in zip(raw, size, strict=True)]), return_inverse=True)
            total = np.bincount(back, np.concatenate([r[5 * m :] for r, m in zip(raw, size, strict=True)]))
            # 0 for a shingle of one document, else a rank that grows with its logarithm
            rank = np.where(total > 1, np.minimum(255, np.floor(6 * np.log2(np.maximum(total, 1)))), 0).astype(np.uint8)[back]
            at = 0
            for (_, shard, _), m in zip(mine, size, strict=True):
                yield from rows([shard], [part], [rank[at : at + m].tobytes()]).to_batches()
                at += m

    def send(group, t, reply):
        enter("jaccard")
        s = Tokens(t.column("text").combine_chunks(), words)
        got = dict(zip(reply.column("part").to_pylist(), reply.column("block").to_pylist(), strict=True))
        rank = np.frombuffer(b"".join(got[p] for p in sorted(got)), np.uint8)
        sh, node = s.rarest(rank, per_cent) if len(s.sh) else (np.zeros(0, U), np.zeros(0, np.int64))
        order = np.lexsort((node, sh))
        sh, node = sh[order], node[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (node[1:] != node[:-1])
        sh, node = sh[new], node[new]
        low, cut = _low(sh, 6), np.searchsorted(_bucket(sh, n), np.arange(n + 1)).tolist()
        some = [p for p in range(n) if cut[p + 1] > cut[p]]
        return rows([0] * len(some), some, [low[cut[p] : cut[p + 1]].tobytes() + node[cut[p] : cut[p + 1]].tobytes() for p in some])

    def meet(batches):
        enter("jaccard")
        keys, nodes = [], []
        for b in batches:
            for block in b.column("block"):
                raw = np.frombuffer(block.as_buffer(), np.uint8)
                m = len(raw) // 14
                keys.append(_whole(raw[: 6 * m], 6))
                nodes.append(np.frombuffer(raw[6 * m :].tobytes(), np.int64))
        if not keys:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        low = node[np.flatnonzero(head)][np.cumsum(head) - 1]
        pairs = np.unique(np.stack([low[low != node], node[low != node]], axis=1), axis=0)
        for i in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 50_000, 0]), pa.array(pairs[i : i + 50_000, 1])], ["a", "b"])

    kind = "shard int, part int, block binary"
    reply = dealt(texts.groupBy("shard").applyInArrow(ask, kind), n, "part").mapInArrow(answer, kind)
    sent = texts.groupBy("shard").cogroup(reply.groupBy("shard")).applyInArrow(send, kind)
    return dealt(sent, n, "part").mapInArrow(meet, "a long, b long")


def _search(asked: DataFrame, words: int, per_cent: int, n: int) -> DataFrame:
    """(a, b): links found among rows (cluster, i, j, kind, grp, rep, text) with equal cluster, i and j: rows of kind 0 among one
    another, rows of kind 2 with those of kind 1.  grp is the group of a row, of which links are known already."""

    def run(batches):
        enter("jaccard")
        now, rows = None, []

        def solve():
            seen: dict[int, tuple] = {}  # a repeated key counts once
            for r in rows:
                seen.setdefault(r[2], r)
            pick = list(seen.values())
            ids, kind = [r[2] for r in pick], [r[0] for r in pick]
            sh, off = shingles(pa.array([r[3] for r in pick], pa.string()), words)
            sets = [sh[off[k] : off[k + 1]] for k in range(len(pick))]
            if kind[0] == 0:
                out = links_within(sets, per_cent)
            else:
                g = Groups(sets, per_cent, [r[1] for r in pick])
                queries = {r[2] for r in rows if r[0] == 2}
                g.by_lists([k for k, x in enumerate(kind) if x == 1], [k for k, x in enumerate(ids) if x in queries])
                out = g.links
            out = np.array([(ids[a], ids[b]) for a, b in out], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        for b in batches:
            at = list(zip(*(b.column(x).to_pylist() for x in ("cluster", "i", "j")), strict=True))
            own = list(zip(*(b.column(x).to_pylist() for x in ("kind", "grp", "rep")), strict=True))
            for k, key in enumerate(at):
                if key != now:
                    if rows:
                        yield solve()
                    now, rows = key, []
                rows.append((*own[k], b.column("text")[k].as_py()))
        if rows:
            yield solve()

    by = ["cluster", "i", "j"]
    return asked.select(*by, "kind", "grp", "rep", "text").repartition(n, *by).sortWithinPartitions(*by, "kind", "rep").mapInArrow(run, "a long, b long")


def _every(n) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _large_clusters(big: DataFrame, links: DataFrame, words: int, per_cent: int, n: int) -> DataFrame:
    """(a, b): links within blocks and all others of clusters of several blocks; big has (cluster, blocks, rep, n, text)."""
    before = None
    while True:
        comp = graph.components(links).select(F.col("node").alias("_n"), "component")
        now = saved(big.select("cluster", "blocks", "rep", "n").join(comp, F.col("rep") == F.col("_n"), "left").select("cluster", "blocks", "rep", "n", F.coalesce("component", "rep").alias("grp")))
        groups = saved(now.groupBy("cluster", "grp").agg(F.count("*").alias("docs"), F.sum("n").alias("size"), F.max(F.when(F.col("rep") == F.col("grp"), F.col("n"))).alias("own")))
        per = groups.groupBy("cluster").agg(F.count("*").alias("groups"), F.sum("own").alias("own"), F.max_by("grp", F.struct("docs", "grp")).alias("largest"), F.sum("docs").alias("docs"), F.sum("size").alias("size"), F.max("docs").alias("most"))
        open_ = saved(per.where("groups > 1"))
        count = open_.agg(F.coalesce(F.sum("groups"), F.lit(0))).first()[0]
        few = open_.count()
        if not count:
            return links
        if before is not None and 10 * count > 9 * before:
            break
        before = count
        # the group's least key is its representative
        reps = graph.spread(groups.select("cluster", F.col("grp").alias("r")), open_.select(F.col("cluster").alias("_c"), _blocks("groups", "own").alias("b")), "cluster", "_c", "inner", few)
        asked = big.select("rep", "text").join(reps.select(F.col("r").alias("rep"), "cluster", F.pmod(F.xxhash64("r", F.lit(count)), F.col("b")).cast("int").alias("i")), "rep")
        links = saved(links.union(_search(asked.select("cluster", "i", F.lit(0).alias("j"), F.lit(0).alias("kind"), F.col("rep").alias("grp"), "rep", "text"), words, per_cent, n)))
    rest = graph.spread(now, open_.select(F.col("cluster").alias("_c"), "largest", _blocks("docs", "size").alias("b"), _blocks(F.col("docs") - F.col("most"), F.col("size") * (1 - F.col("most") / F.col("docs"))).alias("q")), "cluster", "_c", "inner", few)
    deal = lambda most: F.pmod(F.xxhash64("rep"), most).cast("int")
    index = rest.select("cluster", deal(F.col("b")).alias("i"), _every(F.col("q")).alias("j"), F.lit(1).alias("kind"), "grp", "rep")
    queries = rest.where("grp <> largest").select("cluster", _every(F.col("b")).alias("i"), deal(F.col("q")).alias("j"), F.lit(2).alias("kind"), "grp", "rep")
    asked = index.union(queries).join(big.select("rep", "text"), "rep")
    return links.union(_search(asked, words, per_cent, n))


def _blocks(docs, size) -> Column:
    of = lambda x, most: F.ceil((F.col(x) if isinstance(x, str) else x) / most)
    return F.greatest(F.lit(1), of(docs, BLOCK_DOCS), of(size, BLOCK_SHINGLES)).cast("int")


def join(df: DataFrame, words: int = 3, per_cent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; two documents link when 100 * intersection >= per_cent * union."""
    integer(df, key)
    n = parts(df)
    sets = saved(sets_of(df, words, key, text))
    classes = saved(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies")))
    clusters = graph.components(_candidates(df, words, per_cent, key, text))
    member = saved(classes.where("rep IS NOT NULL").join(clusters.hint("merge"), classes["s1"] == clusters["node"]).select("rep", "n", F.col("component").alias("cluster")))
    large = saved(member.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1"))
    several = large.count()
    member = saved(graph.spread(member, large.withColumnRenamed("cluster", "_c"), "cluster", "_c", rows=several).select("rep", "n", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks")))
    texts = df.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("text"))
    asked = split_by(texts, "rep", member.select("rep"))[0].join(member.hint("merge"), "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    links = saved(_search(asked.select("cluster", block.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("kind"), F.col("rep").alias("grp"), "rep", "text"), words, per_cent, n))
    if several:
        links = _large_clusters(saved(asked.where("blocks > 1")), links, words, per_cent, n)
    comp = saved(graph.components(links))
    known = classes.join(comp.hint("merge"), classes["rep"] == comp["node"], "left").where("copies > 1 OR component IS NOT NULL")
    known = known.select(F.struct("s1", "s2").alias("_h"), F.coalesce("component", "rep").alias("component"))
    rows = sets.select("id", "n", F.when(F.col("n") > 0, F.struct("s1", "s2")).alias("h"))
    return graph.spread(rows, known, "h", "_h").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
