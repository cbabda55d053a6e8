"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are first taken together, so a vector that fills a third of the table is indexed once.  Distinct vectors are
dealt to shards by a hash, and the number of shards follows the bytes of the vectors alone.  One task builds a shard's graph, and
the graphs are written once; then every shard is queried for every vector, the queries of a shard split over tasks of which each
reads the graph.  Beams of many queries run side by side in numpy.

Audits.  With its graph a shard gets a beam width: PROBES of its own vectors, picked by a seed, are turned by angles up to the
threshold's, and the beam is doubled until the graph finds RECALL of all links that a full scan finds for these probes.  Each
probe has a link at least, so no audit is empty, and its cost is in proportion to the shard.

A beam of a query that is half full of links is widened on the graph; where even WIDEST places fill with links, the query is in a
group of hundreds, and its links in the shard are counted exactly by products of tiles.  All links are verified by cosine in double
precision, after scaling by the largest component, so no norm overflows or vanishes.

A shard answers with a number of links for each query, one edge from the query to a linked vector, and a spanning forest of
the vectors that its queries have joined, so what it emits does not grow with the square of a group.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component, as are rows with a null id; vectors of different lengths do not link; repeated ids are taken as one vector each row; an
empty table gives an empty table; extra columns are never read; ids that are no integers raise TypeError.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import dealt, integer, saved

#: Bytes of double-precision vectors in a shard, shards at least, and queries that one task puts to a shard.
SHARD_BYTES, SHARDS_LEAST, ASK_ROWS = 192 << 20, 4, 50_000
BLOCK, PROBES, RECALL, WIDEST = 512, 256, 0.99, 256
#: Places of the table of what a query has seen; a node that is displaced there is looked at again, if met again.
SEEN = 1 << 14
CHUNK = 16 << 20
M = 12


class Layer:
    """A graph of some of the vectors: rows of neighbours, -1 where there are fewer."""

    def __init__(self, width: int):
        self.width, self.members = width, np.zeros(0, np.int64)
        self.near = np.zeros((0, width), np.int32)
        self.place = np.zeros(0, np.int64)

    def add(self, members: np.ndarray, total: int) -> np.ndarray:
        at = len(self.members) + np.arange(len(members))
        self.members = np.concatenate((self.members, members))
        self.near = np.concatenate((self.near, np.full((len(members), self.width), -1, np.int32)))
        if len(self.place) < total:
            self.place = np.concatenate((self.place, np.full(total - len(self.place), -1)))
        self.place[members] = at
        return at


def _search(x: np.ndarray, layer: Layer, q: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ef best found places in a layer for each query, best first, and their similarities; -1 where there are fewer."""
    n, rows = len(layer.members), np.arange(len(q))[:, None]
    slots = min(SEEN, 1 << n.bit_length())
    seen = np.full((len(q), slots), n, np.int32)
    ids = np.full((len(q), ef), n, np.int64)
    sim = np.full((len(q), ef), -np.inf, np.float32)
    k = min(entry.shape[1], ef)
    first = np.where(entry[:, :k] < 0, n, entry[:, :k])
    members = np.append(layer.members, 0)
    ids[:, :k] = first
    sim[:, :k] = np.where(first < n, np.einsum("qkd,qd->qk", x[members[first]], q), -np.inf)
    seen[rows, first & slots - 1] = first
    done = sim == -np.inf
    live = np.arange(len(q))
    while len(live):
        s = np.where(done[live], -np.inf, sim[live])
        w = min(width, ef)
        pick = np.argpartition(-s, w - 1, axis=1)[:, :w]
        good = np.take_along_axis(s, pick, 1) > -np.inf
        go = good.any(axis=1)
        live, pick, good = live[go], pick[go], good[go]
        if not len(live):
            break
        d = done[live]
        np.put_along_axis(d, pick, True, 1)
        done[live] = d
        to = layer.near[np.where(good, ids[live[:, None], pick], 0) % max(n, 1)]
        to = np.where(good[:, :, None] & (to >= 0), to, n).reshape(len(live), -1)
        to.sort(axis=1)
        to[:, 1:][to[:, 1:] == to[:, :-1]] = n
        to[seen[live[:, None], to & slots - 1] == to] = n
        if n >= slots:  # what the table has lost may still be in the beam
            to[(to[:, :, None] == ids[live][:, None, :]).any(axis=2)] = n
        cols = (to < n).sum(axis=1).max()
        if cols == 0:
            continue
        to = np.sort(to, axis=1)[:, :cols]
        at, place = np.nonzero(to < n)
        seen[live[at], to[at, place] & slots - 1] = to[at, place]
        new = np.where(to < n, np.einsum("qkd,qd->qk", x[members[to]], q[live]), -np.inf).astype(np.float32)
        all_sim, all_ids = np.concatenate((sim[live], new), axis=1), np.concatenate((ids[live], to), axis=1)
        all_done = np.concatenate((done[live], new == -np.inf), axis=1)
        keep = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        sim[live], ids[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (all_sim, all_ids, all_done))
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(sim > -np.inf, ids, -1), sim


def _choose(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (best first, -1 for none) those that are nearer to the node than to any chosen before; then the best others."""
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    between = np.einsum("nad,nbd->nab", v, v)
    kept, count = np.zeros((n, c), bool), np.zeros(n, np.int64)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (count < most) & ~(kept & (between[:, j, :] > sim[:, j, None])).any(axis=1)
        kept[:, j] = ok
        count += ok
    rank = np.where(cand < 0, 3 * c, np.where(kept, 0, c)) + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(cand, order, 1)


class Index:
    def __init__(self, vectors: np.ndarray, seed: int = 7, build: int = 32):
        self.x, self.build = vectors.astype(np.float32), build
        n = len(vectors)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 6)
        self.layers: list[Layer] = [Layer(2 * M)] + [Layer(M) for _ in range(int(level.max(initial=0)))]
        at = 0
        while at < n:
            size = min(n - at, 256, max(16, at))
            self._insert(np.arange(at, at + size), level[at : at + size])
            at += size

    @classmethod
    def of(cls, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """An index of which the layers' members and neighbours are known."""
        out = object.__new__(cls)
        out.x, out.layers = vectors.astype(np.float32), []
        for members, near in layers:
            layer = Layer(near.shape[1])
            layer.members, layer.near = members, near
            layer.place = np.full(len(vectors), -1)
            layer.place[members] = np.arange(len(members))
            out.layers.append(layer)
        return out

    def _insert(self, members: np.ndarray, level: np.ndarray) -> None:
        x, q = self.x, self.x[members]
        entry = np.full((len(members), 1), -1)
        for n in range(len(self.layers) - 1, -1, -1):
            layer, into = self.layers[n], level >= n
            old = len(layer.members)
            found, sim = np.full((len(members), 0), -1), np.zeros((len(members), 0), np.float32)
            if old:
                entry = np.where((entry < 0).all(axis=1, keepdims=True), 0, entry)
                found, sim = _search(x, layer, q, entry, min(self.build, old) if into.any() or n == 0 else 4)
            glob = np.where(found >= 0, layer.members[np.maximum(found, 0)] if old else -1, -1)
            if into.any():
                new = members[into]
                inner = x[new] @ x[new].T
                np.fill_diagonal(inner, -np.inf)
                k = min(self.build, len(new))
                best = np.argsort(-inner, axis=1, kind="stable")[:, :k]
                c = np.concatenate((glob[into], np.where(np.take_along_axis(inner, best, 1) > -np.inf, new[best], -1)), axis=1)
                s = np.concatenate((sim[into], np.take_along_axis(inner, best, 1)), axis=1)
                order = np.argsort(-np.where(c < 0, -np.inf, s), axis=1, kind="stable")[:, : 2 * self.build]
                c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
                chosen = _choose(x, c, s, M)
                at = layer.add(new, len(x))
                layer.near[at, : chosen.shape[1]] = np.where(chosen >= 0, layer.place[np.maximum(chosen, 0)], -1)
                self._back(layer, at, layer.near[at])
            if n and len(glob):
                below = self.layers[n - 1]
                entry = np.where(glob[:, :4] >= 0, below.place[np.maximum(glob[:, :4], 0)], -1) if len(below.place) and glob.shape[1] else np.full((len(members), 1), -1)

    def _back(self, layer: Layer, at: np.ndarray, near: np.ndarray) -> None:
        """Edges back to the new nodes; a full row keeps a diverse choice of the old and new ones."""
        source, target = np.repeat(at, near.shape[1]), near.ravel().astype(np.int64)
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(target):
            return
        sim = np.einsum("nd,nd->n", self.x[layer.members[source]], self.x[layer.members[target]])
        order = np.lexsort((-sim, target))
        source, target = source[order], target[order]
        t, first, count = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, count)
        keep = nth < layer.width
        extra = np.full((len(t), layer.width), -1, np.int64)
        extra[np.repeat(np.arange(len(t)), count)[keep], nth[keep]] = source[keep]
        both = np.concatenate((layer.near[t].astype(np.int64), extra), axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        for i in range(0, len(t), 1024):
            c, own = both[i : i + 1024], t[i : i + 1024]
            s = np.where(c >= 0, np.einsum("nkd,nd->nk", self.x[layer.members[np.maximum(c, 0)]], self.x[layer.members[own]]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            g = np.where(c >= 0, layer.members[np.maximum(c, 0)], -1)
            chosen = _choose(self.x, g, s, layer.width)
            layer.near[own] = np.where(chosen >= 0, layer.place[np.maximum(chosen, 0)], -1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, similarities) of the ef best found for each query, best first; -1 where there are fewer."""
        entry = np.full((len(q), 1), -1)
        for n in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[n]
            if not len(layer.members):
                continue
            entry = np.where((entry < 0).all(axis=1, keepdims=True), 0, entry)
            found, sim = _search(self.x, layer, q, entry, min(ef if n == 0 else 4, len(layer.members)))
            glob = np.where(found >= 0, layer.members[np.maximum(found, 0)], -1)
            if n == 0:
                return glob, sim
            entry = np.where(glob >= 0, self.layers[n - 1].place[np.maximum(glob, 0)], -1)
        return np.full((len(q), 0), -1), np.zeros((len(q), 0), np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision, whatever the size of their components."""
    if not len(vectors):
        return vectors.astype(np.float64)
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Shard:
    """An index with ids, weights, the beam that its audit asks for, and what the links found so far have joined."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, threshold: float, ef: int):
        self.ids, self.weight, self.t, self.ef = ids, weight, threshold, ef
        self.unit = unit(vectors)
        self.index = Index(self.unit)
        self._ready()
        self.recall = self._audit()

    def _ready(self) -> None:
        self.root = np.arange(len(self.ids))
        self.low = np.float32(self.t - 1e-4)

    def dump(self) -> bytes:
        out = io.BytesIO()
        layers = {f"{k}{i}": v for i, a in enumerate(self.index.layers) for k, v in (("members", a.members), ("near", a.near))}
        np.savez(out, ids=self.ids, weight=self.weight, unit=self.unit, t=self.t, ef=self.ef, recall=self.recall, layers=len(self.index.layers), **layers)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        s, z = object.__new__(cls), np.load(io.BytesIO(data), allow_pickle=False)
        s.ids, s.weight, s.unit, s.t, s.ef, s.recall = z["ids"], z["weight"], z["unit"], float(z["t"]), int(z["ef"]), float(z["recall"])
        s.index = Index.of(s.unit, [(z[f"members{i}"], z[f"near{i}"]) for i in range(int(z["layers"]))])
        s._ready()
        return s

    def _scan(self, q: np.ndarray) -> list[np.ndarray]:
        """The links of each query by products of tiles."""
        n, out = max(1, len(self.ids)), []
        step = max(1, (1 << 22) // n)
        for i in range(0, len(q), step):
            out += [np.flatnonzero(r) for r in q[i : i + step].astype(np.float32) @ self.index.x.T >= self.low]
        return out

    def _audit(self) -> float:
        """Widens the beam until probes find their links; returns the recall."""
        n, d = self.unit.shape
        if not n:
            return 1.0
        rng = np.random.default_rng(20240611)
        u = self.unit[rng.integers(0, n, PROBES)]
        side = rng.normal(size=(PROBES, d))
        side -= (side * u).sum(axis=1, keepdims=True) * u
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        angle = np.arccos(min(1.0, max(-1.0, self.t + 1e-3))) * np.sqrt(rng.random((PROBES, 1)))
        probe = unit(np.cos(angle) * u + np.sin(angle) * side)
        truth = self._scan(probe)
        total = sum(map(len, truth))
        while True:
            found = sum(len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(self._linked(probe, self.ef), truth, strict=True))
            if found >= RECALL * total or self.ef >= n:
                return found / max(1, total)
            self.ef *= 2

    def _linked(self, q: np.ndarray, ef: int) -> list[np.ndarray]:
        found, sim = self.index.search(q.astype(np.float32), ef)
        near = sim >= self.low
        out = [np.sort(f[k]) for f, k in zip(found, near, strict=True)]
        full = np.flatnonzero(near.sum(axis=1) * 2 >= ef)
        if len(full):
            more = self._linked(q[full], 4 * ef) if 4 * ef <= WIDEST else self._scan(q[full])
            for i, got in zip(full.tolist(), more, strict=True):
                out[i] = got
        return out

    def roots(self, at: np.ndarray) -> np.ndarray:
        """The last root of each, which then hangs below it at once."""
        r = self.root[at]
        while (up := self.root[r]).tolist() != r.tolist():
            r = up
        self.root[at] = r
        return r

    def links(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query: the weight of the vectors it links with, and one of their ids (-1 for none)."""
        q = unit(q)
        total, one = np.zeros(len(q), np.int64), np.full(len(q), -1, np.int64)
        for i, near in enumerate(self._linked(q, self.ef)):
            if not len(near):
                continue
            near = near[(self.unit[near] @ q[i] >= self.t) & (self.ids[near] != ids[i])]
            if len(near):
                total[i], one[i] = self.weight[near].sum(), self.ids[near[0]]
                r = np.unique(self.roots(near))
                self.root[r[1:]] = r[0]
        return total, one


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, ef: int = 16) -> DataFrame:
    """(key, n_links, component_id, kept): one row for each row of df."""
    spark = df.sparkSession
    integer(df, key)
    v = F.col("v")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(fine, F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))))
    classes = saved(rows.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    shards = max(SHARDS_LEAST, -(-8 * size // SHARD_BYTES))
    asks = max(1, -(-n // ASK_ROWS), -(-2 * spark.sparkContext.defaultParallelism // shards))

    def grouped(batches):
        """(length, rows of kept columns, matrix) of the vectors of each length in each batch."""
        for b in batches:
            off = b.column("v").offsets.to_numpy()
            flat = b.column("v").values.to_numpy(zero_copy_only=False)
            rep, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n"))
            for d in np.unique(np.diff(off)).tolist():
                m = np.flatnonzero(np.diff(off) == d)
                yield d, rep[m], weight[m], flat[off[m][:, None] + np.arange(d)]

    def build(batches):
        from pyspark import TaskContext

        own: dict[int, list] = {}
        for d, *x in grouped(batches):
            own.setdefault(d, []).append(x)
        for d in sorted(own):
            data = Shard(*(np.concatenate(x) for x in zip(*own.pop(d), strict=True)), threshold, ef).dump()
            for seq, at in enumerate(range(0, len(data), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([d], pa.int32()), pa.array([seq], pa.int32()), pa.array([data[at : at + CHUNK]], pa.binary())], ["shard", "width", "seq", "data"])

    def run(batches):
        names = ["rep", "links", "a", "b"]
        parts: dict[int, list] = {}
        made: dict[int, Shard] = {}

        def asked():
            for b in batches:
                index = b.column("seq").to_numpy() >= 0
                for i in np.flatnonzero(index).tolist():
                    parts.setdefault(b.column("width")[i].as_py(), []).append(b.column("data")[i].as_py())
                yield b.filter(pa.array(~index))

        for d, rep, _, q in grouped(asked()):
            if d not in made and d in parts:
                made[d] = Shard.load(b"".join(parts.pop(d)))
            for i in range(0, len(rep) if d in made else 0, BLOCK):
                total, one = made[d].links(rep[i : i + BLOCK], q[i : i + BLOCK])
                some = np.flatnonzero(one >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(rep[i + some]), pa.array(total[some]), pa.array(rep[i + some]), pa.array(one[some])], names)
        for s in made.values():
            at = s.roots(np.arange(len(s.ids)))
            some = np.flatnonzero(at != np.arange(len(at)))
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(s.ids[some]), pa.array(s.ids[at[some]])], names)

    of = lambda *by, most: F.pmod(F.xxhash64(*by), F.lit(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    index = saved(dealt(classes.withColumn("shard", of("rep", most=shards)), shards, "shard").select("rep", "n", "v").mapInArrow(build, "shard int, width int, seq int, data binary"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    graphs = index.withColumn("ask", every(asks)).select((F.col("shard") * asks + F.col("ask")).alias("part"), "seq", "width", "data", none("long", "rep"), none("long", "n"), F.array().cast("array<double>").alias("v"))
    queries = classes.withColumn("ask", of(F.lit(7), "rep", most=asks)).withColumn("shard", every(shards))
    queries = queries.select((F.col("shard") * asks + F.col("ask")).alias("part"), F.lit(-1).alias("seq"), F.lit(0).alias("width"), none("binary", "data"), "rep", "n", "v")
    # what holds no query comes first: the chunks of the graph, in their order
    together = dealt(graphs.union(queries), shards * asks, "part").sortWithinPartitions(F.col("seq") < 0, "width", "seq")
    found = saved(together.select("seq", "width", "data", "rep", "n", "v").mapInArrow(run, "rep long, links long, a long, b long"))
    links = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    comp = graph.components(found.select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.select("h", "rep", "n").join(links, "rep", "left").join(comp, "rep", "left").where("n > 1 OR links IS NOT NULL OR component IS NOT NULL")
    known = saved(known.select(F.col("h").alias("_h"), "rep", "n", "links", "component"))
    out = graph.spread(rows.select("id", "h"), known, "h", "_h")
    comp_id = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(key), (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), comp_id.alias("component_id"), comp_id.eqNullSafe(F.col("id")).alias("kept"))
