"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are counted by numpy on packed bytes, many documents at a time.  Trees are grown level by level from histograms of
at most 64 bins a feature under logistic loss, then flattened into arrays of equal depth, so that scoring is a fixed number
of vectorised steps for each tree.

Training reads at most about FIT_ROWS labelled rows (a hashed share of them where there are more), all outside the held-out
third.  Labels, language, source and key are never features.

Cases: a null or empty text has the statistics of an empty text and a score as any other; repeated rows score alike; without
labels, or with one label alone, every score is the share of label 1 (0.5 without labels); null labels are left out;
several labels of one key all count;
a null key is scored, not held out, and has no labels; an empty table gives an empty
table; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import enter, saved, wide

FIT_ROWS = 20_000
_UPPER, _LOWER, _DIGIT, _SPACE = vec.lut(bytes(range(65, 91))), vec.lut(bytes(range(97, 123))), vec.lut(b"0123456789"), vec.lut(b" \t\n\r\x0b\x0c")
_MARKS = b"!#$%&*()+,-./:;<=>?@[]_{|}~\"'\\^`"
NAMES = ["log_bytes", "upper", "lower", "digit", "space", "newline", "high", "marks", *(f"mark_{m}" for m in _MARKS), "entropy", "log_words", "word_mean", "word_var", "word_longest", "words_upper", "words_title", "words_digit", "words_marked_end", "distinct_words", "repeat_next", "most_word", "log_lines", "distinct_lines", "line_mean", "line_longest", "short_lines", "distinct_pairs"]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(r[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of len(NAMES) statistics for each text."""
    buf, off = vec.packed(texts)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    at_least = np.maximum(size, 1)
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256).astype(float)
    share = counts / at_least[:, None]
    of = lambda t: share[:, t].sum(axis=1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    def segments(white):
        s, e = vec.runs(white[buf], off)
        keep = ~white[buf[s]] if len(s) else np.zeros(0, bool)
        s, e = s[keep], e[keep]
        return s, e, vec.rows_of(s, off), vec.Segments(buf, s, e).hashes

    s, e, r, h = segments(_SPACE)
    words = np.bincount(r, minlength=n).astype(float)
    w = np.maximum(words, 1)
    length = (e - s).astype(float)
    mean = np.bincount(r, length, n) / w
    var = np.bincount(r, length * length, n) / w - mean * mean
    longest = np.zeros(n)
    np.maximum.at(longest, r, length)
    up = np.concatenate(([0], np.cumsum(_UPPER[buf])))
    low = np.concatenate(([0], np.cumsum(_LOWER[buf])))
    dig = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
    per = lambda m, b=None: np.bincount(r, m, n) / w
    caps = (up[e] - up[s] > 1) & (low[e] - low[s] == 0)
    title = _UPPER[buf[s]] & (low[e] - low[s] > 0) if len(s) else np.zeros(0)
    marked = (buf[e - 1] < 128) & ~(_UPPER | _LOWER | _DIGIT)[buf[e - 1]] if len(s) else np.zeros(0)
    distinct, most = _distinct(r, h, n)
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    repeat = np.bincount(r[1:], same, n) / w if len(r) else np.zeros(n)
    inner = r[1:] == r[:-1]
    pairs, _ = _distinct(r[1:][inner], vec.mix(h[:-1] * np.uint64(3) + h[1:])[inner], n)
    ls, le, lr, lh = segments(vec.lut(b"\n"))
    lines = np.bincount(lr, minlength=n).astype(float)
    ll = np.maximum(lines, 1)
    line_longest = np.zeros(n)
    np.maximum.at(line_longest, lr, (le - ls).astype(float))
    dlines, _ = _distinct(lr, lh, n)
    marks = np.array(list(_MARKS))
    cols = [np.log1p(size), of(_UPPER), of(_LOWER), of(_DIGIT), of(_SPACE), share[:, 10], share[:, 128:].sum(axis=1), share[:, marks].sum(axis=1), *share[:, marks].T, entropy, np.log1p(words), mean, var, longest, per(caps), per(title), per(dig[e] - dig[s] > 0), per(marked), distinct / w, repeat, most / w, np.log1p(lines), dlines / ll, np.bincount(lr, le - ls, n) / ll, line_longest, np.bincount(lr, (le - ls) < 20, n) / ll, pairs / np.maximum(words - 1, 1)]
    return np.stack(cols, axis=1).astype(np.float32)


class Boosted:
    """Gradient-boosted trees, flattened: for each tree a complete binary tree of features, thresholds and leaf values."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        p = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if n else 0.5
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, f), int)
        inner = 2**self.depth - 1
        self.feature, self.cut, self.leaf = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf), np.zeros((self.trees, inner + 1))
        if n == 0 or y.min() == y.max():
            return self
        out, slot = np.full(n, self.base), binned + np.arange(f) * self.bins
        for t in range(self.trees):
            prob = 1 / (1 + np.exp(-out))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            for d in range(self.depth):
                k, first = 2**d, 2**d - 1
                key = (node[:, None] * (f * self.bins) + slot).ravel()
                hist = [np.bincount(key, np.repeat(v, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(axis=2) for v in (g, h)]
                gl, hl = hist
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                for j, c in enumerate(cuts):
                    gain[:, j, len(c) :] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                ok = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
                feat, b = best // self.bins, best % self.bins
                for i in np.flatnonzero(ok).tolist():
                    self.feature[t, first + i], self.cut[t, first + i] = feat[i], cuts[feat[i]][b[i]]
                b = np.where(ok, b, self.bins)
                node = node * 2 + (binned[np.arange(n), np.where(ok, feat, 0)[node]] > b[node])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.leaf[t] = -self.rate * gs / (hs + self.ridge)
            out += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<float>) of every whole text."""

    def run(batches):
        enter("quality")
        for b in batches:
            for i, n in vec.slices(b, "text", 1 << 20):
                part = b.slice(i, n)
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["key", "stats"])

    kind = df.schema[key].dataType.simpleString()
    return wide(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text")).mapInArrow(run, f"key {kind}, stats array<float>").withColumnRenamed("key", key)


def held_out(key: str):
    return F.coalesce(F.expr(f"crc32(CAST(CAST(`{key}` AS STRING) AS BINARY)) % 3 = 1"), F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> Boosted:
    usable = labels.select(key, F.col(f"`{label}`").cast("double").alias("y")).where(~held_out(key) & F.col("y").isNotNull())
    n = usable.count()
    if n > rows:
        usable = usable.where((F.xxhash64(key) / F.lit(2.0**64) + 0.5) < rows / n)
    got = stats.select(key, "stats").join(usable, key).select(F.col(key).cast("string").alias("k"), "stats", "y").toPandas().sort_values(["k", "y"])
    x = np.array(got["stats"].tolist(), np.float32).reshape(len(got), len(NAMES))
    return Boosted().fit(x, got["y"].to_numpy(float))


def score(stats: DataFrame, model: Boosted, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted)."""

    def run(batches):
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["key", "score", "predicted"])

    kind = stats.schema[key].dataType.simpleString()
    return stats.selectExpr(f"`{key}` AS key", "stats").mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Statistics are counted once and kept in the shared folder; fitting and scoring read them there."""
    stats = saved(features(docs, key, text))
    return score(stats, fit(stats, labels, key, label), key)
