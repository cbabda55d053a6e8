"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text.  A text is parsed greedily, across its words, into the longest phrases that
occur in that labelled text; the language that needs the fewest normalised phrases wins.  Normalised phrases are the number of
phrases for each byte of the text, times the logarithm of the labelled text's size (what it takes to name a place in it) over that
of the largest one.  Before, texts are put in lower case and everything between letters (with their marks) becomes one blank, in
labelled texts and others alike.

Many texts step through an automaton side by side; the last few, long ones go on one by one, with the same result.

Training reads a bounded sample: `train_docs` labelled texts a language at most, about, picked by a hash, with equal shares of
`train_bytes` a language.  Both are parameters of the fit, which is the only place where texts are cut.  More than `langs_most`
different labels raise ValueError, as automata for all go to every worker.

Cases: a null text or one without a letter is `und` with score 0; ties go to the language that sorts first; without any labelled
text all is `und`; repeated rows keep their own result; a null key is not held out and never trained on; an empty table gives an empty
table; extra columns are never read; a kept column that has one of the result's names raises ValueError.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cache, enter, free, wide

#: Texts step side by side while so many are left.
SIDE_BY_SIDE = 48


def letters(texts: pa.Array) -> pa.Array:
    """Lower-case letters and their marks, one blank for all between, before and behind; a text without a letter, or null, is empty."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{M}]+", " ")
    trimmed = pc.utf8_trim(low, " ")
    has = pc.match_substring_regex(trimmed, r"\p{L}")
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.if_else(has, pc.binary_join_element_wise(blank, trimmed, blank, none), none)


class Automaton:
    """Suffix automaton of a byte string; its transitions are one sorted array of state * 256 + byte."""

    def __init__(self, data: bytes):
        link, length, step = [-1], [0], [{}]
        last = 0
        for c in data:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        pairs = sorted((s << 8 | c, t) for s, d in enumerate(step) for c, t in d.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([t for _, t in pairs], np.int32)
        self.states, self.size = len(step), len(data)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each byte, state after each state and class); bytes that the text lacks are class 0, no step is 0."""
        found = np.unique(self.keys & 255)
        cls = np.zeros(256, np.uint8)  # at most 255 classes: UTF-8 has no byte 255
        cls[found] = np.arange(1, len(found) + 1)
        to = np.zeros((self.states, len(found) + 1), np.uint16 if self.states < 1 << 16 else np.int32)  # small, to stay in caches
        to[self.keys >> 8, cls[self.keys & 255]] = self.to
        return cls, to

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """How many phrases each packed text needs; a byte that the automaton's text lacks is a phrase of its own."""
        cls, to = self.table()
        width, flat, size = to.shape[1], to.ravel(), np.diff(off)
        order = np.argsort(-size, kind="stable")
        place, length, at = off[:-1][order], size[order], cls[buf]
        count, state = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        ends = length.tolist()
        j, m = 0, int((length > 0).sum())  # m texts are longer than j
        while m >= SIDE_BY_SIDE:
            old, pos, done = state[:m], place[:m], count[:m]
            c = at[pos].astype(np.int64)
            new = flat[old * width + c]
            miss = np.flatnonzero(new == 0)
            done[miss] += old[miss] > 0
            old[:] = new
            again = flat[c[miss]]
            old[miss] = again
            done[miss] += again == 0  # a byte of no phrase
            pos += 1
            j += 1
            while m and ends[m - 1] <= j:
                m -= 1
        step = memoryview(flat)
        for i in range(m):
            s, n, first, last = int(state[i]), 0, int(place[i]), int(place[i]) + ends[i] - j
            for part in range(first, last, 1 << 16):
                for c in at[part : min(part + (1 << 16), last)].tolist():
                    t = step[s * width + c]
                    if not t:
                        n += s > 0
                        t = step[c]
                        n += not t
                    s = t
            state[i] = s
            count[i] += n
        out = np.empty(len(size), np.int64)
        out[order] = count + (state > 0)
        return out


def held_out(key: str):
    """The column that marks rows kept from training: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.expr(f"crc32(CAST(CAST(`{key}` AS STRING) AS BINARY)) % 3 = 1"), F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = 60, train_bytes: int = 40_000, langs_most: int = 2000) -> dict[str, Automaton]:
    """Automata by language, from rows that are not held out."""
    rows = df.selectExpr(f"`{key}` AS key", f"`{text}` AS text", f"`{lang}` AS lang").where(F.col("key").isNotNull() & ~held_out("key") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(langs_most + 1).collect()}  # a row for each language
    if len(count) > langs_most:
        raise ValueError(f"more than {langs_most} languages")
    if not count:
        return {}
    share = F.create_map(*[x for k, n in sorted(count.items()) for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])
    picked = rows.withColumn("order", F.xxhash64("key")).where((F.col("order") / F.lit(2.0**64) + 0.5) < share[F.col("lang")])
    texts: dict[str, list] = {k: [] for k in count}
    # long texts are cut here, in the fitting sample alone
    for r in picked.select("lang", "order", "key", F.substring("text", 1, train_bytes).alias("text")).collect():
        texts[r["lang"]].append((r["order"], r["key"], r["text"]))
    out = {}
    for k, found in texts.items():
        own = letters(pa.array([t for _, _, t in sorted(found, key=lambda x: (x[0], str(x[1])))], pa.string())).to_pylist()
        data = b"".join(_shared([t.encode() for t in own if t], train_bytes))
        if data:
            out[k] = Automaton(data)
    return out


def _shared(texts: list[bytes], most: int) -> list[bytes]:
    """The texts within `most` bytes: each has an equal share, and what short ones leave over goes to the longer ones, which are cut."""
    share = 0
    for done, size in enumerate(sorted(map(len, texts))):
        share = most // (len(texts) - done)
        if size > share:
            break
        most, share = most - size, size
    return [t if len(t) <= share else t[:share].decode(errors="ignore").encode() for t in texts]


class Model:
    def __init__(self, automata: dict[str, Automaton]):
        self.langs = sorted(automata)
        self.automata = [automata[k] for k in self.langs]
        size = np.array([max(2, a.size) for a in self.automata] or [2])
        self.weight = np.log(size) / np.log(size.max())

    def rates(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases for each byte of letters, by text and language; and the bytes of letters with their blanks."""
        buf, off = vec.packed(letters(texts))
        size = np.diff(off)
        rate = np.zeros((len(size), len(self.langs)))
        for j, a in enumerate(self.automata):
            rate[:, j] = a.phrases(buf, off) * self.weight[j]
        return rate / np.maximum(size, 1)[:, None], size

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (how far the best rate lies below the second, as a share of it) and best rate of each text."""
        rate, size = self.rates(texts)
        n, letter = len(rate), size > 0
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.full(n, np.inf)
        best = rate.argmin(axis=1)
        least = rate[np.arange(n), best]
        rest = rate.copy()
        rest[np.arange(n), best] = np.inf
        second = rest.min(axis=1) if len(self.langs) > 1 else np.ones(n)
        score = np.where(letter & (second > 0), 1 - least / np.maximum(second, 1e-9), 0).clip(0, 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], score, np.where(letter, least, np.inf)


_models: dict[int, Model] = cache("langid", {})


def _model(token: int, shared) -> Model:
    """One a worker process, the latest."""
    if token not in _models:
        _models.clear()
        _models[token] = Model(shared.value)
    return _models[token]


def identify(df: DataFrame, automata: dict[str, Automaton], keep: list[str], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rate")) -> DataFrame:
    """The columns `keep` with language, score and rate (normalised phrases for each byte of letters) of every whole text."""
    if clash := {k.lower() for k in keep} & {k.lower() for k in names}:
        raise ValueError(f"columns {sorted(clash)} are kept and made; give other names")
    shared = df.sparkSession.sparkContext.broadcast(automata)  # at most some 40 bytes for each byte of training text, langs_most languages
    token = zlib.crc32(repr(sorted((k, len(a.keys), int(a.keys.sum())) for k, a in automata.items())).encode())
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]

    def run(batches):
        enter("langid")
        model = _model(token, shared)
        for b in batches:
            for i, n in vec.slices(b, len(keep), 4 << 20):
                part = b.slice(i, n)
                lang, score, rate = model.predict(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], [*keep, *names])

    return wide(df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias(free(df, "text")))).mapInArrow(run, ", ".join([*kinds, f"{names[0]} string, {names[1]} double, {names[2]} double"]))
