"""Personal data: base patterns, and terms that would reveal what the patterns protect.

Values found by the base patterns (email, ip, card, phone) are the protected entities.  Corpus co-occurrence estimates how
strongly a term reveals an entity: with n documents in all, n_c with the entity, n_t with the term and n_ct with both,
PMI = log2(n_ct * n / (n_c * n_t)) is held against the entity's own information IC = log2(n / n_c).  A term with
PMI >= ALPHA * IC, seen with the entity in MIN_DOCS documents or more, discloses it; in documents with that entity all its
occurrences outside base spans are sanitised: removed where PMI >= IC (the term never occurs without the entity), else
generalised to `[TERM]`, for a corpus has no taxonomy of its words.  All counts cover whole documents, base spans too; documents
without an entity are left alone.  An entity of fewer than MIN_DOCS documents can't have such terms, so its documents' words are not
paired with it.

A term is a run of ASCII letters and characters beyond ASCII, of any length, in lower case.  A document is a row, whatever
its key: rows of one key, or of none, each count and are each sanitised by their own entities.

Texts are matched once; the table of what was found is written, and the counts and results are made from it.

Cases: a null or empty text has no spans (and stays null where texts are returned); texts of any length are read whole, in
linear time; overlapping spans are merged when texts are rewritten; an empty table gives an empty table; extra columns pass through
`sanitise`, whatever their names, and are never read by `detect`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, vec
from .common import dealt, enter, free, parts, saved, wide

ALPHA, MIN_DOCS = 0.9, 2
KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")
_WORD = vec.lut(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_FOLD = {c: c + 32 for c in range(65, 91)}


def _luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind as listed, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            s = at
            while s > free and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append(("email", s, m.end()))
                free = m.end()
        else:
            free = max(free, at + 1)  # what lies before an @ is never part of a later local part
        at = text.find("@", max(at + 1, free))
    if "." in text:
        for run in _DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                for m in _IP.finditer(run[0]):
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                        out.append(("ip", run.start() + m.start(), run.start() + m.end()))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _hash(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return vec.Segments(buf, end - [len(w) for w in words], end).hashes.view(np.int64) if words else np.zeros(0, np.int64)


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case, one character for one, so that words start and end where they did."""
    return pc.utf8_lower(texts.cast(pa.large_string()))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, one text after the other; and their rows."""
    buf, off = vec.packed(_lower(texts))
    s, e = vec.runs(_WORD[buf], off)
    keep = _WORD[buf[s]] if len(s) else np.zeros(0, bool)
    s, e = s[keep], e[keep]
    h, row = vec.Segments(buf, s, e).hashes, vec.rows_of(s, off)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


class _Names:
    """Names of columns that a table does not have."""

    def __init__(self, df: DataFrame):
        self.row, self.spans, self.own, self.terms, self.all = (free(df, x) for x in ("row", "spans", "own", "terms", "all"))


def _scan(df: DataFrame, text: str, names: _Names, plain: bool) -> DataFrame:
    """Every row with a number, its base spans, and the hashes of its entities; without `plain`, texts of no span become null."""
    keep = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        enter("pii")
        for b in batches:
            spans, own, some = [], [], []
            for t in b.column(keep.index(text)).to_pylist():
                s = base_spans(t) if t else []
                some.append(bool(s))
                spans.append([f"{k}:{x}:{y}" for k, x, y in s])
                own.append(np.unique(_hash([f"{k}:{t[x:y]}".translate(_FOLD).encode() for k, x, y in s])) if s else ())
            cols = list(b.columns)
            if not plain:
                i = keep.index(text)
                cols[i] = pc.if_else(pa.array(some, pa.bool_()), cols[i], pa.scalar(None, cols[i].type))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.list_(pa.string())), pa.array(own, pa.list_(pa.int64()))], [*keep, names.spans, names.own])

    found = wide(df).mapInArrow(run, f"{schema}, {names.spans} array<string>, {names.own} array<long>")
    return saved(found.withColumn(names.row, F.monotonically_increasing_id()))


def _document_counts(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(t, n_t): in how many rows each wanted term occurs.  All terms are counted: each task sums its own, packed by hash range."""
    n = parts(df)

    def count(batches):
        enter("pii")
        known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def pack():
            to = (known >> np.uint64(48)).astype(np.int64) * n >> 16
            cut = np.searchsorted(to, np.arange(n + 1)).tolist()
            some = [p for p in range(n) if cut[p + 1] > cut[p]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([known[cut[p] : cut[p + 1]].tobytes() + total[cut[p] : cut[p + 1]].astype("<u4").tobytes() for p in some], pa.binary()), pa.nulls(len(some), pa.int64())], ["part", "block", "t"])

        for b in batches:
            for i, m in vec.slices(b, "text"):
                h, c = np.unique(_words(b.slice(i, m).column("text"))[0], return_counts=True)
                both, back = np.unique(np.concatenate((known, h)), return_inverse=True)
                total = np.bincount(back, np.concatenate((total, c)), len(both)).astype(np.int64)
                known = both
                if len(known) > 1_000_000:
                    yield pack()
                    known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(known):
            yield pack()

    def add(batches):
        enter("pii")
        keys, counts, want = [], [], []
        for b in batches:
            t = b.column("t")
            want.append(t.drop_null().to_numpy(zero_copy_only=False))
            for block in b.column("block").drop_null():
                raw = block.as_buffer()
                m = len(raw) // 12
                keys.append(np.frombuffer(raw, np.int64, m))
                counts.append(np.frombuffer(raw, "<u4", m, 8 * m))
        want = np.unique(np.concatenate(want)) if want else np.zeros(0, np.int64)
        total = np.zeros(len(want), np.int64)
        for k, c in zip(keys if len(want) else [], counts, strict=False):
            at = np.minimum(np.searchsorted(want, k), len(want) - 1)
            hit = want[at] == k
            total += np.bincount(at[hit], c[hit], len(want)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(want), pa.array(total)], ["t", "n_t"])

    blocks = wide(df.select(F.col(f"`{text}`").alias("text"))).mapInArrow(count, "part int, block binary, t long")
    top = F.shiftrightunsigned("t", 48)
    asked = wanted.select((F.shiftright(top * n, 16)).cast("int").alias("part"), F.lit(None).cast("binary").alias("block"), "t")
    return dealt(blocks.union(asked), n, "part").mapInArrow(add, "t long, n_t long")


def _disclosing(df: DataFrame, hits: DataFrame, text: str, names: _Names, alpha: float, min_docs: int) -> DataFrame:
    """(_row, _terms array<struct<t, gone>>): for each row with entities the terms that disclose one of them."""
    own = hits.select(F.col(names.row).alias("k"), F.explode(names.own).alias("e"))
    n = df.count()
    # entities of the same rows have the same terms, so they are counted as one: a list of addresses that is copied is one entity
    rows_of = [F.bit_xor(F.xxhash64(F.lit(seed), "k")).alias(f"s{seed}") for seed in (1, 2)]
    alike = saved(own.groupBy("e").agg(F.count("*").alias("n_c"), *rows_of).where(F.col("n_c") >= min_docs).select(F.col("e").alias("_e"), F.xxhash64("s1", "s2").alias("c"), "n_c"))
    n_c = alike.select(F.col("c").alias("e"), "n_c").distinct()
    often = graph.spread(own, alike.select("_e", "c"), "e", "_e", "inner", alike.count()).groupBy("k").agg(F.collect_set("c").alias("es"))

    def run(batches):
        enter("pii")
        for b in batches:
            for i, m in vec.slices(b, "text"):
                part = b.slice(i, m)
                t, row = _words(part.column("text"))
                at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=m))))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("es"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(t.view(np.int64)))], ["k", "es", "ts"])

    texts = hits.select(F.col(names.row).alias("_k"), F.col(f"`{text}`").alias("text"))
    whole = texts.join(often, F.col("_k") == F.col("k")).select("k", "es", "text").mapInArrow(run, "k long, es array<long>, ts array<long>")
    each = saved(whole.select("k", F.explode("es").alias("e"), "ts").select("k", "e", F.explode("ts").alias("t")))
    n_ct = each.groupBy("e", "t").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= min_docs)
    pairs = saved(n_ct.join(n_c, "e"))
    n_t = _document_counts(df, text, pairs.select("t").distinct())
    pmi = F.log2(F.col("n_ct") * F.lit(float(n)) / (F.col("n_c") * F.greatest("n_t", "n_ct")))
    ic = F.log2(F.lit(float(n)) / F.col("n_c"))
    found = pairs.join(n_t, "t").withColumn("pmi", pmi).withColumn("ic", ic).where((F.col("ic") > 0) & (F.col("pmi") >= alpha * F.col("ic")))
    found = saved(found.select(F.struct("e", "t").alias("_et"), (F.col("pmi") >= F.col("ic")).alias("gone")))
    met = graph.spread(each.select("k", F.struct("e", "t").alias("et"), "t"), found, "et", "_et", "inner", found.count())
    return met.groupBy("k", "t").agg(F.max("gone").alias("gone")).groupBy(F.col("k").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("t", "gone"))).alias("_terms"))


def _with_terms(df: DataFrame, text: str, names: _Names, plain: bool, alpha: float, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(rows with base spans, and all their spans as kind:start:end, by kind and start; rows without)."""
    found = _scan(df, text, names, plain)
    hits = found.where(F.size(names.spans) > 0)
    terms = _disclosing(df, hits, text, names, alpha, min_docs)
    keep = df.columns
    rows = hits.join(terms, F.col(names.row) == F.col("_row"), "left").select(*[F.col(f"`{c}`") for c in keep], names.spans, F.col("_terms").alias(names.terms))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        enter("pii")
        for b in batches:
            out = []
            for t, spans, terms in zip(b.column(keep.index(text)).to_pylist(), b.column(names.spans).to_pylist(), b.column(names.terms).to_pylist(), strict=True):
                extra = []
                if terms:
                    gone = {x["t"]: x["gone"] for x in terms}
                    taken = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans)
                    words = list(_TERM.finditer(t))
                    starts = np.array([a for a, _ in taken])
                    reach = np.maximum.accumulate([e for _, e in taken])
                    for m, h in zip(words, _hash([w.encode() for w in _lower(pa.array([m[0] for m in words], pa.string())).to_pylist()]).tolist(), strict=True):
                        if h in gone:
                            i = int(np.searchsorted(starts, m.end())) - 1
                            if i < 0 or reach[i] <= m.start():
                                extra.append(("removed" if gone[h] else "term", m.start(), m.end()))
                out.append(spans + [f"{k}:{s}:{e}" for k, s, e in sorted(extra)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], b.column(names.spans), pa.array(out, pa.list_(pa.string()))], [*keep, names.spans, names.all])

    return rows.mapInArrow(run, f"{schema}, {names.spans} array<string>, {names.all} array<string>"), found.where(F.size(names.spans) == 0).select(*[F.col(f"`{c}`") for c in keep])


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of every row."""
    own = df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    names = _Names(own)
    found, rest = _with_terms(own, text, names, False, alpha, min_docs)
    base, all_ = F.col(names.spans), F.col(names.all)
    of = lambda k: F.size(F.filter(base, lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    hit = found.select(F.col(f"`{key}`"), *(of(k) for k in KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(all_, ",").alias("spans"), (F.size(all_) - F.size(base)).cast("long").alias("n_terms"))
    none = hashlib.sha256(b"").hexdigest()
    rest = rest.select(F.col(f"`{key}`"), *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS), F.lit(none).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_terms"))
    return hit.union(rest)


def rewrite(text: str, spans: list[str]) -> str:
    """The text with each span replaced by its kind's mark, and removed terms gone; overlapping spans become one."""
    parsed = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans))
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in parsed:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], MARKS[k]]
        at = e
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, text: str = "text", alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with sanitised texts; rows without an entity are unchanged."""
    keep, names = df.columns, _Names(df)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        enter("pii")
        for b in batches:
            i = keep.index(text)
            new = [rewrite(t, s) for t, s in zip(b.column(i).to_pylist(), b.column(names.all).to_pylist(), strict=True)]
            cols = list(b.columns[: len(keep)])
            cols[i] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, keep)

    found, rest = _with_terms(df, text, names, True, alpha, min_docs)
    return found.select(*[F.col(f"`{c}`") for c in keep], names.all).mapInArrow(run, schema).union(rest)
