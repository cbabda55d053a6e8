"""Operators against brute force, exact round trips, and the cases that their docstrings define."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from spanisle.llm import bpe, graph, hnsw, jaccard, langid, mixing, mpegts, pii, quality, queries, suffixdedup, tokenfile, vec

LONG = "Lorem ipsum dolor sit amet, consectetur " * 3000
TEXTS = ["", None, "a", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "é à 日本語 😀　x y", " \n\t  ", LONG, "mail a@b.co now", "x" * 70000, "tail  "]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null key, and columns whose names operators use inside."""
    rows = [(i, t, "en", "src1", len(t or ""), i, "x", 1.0) for i, t in enumerate(TEXTS + TEXTS[3:8])] + [(3, TEXTS[3], None, None, 1, 1, None, None), (None, "no key at all here", "en", "src2", 1, 1, "k", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, block string, score double")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def plain(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# 1


def removed_by_hand(texts: dict, length: int = 50) -> dict:
    first, out = {}, {}
    for i in sorted(texts):
        x = (texts[i] or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if first.setdefault(x[s : s + length], i) < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(a for a, b in zip(x, gone, strict=True) if not b)
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_brute_force(docs):
    got = by_id(suffixdedup.remove(docs))
    for i, want in removed_by_hand(plain(docs)).items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


@pytest.mark.parametrize(("length", "heavy"), [(8, 256), (9, 0), (50, 0), (61, 2), (64, 256), (64, 1)])
def test_suffix_dedup_other_lengths_and_hot_anchors(spark, length, heavy, monkeypatch):
    """Whole-length repeats at any place; with `heavy` anchors are split by their surroundings."""
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)
    rng = np.random.default_rng(length + heavy)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    hot = word(length // 2 - 1)
    pool = [word(length) for _ in range(8)] + [word(int(rng.integers(5, 30))) + hot + word(int(rng.integers(5, 30))) for _ in range(8)]
    texts = {i: "".join(word(int(rng.integers(0, 40))) + str(rng.choice(pool)) for _ in range(3)) for i in range(90)}
    got = by_id(suffixdedup.remove(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length))
    want = removed_by_hand(texts, length)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 60


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_small_alphabets(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("ab\0"), 90)) for _ in range(6)]
    texts = {i: "".join(rng.choice(pool, 3))[int(rng.integers(40)) :] + "".join(rng.choice(list("ab"), int(rng.integers(60)))) for i in range(40)}
    got = by_id(suffixdedup.remove(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == removed_by_hand(texts)


def test_suffix_dedup_rows_in_any_order(spark):
    """As on a cluster, each step gets the rows of a shard in another order; keys repeat, and reach to the largest."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    pool = [word(70) for _ in range(4)]
    texts = {i: word(int(rng.integers(0, 40))) + str(rng.choice(pool)) + word(int(rng.integers(0, 40))) for i in [*range(200), 2**63 - 1]}

    def turned(batches):
        own = np.random.default_rng()
        for b in batches:
            yield b.take(pa.array(own.permutation(b.num_rows)))

    rows = [(i, t, 0) for i, t in texts.items()] + [(100, t, 1) for t in (texts[100] + "-", texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, nth int").coalesce(1).mapInArrow(turned, "doc_id long, text string, nth int")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", False)
    try:
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.remove(df).collect()]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    want = {(i, *w) for i, w in removed_by_hand(texts).items()}
    assert len(got) == len(rows) and want <= set(got) and sum(w[2] > 0 for w in want) > 150


def test_loser_tree_merges_and_keeps_prefixes():
    rng = np.random.default_rng(3)
    runs = [sorted(bytes(rng.choice([97, 98], int(rng.integers(1, 9)))) for _ in range(int(rng.integers(0, 30)))) for _ in range(5)]
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    common = [[lcp(a, b) for a, b in zip([b"", *r], r, strict=False)] for r in runs]
    run, known, place = suffixdedup.LoserTree(runs, common).merged()
    out = [runs[r][p] for r, p in zip(run, place, strict=True)]
    assert out == sorted(x for r in runs for x in r)
    assert known == [lcp(a, b) for a, b in zip([b"", *out], out, strict=False)]


# 3


def test_bpe_equals_the_library(odd):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(odd, path, public_tokenizers.PATTERN).collect()
    text = defaultdict(set)
    for r in odd.collect():
        text[r["doc_id"]].add(r["text"])
    assert len(ids) == odd.count()
    for r in ids:
        assert r["ids"] in [enc.encode_ordinary(t or "") for t in text[r["doc_id"]]]
    for r in bpe.round_trip(odd, path, public_tokenizers.PATTERN).collect():
        assert r["decoded_sha256"] in [hashlib.sha256((t or "").encode()).hexdigest() for t in text[r["doc_id"]]]
    back = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {(r["doc_id"], bytes(r["bytes"])) for r in back.collect()} == {(k, (t or "").encode()) for k, v in text.items() for t in v}


@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    h = bpe.PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(n)) and (h.find(keys + np.uint64(1)) == -1).all() and len(h.stored) == n


# 4


def components_by_hand(texts: dict, words: int, per_cent: int) -> tuple[dict, dict]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i in sets:
        seen = defaultdict(int)
        for s in sets[i]:
            for j in lists[s]:
                seen[j] += 1
            lists[s].append(i)
        for j, n in seen.items():
            if 100 * n >= per_cent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "per_cent"), [(3, 90), (5, 80)])
def test_jaccard_join_brute_force(spark, words, per_cent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)  # so that clusters are cut into blocks
    rng = np.random.default_rng(words)
    vocab = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for size in (5, 9, 12, 30, 80, 200, 600):
        for _ in range(3):
            base = list(rng.choice(vocab, size))
            for _ in range(7):
                t = list(base)
                for _ in range(int(rng.integers(0, max(2, size // 30) + 1))):
                    t[int(rng.integers(len(t)))] = str(rng.choice(vocab))
                texts[n] = " ".join(t[: len(t) - int(rng.integers(0, 2))])
                n += 1
    want, sizes = components_by_hand(texts, words, per_cent)
    got = by_id(jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words, per_cent))
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert len(set(want.values())) < len(want) - 40


def test_divide_skip_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(400):
        lists = [sorted(set(rng.integers(0, 40, int(rng.integers(0, int(rng.choice([4, 60]))))).tolist())) for _ in range(int(rng.integers(0, 14)))]
        count = defaultdict(int)
        for x in lists:
            for v in x:
                count[v] += 1
        for need in (1, 2, 3, 7, 12):
            want = {v: c for v, c in count.items() if c >= need}
            assert dict(jaccard.merge_skip(lists, need)) == want
            assert dict(jaccard.divide_skip(list(lists), need)) == want


def test_jaccard_search_between_blocks():
    """Sets of another block are found by their true overlap, where most of a query's shingles are not in the index; groups that are
    joined already stay so."""
    rng = np.random.default_rng(7)
    tokens = np.sort(rng.integers(0, 2**63, 90, dtype=np.uint64))
    for per_cent in (80, 90):
        base = rng.permutation(90)[:60]
        sets = [np.sort(tokens[np.union1d(rng.permutation(base)[: 60 - int(rng.integers(0, 9))], rng.integers(0, 90, int(rng.integers(0, 6))))]) for _ in range(120)]
        alike = lambda a, b, p: 100 * (c := len(np.intersect1d(a, b))) >= p * (len(a) + len(b) - c)
        assert sum(alike(sets[i], q, per_cent - 4) and not alike(sets[i], q, per_cent) for q in sets[60:] for i in range(60)) > 20

        def grouped(pairs, start):
            root = list(start)
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root]
            return [min(i for i in range(120) if root[i] == r) for r in root]

        for start in (list(range(120)), [i % 50 for i in range(120)]):
            want = grouped([(i, j) for i in range(60) for j in range(60, 120) if alike(sets[i], sets[j], per_cent)], start)
            g = jaccard.Groups(sets, per_cent, start)
            g.by_lists(list(range(60)), list(range(60, 120)))
            assert grouped(g.links, start) == want and grouped([], [g.find(k) for k in range(120)]) == want
        want = grouped([(i, j) for i in range(120) for j in range(i) if alike(sets[i], sets[j], per_cent)], range(120))
        assert grouped(jaccard.links_within(sets, per_cent), range(120)) == want


def test_jaccard_large_family_below_threshold(spark):
    """A family of more than BLOCK_DOCS texts, most pairs of which just miss the threshold."""
    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in range(122)], {}
    for i in range(2 * jaccard.BLOCK_DOCS + 44):
        t = list(base)
        for at in rng.choice([4, 24, 44, 64, 84, 104], 2, replace=False):  # each change takes 3 of 120 shingles
            t[at] = f"v{int(rng.integers(2, 40))}"
        texts[i] = " ".join(t)
    want, _ = components_by_hand(texts, 3, 94)
    got = by_id(jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 94))
    assert len(set(want.values())) > 20
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_jaccard_candidates_never_miss():
    """Sets at the edge of similarity share one of their rarest shingles, whatever their sizes and the shingles' ranks."""
    rng = np.random.default_rng(0)
    for per_cent in (80, 90):
        for size in [*range(4, 60), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            d = next(d for d in range(len(a), -1, -1) if 100 * (len(a) - d) >= per_cent * (len(a) + d))  # so many are exchanged
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[d:]], rng.integers(0, 2**63, d, dtype=np.uint64))))
            t = jaccard.Tokens(pa.array([], pa.string()), 3)
            t.sh, t.size, t.node = np.concatenate((a, b)), np.array([len(a), len(b)]), np.array([1, 2])
            t.unique, t.back, t.count = np.unique(t.sh, return_inverse=True, return_counts=True)
            rank = np.where(t.count > 1, rng.integers(1, 9, len(t.count)), 0)
            sh, node = t.rarest(rank, per_cent)
            assert set(sh[node == 1].tolist()) & set(sh[node == 2].tolist()), (per_cent, size)


def test_jaccard_odd_rows(odd):
    got = jaccard.join(odd).collect()
    assert len(got) == odd.count()
    rows = [r for r in got if r["doc_id"] in (0, 1, 5)]
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 10)} == {3}
    assert next(r for r in got if r["doc_id"] == 2)["n_shingles"] == 1


# components


@pytest.mark.parametrize("local", [0, 30, graph.LOCAL_EDGES])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 400)] + [(500, 500), (None, 3), (7, 9), (401, 400)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 400), 100), 400: 400, 401: 400}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = np.random.default_rng(local)
    a, b = rng.integers(0, 3000, 2000), rng.integers(0, 3000, 2000)
    root = np.arange(3000)
    for x, y in zip(a, b, strict=True):
        root[root == max(root[x], root[y])] = min(root[x], root[y])
    nodes, label = graph.labels_of(a, b)
    assert (label == root[nodes]).all() and set(nodes.tolist()) == set(a.tolist()) | set(b.tolist())
    got = graph.components(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {int(n): int(root[n]) for n in {*a[a != b].tolist(), *b[a != b].tolist()}}


# 5


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1536, 1537, 12288, 100000])
def test_transport_stream_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    s = mpegts.demux(media := mpegts.mux(mpegts.padded(data)))
    assert s.payload == mpegts.padded(data) and len(s.payload) % 192 == 0 and s.payload[:n] == data
    assert (s.program, s.pid, s.kind, s.gaps, s.bad_tables) == (1, 256, 6, 0, 0) and len(media) % 188 == 0
    assert (np.diff(s.pts) == mpegts.TICKS * mpegts.FRAMES).all() and s.access.tolist() == list(range(0, len(s.pts), mpegts.EVERY))
    assert all(media[a] == 0x47 for a in s.access_at)


def parsed_by_hand(media: bytes) -> tuple[dict, bytes, list, list, int]:
    """Tables, payload, timestamps, access points and packets of a stream, one packet after the other."""
    tables, payload, times, access, counters, left = {}, bytearray(), [], [], {}, 0
    for n in range(0, len(media), 188):
        p = media[n : n + 188]
        assert p[0] == 0x47
        pid, control = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3
        assert counters.setdefault(pid, p[3] & 15) == p[3] & 15
        counters[pid] = (p[3] + 1) & 15
        adapt = p[4] + 1 if control & 2 else 0
        body = p[4 + adapt :]
        if pid in (0, tables.get(0)):
            section = body[1 + body[0] :]
            size = 3 + ((section[1] & 15) << 8 | section[2])
            c = 0xFFFFFFFF
            for byte in section[:size]:
                for bit in range(7, -1, -1):
                    c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (byte >> bit & 1) else 0)
            assert c == 0
            tables[pid] = (section[10] & 31) << 8 | section[11] if pid == 0 else (section[13] & 31) << 8 | section[14]
            continue
        assert pid == tables[tables[0]]
        if p[1] & 0x40:
            assert body[:3] == b"\0\0\1" and left == 0
            left = (body[4] << 8 | body[5]) - 3 - body[8]
            t = body[9:14]
            times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
            if adapt > 1 and p[5] & 0x40:
                access.append(len(times) - 1)
                base = p[6] << 25 | p[7] << 17 | p[8] << 9 | p[9] << 1 | p[10] >> 7
                assert base == times[-1]
            body = body[9 + body[8] :]
        payload += body
        left -= len(body)
    assert left == 0
    return tables, bytes(payload), times, access, len(media) // 188


@pytest.mark.parametrize("n", [192, 1536, 1728, 40_000 * 192 // 192 * 192])
def test_transport_stream_by_hand(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    media = mpegts.mux(data)
    tables, payload, times, access, packets = parsed_by_hand(media)
    s = mpegts.demux(media)
    assert payload == data and times == s.pts.tolist() and access == s.access.tolist() and (tables[0], packets) == (0x1000, s.packets)
    assert mpegts.feature(s) == f"program=1 pid={tables[0x1000]} type=6 packets={packets} gaps=0 units={len(times)} access={len(access)} pts={min(times)}-{max(times)}"


def test_transport_stream_discontinuity():
    """A jump of the counter that a packet announces is no gap."""
    media = bytearray(mpegts.mux(mpegts.padded(b"x" * 60000)))
    at = next(a for a in mpegts.demux(bytes(media)).access_at.tolist() if a > 1000)
    cut = media[: at - 188 * 3] + media[at:]
    assert mpegts.demux(bytes(cut)).gaps >= 1
    told, es = bytearray(cut), 0
    for n in range(0, len(told), 188):
        if n >= at - 188 * 3 and told[n + 3] & 0x20 and told[n + 4]:
            told[n + 5] |= 0x80
    es = mpegts.demux(bytes(cut)).gaps - mpegts.demux(bytes(told)).gaps
    assert es >= 1
    with pytest.raises(ValueError, match="188"):
        mpegts.demux(bytes(media[:-1]))
    with pytest.raises(ValueError, match="188"):
        mpegts.demux_many(np.frombuffer(bytes(media), np.uint8), np.array([0, 188, len(media) - 5]))


def test_transport_stream_faults():
    media = mpegts.mux(mpegts.padded(b"x" * 20000))
    lost = mpegts.demux(media[: 188 * 7] + media[188 * 8 :])
    assert lost.gaps == 1
    assert mpegts.demux(media[:10] + bytes([media[10] ^ 1]) + media[11:]).bad_tables == 1
    with pytest.raises(ValueError, match="sync"):
        mpegts.demux(b"\0" + media[1:])
    with pytest.raises(ValueError, match="multiple"):
        mpegts.mux(b"abc")


def test_media_columns(odd):
    got = mpegts.digests(odd).collect()
    assert len(got) == odd.count()
    want = {(t or "") for t in TEXTS}
    sums = {hashlib.sha256(mpegts.padded(t.encode())).hexdigest(): zlib.crc32(mpegts.padded(t.encode())[-16:]) for t in want}
    for r in got:
        if r["doc_id"] is not None:
            assert sums[r["payload_sha256"]] == r["tail_crc32"]
    for r in mpegts.store(odd).collect():
        tables, payload, times, access, _ = parsed_by_hand(bytes(r["media"]))
        assert payload[: r["n_bytes"]].decode() in want | {"no key at all here"} and r["pts"] == times and [a["unit"] for a in r["access"]] == access
    one = mpegts.store(odd.where("doc_id = 7")).collect()[0]
    assert mpegts.demux(bytes(one["media"])).payload.startswith(b"mail a@b.co") and one["access"][0]["unit"] == 0


# 6


def spans_by_hand(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_brute_force(docs):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(a), int(rng.integers(0, 40)))) for a in ("a@.-1b ", "12.3 .", "1234567890 -", "+(123) .-9", "@a.b@c.d-@é") for _ in range(4000)]
    for t in texts + [t for t in plain(docs).values() if t] + ["4111 1111 1111 1111 and 4111111111111111", "1." * 5000, "a" * 50000 + "@b.c"]:
        assert pii.base_spans(t) == spans_by_hand(t)


def test_disclosing_terms(spark):
    """A term seen only with an entity is removed, a common one stays, and documents without entities are left alone."""
    rows = [(i, f"the quick report of zanzibar was sent by x{i % 2}@mail.example.com to everyone today") for i in range(6)]
    rows += [(i, "the quick report of nothing was sent to everyone today by zanzib") for i in range(10, 200)]
    # kilimanjaro is near one entity alone, zanzibar also near another: one is removed, one generalised
    rows[0] = (0, rows[0][1].replace("zanzibar", "kilimanjaro"))
    rows[2] = (2, rows[2][1].replace("zanzibar", "kilimanjaro"))
    got = by_id(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "removed:20:31" in got[0]["spans"] and "term:20:28" in got[1]["spans"]
    assert all(got[i]["spans"] == "" for i in range(10, 200)) and got[5]["n_email"] == 1
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "kilimanjaro" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and "quick report" in clean[0]["text"] and clean[50]["text"] == rows[-1][1]


def test_disclosing_terms_of_whole_documents(spark):
    """Terms far from the entity and of few letters are found; what also stands without the entity stays; lone entities have none."""
    far = "the quick report was sent to everyone today " * 8
    rows = [(i, f"Ann 李明 Oy {far} mail ab@mail.example.com {far} Kilimanjaro") for i in range(4)]
    rows += [(i, f"a lone Bo {far} mail b{i}@mail.example.com {far} Matterhorn") for i in range(4, 8)]
    rows += [(i, f"{far} Oy and a mail {far}") for i in range(10, 200)]
    rows.append((0, "Zed, in another row of the same key"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["text"] for r in pii.sanitise(df).collect()}
    one = next(t for t in clean if "Oy" in t and "[EMAIL]" in t)
    assert not re.search("Ann|李明|Kilimanjaro", one) and one.count("the quick report was sent to everyone today") == 16 and "Oy" in one and "mail [EMAIL]" in one
    assert sum("Bo" in t and "Matterhorn" in t for t in clean) == 1 and sum("Zed" in t for t in clean) == 1
    spans = [r["spans"] for r in pii.detect(df).collect() if r["doc_id"] in range(1, 4)]
    assert all([s.split(":")[0] for s in x.split(",")] == ["email", "removed", "removed", "removed"] for x in spans)


def terms_by_hand(texts: list, alpha: float, least: int) -> list:
    """All spans of each row, by counting rows."""
    words = [{w.lower() for w in re.findall("[A-Za-z\x80-\U0010ffff]+", t or "")} for t in texts]
    own = [{(k, (t or "")[a:b].lower()) for k, a, b in spans_by_hand(t or "")} for t in texts]
    n, n_c, n_t, n_ct = len(texts), defaultdict(int), defaultdict(int), defaultdict(int)
    for w, o in zip(words, own, strict=True):
        for t in w:
            n_t[t] += 1
        for c in o:
            n_c[c] += 1
            for t in w:
                n_ct[c, t] += 1
    out = []
    for text, w, o in zip(texts, words, own, strict=True):
        spans, told = spans_by_hand(text or ""), {}
        for c in o:
            for t in w:
                if n_c[c] >= least and n_ct[c, t] >= least and n_c[c] < n:
                    pmi, ic = np.log2(n_ct[c, t] * n / (n_c[c] * n_t[t])), np.log2(n / n_c[c])
                    if pmi >= alpha * ic:
                        told[t] = told.get(t, False) or pmi >= ic
        extra = [("removed" if told[m[0].lower()] else "term", *m.span()) for m in re.finditer("[A-Za-z\x80-\U0010ffff]+", text or "") if m[0].lower() in told and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans + sorted(extra)))
    return out


@pytest.mark.parametrize("alpha", [0.6, 0.9])
def test_disclosing_terms_brute_force(spark, alpha):
    """Against plain counts, with rows that repeat, share a key or have none, and long texts of many spans."""
    rng = np.random.default_rng(int(alpha * 10))
    mails = [f"p{i}@mail.example.com" for i in range(6)]
    vocab = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Zoë", "李明", "X"]
    rows = []
    for i in range(160):
        t = list(rng.choice(vocab, 8))
        if i % 3 == 0:
            m = int(rng.integers(6))
            t += [mails[m], f"Own{'abcdef'[m]}", vocab[m]]
        rows.append((i // 2 if i % 5 else None, " ".join(map(str, rng.permutation(t)))))
    rows += rows[:20] + [(900, None), (901, ""), (902, " ".join(["10.0.0.1 and Host", *mails] * 400)), (903, "see 10.0.0.1 Host")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i is None, i or 0, s) for (i, _), s in zip(rows, terms_by_hand([t for _, t in rows], alpha, 2), strict=True))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["spans"]) for r in pii.detect(df, alpha=alpha).collect())
    assert got == want and sum("removed" in s for *_, s in want) > 20


def test_pii_copied_lists(spark):
    """Texts of many entities and many words, copied: entities of the same rows are counted together, and the result is the plain one."""
    lists = [" ".join(f"p{i}x{j}@mail.example.com Name{chr(97 + j % 26)}{'xy'[i]}{'z' * (j // 26)}" for j in range(300)) for i in range(2)]
    rows = [(i, lists[i % 2]) for i in range(6)] + [(9, "p0x1@mail.example.com Namebx")] + [(i, "plain words of no one") for i in range(10, 90)]
    got = by_id(pii.detect(spark.createDataFrame(rows, "doc_id long, text string")))
    want = terms_by_hand([t for _, t in rows], pii.ALPHA, pii.MIN_DOCS)
    assert [got[i]["spans"] for i, _ in rows] == want and want[0].count("removed") + want[0].count("term") >= 299


def test_pii_many_spans_in_linear_time():
    import time

    t = "a1@b.co Ann 10.1.2.3 +44 20 7946 0958, " * 20_000
    began = time.time()
    assert len(pii.base_spans(t)) == 60_000 and time.time() - began < 20


def test_pii_odd_rows(odd):
    got = pii.detect(odd).collect()
    assert len(got) == odd.count() and sum(r["n_email"] for r in got) == 2
    odd = odd.withColumnRenamed("block", "_spanisle_spans").withColumnRenamed("key", "_spanisle_row")
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and clean.where("text LIKE '%@%'").count() == 0
    assert pii.rewrite("ab cd ef", ["email:0:4", "term:3:5", "removed:6:8"]) == "[EMAIL] "


# 7


def test_quality_on_held_out_labels(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = by_id(quality.classify(docs, labels))
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(got) == docs.count() and sum(q == g["predicted"] for q, g in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def boosted_by_hand(x, y, trees, depth, rate, bins, least, ridge):
    """Trees as nested tuples, grown one node after the other with plain loops; gives scores of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    out = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = p - y, p * (1 - p)

        def grow(rows, d):
            if d == depth:
                out[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)
                return
            best, split_at = 1e-9, None
            for j, c in enumerate(cuts):
                for v in c:
                    a = rows & (x[:, j] <= v)
                    hl, ht = h[a].sum(), h[rows].sum()
                    if hl < least or ht - hl < least:
                        continue
                    gl, gt = g[a].sum(), g[rows].sum()
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    if gain > best + 1e-12:
                        best, split_at = gain, (j, v)
            if split_at is None:
                grow(rows, depth)
                return
            a = x[:, split_at[0]] <= split_at[1]
            grow(rows & a, d + 1)
            grow(rows & ~a, d + 1)

        grow(np.ones(len(x), bool), 0)
    return 1 / (1 + np.exp(-out))


def test_boosted_trees_by_hand():
    rng = np.random.default_rng(6)
    x = rng.random((300, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 2] ** 2 + 0.3 * rng.random(300) > 0.9).astype(float)
    model = quality.Boosted(trees=5, depth=3, bins=12).fit(x, y)
    want = boosted_by_hand(x, y, 5, 3, model.rate, 12, model.least, model.ridge)
    assert np.allclose(model.score(x), want, atol=1e-9)
    for row, s in zip(x[:50], model.score(x[:50]), strict=True):  # one row at a time through the flattened trees
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
            total += leaf[at - (2**model.depth - 1)]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12


def test_statistics_by_hand(docs):
    texts = [*[t for t in plain(docs).values() if t][:40], "", "One one TWO, two 3x\n\nline!\n", "é à 日本"]
    x = {k: quality.statistics(pa.array(texts))[:, i] for i, k in enumerate(quality.NAMES)}
    for i, t in enumerate(texts):
        b, w, lines = t.encode(), re.split(r"[ \t\n\r\x0b\x0c]+", t.strip(" \t\n\r\x0b\x0c")) if t.strip() else [], [a for a in t.split("\n") if a]
        want = {
            "log_bytes": np.log1p(len(b)), "upper": sum(65 <= c <= 90 for c in b) / max(1, len(b)), "high": sum(c >= 128 for c in b) / max(1, len(b)), "newline": b.count(b"\n") / max(1, len(b)),
            "entropy": -sum(c / len(b) * np.log2(c / len(b)) for c in np.bincount(list(b)) if c) if b else 0, "log_words": np.log1p(len(w)), "word_mean": sum(len(v.encode()) for v in w) / max(1, len(w)), "word_longest": max((len(v.encode()) for v in w), default=0),
            "distinct_words": len(set(w)) / max(1, len(w)), "most_word": max((w.count(v) for v in set(w)), default=0) / max(1, len(w)), "repeat_next": sum(a == c for a, c in zip(w, w[1:], strict=False)) / max(1, len(w)), "log_lines": np.log1p(len(lines)),
            "distinct_lines": len(set(lines)) / max(1, len(lines)), "line_longest": max((len(a.encode()) for a in lines), default=0), "distinct_pairs": len(set(zip(w, w[1:], strict=False))) / max(1, len(w) - 1),
        }
        for k, v in want.items():
            assert abs(float(x[k][i]) - v) <= 1e-4 * max(1, abs(v)), (k, t[:50])


def test_boosted_trees_and_odd_rows(odd, spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    assert ((quality.Boosted().fit(x, y).score(x) >= 0.5) == y).mean() > 0.97
    assert quality.Boosted().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    labels = spark.createDataFrame([(2, None), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    assert quality.classify(odd, labels).count() == odd.count()
    assert np.isfinite(quality.statistics(pa.array(TEXTS))).all()


# 8


def test_hnsw_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([c + 0.04 * rng.normal(size=(int(rng.integers(1, 60)), 24)) for c in centres] + [np.repeat(centres[:1], 30, axis=0)]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 24), (n + 2, [float("nan")] * 24), (n + 3, [None] * 24), (n + 4, []), (n + 5, [1.0, 2.0]), (None, [1.0] * 24)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r["vec_id"]: r for r in got.collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    near |= (x[:, None] == x[None]).all(axis=2)
    np.fill_diagonal(near, False)
    found, links = sum(got[i]["n_links"] for i in range(n)), near.sum()
    assert 0.98 * links <= found <= links
    comp = np.arange(n)
    while True:
        new = np.array([min(comp[i], comp[near[i]].min(initial=n)) for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    assert [got[i]["component_id"] for i in range(n)] == comp.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(n, n + 6))


def links_by_hand(x):
    u = x.astype(float) / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("seen", [32, hnsw.SEEN])
def test_hnsw_beams_reach_recall(seen, monkeypatch):
    """Partners at many angles, with a table of seen nodes that is far too small, and after a shard is written and read."""
    monkeypatch.setattr(hnsw, "SEEN", seen)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[1500:] = x[:1500] + 0.05 * rng.normal(size=(1500, 16))
    s = hnsw.Shard.load(hnsw.Shard(np.arange(3000), np.ones(3000, int), x, 0.95, 8).dump())
    assert s.recall >= hnsw.RECALL
    found = sum(int(s.links(np.arange(i, i + 500), x[i : i + 500])[0].sum()) for i in range(0, 3000, 500))
    assert found >= 0.97 * links_by_hand(x).sum()


def test_hnsw_one_large_group(spark):
    """A group of distinct near copies that is far wider than any beam is counted whole, and its members are one component."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1, 24))
    x = np.concatenate([base + 0.03 * rng.normal(size=(1500, 24)), rng.normal(size=(800, 24)), -base + 0.05 * rng.normal(size=(300, 24))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_id(hnsw.near_duplicates(df), "vec_id")
    near = links_by_hand(x)
    want, found = near.sum(axis=1), np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert {got[i]["component_id"] for i in np.flatnonzero(near[0])} == {0}


def test_hnsw_norms_of_any_size(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [1e200, 1e190]), (3, [-1e300, 0.0]), (4, [0.0, 1e-310]), (5, [0.0, 3.0])]
    got = by_id(hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    assert [got[i]["component_id"] for i in range(6)] == [0, 0, 0, 3, 4, 4] and [got[i]["n_links"] for i in range(6)] == [2, 2, 2, 0, 1, 1]


def test_keys_that_are_no_integers(spark):
    df = spark.createDataFrame([("a", "x y z", [1.0])], "doc_id string, text string, embedding array<double>")
    for made in (lambda: suffixdedup.remove(df), lambda: jaccard.join(df), lambda: hnsw.near_duplicates(df, "doc_id"), lambda: tokenfile.write(df, public_tokenizers.path("word_bpe_49k.json"), 2)):
        with pytest.raises(TypeError, match="integers"):
            made()


# 9


@pytest.mark.parametrize("most", [1, 2, 1000, 65536, 2**40, 2**63])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_simple8b(most, n):
    v = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64)
    v[::3] = 0
    words, at = tokenfile.pack(v)
    assert (tokenfile.unpack(words, at, n) == v).all()


def test_token_files(odd, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    files = tokenfile.write(odd, path, end_id=2)
    got = sorted(tokenfile.read(files, ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    at = 0
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        assert r["ids"] in texts[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_token_files_quote_special_tokens(spark):
    """The strings of special tokens give what the library gives by itself; in capitals or across two rows they are ordinary text."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["see <|endoftext|> here", "plain text", "<|startoftext|>Hello<|endoftext|>", "", "it's<|ENDOFTEXT|>", "SEE <|endoftext|>\u3000It's 42", "ends <|endof", "text|> starts", "x<|endoftext|><|endoftext|>y", "the end"]
    files = tokenfile.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, end_id=2)
    got, at = by_id(tokenfile.read(files, ids=True)), 0
    for i, t in enumerate(texts):
        want = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["ids"], got[i]["start"], got[i]["n_tokens"]) == (want, at, len(want))
        at += len(want)
    enc = tokenfile.Encoder(path)
    ids, counts = enc.encode(*vec.packed(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in got[0]["ids"]


# 10


def phrases_by_hand(text: bytes, own: bytes) -> int:
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in own:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("side", [1, 3, 48, 10**6])
def test_automaton_counts_longest_phrases(side, monkeypatch):
    """Across words, and alike for texts that step side by side and for those that go on alone."""
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", side)
    rng = np.random.default_rng(side)
    own = b" abra cad abra dab "
    texts = [b" abra ", b" cad abra ", b" zzz ", b" abcad ", b" ab\xc3\xa9 ", b"", b"z"] + [bytes(rng.choice(list(b"abrcd z"), int(rng.integers(0, 60)))) for _ in range(60)]
    buf, off = vec.packed(pa.array(texts, pa.binary()))
    assert langid.Automaton(own).phrases(buf, off).tolist() == [phrases_by_hand(t, own) for t in texts]


def test_language_by_hand(spark, docs, monkeypatch):
    """Every document's rates and language against a plain parse; capitals of other scripts change nothing."""
    learned, real = [], langid.Automaton
    with monkeypatch.context() as m:
        m.setattr(langid, "Automaton", lambda data: (learned.append(data), real(data))[1])
        automata = langid.fit(docs, train_docs=6, train_bytes=3000)
    owns = dict(zip(automata, learned, strict=True))
    rows = [(i, t[:400]) for i, t in list(plain(docs).items())[:60]] + [(10**6, None), (10**6 + 1, "12 !"), (10**6 + 2, "😀 → ☂"), (10**6 + 3, "日本語のテキスト")]
    got = by_id(langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), automata, ["doc_id"]))
    top = np.log(max(map(len, owns.values())))
    for i, t in rows:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        own = f" {' '.join(words)} ".encode()
        rate = {k: phrases_by_hand(own, x) * np.log(len(x)) / top / len(own) for k, x in owns.items()}
        assert abs(got[i]["rate"] - min(rate.values())) < 1e-9 and rate[got[i]["lang_pred"]] <= min(rate.values()) + 1e-9
    model = langid.Model({"ru": langid.Automaton(langid.letters(pa.array(["Однажды весною, в час небывало жаркого заката, в Москве"]))[0].as_py().encode())})
    rate, _ = model.rates(pa.array(["в час небывало жаркого заката", "В ЧАС НЕБЫВАЛО ЖАРКОГО ЗАКАТА"]))
    assert rate[0, 0] == rate[1, 0] < 0.1


def test_language_sample_shares_its_bytes():
    texts = [b"x" * 50_000, b"ab", "é".encode() * 3000, b"c" * 900]
    got = langid._shared(texts, 9001)
    assert [len(t) for t in got] == [4049, 2, 4048, 900] and all(t.decode() in s.decode() for t, s in zip(got, texts, strict=True))
    assert langid._shared(texts, 10**6) == texts and langid._shared([], 10) == []


def test_language_on_held_out(docs, odd):
    got = by_id(langid.identify(docs, langid.fit(docs), ["doc_id", "lang"]))
    held = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    strange = langid.identify(odd, langid.fit(docs), odd.columns, names=("lang_pred", "own", "rate")).collect()
    assert len(strange) == odd.count() and all(r["lang_pred"] == "und" and r["own"] == 0 for r in strange if r["doc_id"] in (0, 1, 5))
    assert {r["lang_pred"] for r in langid.identify(odd, {}, ["doc_id"]).collect()} == {"und"}
    with pytest.raises(ValueError, match="score"):
        langid.identify(odd, {}, odd.columns)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, langs_most=1)


# 2


def test_mixing_fills_budgets(spark):
    rows = [(i, "a b c d e f g h i j", "en" if i % 3 else "fr", f"src{i % 5}") for i in range(200)] + [(900, None, None, None), (901, "", "en", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    domain = F.when(F.col("source") == "src0", "tiny").otherwise("big")
    got = mixing.mix(df, domain, {"domain": {"tiny": 900, "big": 100}}, share=0.9, epochs=2).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r["domain"]] += r["take_tokens"]
        assert 0 < r["take_tokens"] <= r["n_tokens"]
    # the small domain has 400 tokens, twice at most; the rest of 1800 goes to the other
    assert taken["tiny"] == 800 and 990 <= taken["big"] <= 1000
    starts = sorted((r["source"], r["language"], r["token_start"]) for r in got)
    assert len(set(starts)) == len(starts)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df, domain, {"domain": {"tiny": 900, "big": 100}}, share=0.9, epochs=2).collect()))
    whole = mixing.select(df, domain=domain, weights={}, share=1.0, epochs=1)
    assert whole.columns == df.columns and 190 <= whole.count() <= 200


def test_mixing_oracle(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = c.sql(queries.ORACLE["op2_mixing"])
    cols = found.columns
    assert sorted(tuple(r[k] for k in cols) for r in queries.op2_mixing(spark, sf).collect()) == sorted(found.fetchall())


# all


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for made in (
        lambda: suffixdedup.remove(docs), lambda: bpe.round_trip(docs, ranks, public_tokenizers.PATTERN), lambda: jaccard.join(docs), lambda: mpegts.digests(docs), lambda: pii.detect(docs), lambda: pii.sanitise(docs),
        lambda: quality.classify(docs, labels), lambda: hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")), lambda: tokenfile.read(tokenfile.write(docs, path, 2)),
        lambda: langid.identify(docs, langid.fit(docs), ["doc_id"]), lambda: mixing.mix(docs, queries.domain(), **queries.MIX), lambda: mixing.select(docs, domain=queries.domain(), **queries.MIX),
    ):
        assert made().count() == 0


def test_odd_rows_everywhere(odd):
    assert suffixdedup.remove(odd).count() == odd.count()
    assert mixing.select(odd, domain=queries.domain(), **queries.MIX).columns == odd.columns


def test_segment_hashes_do_not_depend_on_place():
    a = np.frombuffer(b"hello world hello, " + b"x" * 300 + b"hello", np.uint8)
    h = vec.Segments(a, np.array([0, 6, 12, 319, 3, 19, 20]), np.array([5, 11, 17, 324, 3, 219, 220])).hashes
    assert h[0] == h[2] == h[3] != h[1] and h[5] == h[6] and len(set(h.tolist())) == 4
    assert (vec.kmers(a, 24)[[19, 20]] == vec.kmers(a[19:], 24)[0]).all() and vec.kmers(a, 5)[0] == vec.kmers(a, 5)[12] != vec.kmers(a, 5)[6]


def test_memo_compares_bytes(monkeypatch):
    """Units that share a hash keep their own numbers."""
    monkeypatch.setattr(vec.Segments, "hashes", property(lambda s: np.zeros(len(s), np.uint64)))
    memo = vec.Memo(np.int64)
    for words in ([b"ab", b"cd", b"ab", b"ab\0", b"longer than eight"], [b"cd", b"cd", b"longer than eighT", b"ab"]):
        end = np.cumsum([len(w) for w in words])
        units = vec.Segments(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end)
        begin, length = memo.lookup(units, lambda i, w=words: (np.array([c for k in i for c in w[k]], np.int64), np.array([len(w[k]) for k in i])))
        assert [bytes(memo.flat[b : b + n].tolist()) for b, n in zip(begin, length, strict=True)] == words


def thue_morse(n: int, pair: str = "ab") -> str:
    return "".join(pair[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [64, 128, 1024, 4096])
def test_words_made_to_collide(spark, n):
    """Words whose polynomial hashes modulo a power of two are equal for every base."""
    import tiktoken
    from tokenizers import Tokenizer

    a, b = thue_morse(n), thue_morse(n, "ba")
    texts = [f"{x} {y}" for x in (a, b) for y in ("", "and more", f"{b} {a}")] + [a, b, "é" + a, "é" + b, f"'{a}", f"'{b}"]
    packed = vec.packed(pa.array(texts))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    ids, counts = codec.encode(*packed)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(t) for t in texts]
    back, at = codec.decode(ids, counts)
    assert [back[i:j].tobytes().decode() for i, j in zip(at[:-1], at[1:], strict=True)] == texts
    tok = Tokenizer.from_file(words := public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = tokenfile.Encoder(words).encode(*packed)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    sh, off = jaccard.shingles(pa.array(texts), 3)
    assert len(set(sh.tolist())) == len({tuple(t.split()[k : k + 3]) for t in texts for k in range(max(1, len(t.split()) - 2))})
    assert len(set(pii._hash([a.encode(), b.encode()]).tolist())) == 2


def test_words_made_to_collide_end_to_end(spark):
    a, b = thue_morse(2048), thue_morse(2048, "ba")
    df = spark.createDataFrame([(0, f"{a} one two three four five"), (1, f"{b} one two three four five"), (2, a), (3, b), (4, a)], "doc_id long, text string")
    got = by_id(jaccard.join(df))
    assert [got[i]["component_id"] for i in range(5)] == [0, 1, 2, 3, 2]
    want = removed_by_hand({r["doc_id"]: r["text"] for r in df.collect()})
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(suffixdedup.remove(df)).items()} == want
