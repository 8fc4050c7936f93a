import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lamplight.llm import bpe, common, linedup, media, minhash, mixing, neighbours, queries, resample, shards, toxicity, warc
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a column with a clashing name."""
    long, base = words(9000, 1), words(60, 2)
    rows = [(1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n"), (7, long), (8, long + " x"), (None, base), (None, None), (9, "a b"), (10, "A  B"), (11, "é" * 50)]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "s", None, "x") for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    agree(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 540)]
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = common.components(spark.createDataFrame(pairs, "a long, b long"), common.Scratch(spark, "t"), "c").collect()
    assert all(r["component"] == top(r["node"]) for r in found)
    assert {r["node"] for r in found} == {x for p in pairs if p[0] != p[1] for x in p}


def test_neighbours_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, [1.0, 2.0, 3.1], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [1.0, None, 3.0], 0), (9, [math.nan, 1.0, 1.0], 0), (10, [math.inf, 1.0, 1.0], 0), (11, [], 0), (12, [1.0, 2.0], 0), (None, v, 0), (2, v, 0)]
    out = neighbours.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False) and got[None][0] == 0
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))


def test_graph_recall():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 24))
    x[1500:] = x[r.integers(0, 1500, 1500)] + 0.25 * r.normal(size=(1500, 24))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = neighbours.Graph(x, neighbours.Params())
    found, recall = graph.within(x, 0.93, own=True)
    true = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert (found & true).sum() >= 0.98 * true.sum() and not (found & ~true).any() and recall >= 0.98


def test_neighbours_between_shards(spark):
    """Several shards, a large group of near copies and vectors that repeat, against brute force."""
    r = np.random.default_rng(9)
    x = r.normal(size=(900, 16))
    x[300:600] = x[0] + 0.02 * r.normal(size=(300, 16))
    x[600:700] = x[r.integers(0, 300, 100)] + 0.2 * r.normal(size=(100, 16))
    x[700:720] = x[20]
    x = x.astype(np.float32).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {v["vec_id"]: v for v in neighbours.near_duplicates(vectors, neighbours.Params(shard=100, widest=64)).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & ~np.eye(900, dtype=bool) & (np.arange(900)[:, None] % 2 == np.arange(900) % 2)
    top, before = np.arange(900), None
    while before is None or (top != before).any():
        before, top = top, np.array([min([top[i], *top[link[i]]]) for i in range(900)])
    assert [got[i]["n_links"] for i in range(900)] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(900)] == top.tolist()
    assert all(got[i]["recall"] >= 0.9 for i in range(900))


def test_spanning_forests():
    r = np.random.default_rng(1)
    hit = r.random((40, 50)) < 0.02
    i, j = neighbours.spanning(hit)
    edge = lambda a, b: [(int(x), 100 + int(y)) for x, y in zip(a, b, strict=True)]

    def parts(pairs):
        top = {x: x for p in pairs for x in p}
        for _ in top:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert hit[i, j].all() and parts(edge(i, j)) == parts(edge(*np.nonzero(hit))) and len(i) < 90


def test_shards(spark, odd):
    rows = [(i, words(20 + i % 70, i % 400), ["en", "fr", None][i % 3], f"s{i % 7}", None, "x") for i in range(2000)] + [(5000 + i, "hot " * 30, "en", "s0", None, "x") for i in range(1000)]
    out = shards.assign(spark.createDataFrame(rows, DOC), shards.Params(shards=8)).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sizes) == 8 and sizes.max() - sizes.min() <= 0.03 * sizes.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    once = out[out.doc_id < 5000].groupby("text_crc32")["shard"].nunique()
    assert once.max() == 1
    assert shards.assign(odd).count() == odd.count() and shards.assign(odd.limit(0)).count() == 0


def test_warc_reads_what_it_writes():
    data = [b"", b"x" * 99, b"<p>" + bytes(range(256)) * 900]
    raw = b"".join(warc.record("response", f"<{i}>", "u", d, hashlib.sha256(d).hexdigest()) for i, d in enumerate(data))
    for chunk in (1, 7, 1 << 16):
        offsets = [at for at, _ in warc.members(io.BytesIO(raw), chunk)]
        assert len(offsets) == 3 and all(zlib.decompressobj(31).decompress(raw[at:]).startswith(b"WARC/1.1") for at in offsets)
    assert [(r["payload_bytes"], r["payload_digest"], r["error"]) for r in warc.read(io.BytesIO(raw))] == [(len(d), hashlib.sha256(d).hexdigest(), None) for d in data]


def test_warc_tells_damage():
    d = b"y" * 500
    good = warc.record("response", "<1>", "u", d, hashlib.sha256(d).hexdigest(), page_id=7)
    assert "digest" in next(warc.read(io.BytesIO(warc.record("response", "<1>", "u", d, "0" * 64))))["error"]
    assert list(warc.read(io.BytesIO(good + good[:-30])))[-1]["error"]
    assert list(warc.read(io.BytesIO(b"not gzip")))[0]["error"]
    assert list(warc.read(io.BytesIO(b""))) == []
    plain = zlib.decompress(good, 31)
    pack = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    noise = random.Random(4).randbytes(3000)
    torn = bytearray(warc.record("response", "<2>", "u", noise, hashlib.sha256(noise).hexdigest()))
    torn[700:760] = bytes(60)
    for bad in (pack(plain.replace(b"Content-Length: ", b"X-Length: ")), pack(b"no record"), pack(plain[:-9]), bytes(torn), b"between", good[:40]):
        for chunk in (5, 300, 1 << 16):
            rows = list(warc.read(io.BytesIO(good + bad + good + good), chunk))
            assert [r["page_id"] for r in rows if r["error"] is None] == [7, 7, 7] and len(rows) == 4 and rows[1]["error"]
            assert [r["offset"] for r in rows if r["error"] is None] == [0, len(good + bad), len(good + bad + good)]


def test_warc_pages(spark):
    big = "é" * 60
    pages = spark.createDataFrame([(3, "u", big, 0), (1, None, big, 0), (2, "u", "tiny", 0), (4, "u", "tiny", 0), (5, "u", None, 0), (None, "u", big, 0), (6, "a\r\nb", "", 0)], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 7 and all(r["error"] is None for r in got.values())
    assert got[3]["record_type"] == "revisit" and got[3]["refers_to"] == 1 and got[3]["payload_bytes"] == 120 and got[1]["refers_to"] is None
    assert {got[k]["record_type"] for k in (1, 2, 4, 5, 6, None)} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_repeated_pages(spark):
    a, b = "x" * 150, "y" * 150
    pages = spark.createDataFrame([(1, "u", a), (1, "v", b), (1, "u", a), (2, "u", a), (2, "u", a), (3, "u", b)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted((r["page_id"], r["payload_digest"] == hashlib.sha256(a.encode()).hexdigest(), r["record_type"], r["refers_to"] or 0) for r in got) == [(1, False, "response", 0), (1, True, "response", 0), (1, True, "response", 0), (2, True, "revisit", 1), (2, True, "revisit", 1), (3, False, "revisit", 1)]
    assert len({r["record_id"] for r in got}) == 6 and all(r["error"] is None for r in got)


def test_warc_tells_false_revisits(spark):
    d = b"z" * 200
    sha = hashlib.sha256(d).hexdigest()
    raw = warc.record("response", "<1>", "u", d, sha, page_id=1)
    raw += b"".join(warc.record("revisit", f"<{i}>", "u", None, digest, to, i, n) for i, digest, to, n in ((2, sha, "<1>", 200), (3, "0" * 64, "<1>", 200), (4, sha, "<1>", 199), (5, sha, "<9>", 200)))
    rows = [{"file": "f"} | r for r in warc.read(io.BytesIO(raw))]
    back = spark.createDataFrame([tuple(r[c] for c in warc.FIELDS) for r in rows], warc.SCHEMA)
    got = {r["page_id"]: (r["refers_to"], r["error"]) for r in warc.resolved(back).collect()}
    assert got[1] == (None, None) and got[2] == (1, None) and "digest" in got[3][1] and "length" in got[4][1] and "missing" in got[5][1]


def test_mixing(spark, odd):
    rows = [(i, words(5 + i % 40, i), "en", "big" if i % 3 else ["a", "b", None][i % 9 // 3], None, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOC)
    out = mixing.copies(docs).toPandas()
    assert len(out) == 3000 and out["copies"].between(0, 3).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= 0.05 * g["target"].iloc[0] + 45
    again = mixing.copies(docs.repartition(7)).toPandas()
    assert out.sort_values("doc_id")["copies"].tolist() == again.sort_values("doc_id")["copies"].tolist()
    assert mixing.copies(odd).count() == odd.count() and mixing.copies(odd.limit(0)).count() == 0


def test_resampling_keeps_good_text(spark, odd):
    rows = [(i, words(80, i) if i % 4 else "zz%% qq## " * 40, "en", "s", None, "x") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    out = resample.resample(spark.createDataFrame(rows, DOC), labels, resample.Params(share=0.75)).toPandas()
    assert abs(out["kept"].sum() - 300) <= 1 and not out[out["doc_id"] % 4 == 0]["kept"].any()
    assert resample.resample(odd, labels).count() == odd.count()
    assert resample.resample(odd, labels.limit(0)).count() == odd.count() and resample.resample(odd.limit(0), labels).count() == 0


def test_word_hashes_agree_over_pieces(monkeypatch):
    data = words(400, 9).encode() + b" " + b"w" * 300 + b" end"
    whole = minhash.word_hashes(data)
    monkeypatch.setattr(minhash, "PIECE", 64)
    parts = minhash.word_hashes(data)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    assert len(whole[0]) == len(data.split())


def test_minhash_odd(spark, odd):
    got = {}
    for r in minhash.near_duplicates(odd, minhash.Params(percent=80)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == [(56, 1, True)] and got[2] == [(56, 1, False)] * 2 and got[3][0][1:] == (1, False)
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)]
    assert got[7][0][1:] == (7, True) and got[8][0][1:] == (7, False)
    assert got[9] == [(1, 9, True)] and got[10] == [(1, 9, False)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    one, two = words(60, 70), words(60, 71)
    rows = [(4, one), (4, two), (9, two), (9, one + " x"), (2, words(60, 72)), (None, words(60, 72))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in out) == [("2", 2, True), ("4", 4, True), ("4", 4, True), ("9", 4, False), ("9", 4, False), ("None", 2, False)]


def test_minhash_blocks_lose_no_link(spark):
    base = words(80, 4).split()
    docs = []
    for i in range(90):
        t = list(base)
        t[i % 80] = f"v{i}"
        docs.append((i, " ".join(t)))
    p = minhash.Params(percent=80, block=16, set_block=16)
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), p).toPandas()
    assert set(out["component_id"]) == {0}


def test_posterior_never_asks_more_than_certain():
    for k, m in minhash.least_matches(minhash.Params(percent=85)):
        assert 0 < m < 0.85 * k


def test_lines(spark, odd):
    note = "Please call the office on 555-{} before noon today"
    rows = [(i, f"{words(30, i)}\n{note.format(i)}\n{words(25, 1000 + i)}") for i in range(20)]
    copies = [(100 + i, "\n".join(words(20, 50 + k) for k in range(6)) + f"\nversion number {i} of this text") for i in range(12)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linedup.drop_lines(docs).collect()}
    assert all(got[i]["_n_dropped"] == 1 and "office" not in got[i]["text"] and got[i]["_n_lines"] == 3 for i in range(20))
    assert all(got[100 + i]["_n_dropped"] == 0 for i in range(12))
    out = linedup.drop_lines(odd)
    assert out.count() == odd.count() and out.where("doc_id = 4").first()["text"] is None and out.where("_n_dropped > 0").count() == 0
    assert linedup.drop_lines(odd.limit(0)).count() == 0


def test_line_blocks_that_occur_together(spark):
    rows = []
    for shared, own, at in ((5, 5, 0), (10, 5, 1000), (10, 2, 2000)):
        block = [f"{words(6, 100 * shared + own + 7000 + k)}" for k in range(shared)]
        rows += [(at + i, "\n".join([words(6, at * 50 + 100_000 + i * 20 + k) for k in range(own)] + block)) for i in range(60)]
    base = [words(6, 900_000 + k) for k in range(20)]
    rows += [(5000 + i, "\n".join([*base[:i], words(6, 910_000 + i), *base[i + 1 :]])) for i in range(15)]
    got = {r["doc_id"]: r["_n_dropped"] for r in linedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 5 and got[1000 + i] == 10 and got[2000 + i] == 10 for i in range(60))
    assert not any(got[5000 + i] for i in range(15))


def test_lines_that_are_most_of_their_documents(spark):
    note = words(50, 800_000)
    rows = [(i, f"{words(12, 810_000 + i)}\n{note}") for i in range(8)] + [(100, note), (101, f"{note} ")]
    pair = words(50, 820_000)
    rows += [(200, pair), (201, f"{words(12, 830_000)}\n{pair}")]
    got = {r["doc_id"]: r["text"] for r in linedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == words(12, 810_000 + i) for i in range(8)) and got[100] == got[101] == ""
    assert got[200] == pair


def test_block_max_search_is_exact():
    r = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        t = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.integers(1, 4, len(t)).astype(float)
        rows.append((t, (w / np.linalg.norm(w)).astype(np.float32)))
    dense = np.zeros((700, 40))
    for k, (t, w) in enumerate(rows):
        dense[k, t] = w
    for common in (0, 8, 40):
        words = toxicity.Vocabulary(np.arange(40, dtype=np.uint64), np.ones(40))
        index = toxicity.Index(toxicity.Params(block=16, dense=common), words, np.arange(700), r.integers(0, 2, 700), list(rows))
        for (t, w), (i, got) in zip(rows[:80], index.nearest(rows[:80], 25), strict=True):
            s = np.round(dense[:, t] @ w.astype(float), 12)
            last = np.sort(s)[-25]
            want = [k for k in np.lexsort((np.arange(700), -s)) if s[k] >= last and s[k] > 0]
            assert index.ids[i].tolist() == want and np.allclose(got, s[want])


def _bag(text):
    """Counts of words, and of the beginnings of longer ones."""
    found = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    return Counter(found), Counter((n, w[:n]) for n in (4, 5) for w in found if len(w) > n)


def test_toxicity_query_is_brute_force(spark):
    """op8 over sf0.001 against dense vectors, all pairs of texts and examples, and a curve fitted by halving steps."""
    p = toxicity.Params()
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, SF, "labels").collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    bags = {i: _bag(t) for i, t in docs.items()}
    same = {}
    for i, y in labels.items():
        if i in docs:
            same.setdefault((frozenset(bags[i][0].items()), frozenset(bags[i][1].items())), []).append((i, y))
    ids = [min(i for i, _ in g) for g in same.values()]
    y = np.array([np.mean([y for _, y in g]) >= 0.5 for g in same.values()], int)
    toxic, clean = int(y.sum()), int((1 - y).sum())
    factor = {}
    for part in (0, 1):
        seen = Counter(t for i in ids for t in bags[i][part])
        bad = Counter(t for i, z in zip(ids, y, strict=True) if z for t in bags[i][part])
        for t, n in seen.items():
            a, b = bad[t], n - bad[t]
            g = 2 * sum(x * math.log(x / (m * q)) for x, m, q in ((a, toxic, n / len(ids)), (b, clean, n / len(ids)), (toxic - a, toxic, 1 - n / len(ids)), (clean - b, clean, 1 - n / len(ids))) if x)
            tells = a >= 3 and a * clean > 3 * b * toxic and g >= 2 * math.log(len(seen)) + 4
            if tells or not part:
                factor[t] = 6.0 if tells else 1.0
    df = Counter(t for a, b in bags.values() for t in (*a, *b) if t in factor)
    names = {t: k for k, t in enumerate(factor)}

    def vector(i):
        v = np.zeros(len(names))
        for t, n in [*bags[i][0].items(), *bags[i][1].items()]:
            if t in names:
                v[names[t]] = (1 + math.log(n)) * (math.log((len(docs) + 1) / (df[t] + 1)) + 0.05) * factor[t]
        return v / (np.linalg.norm(v) or 1)

    held = np.array([vector(i) for i in ids])
    base = (toxic + 0.5) / (len(ids) + 1)

    def vote(v, k, without=None):
        s = held @ v
        last = np.sort(s)[-k] - 1e-7
        w = np.where((s >= last) & (s > 0), s, 0) ** 2
        if without is not None:
            w[without] = 0
        return ((w * y).sum() + p.prior * base) / (w.sum() + p.prior)

    x = np.array([vote(held[e], p.k + 1, e) for e in range(len(ids))])
    z, share = np.log(x / (1 - x)), np.mean(list(labels.values()))
    each = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    loss = lambda c: (each * np.logaddexp(0, np.where(y, -1, 1) * (c[0] + c[1] * z))).sum() + (c[0] ** 2 + (c[1] - 1) ** 2) / 2
    c, step = (0.0, 1.0), 1.0
    while step > 1e-7:
        best = min(((c[0] + i * step, c[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=loss)
        c, step = (best, step) if best != c else (c, step / 2)
    got = {r["doc_id"]: r for r in queries.op8_toxicity_neighbours(spark, SF).collect()}
    assert set(got) == set(docs)
    for i in docs:
        v = vote(vector(i), p.k)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-c[0] - c[1] * math.log(v / (1 - v)))), abs=2e-4)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.5)
        assert bool(got[i]["evidence"]) == bool((held @ vector(i)).max() > 0)


def test_toxicity_scores_go_by_text_alone(spark):
    rows = [(i, words(12, i % 50) + (" vile rotten" if i % 50 < 10 else "")) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 50 < 10)) for i in range(200)], "doc_id long, toxic int")
    one = toxicity.score(docs, labels).toPandas()
    other = toxicity.score(docs.repartition(5), labels).toPandas().set_index("doc_id")["score"]
    assert one.groupby(one["doc_id"] % 50)["score"].nunique().max() == 1
    assert (other[one["doc_id"]].to_numpy() == one["score"].to_numpy()).all()
    assert (one["predicted"] == (one["doc_id"] % 50 < 10)).all()


def test_toxicity(spark, odd):
    rows = [(i, words(40, i) + (" vile rotten vile" if i % 5 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(7, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).toPandas()
    held = out[out["held_out"]]
    assert ((held["doc_id"] % 5 == 0) == (held["predicted"] == 1)).mean() > 0.98 and out["score"].between(0, 1).all()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in held["doc_id"])
    assert toxicity.score(odd, labels).count() == odd.count() and toxicity.score(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.score(odd.limit(0), labels).count() == 0


def _expected(text, enc):
    ids = enc.encode_ordinary(text or "")
    return ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_is_the_library(spark, odd):
    p = queries.tokenizer()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(p.ranks), special_tokens={})
    r = random.Random(1)
    parts = ["a", " ", "  ", "\n", "'", "ll", "é", "12", "!!", "　", "😀"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 99, 101, 500, 1500])))) for i in range(120)]
    rows += [(999, None), (1000, "a" * 3000), (1001, " " * 3000), (1002, "'ll" * 700)]
    for params in (p, replace(p, chunk=100, overlap=24, part=400), replace(p, chunk=64, overlap=8, known=10)):
        got = {x["doc_id"]: x for x in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()}
        assert len(got) == len(rows)
        codec = bpe.Codec(params)
        for i, t in rows:
            ids, a, b = _expected(t, enc)
            assert (got[i]["ids"], got[i]["ids_sha256"], got[i]["decoded_sha256"], got[i]["n_tokens"]) == (ids, a, b, len(ids))
            assert codec.boundaries(t or "") == codec.starts(t or "")
    assert bpe.encode(odd, replace(p, chunk=500, overlap=64, part=2000)).count() == odd.count() and bpe.encode(odd.limit(0), p).count() == 0


def test_bpe_query_is_the_library(spark):
    p = queries.tokenizer()
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(p.ranks), special_tokens={})
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op9_bpe_round_trip(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids, a, b = _expected(t, enc)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), a, b)


def test_pairs_merge_as_one_by_one():
    c = bpe.Codec(queries.tokenizer())
    r = random.Random(3)
    pieces = [bytes(r.choice(b"aeinst \n\xc3\xa9\xe2\x80'1") for _ in range(r.randint(1, 90))) for _ in range(3000)]
    pieces += [bytes([x]) * n for x in b"a =\xff" for n in range(1, 65)]
    assert [np.frombuffer(x, np.int32).tolist() for x in c.merge_all(pieces)] == [list(c.merge(x)) for x in pieces]
    looks, merge = [], c.pairs.merge
    c.pairs.merge = lambda x: looks.append(len(x)) or merge(x)
    texts = [words(400, i) for i in range(8)]
    assert list(c.encode_all(texts)) == [c.encode(t) for t in texts] and len(looks) == 1  # new ones of all texts go together


def test_media(spark, odd):
    for n in (64, 128, 64 * 33, 64 * 2500):
        raw = random.Random(n).randbytes(n)
        d = media.describe(media.store(raw))
        assert d["payload"] == raw and d["codec"] == "raw8" and d["samples"] == n // 64 and d["seconds"] == n // 64 / 1000
        assert [media.store(raw)[a : a + b] for a, b in d["keys"].tolist()] == [raw[k : k + 64] for k in range(0, n, 64 * 16)]
    whole = media.store(bytes(640))
    for bad in (whole[:-1], whole[:40], b"\0\0\0\4free"):
        with pytest.raises(media.Broken):
            media.describe(bad)
    got = {r["doc_id"]: r for r in media.round_trip(odd).collect() if r["doc_id"] is not None}
    assert got[4]["payload_bytes"] == got[5]["payload_bytes"] == 64 and got[4]["n_bytes"] == 0 and got[11]["payload_bytes"] == 128
    assert got[1]["media_sha256"] == got[2]["media_sha256"] and got[5]["tail_crc32"] == zlib.crc32(bytes(64))
    assert media.round_trip(odd).count() == odd.count() and media.round_trip(odd.limit(0)).count() == 0


def test_media_query_is_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op10_media_boxes(spark, SF).collect()}
    docs = common.table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        whole = media.store(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(whole), hashlib.sha256(whole).hexdigest())
        at = whole.index(padded)
        keys = ",".join(f"{at + k}+64" for k in range(0, len(padded), 1024))
        assert r["feature"] == f"raw8|{len(padded) // 64 / 1000:.3f}|{len(padded) // 64}|{keys}"


def test_media_fragments():
    """Two fragments of a track without samples of its own: defaults by track, by fragment and by sample."""
    full = lambda kind, flags, *values: media._full(kind, struct.pack(f">{len(values)}I", *values), flags=flags)
    trak = media._box(b"trak", media._full(b"tkhd", struct.pack(">5I", 0, 0, 5, 0, 0)), media._box(b"mdia", media._full(b"mdhd", struct.pack(">4I", 0, 0, 100, 0))))
    head = media._box(b"moov", trak, media._box(b"mvex", full(b"trex", 0, 5, 1, 7, 10, 0x10000)))

    def moof(n, offset):
        return media._box(b"moof", media._box(b"traf", full(b"tfhd", 0x20000, 5), full(b"trun", 0x5, n, offset, 0)))

    one = moof(3, len(moof(3, 0)) + 8) + media._box(b"mdat", bytes(range(30)))
    traf = lambda at: media._box(b"moof", media._box(b"traf", full(b"tfhd", 0x20008, 5, 9), full(b"trun", 0x601, 2, at, 4, 0x10000, 6, 0)))
    two = traf(len(traf(0)) + 8) + media._box(b"mdat", bytes(range(50, 60)))
    data = head + one + two
    t = media.tracks(data)[0]
    assert t["sizes"].tolist() == [10, 10, 10, 4, 6] and t["duration"] == 3 * 7 + 2 * 9
    assert media.payload(data, t) == bytes(range(30)) + bytes(range(50, 60))
    assert [data[a : a + n] for a, n in t["keys"].tolist()] == [bytes(range(10)), bytes(range(54, 60))]
    for bad in (one, head + media._box(b"moof", media._box(b"traf", full(b"trun", 0, 1))), head + moof(3, 10**6), head + media._box(b"moof", media._box(b"traf", full(b"tfhd", 0, 6)))):
        with pytest.raises(media.Broken):
            media.tracks(bad)


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.withColumn("doc_id", F.col("doc_id"))
        assert 0 < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


#: Names that a stage may want for itself, all at once.
CLASH = ["text_key", "row_key", "_row", "row", "same", "gone", "kept", "_kept", "key", "_key", "other", "total", "rows", "place", "times", "rank", "id", "other_id", "other_key", "lines", "dropped", "_n_lines", "_doc", "_copies", "_copy", "node", "size", "copies"]


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.drop("size").select("*", *(F.lit(7).alias(c) for c in CLASH))


def test_pipeline_stages_take_odd_rows(spark, odd, clashing):
    for docs in (odd.drop("size"), clashing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 1 and (out.columns == docs.columns or stage is corpus_pipeline.STAGES[-1][1])
            assert stage(spark, docs.limit(0), SF).count() == 0


def test_copies_go_by_rows(spark, clashing):
    base, other = words(60, 2), words(60, 3)
    rows = [(1, base)] * 3 + [(2, base), (3, base + " tail"), (4, other), (4, base), (None, base), (None, other), (None, words(60, 5)), (None, words(60, 5)), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, docs, SF).select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    # each text of doc 4 is a document of its own
    assert sorted(map(tuple, got), key=key) == sorted([(1, base), (4, other), (None, words(60, 5)), (6, None), (6, None), (7, "")], key=key)
    assert corpus_pipeline.drop_copies(spark, clashing, SF).where("doc_id in (1, 2, 3)").count() == 1


def test_mix_takes_what_it_says(spark):
    rows = [(i % 130, words(5 + i % 30, i % 130), "en", ["big", "big", "a", None][i % 130 % 4], 0, 3) for i in range(440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_key int")
    want = mixing.copies(docs).select(F.sum(F.col("copies") * F.col("size"))).first()[0]
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    got = out.groupBy("doc_id").count().collect()
    assert out.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == want and out.columns == docs.columns
    each = {r["doc_id"]: r["n"] for r in mixing.copies(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    assert {r["doc_id"]: r["count"] for r in got} == {k: n for k, n in each.items() if n}


def test_workers_keep_nothing(spark):
    docs = spark.createDataFrame([(i, words(300, i)) for i in range(40)], "doc_id long, text string").repartition(2)
    sent = spark.sparkContext.broadcast(np.ones(1000))

    def run(batches):
        for batch in batches:
            yield batch.select(["doc_id"]).filter((sent.value[: batch.num_rows] > 0).tolist())

    def held(batches):
        yield from common.lean(run, sent)(batches)
        assert "_value" not in vars(sent)

    assert sorted(r[0] for r in docs.mapInArrow(held, "doc_id long").collect()) == list(range(40))


def test_driver_gives_memory_back(spark, monkeypatch):
    """What the driver's JVM freed outside its heap goes back to the system as tables are written, but not at each of them."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(open(f"/proc/{pid}/statm").read().split()[1]) * 4096 >> 20
    scratch = common.Scratch(spark, "t")

    def dropped():
        held = [jvm.java.util.zip.Deflater() for _ in range(3000)]
        kept = held[::8]  # among the others, so that these don't go by themselves
        for x in (x for i, x in enumerate(held) if i % 8):
            x.end()
        before = resident()
        scratch.save(spark.range(1), "t")
        after = resident()
        for x in kept:
            x.end()
        return before - after

    scratch.save(spark.range(1), "t")
    monkeypatch.setattr(common, "_TRIMMED", {}, raising=False)
    monkeypatch.setattr(common, "TRIM_S", 1e6, raising=False)
    first, second = dropped(), dropped()
    assert first > 100 and second < 100, (first, second)


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.encode_tokens])
def test_stages_bound_batches(spark, stage):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    try:
        stage(spark, common.table(spark, SF, "documents"), SF)
        seen = spark.range(0, 4000, 1, 1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", pa.array([b.num_rows])) for b in batches), "id long")
        assert max(r[0] for r in seen.collect()) <= corpus_pipeline.BATCH
    finally:
        spark.conf.unset(key)


def test_toxic_rows_go_by_text(spark):
    rows = [(i, words(40, i) + (" vile rotten vile" if i % 5 == 0 else ""), "en", "s", 0) for i in range(600)]
    rows += [(None, words(40, 900) + " vile rotten vile", "en", "s", 0), (None, words(40, 901), "en", "s", 0), (700, words(40, 902), "en", "s", 0), (700, words(40, 903) + " rotten vile vile", "en", "s", 0), (601, None, "en", "s", 0), (602, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = toxicity.keep_clean(docs, labels)
    texts = [r["text"] or "" for r in out.collect()]
    assert not any("vile" in t for t in texts) and len(texts) == 484 and out.columns == docs.columns
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == len(rows)


def test_pipeline_is_its_stages_by_brute_force(spark):
    """Each stage over sf0.001 against plain Python on its own input; line dedup against SQL in test_sql."""
    docs = common.table(spark, SF, "documents")
    scores = {r["doc_id"]: r["predicted"] for r in queries.op8_toxicity_neighbours(spark, SF).collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, y in scores.items() if not y}
    thin = corpus_pipeline.drop_lines(spark, clean, SF)
    want = {r["doc_id"]: r["text"] for r in linedup.drop_lines(clean).collect()}
    rows = thin.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want
    sets = {}
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").translate({k: k + 32 for k in range(65, 91)})) if x]
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while top[x] != x:
                    x = top[x]
                while top[y] != y:
                    y = top[y]
                top[max(x, y)] = min(x, y)
    kept = corpus_pipeline.drop_copies(spark, thin, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in top if top[i] == i)
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    each = {r["doc_id"]: r["copies"] for r in mixing.copies(kept).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in each.items() if n})
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.tokenizer().ranks), special_tokens={})
    last = corpus_pipeline.encode_tokens(spark, mixed, SF).collect()
    plain = Counter((r["doc_id"], len(_expected(r["text"], enc)[0]), *_expected(r["text"], enc)[1:]) for r in mixed.collect())
    assert Counter(map(tuple, last)) == plain
    assert Counter(map(tuple, queries.pipeline(spark, SF).collect())) == plain
