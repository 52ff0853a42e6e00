"""Operators 11 to 13 against brute force, Python's own ZIP writer, and numpy; odd rows and empty tables."""

import gzip
import hashlib
import io
import itertools
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import phrases, web_archives, whitening

# ---- ZIP directories


def members(data):
    return list(web_archives.directory(lambda at, n: data[at : at + n], len(data)))


def zipped(files, wide=False, comment=b"", monkeypatch=None, streamed=False):
    out = io.BytesIO()
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(web_archives._Stream(out) if streamed else out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
        z.comment = comment
    if wide:
        monkeypatch.undo()
    return out.getvalue()


FILES = {"archive/a.warc": b"hello world, this is long", "indexes/ü.cdxj": b"{}", "empty": b""}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before", [b"", b"MZ" * 50])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 in a comment " * 9])
def test_directory(monkeypatch, wide, before, comment):
    data = before + zipped(FILES, wide, comment, monkeypatch)
    assert {m.name: data[m.start : m.start + m.size] for m in members(data)} == FILES
    assert all(m.stored for m in members(data))


def test_directory_streamed_and_large(monkeypatch):
    many = {f"f{i}": str(i).encode() for i in range(70_000)}  # more than 16 bits number: ZIP64
    data = zipped(many, streamed=True)
    monkeypatch.setattr(web_archives, "CHUNK", 1000)
    found = members(data)
    assert len(found) == 70_000 and data[found[69_999].start :][:5] == b"69999"


def test_directory_faults(monkeypatch):
    data = zipped(FILES)
    for bad in (b"", b"no archive", data[:-1], data[:-30]):
        with pytest.raises(ValueError):
            members(bad)
    at = data.index(b"PK\1\2")
    with pytest.raises(ValueError, match="encrypted"):
        members(data[: at + 8] + struct.pack("<H", 1) + data[at + 10 :])


# ---- packages


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, kind int, digest string")


def brute_pages(rows):
    first = {}
    for k, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and k is not None:
            first[b] = min(first.get(b, k), k)
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= 100 and sum((x[2] or "").encode() == b for x in rows) > 1 else None
        again = f is not None and f != k
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


ODD = [(i, f"http://a.b/{i % 7}", f"<p>{i % 5}</p>" * 30) for i in range(60)]
ODD += [(100 + i, None, "short") for i in range(5)] + [(200, "u\r\nInjected: 1", "é" * 50), (201, "", "é" * 50), (202, None, "é" * 49 + "a"), (300, "x", None), (301, "x", ""), (302, None, None)]
ODD += [(None, "n", "<p>0</p>" * 30), (None, "n", "q" * 200), (None, "n", "q" * 200), (400, "w", "w" * 100), (400, "w", "w" * 100), (401, "w", "w" * 100), (500, "long", "漢字 \r\n\r\nWARC/1.1\r\n" * 50_000)]


@pytest.mark.parametrize("limit", [1 << 16, 0])
def test_round_trip(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(web_archives, "BROADCAST_ROWS", limit)
    made = web_archives.with_revisits(pages(spark, ODD).repartition(3))
    packages = web_archives.write_packages(made, f"file:{tmp_path}/p", package_records=9)
    assert packages.agg(F.sum("records")).first()[0] == len(ODD) and packages.count() >= len(ODD) // 9
    got = web_archives.read_records(packages, most=4).collect()
    number = lambda x: None if x in (None, "urn:page:none") else int(x[9:])
    assert Counter((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got) == Counter(brute_pages(ODD))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert Counter(bytes(r.payload) for r in got if r.payload is not None) == Counter((h or "").encode() for (k, _, h), b in zip(ODD, brute_pages(ODD), strict=True) if b[3] == "response")
    for f in (tmp_path / "p").iterdir():  # Python's reader agrees
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None and {"archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"} == set(z.namelist())
    listed = web_archives.read_records(web_archives.list_packages(spark, f"{tmp_path}/p/*.wacz"), payload=False)
    assert listed.count() == len(ODD)


def foreign(tmp_path, files):
    with zipfile.ZipFile(tmp_path / "f.wacz", "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return [(str(tmp_path / "f.wacz"), (tmp_path / "f.wacz").stat().st_size)]


def some(n):
    texts = [f"page {i} " * (i * 40) for i in range(n)]
    return texts, [web_archives.record("response", f"urn:x:{i}", f"http://x/{i}", t.encode(), hashlib.sha256(t.encode()).hexdigest(), len(t), None, "2020-01-01T00:00:00Z") for i, t in enumerate(texts)]


def test_archives_without_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(web_archives, "CHUNK", 4096)
    texts, records = some(40)
    files = {"archive/a.warc.gz": b"".join(map(gzip.compress, records[:20])), "archive/b.warc": b"".join(records[20:]), "archive/none.warc": b"", "archive/notes.txt": b"x"}
    got = web_archives.read_records(spark.createDataFrame(foreign(tmp_path, files), "path string, length long")).collect()
    assert sorted(r.payload.decode() for r in got) == sorted(texts)


def test_compressed_index_in_pieces(spark, tmp_path):
    texts, records = some(12)
    packed, at, lines = [gzip.compress(r) for r in records], 0, []
    for p in packed:
        lines.append(f'x)/ 2020 {{"filename": "a.warc.gz", "offset": {at}, "length": {len(p)}}}\n'.encode())
        at += len(p)
    lines = lines[:5] + lines[3:10] + [b"!meta 0\n"]  # repeats count once; 10 and 11 are not named
    files = {"archive/a.warc.gz": b"".join(packed), "indexes/index.cdx.gz": gzip.compress(b"".join(lines[:4])) + gzip.compress(b"".join(lines[4:]))}
    got = web_archives.read_records(spark.createDataFrame(foreign(tmp_path, files), "path string, length long")).collect()
    assert sorted(r.payload.decode() for r in got) == sorted(texts[:10])


def test_broken_records(spark, tmp_path):
    _, (record,) = some(1)
    bad = web_archives.record("response", "urn:x:1", None, b"abc", "0" * 64, 3, None, "2020-01-01T00:00:00Z")
    for data in (bad, record[:-10], b"junk"):
        with pytest.raises(Exception, match="digest differ|cut short|no WARC record"):
            web_archives.read_records(spark.createDataFrame(foreign(tmp_path, {"archive/a.warc": data}), "path string, length long")).collect()


def test_query_and_empty_pages(spark, tmp_path):
    pages(spark, ODD).write.parquet(f"{tmp_path}/t/pages.parquet")
    got = web_archives.op11_zip_warc(spark, f"{tmp_path}/t")
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == Counter(brute_pages(ODD))
    pages(spark, ODD).limit(0).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert web_archives.op11_zip_warc(spark, f"{tmp_path}/e").count() == 0


# ---- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<double>, component int, key double")


def brute_white(vecs, top=8):
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vecs]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    y = np.array([[c / n for c in r] for r in off])
    e, u = np.linalg.eigh(y.T @ y / n)
    return [sum(c * c for c in r) for r in off], (y @ u)[:, ::-1][:, :top] / np.sqrt(np.maximum(e[::-1][:top], 1e-300)), e[::-1] / np.trace(y.T @ y / n)


@pytest.mark.parametrize(("scale", "d"), [(1.0, 12), (1e6, 5), (1.0, 3)])
def test_whitening(spark, scale, d):
    rng = random.Random(d)
    vecs = [[rng.gauss(0, scale * (j + 1)) for j in range(d)] for _ in range(300)]
    vecs += [vecs[0]] * 20
    odd = [None, [], [float("nan")] * d, [float("inf"), *[0.0] * (d - 1)], [None, *[0.0] * (d - 1)], [1.0] * (d + 1)]
    rows = list(enumerate(vecs)) + [(1000 + i, v) for i, v in enumerate(odd)]
    got = whitening.whiten(vectors(spark, rows).repartition(4)).collect()
    deviation, w, share = brute_white(vecs)
    k = min(8, d)
    assert Counter(r.vec_id for r in got) == {i: k for i in range(len(vecs))}
    for r in got:
        assert r.n == len(vecs) and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-8
        assert abs(r.explained - share[r.component - 1]) < 1e-9
    mine = np.zeros((len(vecs), k))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((mine * w).sum(0))
    assert np.allclose(mine, w * signs, atol=1e-7)


def test_whitening_without_full_rank(spark):
    rng = random.Random(1)
    line = [[a, 2 * a, 0.0] for a in (rng.randrange(-50, 50) / 16 for _ in range(60))]
    got = whitening.whiten(vectors(spark, list(enumerate(line)))).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 and r.identity_error < 1e-8 for r in got)
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0])] * 5)).count() == 0  # no variance, no component
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0


def test_whitening_query(spark, tmp_path):
    vectors(spark, [(i, [float(i), float(i * i % 7)]) for i in range(50)] + [(None, [1.0, 2.0])]).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op12_svd_whitening(spark, str(tmp_path))
    assert dict(out.dtypes)["deviation"] == "bigint" and out.count() == 102 and out.where("vec_id is null").count() == 2


# ---- phrases


def brute_phrases(rows, words=3, least=10, cover=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang, text = lang if lang is not None else "und", (text or "").encode()
        lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        gone = {g[i:j] for g, a in cand.items() for i, j in itertools.combinations(range(len(g) + 1), 2) if j - i < len(g) and g[i:j] in cand and 100 * a >= cover * cand[g[i:j]]}
        found = []
        for g, a in cand.items():
            if g not in gone:
                score, _, l, r = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, b" ".join(g), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["New", "york", "the", "of", "É", "é", "city", "a", "b", "x-y", "ß", "\x00", "\x1c", "\x85", "　"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", "?"] + [" "] * 6) for _ in range(n))
    rows = [(text(rng.randrange(0, 60)), rng.choice(["aa", "zz", None, "und", ""])) for _ in range(150)]
    rows += [(None, "aa"), ("", None), (" \t.\n", "qq"), ("San Francisco Bay area " * 12, "aa")] + [("hot Hot hot dog", "hot")] * 400 + [("w" * 300_000 + " end", "aa"), ("one two three four " * 30_000, "long")]
    return rows


@pytest.mark.parametrize(("bits", "more"), [(phrases.BITS, {}), (64, {}), (phrases.BITS, {"words": 4, "cover": 80, "top": 7, "least": 12}), (64, {"words": 5, "least": 11})])
def test_phrases(spark, bits, more):
    """Also with sieves that let nearly all through."""
    rows = corpus()
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, f int, gram string").repartition(5)
    got = phrases.phrases(df, bits=bits, **more)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute_phrases(rows, **more)


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_grams_in_small_portions(spark, k):
    rows = [(t, lang) for t, lang in corpus()[:170] if lang == "aa"]
    flat = [w for t, _ in rows for p in phrases.pieces((t or "").encode()) if p for w in [*p, b""]]
    every = phrases.Sieve(np.full(1, -1, np.int64))

    def counted(chunk, often):
        c, total, at = phrases.Words(b"aa") if k == 1 else phrases.Grams(b"aa", k, [every] * k), Counter(), 0
        while at < len(flat):
            end = flat.index(b"", min(at + chunk, len(flat) - 1)) + 1
            c.add(flat[at:end])
            at = end
            if often or at >= len(flat):
                for b in c.drain():
                    for gram, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                        total[gram] += n
        return total

    f = Counter()
    for t, _ in rows:
        for w in phrases.pieces((t or "").encode()):
            f.update(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    got = counted(10, True)
    assert got == counted(1 << 20, False) and (got.pop(None) == sum(f.values()) if k == 1 else True) and got == f


def test_no_documents(spark):
    assert phrases.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.phrases(spark.createDataFrame([(None, None), ("", "aa")], "text string, lang string")).count() == 0


def test_sieves(spark):
    grams = [("aa", "new york"), ("", "é ß"), ("zz", "x" * 100), ("aa", "one two three")]
    frame = spark.createDataFrame(grams, "lang string, gram string")
    for most in (64, phrases.BITS):
        sieve = phrases.Sieve.of(frame, most)
        assert all(sieve.passes(np.array([phrases.gram_hash(x.encode(), g.encode())], np.uint64))[0] for x, g in grams)
    others = np.array([phrases.gram_hash(b"aa", b"other %d" % i) for i in range(1000)], np.uint64)
    assert sieve.passes(others).mean() < 0.1 and not phrases.Sieve.of(frame.limit(0)).passes(others).any()
