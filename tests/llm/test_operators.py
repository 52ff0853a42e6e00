"""Each operator against a brute-force version or an exact round trip, with nulls, empty texts, repeats and extra columns."""

import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import fingerprints, jaccard_join, languages, licenses, mixing, neighbors, quality, sentence_pieces, sharding, token_counts
from helixframe.llm.common import components

ODD = [None, "", " ", "a", "Straße  ﬁne", "STRASSE fine", "x" * 5000, "the cat sat " * 300]


def frame(spark, texts, **more):
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns(more) if more else df


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    for i in range(20):
        w = texts[i].split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0]] * 15 + ODD
    # names that clash with columns used inside
    return frame(spark, texts, x=F.lit(1), size=F.lit("z"), shard=F.lit(9), score=F.lit(2), u=F.lit(0)).cache()


def collect(df):
    return df.collect()


def test_sharding(docs):
    rows = collect(sharding.shard(docs.select("doc_id", "text", "lang", "source"), shards=4))
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s, rs in by.items():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 4) <= most
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)
    assert collect(sharding.shard(docs.where("false").select("doc_id", "text"), shards=3)) == []


def test_sharding_into_many_leaves(spark):
    rows = [(i, f"text {i} " * (1 + i % 7), f"s{i % 11}") for i in range(6000)] + [(6000 + i, "copy " * 30, None) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("x"))
    got = sharding.shard(d, shards=64).groupBy("shard").agg(F.sum("size").alias("z"), F.count("*").alias("n"), F.max("slot").alias("s")).collect()
    total = sum(len(t) + 1 for _, t, _ in rows)
    assert len(got) == 64 and all(abs(r["z"] - total / 64) < total / 64 * 0.15 and r["s"] == r["n"] - 1 for r in got)
    assert sharding.shard(d, shards=64).columns == ["doc_id", "source", "size", "text_crc32", "shard", "slot"]


def test_language(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then the other one", "der schnelle braune fuchs springt über den faulen hund und dann noch einer"
    train = spark.createDataFrame([(i, " ".join(random.Random(i).sample((en if i % 2 else de).split(), 9)), "en" if i % 2 else "de") for i in range(60)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    protos = languages.learn(train)
    assert sorted(protos) == ["de", "en"]
    ask = spark.createDataFrame([(0, en), (1, de), (2, None), (3, ""), (4, "123 !!"), (5, en)], "doc_id long, text string").withColumn("lang_x", F.lit(1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.predict(ask, protos).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "en"] and got[0] == got[5]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in languages.predict(ask, languages.learn(train.where("false"))).collect()} == {"und"}


def canonical(t):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", n(n(t or "").casefold())).strip()


def test_fingerprints(docs, monkeypatch):
    rows = collect(fingerprints.fingerprint(docs))
    seen = {}
    for r in rows:
        seen.setdefault(canonical(r["text"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)
    # with a digest that collides, the bytes still tell texts apart
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lit("same"))
    rows = collect(fingerprints.fingerprint(docs.select("doc_id", "text")))
    assert len({r["fingerprint"] for r in rows}) == len(seen) and len(rows) == docs.count()


def test_next_text_over_many_buckets(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r["doc_id"]: r["nxt"] for r in fingerprints.with_next(d, "doc_id", "text", "nxt").collect()}
    texts = [r["text"] for r in d.orderBy("doc_id").collect()]
    assert [got[i] for i in range(len(texts))] == texts[1:] + texts[:1]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_licenses(spark):
    texts = ["CC-BY and cc by, all RIGHTS reserved", "the General Public License", "licensed under the apache really license version 2 0", "cc by cc by", None, "", "cc", "general public", "permission is hereby granted free of charge to any person obtaining a copy of this software"]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts, t=F.lit(1), h=F.lit(2))).collect()}
    phrases = [(p.split(), lab) for p, lab in licenses.BASE]
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, lab) for p, lab in phrases for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({lab for _, lab in at}))
    assert rows[2]["labels"] == "apache-2.0" and 0 < rows[2]["score"] < 1 and rows[8]["labels"] == "mit"
    assert licenses.scan(frame(spark, texts).where("false")).count() == 0


def test_licenses_count_different_pairs(spark):
    """Labels against a brute-force reading of the rule, over random repeats of the templates' words."""
    rng = random.Random(8)
    temps = [(p.split(), lab) for p, lab in licenses.NOTICES]
    vocab = sorted({w for t, _ in temps for w in t})
    texts = ["cc by cc by cc by cc by cc by", "cc by " * 200, "licensed under cc by nc 4 0 " * 3, "cc by cc by licensed under cc by sa 4 0 cc by"]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            t = list(rng.choice(temps)[0])
            for _ in range(rng.randrange(0, 5)):
                i = rng.randrange(len(t) + 1)
                t[i:i] = [rng.choice(vocab)] * rng.randrange(0, 2)
                if len(t) > 2 and rng.random() < 0.5:
                    del t[rng.randrange(len(t))]
            words += t + [rng.choice(vocab) for _ in range(rng.randrange(0, 6))]
        texts.append(" ".join(words))

    def told(w):
        out = {lab for p, lab in licenses.BASE if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
        for t, lab in temps:
            hits = [(i - j, j, i) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
            for d in {h[0] for h in hits}:
                near = [h for h in hits if d <= h[0] <= d + licenses.GAP]
                if len({j for _, j, _ in near}) >= licenses.SHARE * (len(t) - 1) and max(i for *_, i in near) + 1 - min(i for *_, i in near) <= len(t) - 1 + licenses.GAP:
                    out.add(lab)
        return ",".join(sorted(out))

    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts, labels=F.lit("x"), N_WORDS=F.lit(0))).collect()}
    assert [rows[i]["labels"] for i in range(len(texts))] == [told(t.split()) for t in texts]
    assert rows[0]["labels"] == "cc-by" and rows[2]["labels"] == "cc-by,cc-by-nc" and rows[2]["n_base"] == 3
    assert [p["label"] for p in rows[2]["places"]].count("cc-by-nc") == 3
    assert sum("cc-by-nc" in r["labels"] for r in rows.values()) > 5


def test_mixing(docs):
    assert mixing.targets([100, 100, 100]) == [200.0, 166.66666666666666, 83.33333333333333] or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    rows = collect(mixing.mix(docs.select("doc_id", "text", "source")))
    again = collect(mixing.mix(docs.select("doc_id", "text", "source").repartition(3)))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * total)
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3 + 0.002 * total
    assert collect(mixing.mix(docs.where("false").select("doc_id", "text", "source"))) == []


def test_mixing_takes_each_target(spark):
    sizes = {"huge": [30_000_000, 20_000_000, 25_000_000], "none": [0], "one": [1], "s300": [100] * 3, "s2000": [700, 700, 600], "s20000": [50] * 400, None: [7] * 11}
    rows = [(i, s, z) for i, (s, z) in enumerate((s, z) for s, zs in sizes.items() for z in zs)]
    d = spark.createDataFrame([(i, "", s, z) for i, s, z in rows], "doc_id long, text string, source string, z long")
    got = mixing.mix(d, size=F.col("z")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s, zs in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == sum(zs)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, []), (404, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = neighbors.search(e, e.where("vec_id % 50 = 0")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(400), -s))[:5].tolist()
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        hit += len(set(want) & set(mine))
        if q in (0, 50):
            assert mine == want
    assert hit >= 0.9 * 40 and len(got) == 40
    assert neighbors.search(e.where("false"), e).count() == 0


def test_neighbours_by_codes(spark, monkeypatch):
    """Far fewer candidates than rows, so that the codes decide; several blocks of queries, chunks and tiles of codes."""
    for name, value in {"RERANK": 40, "QUERY_BYTES": 16 * 4 * 10, "TILE": 4, "CHUNK": 300, "TASK_CODES": 1000}.items():
        monkeypatch.setattr(neighbors, name, value)
    x = np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbors.search(e, e.where("vec_id % 50 = 0")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -9
    want = np.argsort(-s, axis=1)[:, :5]
    hit = sum(len({r["vec_id"] for r in got if r["query_id"] == 50 * i} & set(want[i])) for i in range(60))
    assert len(got) == 300 and hit >= 0.9 * 300
    assert all(r["score"] == pytest.approx(u[r["query_id"]] @ u[r["vec_id"]], abs=1e-12) for r in got)


def test_neighbours_are_the_nearest_where_codes_tell_little(spark, monkeypatch):
    """Many dimensions, a common mean, equal directions and large values: with few candidates by code alone most would be missed."""
    for name, value in {"RERANK": 8, "TILE": 16, "CHUNK": 700, "FIT_ROWS": 300, "PIECE": 200}.items():
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(1500, 200))
    for x in (wide, 50 + 0.05 * wide, wide[rng.integers(0, 40, 1500)] + 0.001 * wide, wide[rng.integers(0, 300, 1500)] * rng.integers(1, 3, (1500, 1))):
        x = x.astype(np.float32)
        e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = neighbors.search(e, e.where("vec_id % 50 = 0")).collect()
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        s = u[::50] @ u.T
        s[np.arange(30), np.arange(0, 1500, 50)] = -9
        want = -np.sort(-s, axis=1)[:, :5]
        mine = {(r["query_id"], r["rank"]): r["score"] for r in got}
        assert len(got) == len(mine) == 150
        assert all(abs(mine[50 * i, j + 1] - want[i, j]) < 1e-12 for i in range(30) for j in range(5))


def test_quality(spark):
    good, bad = "the cat and the dog went home and had some tea", "$$$ %% buy now !!! $$$ win win win"
    rows = [(i, " ".join(random.Random(i).sample((good if i % 3 else bad).split(), 7)), int(i % 3 > 0)) for i in range(300)]
    d = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "x " * 4000)], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.train(quality.sample(d, lab, "quality", F.lit(True)))
    got = {r["doc_id"]: r["score"] for r in quality.score(d.withColumn("score_x", F.lit(1)), model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows) and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901]
    assert quality.score(d, quality.train(quality.sample(d, lab.where("false"), "quality", F.lit(True)))).where("score = 0.5").count() == 303


def test_token_counts(docs, spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 64)
    enc = token_counts.encoder(*token_counts.vocabulary())
    want = {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counts_of(docs.select("doc_id", "text")).collect()}
    assert got == want


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 8)
    rng, want = np.random.default_rng(2), {}
    for f in range(4):
        sizes = [0, 3, 40, 0, 7, 1] if f < 3 else []
        ids = np.concatenate([np.r_[rng.integers(0, 50000, n), 50256] for n in sizes] or [[]]).astype("<u2")
        if f == 2:
            ids = np.r_[ids, np.array([5, 6], "<u2")]
            sizes = [*sizes, 2]
        (tmp_path / f"{f}.bin").write_bytes(ids.astype("<u2").tobytes())
        want |= {(f, i): n for i, n in enumerate(sizes)}
    rows = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path))).collect()
    assert {(int(r["file"][-5]), r["ordinal"]): r["n_tokens"] for r in rows} == want


def test_token_counts_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "one two"), (1, None), (1, "a b c"), (1, "a b c"), (2, "")], "doc_id long, text string").withColumn("file", F.lit("x"))
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.counts_of(d.repartition(3)).collect()), key=str)
    assert got == sorted([(None, 2), (1, 0), (1, 3), (1, 3), (2, 0)], key=str)
    assert token_counts.counts_of(d.where("false")).collect() == []


@pytest.mark.parametrize("whole", [1 << 30, 10])
def test_token_files_by_ranges(spark, tmp_path, monkeypatch, whole):
    """Files read whole and by ranges; bytes behind the last id are left out, in a range they are an error."""
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 6)
    monkeypatch.setattr(token_counts, "WHOLE_BYTES", whole)
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 50256, 3, 50256, 50256, 4, 5, 6, 7, 8, 50256, 9], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    rows = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path))).collect()
    assert {r["ordinal"]: r["n_tokens"] for r in rows} == {0: 2, 1: 1, 2: 0, 3: 5, 4: 1}
    (tmp_path / "c.bin").write_bytes(np.array([50256] * 7, "<u2").tobytes() + b"x")
    if whole == 10:
        with pytest.raises(ValueError, match="no whole ids"):
            token_counts.read_token_files(spark, str(tmp_path))
    else:
        assert token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path))).where("file like '%c.bin'").count() == 7


def test_sentence_pieces(docs, spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    more = frame(spark, ["été  漢字\n\tx", "  lead", "▁", "a▁b", "\U0001f600 mixed", "tail  "])
    for d in (docs.select("doc_id", "text"), more.select("doc_id", "text")):
        rows = sentence_pieces.decode(sentence_pieces.encode(d, verify=True), out="back").collect()
        for r in rows:
            assert r["round_trip"]
            if r["text"] is None:
                assert r["pieces"] is None and r["back"] is None
            else:
                assert r["pieces"] == lib.encode(r["text"]) and r["back"] == r["text"].replace("▁", " ")


def test_round_trip_decodes_the_finished_ids():
    with open(sentence_pieces.model_path(), "rb") as f:
        t = sentence_pieces.Transducer(f.read())
    ids, ok = t.checked("one two three")
    assert ok and t.decode(ids) == "one two three"
    word = t.words.findall(t.normalise("one two three"))[1]
    t.kept[word] = (*t.kept[word], int(ids[0]))
    assert not t.checked("one two three")[1] and t.checked("one three")[1]


def test_normaliser():
    with open(sentence_pieces.model_path(), "rb") as f:
        t = sentence_pieces.Transducer(f.read())
    rng = random.Random(6)
    for squeeze in (0, 1):
        for prefix in (0, 1):
            t.squeeze, t.prefix, t.normaliser = squeeze, prefix, sentence_pieces.normaliser(prefix, squeeze, 1)
            for _ in range(200):
                text = "".join(rng.choice("  ab▁é") for _ in range(rng.randrange(0, 12)))
                assert t.transduce(text) == t.normalise(text)


def test_neighbours_of_pieces():
    """The acceptor against merging the joint text."""
    with open(sentence_pieces.model_path(), "rb") as f:
        t = sentence_pieces.Transducer(f.read())
    rng, names = random.Random(4), sorted(t.ids)
    short = [p for p in names if len(p) <= 3]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(4000)] + [(rng.choice(short), rng.choice(short)) for _ in range(8000)] + [(p[: len(p) // 2], p[len(p) // 2 :]) for p in names[::7] if len(p) > 1]
    assert [t.neighbours(a, b) for a, b in pairs] == [t.merged(a + b) == [a, b] for a, b in pairs]


def test_one_path_of_neighbours():
    """Of all cuts of a word into pieces, the acceptor leaves the library's alone."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    with open(sentence_pieces.model_path(), "rb") as f:
        t = sentence_pieces.Transducer(f.read())

    def cuts(word, i, last):
        if i == len(word):
            yield ()
            return
        for j, _, piece in t.arcs(word, i):
            if t.neighbours(last, word[i:j]) or (not last and j == i + 1):
                yield from ((piece, *rest) for rest in cuts(word, j, word[i:j]))

    for word in ("unbelievable", "aaaaaaa", "xyzzyx", "internationalisation", "banana"):
        assert [list(c) for c in cuts("▁" + word, 0, "")] == [lib.encode(word)] == [list(t.path("▁" + word))]


def test_unigram_shortest_path():
    t = sentence_pieces.Transducer.__new__(sentence_pieces.Transducer)
    pieces = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -5.0, "c": -1.2}
    t.trie, t.unknown, t.merges, t.byte, t.unk = {}, 20.0, False, {}, -1
    for i, (p, s) in enumerate(pieces.items()):
        at = t.trie
        for ch in p:
            at = at.setdefault(ch, {})
        at[""] = (-s, i)
    names = list(pieces)
    assert [names[i] for i in t.path("abc")] == ["ab", "c"] and t.path("axb")[1] == -1


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "small", "cell", "rows"), [(3, 90, 32, 16_384, 1 << 16), (5, 80, 2, 8, 16)])
def test_jaccard_join(docs, monkeypatch, k, num, small, cell, rows):
    for name, value in {"SMALL": small, "CELL": cell, "CELL_SHINGLES": 64 * cell, "ROWS": rows, "KEPT": rows}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    d = docs.select("doc_id", "text", F.lit(1).alias("x"), F.lit(2).alias("n"), F.lit(3).alias("own"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d, k, num, 100).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], k, num, 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_large_regions(spark, monkeypatch, seed):
    """Groups of near copies of all degrees that share a passage, so that regions hold many classes and many cells."""
    for name, value in {"SMALL": 3, "CELL": 6, "CELL_SHINGLES": 300, "ROWS": 10}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(12)]
    for _ in range(4):
        base = [word() for _ in range(20)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join([*passage, *w[: rng.randrange(8, 21)]])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, 100).collect()}
    want = brute(rows, 2, 80, 100)
    assert got == want and len({c for _, c in want.values()}) > 4


def test_jaccard_join_without_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(None, a), (4, a), (4, b), (None, b + " more"), (None, None), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda r: (r[0] or -1, r[1], r[2] or -1)
    got = sorted((tuple(r) for r in jaccard_join.join(d, 3, 90, 100).collect()), key=order)
    assert got == sorted([(None, 5, 4), (4, 5, 4), (4, 3, 4), (None, 4, None), (None, 0, None), (None, 0, None)], key=order)
    named = jaccard_join.join(d.select(F.col("doc_id").cast("string"), "text").na.fill("z", ["doc_id"]), 3, 90, 100)
    assert sorted(r["component_id"] for r in named.collect()) == ["4", "4", "4", "z", "z", "z"]


def test_jaccard_join_with_repeated_ids(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve", "so many other words here now"
    d = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (9, b), (11, c), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(d, 3, 90, 100).collect())
    assert got == [(3, 0, 3), (5, 3, 5), (5, 5, 5), (7, 5, 5), (9, 3, 5), (9, 3, 5), (11, 4, 11)]
    assert jaccard_join.join(d.where("false"), 3, 90, 100).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (102, 100), (50, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert not math.isnan(len(got))
