"""The corpus pipeline, stage by stage, on a small corpus."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, path = random.Random(3), tmp_path_factory.mktemp("sf")
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 90))) for _ in range(60)]
    junk = ["### $$$ " * rng.randrange(5, 30) for _ in range(20)]
    texts += [t + " end" for t in texts[:10]] + [texts[0]] * 3
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n + i, t, "en", "s1", len(t)) for i, t in enumerate(junk)] + [(n + 20, None, None, None, None), (n + 21, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < n), 0) for i in range(n + 20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), n


def test_stages(spark, sf):
    path, n = sf
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit(1))
    names = [x for x, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        steps[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in steps["quality"]} == set(range(n))
    assert {r["doc_id"] for r in steps["language"]} == set(range(n))
    want = brute([(r["doc_id"], r["text"]) for r in steps["language"]], 5, 80, 100)
    assert sorted(r["doc_id"] for r in steps["near duplicates"]) == sorted(i for i, (_, c) in want.items() if i == c)
    times = Counter(r["doc_id"] for r in steps["mixing"])
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in steps["near duplicates"]}
    last = steps["sentence pieces"]
    assert Counter(r["doc_id"] for r in last) == times and all(r["round_trip"] for r in last)
    whole = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in whole) == times


def test_language_keeps_short_clean_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)] + [" ".join(rng.choice(words) for _ in range(n)) for n in range(1, 13) for _ in range(5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000, "123 !!", "en", "s", 6), (1001, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == list(range(len(texts)))


def test_null_and_repeated_ids(spark):
    a, b, c, d = "one two three four five six seven", "eight nine ten eleven twelve", "so many other words here now", "yet another text of some six words"
    rows = [(5, a), (7, a), (7, c), (9, b), (9, b), (None, d), (None, a), (None, "quite different words in this one here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").cache()
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(5, a), (7, c), (9, b), rows[5], rows[7]])
    one = docs.where("doc_id is null or doc_id = 9")
    taken = Counter(r["times"] for r in corpus_pipeline.mixing_stage(spark, one, "").groupBy("text").agg(F.count("*").alias("times")).collect())
    mixed = corpus_pipeline.mixing.mix(one.select("doc_id", "text", "source"))
    want = mixed.select(F.round(F.col("taken") / F.col("size")).alias("t")).agg(F.sum("t")).first()[0]
    assert sum(k * n for k, n in taken.items()) == want
    assert corpus_pipeline.mixing_stage(spark, docs.where("doc_id is null"), "").count() > 0
