"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features: hashes of words and of word pairs, and the same over the words' shapes (runs of capitals, letters, digits
or one punctuation sign, and whether a word repeats the one before), so that words never seen still tell something.
A text's feature values are its shares of n-grams times ``SCALE``.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import only, prepare, read, wider
from helixframe.llm.languages import held_out
from helixframe.llm.text_kernel import U, is_word, mix, ngrams, pieces, span_hashes, spans

BITS = 20
SCALE = 30.0
#: Labelled documents that train the model, at most: those with the smallest hash of their id.
TRAIN_ROWS = 10_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.05
THRESHOLD = 0.7


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every n-gram of every text, sorted by row."""
    s, e, row = spans(is_word(data), off)
    h = span_hashes(data, s, e)
    cls = np.arange(256, dtype=np.uint8)
    cls[65:91], cls[97:123], cls[48:58], cls[128:] = 65, 97, 48, 97
    c = cls[data]
    first = np.ones(len(c), bool)
    if len(c):
        first[1:] = c[1:] != c[:-1]
        first[s] = True
    n = np.concatenate([[0], np.cumsum(first)])
    shape = span_hashes(c[first], n[s], n[e])
    if len(h) > 1:
        shape[1:] = np.where((h[1:] == h[:-1]) & (row[1:] == row[:-1]), mix(shape[1:] + U(1)), shape[1:])
    out = [(h + U(1), row), (shape + U(2), row), *[(g + U(3 + i), r) for i, (g, r) in enumerate((ngrams(h, row, 2), ngrams(shape, row, 2)))]]
    f = np.concatenate([mix(x) >> U(64 - BITS) for x, _ in out]).astype(np.int64)
    r = np.concatenate([r for _, r in out])
    return f, r


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id") -> tuple[float, np.ndarray]:
    """(bias, weights) from rows with label 0 or 1. Fits on TRAIN_ROWS documents at most, in the order of a hash of
    their id, EPOCHS times, in one task: per-coordinate FTRL is a sequential method. Nothing labelled: all zero."""
    prepare(labelled.sparkSession)

    def sparse(batches):
        for b in batches:
            ids, vals = [], []
            for _, n, data, off in pieces(b.column(0)):
                f, r = features(data, off)
                pair, cnt = np.unique(r << BITS | f, return_counts=True)
                row, idx = pair >> BITS, (pair & ((1 << BITS) - 1)).astype(np.int32)
                per = np.bincount(row, weights=cnt, minlength=n)
                v = (cnt / np.maximum(per[row], 1) * SCALE).astype(np.float32)
                at = np.searchsorted(row, np.arange(n + 1))
                ids += [idx[at[i] : at[i + 1]].tobytes() for i in range(n)]
                vals += [v[at[i] : at[i + 1]].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(ids, pa.binary()), pa.array(vals, pa.binary())], names=["y", "h", "f", "v"])

    def fit(batches):
        z, n, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(2)
        def weight(z, n):
            return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        for b in batches:
            for y, f, v in zip(b["y"], b["f"], b["v"], strict=True):
                i, x = np.frombuffer(f, np.int32), np.frombuffer(v, np.float32).astype(np.float64)
                w, b0 = weight(z[i], n[i]), -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
                p = 1 / (1 + np.exp(-np.clip(w @ x + b0, -35, 35)))
                for zz, nn, at, g, ww in ((z, n, i, (p - y) * x, w), (bias[:1], bias[1:], slice(None), np.array([p - y]), b0)):
                    sigma = (np.sqrt(nn[at] + g * g) - np.sqrt(nn[at])) / ALPHA
                    zz[at] += g - sigma * ww
                    nn[at] += g * g
        w = weight(z, n).astype(np.float32)
        at = np.flatnonzero(w).astype(np.int32)
        yield pd.DataFrame({"bias": [-bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)], "i": [at.tobytes()], "w": [w[at].tobytes()]})

    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("int").alias("y"), F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("train")).alias("h"))
    got = rows.mapInArrow(sparse, "y int, h long, f binary, v binary").withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    model = got.repartition(1).sortWithinPartitions("e", "h", "y", "f").select("y", "f", "v").mapInPandas(fit, "bias double, i binary, w binary").collect()
    out = np.zeros(1 << BITS, np.float32)
    for m in model:
        out[np.frombuffer(m["i"], np.int32)] = np.frombuffer(m["w"], np.float32)
    return float(model[0]["bias"]) if model else 0.0, out


def sample(docs: DataFrame, labels: DataFrame, label: str, where) -> DataFrame:
    """Labelled documents to train on: TRAIN_ROWS ids at most, those first by hash; a repeated id has its largest label."""
    ids = labels.where(where & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "doc_id").limit(TRAIN_ROWS)
    return docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def score(docs: DataFrame, model: tuple[float, np.ndarray], text: str = "text") -> DataFrame:
    """docs with score (0 to 1). Null and empty texts get the model's bias; repeated rows get equal scores; an empty table
    gives no rows. An input column of that name gives way to it."""
    prepare(docs.sparkSession)
    docs = docs.drop("score")
    bias, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers
    at, schema = docs.columns.index(text), wider(docs, score="double")

    def dot(batches):
        w = shared.value.astype(np.float64)
        for b in batches:
            s = np.zeros(b.num_rows)
            for i, n, data, off in pieces(b.column(at)):
                f, r = features(data, off)
                per = np.maximum(np.bincount(r, minlength=n), 1)
                s[i : i + n] = np.bincount(r, weights=w[f], minlength=n) / per * SCALE
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(1 / (1 + np.exp(-np.clip(s + bias, -35, 35))), 9))], names=[*b.schema.names, "score"])

    return docs.mapInArrow(dot, schema)


def op7_ftrl_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from three quarters of the labels."""
    docs = only(read(spark, sf_dir, "documents"), "doc_id", "text")
    labels = only(read(spark, sf_dir, "labels"), "doc_id", "quality")
    model = train(sample(docs, labels, "quality", ~held_out(4, 2)))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
