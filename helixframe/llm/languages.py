"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from its code point). An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place. A text's vector bundles (adds) its n-grams' vectors; a
language's prototype bundles its documents', each with equal weight. A text gets the language of the nearest
prototype by cosine.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import only, prepare, read, wider
from helixframe.llm.text_kernel import U, mix, pieces

DIM = 1024
N = 3
#: N-grams whose vectors are in memory at once.
GRAMS = 4096
#: Languages are few; more distinct labels than this are refused, as prototypes are broadcast.
MAX_LANGUAGES = 10_000


@lru_cache(maxsize=65536)
def letter(symbol: int) -> np.ndarray:
    """Random vector of a letter; 0 is the gap between words."""
    x = mix(np.arange(DIM // 64, dtype=U) + U(symbol * 1_000_003 + 17))
    return np.unpackbits(mix(x).view(np.uint8)).astype(np.int8) * 2 - 1


@lru_cache(maxsize=65536)
def symbol(cp: int) -> int:
    """Lower-cased letter of a code point, 0 if it is none."""
    c = chr(cp)
    return ord(c.lower()[0]) if c.isalpha() else 0


def profiles(data: np.ndarray, off: np.ndarray):
    """(bundled vectors by text, numbers of n-grams, texts with a letter) of one piece. The vectors of the n-grams are
    made for GRAMS of them at a time."""
    rows = len(off) - 1
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]  # code points before each text
    seen = np.flatnonzero(np.bincount(cps, minlength=1))
    syms = np.array([symbol(int(c)) for c in seen], dtype=np.int64)
    alphabet, idx = np.unique(np.concatenate([[0], syms]), return_inverse=True)
    lut = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, dtype=np.int64)
    lut[seen] = idx[1:]
    # a gap before and after each text, and runs of other signs count as one gap
    s = np.insert(lut[cps], at, 0) if len(cps) else np.zeros(rows + 1, np.int64)
    doc = np.repeat(np.arange(rows), np.diff(at) + 1)
    doc = np.append(doc, rows - 1)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s, doc = s[keep], doc[keep]
    has = np.bincount(doc[s != 0], minlength=rows) > 0
    n = len(s) - N + 1
    if n <= 0:
        return np.zeros((rows, DIM), np.float32), np.zeros(rows), has
    a = len(alphabet)
    code = (s[:n] * a + s[1 : n + 1]) * a + s[2 : n + 2]
    # the n-gram belongs to the text of its middle letter; grams around a gap between texts carry no letter pair
    row = doc[1 : n + 1]
    ok = (s[1 : n + 1] != 0) | ((s[:n] != 0) & (s[2 : n + 2] != 0) & (doc[:n] == doc[2 : n + 2]))
    code, row = code[ok], row[ok]
    pair, count = np.unique(code * rows + row, return_counts=True)
    gram, row = pair // rows, pair % rows
    base = np.stack([letter(int(x)) for x in alphabet])
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    out = np.zeros((rows, DIM), np.float32)
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    number = np.cumsum(new) - 1
    grams = gram[new]
    for i in range(0, len(grams), GRAMS):
        g = grams[i : i + GRAMS]
        at = slice(*np.searchsorted(number, (i, i + len(g))))
        counts = np.zeros((rows, len(g)), np.float32)
        counts[row[at], number[at] - i] = count[at]
        out += counts @ (first[g // (a * a)] * second[g // a % a] * base[g % a]).astype(np.float32)
    return out, np.bincount(row, weights=count, minlength=rows), has


def parts(data: np.ndarray, off: np.ndarray, most: int = 256):
    for i in range(0, len(off) - 1, most):
        j = min(i + most, len(off) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language. Rows with null text, null language or no letter teach nothing; an empty table
    gives none. Each task sends one vector for each language; they are added by (language, dimension)."""
    prepare(docs.sparkSession)

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            tags = np.array(b.column(1).to_pylist(), dtype=object)
            for i, n, data, off in pieces(b.column(0)):
                for j, d, o in parts(data, off):
                    vec, n_grams, has = profiles(d, o)
                    t = tags[i + j : i + j + len(o) - 1]
                    share = vec / np.maximum(n_grams, 1)[:, None]
                    for tag in set(t):
                        m = (t == tag) & has
                        if m.any():
                            total[tag] = total.get(tag, 0) + share[m].sum(0, dtype=np.float64)
        yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [v.tolist() for v in total.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"))
    sums = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # rounded, as the order of the sums over tasks is free
    vecs = {r["lang"]: np.round(np.array([x["x"] for x in r["v"]]), 6) for r in got}
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(vecs.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score (cosine, cut to 0..1); ``und`` and 0 for null texts, texts without a letter, or
    if nothing was learned. Ties go to the first language by name. Repeated rows get equal results, an empty table gives
    no rows, and an input column with the name of a result gives way to it."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = list(prototypes)
    proto = np.stack(list(prototypes.values())).astype(np.float32) if names else np.zeros((0, DIM), np.float32)
    out_schema = wider(docs, lang_pred="string", score="double")
    at = docs.columns.index(text)

    def guess(batches):
        for b in batches:
            tag, score = np.full(b.num_rows, "und", dtype=object), np.zeros(b.num_rows)
            for i, n, data, off in pieces(b.column(at)):
                for j, d, o in parts(data, off):
                    docv, _, has = profiles(d, o)
                    if not names or not has.any():
                        continue
                    cos = (docv @ proto.T) / np.maximum(np.linalg.norm(docv, axis=1, keepdims=True), 1e-12)
                    cos = np.round(cos.astype(np.float64), 6)
                    best = cos.argmax(1)
                    for r in np.flatnonzero(has):
                        tag[i + j + r] = names[best[r]]
                        score[i + j + r] = min(1.0, max(0.0, cos[r, best[r]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tag, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(guess, out_schema)


def held_out(n: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % n == rest


def op2_hd_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from four fifths of the labelled documents."""
    docs = only(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    prototypes = learn(docs.where(~F.coalesce(held_out(5, 0), F.lit(False))))
    # every row is predicted from its text alone
    return predict(docs.select("doc_id", "text"), prototypes).select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")
