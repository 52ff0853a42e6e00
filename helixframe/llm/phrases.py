"""Phrase collocations by level-wise (Apriori) passes.

Level k counts the k-grams whose both overlapping (k-1)-grams are frequent. The frequent grams of the levels before
travel to the tasks as a sieve: a bitmap of 16 bits a gram, two of them set, and of ``BITS`` bits at most. A sieve lets
some others through (equal bits), never too few, and the counts are kept by the grams themselves, so they are exact
whatever the size of the sieve. Cuts are scored from the level tables by joins.
"""

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import cut, only, read

BITS = 1 << 28
#: Words that are numbered at once, grams that a task holds before it counts them, rows of a batch handed over.
CHUNK, HELD, ROWS = 1 << 18, 1 << 22, 1 << 16
#: Bits of a word's number, so that three fit 64 bits.
NUMBER = 21
#: First groups of the ranking; each hands on at most as many rows as are asked for.
GROUPS = 256
#: Bytes as a count sees them: A-Z lowered, ends of pieces as line feeds, tabs as blanks.
SEEN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of grams that a word is put behind."""
    h = h * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def gram_hash(lang: bytes, gram: bytes) -> int:
    h = word_hashes(lang, gram.split(b" "))
    return int(reduce(lambda x, y: mixed(x, y), (h[i : i + 1] for i in range(len(h))))[0])


class Sieve:
    """Frequent grams of a level: some others may pass, none is lost."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap  # of 64-bit cells, a power of two of them

    @classmethod
    def of(cls, frequent: DataFrame, most: int = BITS) -> "Sieve":
        """From (lang, gram). The driver holds ``most`` / 4 bytes at most, whatever the number of grams."""
        bits = min(most, max(64, 1 << (16 * frequent.count()).bit_length()))

        def places(batches):
            for b in batches:
                h = np.array([gram_hash(x.encode(), g.encode()) for x, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], dtype=np.uint64)
                both = np.concatenate([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both >> 6), pa.array(np.left_shift(np.int64(1), both & 63))], names=["i", "b"])

        cells = frequent.select("lang", "gram").mapInArrow(places, "i long, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
        bitmap = np.zeros(bits // 64, dtype=np.int64)
        bitmap[cells.column("i").to_numpy()] = cells.column("b").to_numpy()
        return cls(bitmap)

    def passes(self, h: np.ndarray) -> np.ndarray:
        last = np.uint64(self.bitmap.size * 64 - 1)
        at = (h & last).astype(np.int64)
        ok = (self.bitmap[at >> 6] >> (at & 63)) & 1
        at = ((h >> np.uint64(32)) & last).astype(np.int64)
        return (ok & (self.bitmap[at >> 6] >> (at & 63))) & 1 > 0


class Numbers(dict):
    """Words by number, in the order they come."""

    def __init__(self):
        super().__init__({b"": 0})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


class Grams:
    """The k-grams (k > 1) of one language in one task, by numbers of words that hold until the next ``drain``."""

    def __init__(self, lang: bytes, k: int, sieves: list[Sieve]):
        self.lang, self.k, self.sieves = lang, k, sieves
        self.reset()

    def reset(self) -> None:
        self.numbers, self.hash, self.ok = Numbers(), np.zeros(1, np.uint64), np.zeros(1, bool)
        self.codes: list[np.ndarray] = []
        self.held = self.bytes = 0

    def add(self, flat: list[bytes]) -> None:
        """Words in order, with an empty one behind each piece."""
        names = self.numbers.names
        was = len(names)
        words = np.fromiter(map(self.numbers.__getitem__, flat), dtype=np.int64, count=len(flat))
        fresh = word_hashes(self.lang, names[was:])
        self.bytes += sum(map(len, names[was:])) + 128 * len(fresh)
        self.hash, self.ok = np.concatenate([self.hash, fresh]), np.concatenate([self.ok, self.sieves[0].passes(fresh)])
        there, hashes = self.ok[words], self.hash[words]
        h = hashes
        for j in range(1, self.k):
            there = there[:-1] & there[1:]
            if j < self.k - 1:
                h = mixed(h[:-1], hashes[j:])
                at = np.flatnonzero(there)
                there[at] = self.sieves[j].passes(h[at])
        at = np.flatnonzero(there)
        if self.k <= 3:
            code = words[at]
            for j in range(1, self.k):
                code = code << NUMBER | words[at + j]
        else:
            code = np.stack([words[at + j] for j in range(self.k)], axis=1)
        self.codes.append(code)
        self.held += len(code)

    @property
    def full(self) -> bool:
        return self.held > HELD or self.bytes > 32 * HELD or len(self.numbers.names) > (1 << NUMBER) - CHUNK

    def drain(self):
        """Batches of (gram, count)."""
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.int64)
        names = pa.array(self.numbers.names, pa.large_binary())
        k, lang = self.k, self.lang
        self.reset()
        codes, n = np.unique(codes, return_counts=True, axis=0 if codes.ndim > 1 else None)
        for i in range(0, len(codes), ROWS):
            c = codes[i : i + ROWS]
            parts = [c[:, j] if c.ndim > 1 else c >> (NUMBER * (k - 1 - j)) & ((1 << NUMBER) - 1) for j in range(k)]
            grams = pc.binary_join_element_wise(*[names.take(pa.array(p)) for p in parts], pa.scalar(b" ", pa.large_binary()))
            yield batch(lang, grams.cast(pa.binary()), n[i : i + ROWS])


def batch(lang: bytes, grams, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.binary()), grams if isinstance(grams, pa.Array) else pa.array(grams, pa.binary()), pa.array(n, pa.int64())], names=["lang", "gram", "f"])


class Words:
    """Words of one language in one task."""

    def __init__(self, lang: bytes):
        self.lang, self.counts, self.total = lang, Counter(), 0

    def add(self, flat: list[bytes]) -> None:
        self.counts.update(flat)
        self.total += len(flat) - self.counts.pop(b"", 0)

    @property
    def full(self) -> bool:
        return len(self.counts) > HELD // 8

    def drain(self):
        counts, total = self.counts, self.total
        self.counts, self.total = Counter(), 0
        grams, n = list(counts), list(counts.values())
        for i in range(0, len(grams), ROWS):
            yield batch(self.lang, grams[i : i + ROWS], n[i : i + ROWS])
        if total:
            yield batch(self.lang, [None], [total])


def pieces(text: bytes) -> list[list[bytes]]:
    """Words of each piece of a text."""
    return [p.split() for p in text.translate(SEEN).split(b"\n")]


def level(docs: DataFrame, k: int, sieves: list[Sieve], least: int) -> DataFrame:
    """(lang, gram, f) of the k-grams that occur ``least`` times at least in docs (lang, text); k = 1 gives for each
    language also the number of its words, under a null gram."""
    shared = docs.sparkSession.sparkContext.broadcast(sieves)

    def go(batches):
        held: dict[bytes, Words | Grams] = {}
        waiting: dict[bytes, list[bytes]] = {}

        def take(lang: bytes):
            c = held.get(lang) or held.setdefault(lang, Words(lang) if k == 1 else Grams(lang, k, shared.value))
            c.add(waiting.pop(lang))
            if c.full:
                yield from c.drain()

        for b in batches:
            for lang, text in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                flat = waiting.setdefault(lang, [])
                for words in pieces(text):
                    if words:
                        flat += words
                        flat.append(b"")
                    if len(flat) > CHUNK:
                        yield from take(lang)
                        flat = waiting.setdefault(lang, [])
            while sum(map(len, waiting.values())) > CHUNK:
                yield from take(max(waiting, key=lambda x: len(waiting[x])))
            while sum(c.held for c in held.values() if k > 1) > HELD:
                yield from max(held.values(), key=lambda c: c.held).drain()
        for lang in list(waiting):
            yield from take(lang)
        for c in held.values():
            yield from c.drain()

    parts = docs.mapInArrow(go, "lang binary, gram binary, f long")
    parts = parts.select(F.col("lang").cast("string").alias("lang"), F.col("gram").cast("string").alias("gram"), "f")
    return parts.groupBy("lang", "gram").agg(F.sum("f").alias("f")).where(F.col("gram").isNull() | (F.col("f") >= least))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10, cover: int = 50, top: int = 2000, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of each language, best first.

    Candidates are phrases of 2 to ``words`` words that occur ``least`` times; a cut is scored floor(1000000 a a / (l r))
    and the lowest one counts (ties: the first). A candidate inside a longer one that occurs in ``cover`` of 100 of its
    places goes. Ties of score and a are ordered by the phrase's bytes. Null languages are ``und``, which joins rows that
    are so labelled; null and empty texts have no words; repeated rows count again; other columns don't matter. An
    empty table gives no rows. Products are decimals of 38 digits; more is an error of Spark, not a wrong score.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    tables, sieves = [], []
    for k in range(1, words + 1):
        t = cut(level(rows, k, sieves, least))
        if k == 1:
            total = t.where("gram is null").select("lang", F.col("f").alias("n"))
        tables.append(t.where("gram is not null"))
        if k < words:
            sieves.append(Sieve.of(tables[-1], bits))
    freq = reduce(DataFrame.unionByName, tables)
    cand = reduce(DataFrame.unionByName, [t.withColumn("m", F.lit(k + 2)) for k, t in enumerate(tables[1:])])
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cand.withColumn("w", F.split("gram", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "gram", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    side = lambda gram, f: freq.select("lang", F.col("gram").alias(gram), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).withColumn("down", wide("l") * wide("r"))
    best = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("c"))
    inner = cand.where("m > 2").withColumn("w", F.split("gram", " ")).withColumn("s", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("s") + 1))).select("lang", part(F.col("i"), F.col("s")).alias("gram"), "f")
    over = inner.groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    left = best.join(over, ["lang", "gram"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
    left = left.select("lang", F.col("gram").alias("phrase"), "a", "c.l", "c.r", "c.score")
    # the best of a language are among the best of its groups, so no window holds a language's candidates
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top)
    out = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_apriori_phrases(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents; odd rows behave as in ``phrases``."""
    return phrases(only(read(spark, sf_dir, "documents"), "text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, p
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS p FROM documents)),
w AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
t AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
n AS (SELECT lang, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM t WINDOW x AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, 1 AS k, w AS gram FROM n UNION ALL SELECT lang, 2, w || ' ' || w2 FROM n WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM n WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k AS m, gram, f AS a, string_split(gram, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.gram, c.a, x.f AS l, y.f AS r, s.s AS k, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
         FROM cand c JOIN (VALUES (1), (2)) s(s) ON s.s < c.m
         JOIN f x ON x.lang = c.lang AND x.gram = array_to_string(c.w[1:s.s], ' ')
         JOIN f y ON y.lang = c.lang AND y.gram = array_to_string(c.w[s.s + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
longer AS (SELECT lang, gram, max(f) AS f FROM (
  SELECT lang, w[1] || ' ' || w[2] AS gram, a AS f FROM cand WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.gram = b.gram WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, score::BIGINT AS score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
