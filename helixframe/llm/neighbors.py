"""Approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional codewords are learned one after the other on what the codebooks before leave over;
every vector is encoded by a beam search over the sums of one codeword from each book. The index keeps the codes
of every distinct vector, and its angle to its code. A query scores codes by table look-up (its products with all
codewords). The angle to the code and the code's to its vector bound the cosine of query and vector, and every vector
whose bound reaches the k-th best cosine found so far is compared exactly. So the result is exact whatever the rows are:
where codes tell little, more is compared.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import cut, only, prepare, read

BOOKS, WORDS, BEAM = 16, 256, 8
#: Distinct vectors that the codebooks are fitted on, at most: those first by a hash.
FIT_ROWS = 20_000
#: Rounds of joint refinement of the codebooks, and sweeps over the books in each.
ROUNDS, SWEEPS = 1, 3
#: Rows with the best codes of a chunk that are compared exactly first; all others follow whose bound allows it.
RERANK = 400
#: What float sums may lack; share of pairs left from which on products of whole matrices pay; rows of a piece.
SLACK, DENSE, PIECE = 1e-4, 0.05, 2048
#: Bytes of the queries that are broadcast at once; queries scored together; codes scored together; codes of a task.
QUERY_BYTES, TILE, CHUNK, TASK_CODES = 4 << 20, 128, 16_384, 1 << 20
#: Bytes of the vectors of a row of the index, of those scored together and of pairs compared at once.
ROW_BYTES, CHUNK_BYTES, PAIR_BYTES = 64 << 10, 16 << 20, 16 << 20


def valid(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null, not empty, has no null or non-finite component and is not zero."""
    c = F.col(f"`{vec}`")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(c.isNotNull() & (F.size(c) > 0)).where(~bad & F.exists(c, lambda x: x != 0))


def fit(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """BOOKS x WORDS x dim codebooks of unit vectors x: k-means of what the books before leave over, then ROUNDS times
    encoding by beam search and refining all books jointly (each word becomes the mean of what the other books leave)."""
    rng, books, rest = np.random.default_rng(seed), [], x.astype(np.float32).copy()
    for _ in range(BOOKS):
        c = rest[rng.choice(len(rest), WORDS, replace=len(rest) < WORDS)]
        for _ in range(8):
            near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=WORDS)
            c = np.where(n[:, None] > 0, sums(near, rest) / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), WORDS)])
        rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)]
        books.append(c.astype(np.float32))
    books = np.stack(books)
    for _ in range(ROUNDS):
        codes = np.concatenate([encode(x[i : i + 512], books) for i in range(0, len(x), 512)])
        rest = x - books[np.arange(BOOKS), codes].sum(1)
        for _ in range(SWEEPS):
            for j in range(BOOKS):
                own = rest + books[j, codes[:, j]]
                n = np.bincount(codes[:, j], minlength=WORDS)[:, None]
                books[j] = np.where(n > 0, sums(codes[:, j], own) / np.maximum(n, 1), books[j])
                rest = own - books[j, codes[:, j]]
    return books


def sums(of: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum of the rows x of each word."""
    order = np.argsort(of, kind="stable")
    out = np.zeros((WORDS, x.shape[1]), np.float32)
    words, first = np.unique(of[order], return_index=True)
    out[words] = np.add.reduceat(x[order], first, axis=0)
    return out


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of x by beam search: the BEAM best partial sums go on to the next codebook."""
    n, d = x.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :].astype(np.float32)
    for c in books:
        err = (rest * rest).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
        flat = err.reshape(n, -1)
        keep = np.argpartition(flat, min(BEAM, flat.shape[1]) - 1, axis=1)[:, :BEAM]
        b, w = keep // len(c), keep % len(c)
        at = np.arange(n)[:, None]
        codes = np.concatenate([codes[at, b], w[:, :, None].astype(np.uint8)], axis=2)
        rest = rest[at, b] - c[w]
    return codes[np.arange(n), (rest * rest).sum(2).argmin(1)]


def search(base: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, its own row left out.

    Score: cosine in double precision on the original vectors; ties to the smaller id. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor those of another length than most have. Equal
    vectors are one entry of the index with its smallest k + 1 ids, which is exact: the others can't be among the
    k nearest. Queries with the same id twice give rows for each. No rows, or no queries, give none.
    """
    spark = base.sparkSession
    prepare(spark)
    b = valid(base.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("v")), "v").where("id is not null")
    size = b.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    dim = size["d"]
    b = b.where(F.size("v") == dim)
    # equal vectors: each task's smallest ids, then the smallest of all, so that a hot vector stays small
    near = F.expr(f"slice(array_sort(collect_set(id)), 1, {k + 1})")
    b = b.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("v", "salt").agg(near.alias("ids"))
    b = b.groupBy("v").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(ids)))), 1, {k + 1})").alias("ids"))
    b = cut(b.select(F.col("ids")[0].alias("id"), "ids", "v"))
    train = b.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toPandas()["v"]
    x = np.stack(train.to_list()).astype(np.float64)
    books = fit((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))

    per_row = max(1, ROW_BYTES // (8 * dim))

    def index(batches):
        for t in batches:
            if not len(t):
                continue
            v = np.stack(t["v"].to_list()).astype(np.float64)
            unit = v / norms(v)
            codes = np.concatenate([encode(unit[i : i + 512].astype(np.float32), books) for i in range(0, len(unit), 512)])
            made = books[np.arange(BOOKS), codes].sum(1, dtype=np.float64)
            size = np.maximum(norms(made)[:, 0], 1e-12)
            # the angle between a vector and its code, as a cosine
            near = np.clip((unit * made).sum(1) / size, -1, 1)
            held, ids = t["ids"].map(len).to_numpy().astype(np.int32), np.zeros((len(t), k + 1), np.int64)
            for row, x in zip(ids, t["ids"], strict=True):
                row[: len(x)] = x
            parts = [slice(i, i + per_row) for i in range(0, len(t), per_row)]
            yield pd.DataFrame([(len(v[p]), *[x[p].tobytes() for x in (ids, held, v, codes, size.astype(np.float32), near.astype(np.float32))]) for p in parts], columns=["n", "ids", "held", "v", "code", "norm", "near"])

    # the codes stay with their vectors, in blocks; a task takes whole blocks of about TASK_CODES codes
    columns = "n long, ids binary, held binary, v binary, code binary, norm binary, near binary"
    codes = cut(b.select("ids", "v").mapInPandas(index, columns))
    n = codes.agg(F.sum("n")).first()[0]
    codes = codes.coalesce(max(-(-n // TASK_CODES), min(spark.sparkContext.defaultParallelism, -(-n // CHUNK))))
    q = valid(queries.select(F.col(f"`{key}`").alias("qid"), F.col(f"`{vec}`").cast("array<double>").alias("q")), "q").where(F.col("qid").isNotNull() & (F.size("q") == dim))
    # a stated query set against all rows, in blocks: a block of about QUERY_BYTES at most is broadcast
    per = max(1, QUERY_BYTES // (4 * dim))
    q = cut(q)
    nq, out = q.count(), []
    blocks = 1 if nq <= per else -(-5 * nq // (4 * per))
    dealt = q.withColumn("blk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    for i in range(blocks):
        mine = dealt.where(F.col("blk") == i).select("qid", "q").toPandas().sort_values("qid", kind="stable", ignore_index=True)
        if len(mine):
            out.append(_block(spark, codes, books, mine["qid"].to_numpy().astype(np.int64), np.stack(mine["q"].to_list()).astype(np.float64), k))
    if not out:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1, keepdims=True))


def bound(c: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Largest cosine that a query with cosine c to a code can have to a vector with cosine near to it: angles add up.
    SLACK covers the float sums."""
    c = np.clip(c, -1, 1)
    return c * near + np.sqrt((1 - c * c + SLACK) * (1 - near * near + SLACK)) + SLACK


class Nearest:
    """The k + 1 best entries found for each query of a tile (one may be the query's own), by score, then smallest id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.norm, self.keep = q, norms(q), k + 1
        self.s, self.ids = np.full((len(q), k + 1), -np.inf), np.zeros((len(q), k + 1, k + 1), np.int64)
        self.held = np.zeros((len(q), k + 1), np.int32)

    def exact(self, u: np.ndarray, r: np.ndarray, v: np.ndarray, vn: np.ndarray) -> np.ndarray:
        """Cosines of the pairs (query u, row r), in double precision."""
        per, out = max(1, PAIR_BYTES // (8 * v.shape[1])), np.empty(len(u))
        for i in range(0, len(u), per):
            a, b = u[i : i + per], r[i : i + per]
            out[i : i + per] = (self.q[a] * v[b]).sum(1) / (self.norm[a, 0] * vn[b, 0])
        return out

    def take(self, u: np.ndarray, r: np.ndarray, s: np.ndarray, ids: np.ndarray, held: np.ndarray) -> None:
        """Enter the scored pairs (query u, row r)."""
        least = s >= self.s[u, -1]
        u, r, s = u[least], r[least], s[least]
        # the best of each query's new pairs, then with those it has
        order = np.lexsort((ids[r, 0], -s, u))
        u, r, s = u[order], r[order], s[order]
        first = np.searchsorted(u, u, "left")
        best = np.arange(len(u)) - first < self.keep
        u, r, s, place = u[best], r[best], s[best], (np.arange(len(u)) - first)[best]
        changed, at = np.unique(u, return_inverse=True)
        both = np.full((len(changed), 2 * self.keep), -np.inf)
        new_ids, new_held = np.zeros((*both.shape, self.keep), np.int64), np.zeros(both.shape, np.int32)
        both[:, : self.keep], new_ids[:, : self.keep], new_held[:, : self.keep] = self.s[changed], self.ids[changed], self.held[changed]
        both[at, self.keep + place], new_ids[at, self.keep + place], new_held[at, self.keep + place] = s, ids[r], held[r]
        top = np.lexsort((new_ids[:, :, 0], -both), axis=1)[:, : self.keep]
        rows = np.arange(len(changed))[:, None]
        self.s[changed], self.ids[changed], self.held[changed] = both[rows, top], new_ids[rows, top], new_held[rows, top]

    def add(self, c: np.ndarray, near: np.ndarray, v: np.ndarray, vn: np.ndarray, ids: np.ndarray, held: np.ndarray) -> None:
        """Rows v whose codes have cosines c with the queries: the best codes are compared first, then every row whose
        bound is not below what the query has by then."""
        ranked = min(RERANK, c.shape[1])
        top = np.argpartition(-c, ranked - 1, axis=1)[:, :ranked]
        done = np.zeros(c.shape, bool)
        np.put_along_axis(done, top, True, 1)
        u, r = np.nonzero(done)
        self.take(u, r, self.exact(u, r, v, vn), ids, held)
        left = (bound(c, near) >= self.s[:, -1:]) & ~done
        if left.mean() > DENSE:
            # most rows are left: their products at once say which are compared
            left &= (self.q / self.norm) @ (v / vn).T >= self.s[:, -1:] - 1e-9
        for i in range(0, c.shape[1], PIECE):
            u, r = np.nonzero(left[:, i : i + PIECE])
            if len(u):
                self.take(u, r + i, self.exact(u, r + i, v, vn), ids, held)
                left[:, i + PIECE :] &= bound(c[:, i + PIECE :], near[i + PIECE :]) >= self.s[:, -1:]


def _block(spark, codes: DataFrame, books: np.ndarray, qid: np.ndarray, qv: np.ndarray, k: int) -> DataFrame:
    """Result rows of one block of queries (u is a query's place in it)."""
    shared = spark.sparkContext.broadcast((qid, qv))
    dim = qv.shape[1]
    most = max(1, min(CHUNK, CHUNK_BYTES // (8 * dim)))

    def lookup(batches):
        ask, m = shared.value
        best = [Nearest(m[i : i + TILE], k) for i in range(0, len(m), TILE)]
        unit = [(t.q / t.norm).astype(np.float32) for t in best]

        def add(held):
            ids, n_ids, v, code, norm, near = (np.concatenate(x) for x in zip(*held, strict=True))
            vn = norms(v)
            for t, x in zip(best, unit, strict=True):
                table = np.einsum("qd,bwd->bqw", x, books, optimize=True)
                s = np.zeros((len(x), len(code)), np.float32)
                for j in range(BOOKS):
                    s += table[j][:, code[:, j]]
                t.add(s / norm, near, v, vn, ids, n_ids)

        held, size = [], 0
        for t in batches:
            for x in t.itertuples(index=False):
                held.append((np.frombuffer(x.ids, np.int64).reshape(-1, k + 1), np.frombuffer(x.held, np.int32), np.frombuffer(x.v, np.float64).reshape(-1, dim), np.frombuffer(x.code, np.uint8).reshape(-1, BOOKS), np.frombuffer(x.norm, np.float32), np.frombuffer(x.near, np.float32)))
                size += len(held[-1][0])
                if size >= most:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        for i, t in enumerate(best):
            u, place = np.nonzero(t.held)
            yield pd.DataFrame({"u": u + i * TILE, "qid": ask[u + i * TILE], "s": t.s[u, place], "ids": [list(x[:n]) for x, n in zip(t.ids[u, place], t.held[u, place], strict=True)]})

    found = codes.mapInPandas(lookup, "u long, qid long, s double, ids array<long>")
    full = found.select("u", "qid", "s", F.explode("ids").alias("id")).where("id <> qid")
    full = full.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "id"))).where(F.col("rank") <= k)
    return full.select(F.col("qid").cast("long").alias("query_id"), F.col("rank").cast("int"), F.col("id").cast("long").alias("vec_id"), F.col("s").alias("score"))


def op6_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    """5 nearest of every vector whose id is divisible by 50."""
    e = only(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(e, e.where(F.col("vec_id") % 50 == 0))
