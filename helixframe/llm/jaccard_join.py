"""Exact n-gram Jaccard join in a metric space.

Documents are points of the metric space of sets (Jaccard distance, and size of the symmetric difference). Equal sets
are joined first and go on as one point.

Regions: the pivots are the sets of one shingle, in one global order, rare shingles first. The distance of a point to a
pivot is 1 - 1/n if it holds the shingle and 1 if not, so its Voronoi region is that of the first of its shingles in the
order. Let the distance of two points be at most 1 - t. Their common part is then at least t times the larger set, so by
the triangle inequality their nearest common pivot stands among the first n - ceil(t n) + 1 shingles of each: within this
window a point is replicated to the pivots' regions, and every linked pair meets in the region of its first common
shingle. The order comes from a fixed-size count sketch of all documents; an error in it costs time, not links.

Bounds inside a region: rows carry n and the number of shingles from this pivot on. Where the pivot is the first common
one, the common part is at most the smaller of these numbers, which leaves few pairs. A region of at most ``SMALL``
points gives its pairs by these bounds; only ids travel. Of a larger region at first only neighbours in the order of
sizes are paired. A spanning forest of the pairs is compared by the whole texts, then the pairs that still stand between
two classes.

Large regions that then hold points of several classes are joined again, recursively by cells: the points outside of
the region's main class meet all others of the region, cell by cell, where a cell has a bounded number of points and
shingles. The sizes of ``SLICES`` slices of the space of hashes prune by the triangle inequality (the common part is at
most the sum over the slices of the smaller part), and what is left is compared by whole sets.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from helixframe.llm.common import components, cut, only, prepare, read
from helixframe.llm.text_kernel import U, mix, ngrams, pieces, words

SKETCH_BITS, SKETCH_PARTS = 22, 64
SLICES = 128
#: Most points of a cell, on average, and most shingles.
CELL, CELL_SHINGLES = 16_384, 1 << 21
#: Ids of points whose texts are wanted are broadcast up to this number (8 bytes each).
BROADCAST_ROWS = 1_000_000
#: Regions of at most this many points give their pairs at once.
SMALL = 32
#: Rows of a set's copies are dealt to so many parts before they meet.
SALT = 64
#: Signatures that a task keeps to leave out copies; rows that it holds before it works on them.
KEPT, ROWS = 1 << 20, 1 << 16
#: Rows of an Arrow batch that hold whole texts of two points or of a cell.
WIDE = 16


def shingles(data: np.ndarray, off: np.ndarray, k: int):
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle."""
    h, row = words(data, off)
    n = np.bincount(row, minlength=len(off) - 1)
    g, r = ngrams(h, row, k)
    at = np.searchsorted(r, np.arange(len(off)))
    start = np.concatenate([[0], np.cumsum(n)])
    for i in range(len(off) - 1):
        if n[i] >= k:
            s = np.sort(g[at[i] : at[i + 1]])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            yield s[keep]
        elif n[i]:
            x = np.zeros(1, U)
            for j, w in enumerate(h[start[i] : start[i + 1]]):
                x = mix(x * U(3) + w + U(j))
            yield mix(x + U(int(n[i])))
        else:
            yield np.zeros(0, U)


def of_batch(column, k: int):
    for _, _, data, off in pieces(column):
        yield from shingles(data, off, k)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2) of rows (doc_id, text): size and 128-bit signature of each set."""

    def sign(batches):
        for b in batches:
            n, s1, s2 = [], [], []
            for s in of_batch(b.column(1), k):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    s1.append(int(mix(s + U(11)).sum(dtype=U).view(np.int64)) if len(s) else 0)
                    s2.append(int(mix(s + U(23)).sum(dtype=U).view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(sign, "doc_id long, n long, s1 long, s2 long")


def sketch_of(docs: DataFrame, k: int) -> np.ndarray:
    """Frequency class (8 bits) of each of 2**SKETCH_BITS hash cells over all documents: 4 MB at any size."""
    part = (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches):
        c = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for _, _, data, off in pieces(b.column(0)):
                h, row = words(data, off)
                g, _ = ngrams(h, row, k)
                c += np.bincount((g >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(c)).astype(np.uint32)
        small = np.minimum(c, 65535).astype("<u2")
        packed = [zlib.compress(small[i * part : (i + 1) * part].tobytes(), 1) for i in range(SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "c"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.uint64)
        for c in pdf["c"]:
            total += np.frombuffer(zlib.decompress(c), "<u2")
        cls = np.minimum(np.log2(1.0 + total) * 8, 255).astype(np.uint8)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "c": [cls.tobytes()]})

    counts = docs.select("text").mapInArrow(count, "part int, c binary")
    got = counts.groupBy("part").applyInPandas(add, "part int, c binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in got:
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["c"], np.uint8)
    return out


def regions_of(docs: DataFrame, sketch: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(e, s1, q): the regions of each set, by its first shingles in the global order; s1 is half of the set's signature,
    so copies give equal rows (a task leaves out those that it sees again); q holds n and the shingles from e on."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def deal(batches):
        order, seen = shared.value, set()
        for b in batches:
            e, x, q = [], [], []
            for s in of_batch(b.column(0), k):
                with np.errstate(over="ignore"):
                    sig = mix(s + U(11)).sum(dtype=U).view(np.int64)
                if not len(s) or int(sig) in seen:
                    continue
                if len(seen) >= KEPT:
                    seen.clear()
                seen.add(int(sig))
                p = len(s) - -(-num * len(s) // den) + 1
                rank = order[(s >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(U) << U(56) | mix(s) >> U(8)
                e.append(s[np.argsort(rank, kind="stable")[:p]].view(np.int64))
                x.append(np.full(len(e[-1]), sig))
                q.append((len(s) << 32) + len(s) - np.arange(len(e[-1]), dtype=np.int64))
            cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(e)), pa.array(cat(x)), pa.array(cat(q))], names=["e", "s1", "q"])

    return docs.select("text").mapInArrow(deal, "e long, s1 long, q long")


def near_enough(n_a, n_b, rem_a, rem_b, num: int, den: int):
    """Whether two sets can be linked by their sizes and what they hold from their first common shingle on."""
    return (den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)) & ((num + den) * np.minimum(rem_a, rem_b) >= num * (n_a + n_b))


def meet(num: int, den: int):
    """mapInArrow function over rows (e, s1, q) sorted by e and q: rows (null, a, b, 0) for the pairs of small regions and
    for neighbours of large ones, and rows (e, s1, null, q) of the large regions. A region may span batches."""

    def told(e, s1, q, large, skip):
        """Whole regions; those with ``large`` or more than SMALL rows are large. The first ``skip`` rows were told."""
        n, rem = q >> 32, q & 0xFFFFFFFF
        first = np.ones(len(e), bool)
        first[1:] = e[1:] != e[:-1]
        g = np.cumsum(first) - 1
        m = np.bincount(g)
        big = (m > SMALL)[g] | (large & (g == 0))
        a, b = [], []
        for d in range(1, min(SMALL, int(m.max()))):
            i = np.flatnonzero((g[:-d] == g[d:]) & (~big[:-d] | (d == 1)))
            i = i[near_enough(n[i], n[i + d], rem[i], rem[i + d], num, den) & (s1[i] != s1[i + d])]
            a.append(np.minimum(s1[i], s1[i + d]))
            b.append(np.maximum(s1[i], s1[i + d]))
        if a:
            ab = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            if len(ab):
                yield batch(np.zeros(len(ab), np.int64), ab[:, 0].copy(), ab[:, 1].copy(), np.zeros(len(ab), np.int64), True)
        rows = np.flatnonzero(big)
        rows = rows[rows >= skip]
        if len(rows):
            yield batch(e[rows], s1[rows], np.zeros(len(rows), np.int64), q[rows], False)

    def batch(e, a, b, q, pair):
        mask = np.ones(len(a), bool)
        return pa.RecordBatch.from_arrays([pa.array(e, mask=mask if pair else None), pa.array(a), pa.array(b, mask=None if pair else mask), pa.array(q)], names=["e", "a", "b", "q"])

    def run(batches):
        held, size, large, skip = [], 0, False, 0
        for t in batches:
            if not t.num_rows:
                continue
            held.append([t.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += t.num_rows
            if size < ROWS:
                continue
            e, s1, q = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.flatnonzero(e != e[-1])[-1]) + 1 if e[0] != e[-1] else 0
            if last:
                yield from told(e[:last], s1[:last], q[:last], large, skip)
                held, large, skip = [[e[last:], s1[last:], q[last:]]], False, 0
            else:
                # one region of more rows than are held: all but its last row are told, which the next pair needs
                yield from told(e, s1, q, True, skip)
                held, large, skip = [[e[-1:], s1[-1:], q[-1:]]], True, 1
            size = len(held[0][0])
        if held:
            yield from told(*(np.concatenate(c) for c in zip(*held, strict=True)), large, skip)

    return run


def vectors_of(docs: DataFrame, k: int) -> DataFrame:
    """(x, v): the slice sizes of each set (empty: too large to tell) of rows (x, text)."""

    def run(batches):
        for b in batches:
            out = []
            for s in of_batch(b.column(1), k):
                c = np.bincount((s & U(SLICES - 1)).astype(np.int64), minlength=SLICES)
                out.append(c.astype(np.uint8).tobytes() if c.max() < 256 else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["x", "v"])

    return docs.mapInArrow(run, "x long, v binary")


def linked(k: int, num: int, den: int):
    """mapInArrow function: those of the rows (a, b, text, text) whose sets are as near as asked."""

    def run(batches):
        for t in batches:
            ok = []
            for s, u in zip(of_batch(t.column(2), k), of_batch(t.column(3), k), strict=True):
                small, large = (s, u) if len(s) <= len(u) else (u, s)
                pos = np.searchsorted(large, small)
                pos[pos == len(large)] = 0
                common = int((large[pos] == small).sum())
                ok.append(den * common >= num * (len(s) + len(u) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def active(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame | None:
    """Rows of a pair of cells that have a candidate in another class, under a name that depends on them alone."""
    pdf = pdf.sort_values("x", kind="stable").drop_duplicates("x")
    x, n, rem, side = (pdf[c].to_numpy().astype(np.int64) for c in ("x", "n", "rem", "side"))
    _, cls = np.unique(pdf["c"].to_numpy(), return_inverse=True)
    blank = np.array([not b for b in pdf["v"]])
    v = np.frombuffer(b"".join(b or bytes(SLICES) for b in pdf["v"]), np.uint8).reshape(-1, SLICES)
    two = side.min() != side.max()
    keep = np.zeros(len(x), bool)
    for i in np.flatnonzero(side == side.min()):
        j = np.flatnonzero((cls != cls[i]) & ((side != side[i]) if two else True) & near_enough(n, n[i], rem, rem[i], num, den))
        if len(j):
            most = np.where(blank[j] | blank[i], np.minimum(n[j], n[i]), np.minimum(v[j], v[i]).sum(1, dtype=np.int64))
            j = j[den * most >= num * (n[j] + n[i] - most)]
            keep[j] = True
            keep[i] |= len(j) > 0
    if not keep.any():
        return None
    with np.errstate(over="ignore"):
        name = mix(x[keep].astype(U) * U(2048) + side[keep].astype(U)).sum(dtype=U).view(np.int64)
    return pd.DataFrame({"g": name, "x": x[keep], "c": pdf["c"].to_numpy()[keep], "side": side[keep]})


def exact(pdf: pd.DataFrame, k: int, num: int, den: int) -> pd.DataFrame | None:
    """Spanning forest of the true links between classes of a pair of cells, by its whole sets."""
    pdf = pdf.sort_values("x", kind="stable").drop_duplicates("x")
    x, side = pdf["x"].to_numpy(), pdf["side"].to_numpy()
    _, cls = np.unique(pdf["c"].to_numpy(), return_inverse=True)
    sets = list(of_batch(pa.array(pdf["text"], pa.large_string()), k))
    n = np.array([len(s) for s in sets])
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    at = np.concatenate([[0], np.cumsum(n)])
    order = np.argsort(item, kind="stable")
    holders, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(item))])

    def near(i, j):
        mine = item[at[i] : at[i + 1]]
        count = start[mine + 1] - start[mine]
        where = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(holders[where], minlength=len(sets))[j]
        return j[den * common >= num * (n[j] + n[i] - common)]

    found = walk(cls, side, near)
    return pd.DataFrame([(min(x[i], x[j]), max(x[i], x[j])) for i, j in found], columns=["a", "b"]) if found else None


def walk(cls: np.ndarray, side: np.ndarray, near) -> list[tuple[int, int]]:
    """Spanning forest between the classes over the rows near(i, others); the lowest ids are the roots, so that regions
    of the same points propose the same pairs. Ends as soon as all rows are of one class."""
    edges, left = [], int(cls.max()) + 1
    two = side.min() != side.max()
    todo = np.ones(len(cls), bool)
    while left > 1 and todo.any():
        queue = [int(np.flatnonzero(todo)[0])]
        todo[queue[0]] = False
        while queue and left > 1:
            i = queue.pop()
            other = cls != cls[i]
            if two:
                other &= side != side[i]
            j = np.flatnonzero(other)
            for t in near(i, j) if len(j) else ():
                if cls[t] != cls[i]:
                    edges.append((i, int(t)))
                    cls[cls == cls[t]] = cls[i]
                    left -= 1
                    if todo[t]:
                        todo[t] = False
                        queue.append(int(t))
    return edges


def by_cell(keys: tuple[str, ...], solve):
    """mapInPandas function over rows sorted by keys: solve(rows of a cell) for each cell of two rows or more. A cell may
    span batches."""
    keys = list(keys)

    def run(batches):
        held = None
        for t in batches:
            t = t if held is None else pd.concat([held, t], ignore_index=True)
            if len(t):
                new = (t[keys] != t[keys].shift()).any(axis=1).to_numpy()
                last = int(np.flatnonzero(new)[-1])
                yield from told(t.iloc[:last], np.cumsum(new[:last]))
                held = t.iloc[last:]
        if held is not None:
            yield from told(held, np.zeros(len(held), int))

    def told(t, g):
        for _, part in t.groupby(g, sort=False):
            out = solve(part) if len(part) > 1 else None
            if out is not None and len(out):
                yield out

    return run


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", unique_ids: bool | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: classes of texts linked by Jaccard similarity >= num / den of
    their sets of k-word shingles, over chains of links; component_id is the smallest id of the class.

    Words: white-space separated, A-Z lower-cased. A text with fewer than k words is one shingle; null texts and texts
    without words have an empty set and are linked with nothing: their class is their own id. Every row gives one row.
    Rows with the same id, or without one, are documents of their own: rows of one id and different texts share a name,
    and rows without an id get the smallest id in their class, null if no row of it has one. Ids that are no integers go
    the same way. An empty table gives no rows. Links are exact: a pair is compared by its whole sets (64-bit hashes of
    shingles). ``unique_ids``: the caller knows that ids are integers, there and different.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if unique_ids is None:
        unique_ids = isinstance(d.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)) and d.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()
    if not unique_ids:
        own = cut(d.withColumn("own", F.monotonically_increasing_id()))
        named = cut(own.select("doc_id", "own").join(join(own.select(F.col("own").alias("doc_id"), "text"), k, num, den, unique_ids=True).withColumnRenamed("doc_id", "own"), "own"))
        least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").select("component_id", "least")
        out = named.join(least, "component_id", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    d = d.withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut(sets_of(d, k)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    # equal sets are one point, named by its smallest id; copies are dealt to parts, so that no task gets a hot group
    part = signed.where("n > 0").groupBy("s1", "s2", "n", "salt").agg(F.min("doc_id").alias("x"))
    points = cut(part.groupBy("s1", "s2", "n").agg(F.min("x").alias("x")))
    known = d.where("text is not null")
    sketch = sketch_of(known, k)
    # one shuffle by region serves the windows, the removal of copies and the sizes of regions. Only points that have
    # another of fitting size in their region go on
    w = Window.partitionBy("e").orderBy("q", "s1")
    r = regions_of(known, sketch, k, num, den).repartition("e")
    again = (F.lag("q").over(w) == F.col("q")) & (F.lag("s1").over(w) == F.col("s1"))
    r = r.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").drop("again")
    n = lambda c: F.shiftright(c, 32)
    fits = F.coalesce(n(F.lag("q").over(w)) * den >= n("q") * num, F.lit(False)) | F.coalesce(n(F.col("q")) * den >= n(F.lead("q").over(w)) * num, F.lit(False))
    r = r.withColumn("fits", fits).where("fits").select("e", "s1", "q")
    met = cut(r.mapInArrow(meet(num, den), "e long, a long, b long, q long").distinct())
    # two sets of one s1 would both take the place: more to compare, nothing lost
    to_a, to_b = points.select(F.col("s1").alias("a"), F.col("x").alias("xa")), points.select(F.col("s1").alias("b"), F.col("x").alias("xb"))
    pairs = met.where("b is not null").select("a", "b").join(to_a, "a").join(to_b, "b").select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b"))
    pairs = cut(pairs.distinct())
    large = cut(met.where("b is null").select("e", F.col("a").alias("s1"), "q").join(points.select("s1", "x"), "s1").select("e", "x", n("q").cast("int").alias("n"), F.col("q").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("rem")))

    def fetch(wanted: DataFrame) -> DataFrame:
        """(x, text) of some points. Few ids go to the texts; more than BROADCAST_ROWS meet them in a shuffle."""
        wanted = cut(wanted)
        few = wanted.count() <= BROADCAST_ROWS
        return known.join(F.broadcast(wanted) if few else wanted, known["doc_id"] == wanted["x"], "left_semi").select(F.col("doc_id").alias("x"), "text")

    texts = cut(fetch(pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct()))

    def compare(some: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("x").alias("a"), F.col("text").alias("ta")), texts.select(F.col("x").alias("b"), F.col("text").alias("tb"))
        return cut(some.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(linked(k, num, den), "a long, b long"), WIDE)

    def classes(links: DataFrame) -> DataFrame:
        return cut(components(links).select(F.col("node").alias("x"), F.col("component").alias("c")))

    def class_of(rows: DataFrame, of: DataFrame, col: str, out: str) -> DataFrame:
        """rows with the class of their points: the point itself if it is in no pair."""
        return rows.join(of.select(F.col("x").alias(col), F.col("c").alias("_c")), col, "left").withColumn(out, F.coalesce("_c", col)).drop("_c")

    def merged(of: DataFrame, links: DataFrame) -> DataFrame:
        """Classes after more links, by the components of the classes that these join."""
        more = class_of(class_of(links, of, "a", "ca"), of, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        up = classes(more)
        points = of.select("x", "c").unionByName(up.select("x", F.col("x").alias("c")).join(of.select("x"), "x", "left_anti"))
        return cut(class_of(points, up, "c", "top").select("x", F.col("top").alias("c")))

    # a forest first: each point with its smallest partner; then the pairs that are still of two classes
    forest = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    of = classes(compare(forest))
    rest = class_of(class_of(pairs.join(forest, ["a", "b"], "left_anti"), of, "a", "ca"), of, "b", "cb")
    rest = cut(rest.where("ca <> cb").select("a", "b"))
    if not rest.isEmpty() and not (links := compare(rest)).isEmpty():
        of = merged(of, links)
    # large regions of several classes: points outside of the main class meet all others, in pairs of cells
    at = class_of(large, of, "x", "c")
    of_class = at.groupBy("e", "c").agg(F.count("*").alias("m"), F.sum("n").alias("z"))
    main = of_class.groupBy("e").agg(F.max(F.struct("m", "c", "z")).alias("top"), F.sum("m").alias("m"), F.sum("z").alias("z"), F.count("*").alias("classes")).where("classes > 1")
    cells = lambda m, z: F.greatest(F.ceil(m / CELL), F.ceil(z / CELL_SHINGLES)).cast("int")
    main = cut(main.select("e", F.col("top.c").alias("main"), cells(F.col("m") - F.col("top.m"), F.col("z") - F.col("top.z")).alias("few"), cells(F.col("top.m"), F.col("top.z")).alias("many")))
    if not main.isEmpty():
        at = at.join(main, "e")
        low = F.col("c") != F.col("main")
        at = cut(at.withColumn("cell", F.when(low, F.pmod(F.xxhash64("x"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("x"), F.col("many"))).cast("int")))
        vec = cut(vectors_of(fetch(at.select("x").distinct()), k))
        other = F.explode(F.when(low, F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1)))
        both = at.withColumn("o", other).select("e", F.least("o", "cell").alias("i"), F.greatest("o", "cell").alias("j"), "x", "n", "rem", "c", F.when(F.col("o") == F.col("cell"), 0).otherwise(F.col("cell")).alias("side")).join(vec, "x")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        still = both.repartition(parts, "e", "i", "j").sortWithinPartitions("e", "i", "j").mapInPandas(by_cell(("e", "i", "j"), lambda g: active(g, num, den)), "g long, x long, c long, side int")
        still = cut(still.distinct())
        whole = fetch(still.select("x").distinct())
        found = still.join(whole, "x").repartition(parts, "g").sortWithinPartitions("g").mapInPandas(by_cell(("g",), lambda g: exact(g, k, num, den)), "a long, b long")
        of = merged(of, cut(found.distinct(), WIDE))
    # back from points to rows over the parts of copies
    named = part.withColumnRenamed("x", "lo").join(points, ["s1", "s2", "n"]).join(of, "x", "left").select("s1", "s2", "n", "salt", F.coalesce("c", "x").alias("c"))
    return signed.join(named, ["s1", "s2", "n", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def op10_metric_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 3-word shingle sets of similarity 0.9 or more."""
    return join(only(read(spark, sf_dir, "documents"), "doc_id", "text"), k=3, num=90, den=100)
