"""Profile hidden Markov model of a sequence graph: forward, backward, state usage, read mapping.

The model is a set of numpy arrays that a task loads once for all its reads. One base is one vectorised step over the
nodes (or over the active ones), in linear space with a logarithmic scale for each base. Reads run in mapInPandas.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ACTIVE = 400
INF = float("inf")


@dataclass(frozen=True)
class Params:
    """Transition and emission probabilities. Each of the other three bases is emitted with p_mismatch (not a third)."""

    p_mismatch: float = 0.01
    p_open: float = 0.01
    p_ext: float = 0.01
    p_end: float = 1e-5
    n_active: int = 40
    n_warmup: int = 50
    max_ratio: float = 30.0
    max_gaps: int = 4
    warmup_threshold: int = MAX_ACTIVE // 2

    def __post_init__(self):
        if not 0 < self.n_active < MAX_ACTIVE or self.n_warmup <= 0:
            raise ValueError("n_active must be in 1..399 and n_warmup positive")

    @classmethod
    def uniform(cls, p: float, **kw) -> "Params":
        return cls(p, p, p, **kw)

    @classmethod
    def default(cls) -> "Params":
        return cls.uniform(0.01)

    @classmethod
    def mid_error_2(cls) -> "Params":
        return cls.uniform(0.02)

    @classmethod
    def mid_error(cls) -> "Params":
        return cls.uniform(0.05)

    @classmethod
    def high_error(cls) -> "Params":
        return cls.uniform(0.1)

    @classmethod
    def zero_error(cls) -> "Params":
        return cls.uniform(0.0)

    @property
    def p_match(self) -> float:
        return 1 - self.p_mismatch

    @property
    def mm(self) -> float:
        return 1 - 2 * self.p_open - self.p_end

    @property
    def im(self) -> float:
        return 1 - self.p_open - self.p_ext - self.p_end

    dm = im

    @property
    def p_error(self) -> float:
        return 2 * self.p_open + self.p_mismatch


@dataclass
class Model:
    """Nodes 0..n-1 with base and initial probability; edges (source, target, transition probability)."""

    base: np.ndarray
    init: np.ndarray
    source: np.ndarray
    target: np.ndarray
    trans: np.ndarray
    params: Params = field(default_factory=Params)
    copy_num: np.ndarray | None = None
    edge_copy: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.base)

    def into(self, v: np.ndarray) -> np.ndarray:
        """Sum over the parents of each node."""
        return np.bincount(self.target, weights=v[self.source] * self.trans, minlength=self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        """Sum over the children of each node."""
        return np.bincount(self.source, weights=v[self.target] * self.trans, minlength=self.n)

    def emit(self, letter: str) -> np.ndarray:
        return np.where(self.base == letter, self.params.p_match, self.params.p_mismatch)

    def childs(self, nodes: np.ndarray, also: bool = False) -> np.ndarray:
        """Children of the nodes (after the nodes themselves, if also), each once, MAX_ACTIVE at most."""
        m = np.zeros(self.n, bool)
        m[nodes] = True
        out = self.target[m[self.source]]
        out = np.concatenate([nodes, out]) if also else out
        _, first = np.unique(out, return_index=True)
        return out[np.sort(first)][:MAX_ACTIVE]

    def parents(self, nodes: np.ndarray, also: bool = False) -> np.ndarray:
        m = np.zeros(self.n, bool)
        m[nodes] = True
        out = self.source[m[self.target]]
        out = np.concatenate([nodes, out]) if also else out
        _, first = np.unique(out, return_index=True)
        return out[np.sort(first)][:MAX_ACTIVE]


@dataclass
class Table:
    """One step: vectors m, i, d and scalars mb, ib, e, all times exp(scale)."""

    m: np.ndarray
    i: np.ndarray
    d: np.ndarray
    mb: float
    ib: float
    e: float
    scale: float
    nodes: np.ndarray | None = None  # active ones; None: all

    def total(self) -> np.ndarray:
        return self.m + self.i + self.d

    def lp(self, x) -> float:
        return math.log(x) + self.scale if x > 0 else -INF


def linear_model(seq: str, params: Params) -> Model:
    """Model of one sequence: a chain of its bases, each as likely a start."""
    n = len(seq)
    return Model(np.array(list(seq)), np.full(n, 1 / max(n, 1)), np.arange(n - 1), np.arange(1, n), np.ones(n - 1), params, np.ones(n, int))


def graph_model(base, source, target, copy_num, params: Params, edge_copy=None, least: int = 0, uniform: bool = False) -> Model:
    """Model of a sequence graph. Start: max(copies, least) over the sum of emittable nodes. Transition: copies of the
    edge over those of its parent where edges have copies, else of the child over those of all emittable children.
    ``least=1`` gives every node a chance (to map reads); ``uniform`` ignores copies."""
    base, source, target = np.asarray(base), np.asarray(source, dtype=int), np.asarray(target, dtype=int)
    c, n = np.asarray(copy_num, dtype=float), len(base)
    ok = base != "n"
    if uniform:
        w = ok.astype(float)
        t = ok[target].astype(float)
    else:
        w = np.maximum(c, least) * ok
        t = np.maximum(c[target], least) * ok[target]
        if edge_copy is not None:
            t = np.maximum(np.asarray(edge_copy, dtype=float), least) * ok[target]
    total = np.bincount(source, weights=t, minlength=n)
    trans = np.divide(t, total[source], out=np.zeros(len(t)), where=total[source] > 0)
    return Model(base, w / w.sum() if w.sum() else w, source, target, trans, params, np.asarray(copy_num), edge_copy)


def _scaled(m, i, d, mb, ib, e, scale, nodes) -> Table:
    top = max(m.max(initial=0), i.max(initial=0), d.max(initial=0), mb, ib)
    if top > 0:
        m, i, d, mb, ib, e, scale = m / top, i / top, d / top, mb / top, ib / top, e / top, scale + math.log(top)
    return Table(m, i, d, mb, ib, e, scale, nodes)


def _only(v: np.ndarray, nodes) -> np.ndarray:
    if nodes is None:
        return v
    out = np.zeros_like(v)
    out[nodes] = v[nodes]
    return out


def forward_step(h: Model, x: str, t: Table, nodes=None, spread: bool = False) -> Table:
    """Table after base x. Nodes: those to fill (None: all); with ``spread`` the deletions follow the children."""
    p = h.params
    m = _only(h.emit(x) * (h.into(p.mm * t.m + p.im * t.i + p.dm * t.d) + h.init * (p.mm * t.mb + p.im * t.ib)), nodes)
    i = _only(0.25 * (p.p_open * t.m + p.p_ext * t.i + p.p_open * t.d), nodes)
    ib = 0.25 * (p.p_open * t.mb + p.p_ext * t.ib)
    reach = h.childs(nodes) if spread and nodes is not None else nodes
    step = _only(h.into(p.p_open * m + p.p_open * i) + h.init * p.p_open * ib, reach)
    d = step.copy()
    for _ in range(p.max_gaps):
        reach = h.childs(reach) if spread and nodes is not None else nodes
        step = _only(h.into(p.p_ext * step), reach)
        d += step
    full = m + i + d
    e = p.p_end * (full.sum() if nodes is None else full[nodes].sum())
    return _scaled(m, i, d, 0.0, ib, e, t.scale, nodes)


def start_table(h: Model) -> Table:
    z = np.zeros(h.n)
    return Table(z, z, z, 1.0, 0.0, 0.0, 0.0)


def top_nodes(t: Table, n: int) -> np.ndarray:
    w = t.total()
    return np.lexsort((np.arange(len(w)), -w))[:n]


def nodes_by_ratio(t: Table, ratio: float) -> np.ndarray:
    """Nodes whose log probability is less than ratio below the best, best first, MAX_ACTIVE at most."""
    w = t.total()
    keep = np.flatnonzero(w > w.max() * math.exp(-ratio)) if w.max() > 0 else np.zeros(0, int)
    return keep[np.lexsort((keep, -w[keep]))][:MAX_ACTIVE]


def forward(h: Model, x: str) -> list[Table]:
    out, t = [], start_table(h)
    for c in x:
        t = forward_step(h, c, t)
        out.append(t)
    return out


def forward_sparse(h: Model, x: str, by_ratio: bool = True, fixed_warmup: bool = False) -> list[Table]:
    """Forward that leaves the dense form once few nodes are active (or after the warm-up) and never returns to it. The
    next step's nodes are the best ones and their children."""
    p, out, t, dense = h.params, [], start_table(h), True
    for j, c in enumerate(x):
        active = None
        if out:
            best = nodes_by_ratio(t, p.max_ratio) if by_ratio else top_nodes(t, p.n_active)
            warm = j < p.n_warmup and (fixed_warmup or len(best) > p.warmup_threshold)
            dense = dense and warm
            active = None if dense else h.childs(best, also=True)
        t = forward_step(h, c, t, active, spread=active is not None)
        out.append(t)
    return out


def forward_mapped(h: Model, x: str, mapping: list) -> list[Table]:
    """Forward over the candidate nodes of each base alone."""
    out, t = [], start_table(h)
    for j, c in enumerate(x):
        t = forward_step(h, c, t, np.asarray(mapping[j], dtype=int))
        out.append(t)
    return out


def backward_step(h: Model, x: str, t: Table, nodes=None) -> Table:
    p = h.params
    em = h.emit(x) * t.m
    to_m, stay = h.back(em), 0.25 * t.i
    step = _only(p.dm * to_m + p.p_open * stay, nodes)
    d = step.copy()
    for _ in range(p.max_gaps):
        step = _only(h.back(p.p_ext * step), nodes)
        d += step
    to_d = h.back(d)
    m = _only(p.mm * to_m + p.p_open * to_d + p.p_open * stay, nodes)
    i = _only(p.im * to_m + p.p_open * to_d + p.p_ext * stay, nodes)
    fm, fd, fb = (h.init * em).sum(), (h.init * d).sum(), 0.25 * t.ib
    mb = p.mm * fm + p.p_open * fd + p.p_open * fb
    ib = p.im * fm + p.p_open * fd + p.p_ext * fb
    return _scaled(m, i, d, mb, ib, 0.0, t.scale, nodes)


def backward(h: Model, x: str, nodes: list | None = None) -> list[Table]:
    """Tables b[0..n]: b[j] before base j; b[n] is the end."""
    e = np.full(h.n, h.params.p_end)
    t = Table(e, e, e, 0.0, 0.0, 1.0, 0.0)
    out = [t]
    for j in range(len(x) - 1, -1, -1):
        t = backward_step(h, x[j], t, None if nodes is None else nodes[j])
        out.append(t)
    return out[::-1]


def backward_by_forward(h: Model, x: str, f: list[Table]) -> list[Table]:
    """Backward over the nodes that the forward pass reached after the base before."""
    act = [None] + [None if t.nodes is None else np.flatnonzero(t.total() > 0) for t in f[:-1]]
    return backward(h, x, act)


def backward_sparse(h: Model, x: str) -> list[Table]:
    e = np.full(h.n, h.params.p_end)
    t = Table(e, e, e, 0.0, 0.0, 1.0, 0.0)
    out = [t]
    for j in range(len(x) - 1, -1, -1):
        near = None if len(x) - j <= h.params.n_warmup else h.parents(top_nodes(t, h.params.n_active), also=True)
        t = backward_step(h, x[j], t, near)
        out.append(t)
    return out[::-1]


def full_prob(f: list[Table]) -> float:
    """Log probability of the read from a forward pass."""
    return f[-1].lp(f[-1].e) if f else -INF


def full_prob_backward(b: list[Table]) -> float:
    return b[0].lp(b[0].mb)


def score(h: Model, x: str, mapping: list | None = None, sparse: bool = True, by_ratio: bool = True) -> float:
    """Log probability of a read, forward only, keeping one table."""
    if mapping is not None:
        return full_prob(forward_mapped(h, x, mapping))
    return full_prob(forward_sparse(h, x, by_ratio) if sparse else forward(h, x))


def state_probs(f: list[Table], b: list[Table]) -> list[Table]:
    """Posterior of the states after each base: forward times backward over the whole."""
    z, out = full_prob(f), []
    for j, t in enumerate(f):
        r = b[j + 1]
        k = math.exp(min(t.scale + r.scale - z, 700)) if z > -INF else 0.0
        out.append(Table(t.m * r.m * k, t.i * r.i * k, t.d * r.d * k, 0.0, t.ib * r.ib * k, 0.0, 0.0, t.nodes))
    return out


def run(h: Model, x: str, how: str = "adaptive", mapping: list | None = None, by_ratio: bool = True):
    """(forward, backward) by one of dense, sparse, adaptive, mapping."""
    if how == "dense":
        return forward(h, x), backward(h, x)
    if how == "sparse":
        return forward_sparse(h, x, by_ratio, fixed_warmup=True), backward_sparse(h, x)
    if how == "mapping":
        return forward_mapped(h, x, mapping), backward(h, x, [np.asarray(a, dtype=int) for a in mapping])
    f = forward_sparse(h, x, by_ratio)
    return f, backward_by_forward(h, x, f)


def node_freqs(f, b, n: int) -> np.ndarray:
    """Expected uses of each node."""
    return sum((t.total() for t in state_probs(f, b)), np.zeros(n))


def edge_and_init_freqs(h: Model, x: str, f: list[Table], b: list[Table]) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of each edge and of each start."""
    p, z = h.params, full_prob(f)
    edge, init = np.zeros(len(h.source)), np.zeros(h.n)
    for j in range(len(x) + 1):
        t, now = (start_table(h) if j == 0 else f[j - 1]), b[j]
        k = math.exp(min(t.scale + now.scale - z, 700))
        a, w, tr = h.source, h.target, h.trans
        silent = (p.p_open * t.m + p.p_open * t.i + p.p_ext * t.d)[a] * now.d[w]
        edge += tr * silent * k
        init += h.init * p.p_open * t.ib * now.d * k
        if j < len(x):
            nxt = b[j + 1]
            k = math.exp(min(t.scale + nxt.scale - z, 700))
            em = h.emit(x[j]) * nxt.m
            edge += tr * (p.mm * t.m + p.im * t.i + p.dm * t.d)[a] * em[w] * k
            init += h.init * (p.mm * t.mb + p.im * t.ib) * em * k
    return edge, init


def q_score(h: Model, edge: np.ndarray, init: np.ndarray) -> tuple[float, float]:
    """(start part, transition part) of the expected log-likelihood, over emittable starts and possible edges."""
    ok = h.init > 0
    on = h.trans > 0
    return float((init[ok] * np.log(h.init[ok])).sum()), float((edge[on] * np.log(h.trans[on])).sum())


def states(t: Table, p0: float | None = None, normalise: bool = False) -> list[tuple[str, float]]:
    """(state, probability) best first, cut after the row where the running sum passes p0."""
    rows = [(f"{s}{v}", x) for s, vec in (("M", t.m), ("I", t.i), ("D", t.d)) for v, x in enumerate(vec) if x > 0] + [(s, x) for s, x in (("MB", t.mb), ("IB", t.ib), ("E", t.e)) if x > 0]
    rows.sort(key=lambda r: (-r[1], r[0]))
    total = sum(x for _, x in rows) if normalise else 1.0
    out, run_ = [], 0.0
    for s, x in rows:
        if p0 is not None and run_ > p0:
            break
        out.append((s, x / total))
        run_ += x / total
    return out


def diff(a: Table, b: Table) -> float:
    """Sum of absolute differences of two tables."""
    ka, kb = math.exp(a.scale), math.exp(b.scale)
    return float(sum(np.abs(x * ka - y * kb).sum() for x, y in ((a.m, b.m), (a.i, b.i), (a.d, b.d))) + sum(abs(x * ka - y * kb) for x, y in ((a.mb, b.mb), (a.ib, b.ib), (a.e, b.e))))


def forward_scores(h: Model, seqs: list[str], batch: int = 256) -> np.ndarray:
    """Log probabilities of many reads by dense forward passes, a whole batch of reads in each step. Nodes are rows and
    reads columns, so a way between nodes moves whole rows; equal reads are scored once; values are rescaled every 8
    bases (doubles hold eight factors of 1e-30). Empty reads score -inf; a letter that no node has mismatches them all."""
    p, n = h.params, h.n
    texts, which = np.unique(np.array([s or "" for s in seqs], dtype=object), return_inverse=True)
    out = np.full(len(texts), -INF)
    by = np.argsort(h.target, kind="stable")
    src, tr = h.source[by], h.trans[by][:, None]
    heads, first = np.unique(h.target[by], return_index=True)
    chain = n > 1 and len(by) == n - 1 and np.array_equal(src, np.arange(n - 1)) and np.array_equal(h.target[by], np.arange(1, n)) and (tr == 1).all()

    def into(v, r):
        if chain:
            r[0] = 0.0
            r[1:] = v[:-1]
            return r
        r[:] = 0.0
        if len(heads) == len(by):  # one way into each node: nothing to add up
            r[heads] = v[src] * tr
        elif len(by):
            r[heads] = np.add.reduceat(v[src] * tr, first, axis=0)
        return r

    letters = sorted({*h.base.tolist(), *"ACGT"})
    table = np.where(h.base[:, None] == np.array([*letters, ""])[None, :], p.p_match, p.p_mismatch)
    index = np.full(256, len(letters), np.uint8)
    index[[ord(c) for c in letters]] = np.arange(len(letters))
    init = h.init[:, None]
    order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), batch):
        idx = np.array(order[at : at + batch])
        size = np.array([len(texts[i]) for i in idx])
        codes = np.zeros((int(size[0]), len(idx)), np.uint8)
        for r, i in enumerate(idx):
            codes[: size[r], r] = index[np.frombuffer(texts[i].encode("latin-1", "replace"), np.uint8)]
        lives = len(idx) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
        m, i_, d, a, b, c = (np.zeros((n, len(idx))) for _ in range(6))
        ib, scale = np.zeros(len(idx)), np.zeros(len(idx))
        mb = 1.0
        for j, live in enumerate(lives.tolist()):
            if live < m.shape[1]:
                m, i_, d = (np.ascontiguousarray(x[:, :live]) for x in (m, i_, d))
                a, b, c = (np.empty((n, live)) for _ in range(3))
                ib, scale = ib[:live], scale[:live]
            np.add(m, d, out=a)
            i2 = np.multiply(a, 0.25 * p.p_open, out=b)  # insertions open from matches and deletions
            np.multiply(m, p.mm - p.im, out=m)
            a += i_
            a *= p.im
            a += m  # mm m + im i + dm d, as dm = im
            i_ *= 0.25 * p.p_ext
            i2 += i_
            m2 = into(a, c)
            m2 += init * (p.mm * mb + p.im * ib)
            m2 *= np.take(table, codes[j, :live], axis=1)
            ib = 0.25 * (p.p_open * mb + p.p_ext * ib)
            mb = 0.0
            np.add(m2, i2, out=a)
            a *= p.p_open
            d2 = into(a, d)
            d2 += init * (p.p_open * ib)
            np.multiply(d2, p.p_ext, out=a)
            step, spare = a, m
            for gap in range(p.max_gaps):
                spare = into(step, spare)
                d2 += spare
                if gap < p.max_gaps - 1:
                    spare *= p.p_ext
                step, spare = spare, step
            m, i_, d, (a, b, c) = m2, i2, d2, (step, i_, spare)
            if j % 8 == 7:
                top = np.maximum(np.maximum(np.maximum(m.max(0), i_.max(0)), d.max(0)), ib)
                top = np.where(top > 0, top, 1.0)
                for x in (m, i_, d):
                    x /= top
                ib, scale = ib / top, scale + np.log(top)
            done = live if j + 1 == len(lives) else live - int(lives[j + 1])
            if j + 1 == len(lives) or done:
                ends = slice(live - done, live)
                with np.errstate(divide="ignore"):
                    out[idx[ends]] = np.log(p.p_end * (m[:, ends] + i_[:, ends] + d[:, ends]).sum(0)) + scale[ends]
    return out[which]


# ---- mappings: rows (read_id, pos, node, lp)


def map_read(h: Model, x: str, ratio: float | None = None, top: int | None = None, mapping: list | None = None, how: str = "adaptive") -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base the candidate nodes and their log probabilities, best first."""
    f, b = run(h, x, "mapping" if mapping is not None else how, mapping)
    out = []
    for t in state_probs(f, b):
        nodes = top_nodes(t, top)[: (t.total() > 0).sum()] if top else nodes_by_ratio(t, h.params.max_ratio if ratio is None else ratio)
        with np.errstate(divide="ignore"):
            out.append((nodes, np.log(t.total()[nodes])))
    return out


MAPPING = "read_id long, pos int, node long, lp double"


def mapping_lists(mappings: DataFrame) -> DataFrame:
    """(read_id, map): the candidate nodes of each base of a read, in order; a base without any is left out."""
    m = mappings.groupBy("read_id", "pos").agg(F.collect_list("node").alias("nodes"))
    return m.groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nodes"))), lambda s: s["nodes"]).alias("map"))


def generate_mappings(reads: DataFrame, h: Model, ratio: float | None = None, top: int | None = None, how: str = "adaptive", within: DataFrame | None = None) -> DataFrame:
    """Mapping rows of all reads; one task maps its reads with one copy of the model. ``within``: a mapping whose nodes
    alone may be used, for the reads that it gives nodes for every base."""
    shared = reads.sparkSession.sparkContext.broadcast(h)
    rows = reads.select("read_id", "seq")
    if within is not None:
        rows = rows.join(mapping_lists(within), "read_id", "left")

    def go(batches):
        model = shared.value
        for t in batches:
            maps = t["map"] if "map" in t else [None] * len(t)
            for r, x, m in zip(t["read_id"], t["seq"], maps, strict=True):
                if x:
                    got = map_read(model, x, ratio, top, m if m is not None and len(m) == len(x) else None, how=how)
                    k = [len(v) for v, _ in got]
                    yield pd.DataFrame({"read_id": r, "pos": np.repeat(np.arange(len(x), dtype=np.int32), k), "node": np.concatenate([v for v, _ in got]), "lp": np.concatenate([p for _, p in got])})

    return rows.mapInPandas(go, MAPPING)


def score_reads(reads: DataFrame, h: Model, mappings: DataFrame | None = None, how: str = "sparse") -> DataFrame:
    """(read_id, lp) of each read; with mappings only their nodes are filled."""
    shared = reads.sparkSession.sparkContext.broadcast(h)
    rows = reads.select("read_id", "seq")
    if mappings is not None:
        rows = rows.join(mapping_lists(mappings), "read_id", "left")

    def go(batches):
        model = shared.value
        for t in batches:
            maps = t["map"] if "map" in t else [None] * len(t)
            if how == "dense" and "map" not in t:
                yield pd.DataFrame({"read_id": t["read_id"], "lp": forward_scores(model, t["seq"].to_list())})
                continue
            yield pd.DataFrame({"read_id": t["read_id"], "lp": [score(model, x, m, sparse=how != "dense") for x, m in zip(t["seq"], maps, strict=True)]})

    return rows.mapInPandas(go, "read_id long, lp double")


def _per_read(reads: DataFrame, h: Model, schema: str, rows) -> DataFrame:
    """Rows of each read that is not empty, from its (forward, backward) tables; a task keeps one read's tables."""
    shared = reads.sparkSession.sparkContext.broadcast(h)
    names = [c.split()[0] for c in schema.split(", ")]

    def go(batches):
        model = shared.value
        for t in batches:
            for r, x in zip(t["read_id"], t["seq"], strict=True):
                if x:
                    yield pd.DataFrame({"read_id": r, **rows(model, x)})[names]

    return reads.select("read_id", "seq").mapInPandas(go, schema)


def backward_scores(reads: DataFrame, h: Model, sparse: bool = False) -> DataFrame:
    """(read_id, lp) of each read by the backward pass alone."""
    return _per_read(reads, h, "read_id long, lp double", lambda m, x: {"lp": [full_prob_backward((backward_sparse if sparse else backward)(m, x))]})


def node_usage(reads: DataFrame, h: Model, how: str = "adaptive") -> DataFrame:
    """(read_id, node, freq): expected uses of each node by each read; nodes without any are left out."""

    def rows(m, x):
        freq = node_freqs(*run(m, x, how), m.n)
        on = np.flatnonzero(freq > 0)
        return {"node": on, "freq": freq[on]}

    return _per_read(reads, h, "read_id long, node long, freq double", rows)


def edge_usage(reads: DataFrame, h: Model, how: str = "dense") -> DataFrame:
    """(read_id, source, target, freq): expected uses of each edge; those of starts have a null source."""

    def rows(m, x):
        edge, init = edge_and_init_freqs(m, x, *run(m, x, how))
        return {"source": pd.array([*m.source.tolist(), *[None] * m.n], dtype="Int64"), "target": np.concatenate([m.target, np.arange(m.n)]), "freq": np.concatenate([edge, init])}

    return _per_read(reads, h, "read_id long, source long, target long, freq double", rows)


def q_scores(reads: DataFrame, h: Model, how: str = "dense") -> DataFrame:
    """(read_id, q_start, q_edge): the two parts of each read's expected log-likelihood."""

    def rows(m, x):
        start, edge = q_score(m, *edge_and_init_freqs(m, x, *run(m, x, how)))
        return {"q_start": [start], "q_edge": [edge]}

    return _per_read(reads, h, "read_id long, q_start double, q_edge double", rows)


# ---- states: rows (read_id, pos, state, node, lp); states M, I, D have a node, IB none


def state_rows(reads: DataFrame, h: Model, how: str = "adaptive") -> DataFrame:
    """Posterior of the states after each base, one row for each state with a probability above 0."""

    def rows(m, x):
        pos, state, node, lp = [], [], [], []
        for j, t in enumerate(state_probs(*run(m, x, how))):
            for name, v in (("M", t.m), ("I", t.i), ("D", t.d), ("IB", np.array([t.ib]))):
                on = np.flatnonzero(v > 0)
                pos += [j] * len(on)
                state += [name] * len(on)
                node += [None] * len(on) if name == "IB" else on.tolist()
                lp.append(np.log(v[on]))
        return {"pos": np.array(pos, np.int32), "state": np.array(state, object), "node": pd.array(node, dtype="Int64"), "lp": np.concatenate(lp)}

    return _per_read(reads, h, "read_id long, pos int, state string, node long, lp double", rows)


def sum_states(rows: DataFrame, *by: str) -> DataFrame:
    """Sum of tables as (by.., state, node, lp): a log-sum-exp in each state. Two tables add up as the sum of their union.
    Rows are summed by whole logarithms first, so a state has a few hundred partial sums however many rows it holds."""
    keys = [*by, "state", "node"]
    parts = rows.groupBy(*keys, F.floor("lp").alias("whole")).agg(F.sum(F.exp(F.col("lp") - F.floor("lp"))).alias("p"))
    w = parts.groupBy(*keys).agg(F.max("whole").alias("top"), F.collect_list(F.struct("whole", "p")).alias("ps"))
    total = F.aggregate("ps", F.lit(0.0), lambda acc, x: acc + x["p"] * F.exp((x["whole"] - F.col("top")).cast("double")))
    return w.select(*keys, (F.ln(total) + F.col("top")).alias("lp"))


def multiply_states(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Product of two tables, state by state."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "state", "node")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.alias("a").join(b.alias("b"), cond).select(*[f"a.{c}" for c in (*by, "state", "node")], (F.col("a.lp") + F.col("b.lp")).alias("lp"))


def divide_states(rows: DataFrame, lp) -> DataFrame:
    """Table over one probability, given as its logarithm."""
    return rows.withColumn("lp", F.col("lp") - (lp if not isinstance(lp, (int, float)) else F.lit(float(lp))))


def summary(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """(by.., text): the n most probable states of each table on a line, best first."""
    w = Window.partitionBy(*by).orderBy(F.desc("lp"), "state", "node")
    name = F.when(F.col("node").isNull(), F.col("state")).otherwise(F.concat(F.col("node"), F.lit(":"), F.col("state"), F.lit("(n"), F.col("node"), F.lit(")")))
    best = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    items = F.array_sort(F.collect_list(F.struct("r", F.concat(name, F.format_string("%.5f", F.col("lp"))).alias("s"))))
    return best.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["s"]), ",").alias("text"))


def mapping_texts(mappings: DataFrame) -> DataFrame:
    """(read_id, pos, text): candidates of each base as node:percent, best first."""
    w = Window.partitionBy("read_id", "pos").orderBy(F.desc("lp"), "node")
    item = F.struct(F.row_number().over(w).alias("r"), F.concat(F.col("node"), F.lit(":"), F.format_string("%.1f", 100 * F.exp("lp"))).alias("s"))
    return mappings.select("read_id", "pos", item.alias("x")).groupBy("read_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ",").alias("text"))


def total_score(scores: DataFrame) -> float:
    """P(R): the product over reads."""
    return scores.agg(F.sum("lp")).first()[0] or 0.0


def mapping_freqs(mappings: DataFrame) -> DataFrame:
    """(node, freq): expected uses by the mapped reads."""
    return mappings.groupBy("node").agg(F.sum(F.exp("lp")).alias("freq"))


def mapping_top(mappings: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("read_id", "pos").orderBy(F.desc("lp"), "node")
    return mappings.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def mapping_by_ratio(mappings: DataFrame, ratio: float) -> DataFrame:
    w = Window.partitionBy("read_id", "pos")
    return mappings.withColumn("top", F.max("lp").over(w)).where(F.col("top") - F.col("lp") < ratio).drop("top")


def map_nodes(mappings: DataFrame, node_map: DataFrame, most: int = MAX_ACTIVE) -> DataFrame:
    """Mapping moved along node_map(node, new_node): probability is split equally, summed, the best kept."""
    share = node_map.join(node_map.groupBy("node").agg(F.count("*").alias("k")), "node")
    m = mappings.join(share, "node").groupBy("read_id", "pos", F.col("new_node").alias("node")).agg(F.ln(F.sum(F.exp("lp") / F.col("k"))).alias("lp"))
    return mapping_top(m, most)


def mapping_text(nodes, lps) -> str:
    """Candidates as node:percent."""
    return ",".join(f"{n}:{100 * math.exp(p):.1f}" for n, p in zip(nodes, lps, strict=True))
