"""Posterior over copy numbers: scores, sampled vectors, marginals, and the search.

A score is likelihood + prior + log number of Euler circuits. The driver holds the compacted graph and the sampled
vectors; each set of candidates is one Spark job that scores every candidate on every read in one pass over the reads.
"""

import json
import math
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import probability as P
from helixframe.operators import hmm, kernels
from helixframe.operators.assembly import Assembly
from helixframe.plans import draft as D


@dataclass(frozen=True)
class Update:
    """A move: kind R (rescue), S (short), L (long), X (reducer), M (several), and its cycle."""

    kind: str
    cycle: tuple = ()
    facts: tuple = ()

    def __str__(self) -> str:
        body = kernels.cycle_text(list(self.cycle)) if self.kind != "M" else f"{self.facts[0]}:{self.facts[1]}"
        return f"{self.kind}({'|'.join([body, *map(str, self.facts)]) if self.kind == 'R' else body})"

    @classmethod
    def parse(cls, text: str) -> "Update":
        m = re.fullmatch(r"([RSLXM])\((.*)\)", text)
        if not m:
            raise ValueError(text)
        if m[1] == "M":
            return cls("M", (), tuple(map(int, m[2].split(":"))))
        head, *facts = m[2].split("|")
        return cls(m[1], tuple(kernels.cycle_parse(head)), tuple(facts))


def infos_text(infos: list[Update]) -> str:
    return "[" + ",".join(map(str, infos)) + "]"


def parse_infos(text: str) -> list[Update]:
    return [Update.parse(x) for x in re.findall(r"[RSLXM]\([^)]*\)", text)]


@dataclass(frozen=True)
class Score:
    likelihood: float
    prior: float
    n_euler: float
    genome_size: int
    time_likelihood: int = 0
    time_euler: int = 0

    @property
    def p(self) -> float:
        return self.likelihood + self.prior + self.n_euler

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "Score":
        return cls(**json.loads(text))


@dataclass(frozen=True)
class Sample:
    copies: tuple[tuple[int, int], ...]
    score: Score
    infos: tuple[Update, ...] = ()

    def as_dict(self) -> dict[int, int]:
        return dict(self.copies)


def vector(copies: dict[int, int]) -> tuple[tuple[int, int], ...]:
    return tuple(sorted(copies.items()))


@dataclass
class Posterior:
    """Sampled vectors, each once."""

    samples: dict = field(default_factory=dict)

    def add(self, s: Sample) -> bool:
        if s.copies in self.samples:
            return False
        self.samples[s.copies] = s
        return True

    def __contains__(self, copies: dict[int, int]) -> bool:
        return vector(copies) in self.samples

    def find(self, copies: dict[int, int]) -> Sample | None:
        return self.samples.get(vector(copies))

    def p(self) -> float:
        lps = [s.score.p for s in self.samples.values()]
        top = max(lps, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in lps))

    def max_sample(self) -> Sample:
        best = max(s.score.p for s in self.samples.values())
        return [s for s in self.samples.values() if s.score.p == best][-1]

    def max_copy_nums(self) -> dict[int, int]:
        return self.max_sample().as_dict()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [c for _, c in s.copies], [e for e, _ in s.copies], s.score.likelihood, s.score.prior, s.score.n_euler, s.score.genome_size, s.score.p, [str(x) for x in s.infos]) for i, s in enumerate(self.samples.values())]
        return spark.createDataFrame(rows, "sample_id long, copy_nums array<long>, edges array<long>, likelihood double, prior double, n_euler double, genome_size long, p_lp double, infos array<string>")

    def edge_distribution(self, edge: int) -> dict[int, float]:
        """P(copies of the edge), over the sampled vectors."""
        z, out = self.p(), {}
        for s in self.samples.values():
            x = s.as_dict()[edge]
            out[x] = out.get(x, 0.0) + math.exp(s.score.p - z)
        return dict(sorted(out.items()))

    def p_edge(self, edge: int, x: int) -> float:
        return self.edge_distribution(edge).get(x, 0.0)


def marginals(samples: DataFrame) -> DataFrame:
    """(edge, x, x_lp): marginal distribution of every edge from a frame of samples, by built-in aggregates."""
    rows = samples.select("p_lp", F.explode(F.arrays_zip("edges", "copy_nums")).alias("z")).select("p_lp", F.col("z.edges").alias("edge"), F.col("z.copy_nums").alias("x"))
    return P.distribution(rows, ["edge"], "x", "p_lp")


def prior(genome_size: int, expected: int, sigma: int) -> float:
    """Log density of the genome size."""
    z = (genome_size - expected) / sigma
    return -z * z / 2 - math.log(sigma) - math.log(2 * math.pi) / 2


def likelihoods(g: Assembly, reads: DataFrame, mappings: DataFrame | None, params: hmm.Params, candidates: list[dict[int, int]], sparse: bool = False) -> list[float]:
    """Log likelihood of all reads under each candidate. With mappings only their nodes are filled: the reads are scored
    once on blocks of the model, and each candidate again on the reads that touch its changes. Without, all nodes are
    filled, or with ``sparse`` the active ones (an approximation that takes less time on large graphs); then every task
    holds the whole model, once for each candidate. Which one does not hang on the size of the graph."""
    if mappings is not None:
        return mapped_likelihoods(g, reads, mappings, params, candidates)
    models = [g.model(params, copies=c) for c in candidates]
    shared = reads.sparkSession.sparkContext.broadcast(models)

    def go(batches):
        ms = shared.value
        for t in batches:
            seqs = t["seq"].to_list()
            for j, h in enumerate(ms):
                lps = [hmm.score(h, x) for x in seqs] if sparse else hmm.forward_scores(h, seqs)
                yield pd.DataFrame({"candidate": [j], "lp": [float(np.sum(lps))]})

    got = {r["candidate"]: r["lp"] for r in reads.select("read_id", "seq").mapInPandas(go, "candidate int, lp double").groupBy("candidate").agg(F.sum("lp").alias("lp")).collect()}
    return [got.get(j, 0.0) for j in range(len(candidates))]


def mapped_likelihoods(g: Assembly, reads: DataFrame, mappings: DataFrame, params: hmm.Params, candidates: list[dict[int, int]]) -> list[float]:
    """Log likelihood of all reads on their mappings under each candidate, from changes of the graph's own copies."""
    base = g.facts("copies")
    rows = [(j, int(e), int(n) - base[e]) for j, c in enumerate(candidates) for e, n in c.items() if n != base[e]]
    rows += [(j, next(iter(base), 0), 0) for j in range(len(candidates))]  # so that each is there
    changes = reads.sparkSession.createDataFrame(rows, "candidate long, edge long, delta long")
    got = {r["candidate"]: r["lp"] for r in g.blocks().candidate_scores(reads, mappings, params, changes).collect()}
    return [got[j] for j in range(len(candidates))]


@dataclass
class Problem:
    """What a search needs besides the graph."""

    reads: DataFrame
    params: hmm.Params
    genome_size: int
    sigma: int
    mappings: DataFrame | None = None
    sparse: bool = False

    def likelihoods(self, g: Assembly, candidates: list[dict[int, int]]) -> list[float]:
        return likelihoods(g, self.reads, self.mappings, self.params, candidates, self.sparse)

    def scores(self, g: Assembly, candidates: list[dict[int, int]]) -> list[Score]:
        t0 = time.perf_counter()
        lik = self.likelihoods(g, candidates)
        ms = int((time.perf_counter() - t0) * 1000)
        real = {e: sum(b != "n" for b in s) for e, s in g.facts("seqs").items()}
        out = []
        for c, x in zip(candidates, lik, strict=True):
            size = sum(real[e] * n for e, n in c.items())
            out.append(Score(x, prior(size, self.genome_size, self.sigma), g.n_euler_circuits(c), size, ms))
        return out


@dataclass
class TextGraph:
    """The graph of one linear text, with what the search asks of an Assembly, inside a task. Edges are numbered in the
    order of their first k-mers."""

    k: int
    nodes: list[tuple[str, int]]  # full edges: k-mer, copies
    owner: np.ndarray  # compact edge of each full edge
    known: dict

    @classmethod
    def of(cls, seq: str, k: int) -> "TextGraph":
        padded, end = "n" * (k - 1) + seq + "n" * (k - 1), "n" * (k - 1)
        n = Counter(padded[i : i + k] for i in range(len(padded) - k + 1))
        outs, ins = Counter(x[:-1] for x in n), Counter(x[1:] for x in n)
        inner = {v for v in outs if v != end and outs[v] == ins[v] == 1}
        after = {x[:-1]: x for x in n}  # the one k-mer out of an inner node
        nodes, edges, owner = sorted(n), [], {}
        for first in (x for x in nodes if x[:-1] not in inner):
            path = [first]
            while path[-1][1:] in inner:
                path.append(after[path[-1][1:]])
            owner |= dict.fromkeys(path, len(edges))
            edges.append(path)
        ids = {v: i for i, v in enumerate(sorted(set(outs) | set(ins)))}
        known = {"edges": [(e, ids[p[0][:-1]], ids[p[-1][1:]]) for e, p in enumerate(edges)], "bases": {e: len(p) for e, p in enumerate(edges)}, "seqs": {e: "".join(x[-1] for x in p) for e, p in enumerate(edges)}, "copies": {e: n[p[0]] for e, p in enumerate(edges)}, "terminal": ids[end]}
        return cls(k, [(x, n[x]) for x in nodes], np.array([owner[x] for x in nodes]), known)

    def local(self) -> list[tuple[int, int, int]]:
        return self.known["edges"]

    def facts(self, name: str):
        return self.known[name]

    def set_copy_nums(self, copy_nums: dict[int, int]) -> "TextGraph":
        return TextGraph(self.k, self.nodes, self.owner, {**self.known, "copies": dict(copy_nums)})

    def n_euler_circuits(self, copies: dict[int, int] | None = None) -> float:
        c = copies or self.facts("copies")
        return kernels.euler_count([(s, t, c[e]) for e, s, t in self.local()])

    def model(self, params: hmm.Params, copies: dict[int, int] | None = None) -> hmm.Model:
        c = copies or self.facts("copies")
        names, end = [x for x, _ in self.nodes], "n" * (self.k - 1)
        pairs = [(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if x[1:] == y[:-1] != end]
        return hmm.graph_model([x[-1] for x in names], [i for i, _ in pairs], [j for _, j in pairs], [c[int(e)] for e in self.owner], replace(params, n_warmup=self.k))


@dataclass
class TextProblem(Problem):
    """Reads are (sequence, times), scored inside the task."""

    def likelihoods(self, g: TextGraph, candidates: list[dict[int, int]]) -> list[float]:
        seqs, times = [x for x, _ in self.reads], np.array([n for _, n in self.reads])
        return [float((hmm.forward_scores(g.model(self.params, copies=c), seqs) * times).sum()) for c in candidates]


def moves(g: Assembly, kind: str, freqs: dict[int, float] | None = None, size: int = 10, flips: int = 2) -> list[Update]:
    """Candidate moves of one kind from the graph's copy numbers."""
    edges, flow, bases, t = g.local(), g.facts("copies"), g.facts("bases"), g.facts("terminal")
    if kind == "S":
        return [Update("S", tuple(c)) for c in kernels.short_moves(edges, flow, size, flips)]
    if kind == "X":
        return [Update("X", tuple(c)) for c in kernels.reducer_moves(edges, flow)]
    if kind == "L":
        return [Update("L", tuple(c)) for c in kernels.long_moves(edges, flow, bases, t)]
    costs = {e: (lambda c, f=(freqs or {}).get(e, 0.0): kernels.cost_v4([f], c)) for e, _, _ in edges}
    out = []
    for e, _, _ in edges:
        if flow[e] == 0:
            for cycle, change, n, zero in kernels.rescue_merged(edges, flow, e, bases, costs, terminal=t):
                out.append(Update("R", tuple(cycle), (0 if not zero else 1, n, f"{change:.3f}", "Z" if zero else "N")))
    return out


def independent(cycles: list[Update], nxt: Update) -> bool:
    used = {e for u in cycles for e, _ in u.cycle}
    return not used & {e for e, _ in nxt.cycle}


def sample_once(g: Assembly, problem: Problem, post: Posterior, candidates: list[Update], infos: tuple, multi: bool = True) -> Sample | None:
    """Score new candidates, add them, and return the best sample if it beats the graph's own; independent improving
    moves are tried together, in the order of their scores."""
    here = post.find(g.facts("copies"))
    todo = [(u, kernels.apply_cycle(g.facts("copies"), list(u.cycle))) for u in candidates]
    fresh = {vector(c): (u, c) for u, c in todo if vector(c) not in post.samples and min(c.values()) >= 0}
    if fresh:
        scores = problem.scores(g, [c for _, c in fresh.values()])
        for (u, c), s in zip(fresh.values(), scores, strict=True):
            post.add(Sample(vector(c), s, (*infos, u)))
    ranked = sorted(((post.find(c), u) for u, c in todo if post.find(c)), key=lambda x: -x[0].score.p)
    better = [(s, u) for s, u in ranked if s.score.p > here.score.p]
    if multi and len(better) > 1:
        taken: list[Update] = []
        for _, u in better:
            if independent(taken, u):
                taken.append(u)
        if len(taken) > 1:
            c = dict(g.facts("copies"))
            for u in taken:
                c = kernels.apply_cycle(c, list(u.cycle))
            if vector(c) not in post.samples:
                post.add(Sample(vector(c), problem.scores(g, [c])[0], (*infos, *taken)))
    best = post.max_sample()
    return best if best.score.p > here.score.p else None


def sample_posterior(g: Assembly, problem: Problem, freqs: dict[int, float] | None = None, rescue_only: bool = False, max_iter: int = 100) -> tuple[Assembly, Posterior]:
    """Greedy ascent: rescue moves, then (unless rescue_only) short and reducing ones, then long ones; begins again after
    the first set that improves and ends at a local optimum."""
    post = Posterior()
    post.add(Sample(vector(g.facts("copies")), problem.scores(g, [g.facts("copies")])[0]))
    infos: tuple = ()
    for _ in range(max_iter):
        for kinds in [("R",)] + ([] if rescue_only else [("X", "S"), ("L",)]):
            cand = [u for k in kinds for u in moves(g, k, freqs)]
            best = sample_once(g, problem, post, cand, infos) if cand else None
            if best is not None:
                infos = best.infos
                g = g.set_copy_nums(best.as_dict())
                break
        else:
            break
    return g, post


def map_reads(g: Assembly, reads: DataFrame, params: hmm.Params) -> DataFrame:
    """Mapping rows of reads with full-edge ids, on the model where every edge has a chance."""
    ids = g.node_ids()
    at = reads.sparkSession.createDataFrame(list(enumerate(ids)), "node long, edge long")
    m = hmm.generate_mappings(reads, g.model(params, least=1))
    return m.join(F.broadcast(at), "node").select("read_id", "pos", F.col("edge").alias("node"), "lp")


def compact_freqs(g: Assembly, freqs: DataFrame, coverage: float) -> dict[int, float]:
    """Mean usage of each compact edge over coverage."""
    rows = g.full_to_compact().join(freqs, F.col("full") == F.col("node"), "left").groupBy("compact").agg(F.avg(F.coalesce("freq", F.lit(0.0))).alias("f")).collect()
    return {r["compact"]: r["f"] / coverage for r in rows}


def infer(g: Assembly, reads: DataFrame, k_final: int, params: hmm.Params, params_error: hmm.Params, genome_size: int, sigma: int, coverage: float, p0: float = 0.8, n_haplotypes: int = 2, max_iter: int = 10, on_k: Callable | None = None) -> tuple[Assembly, Posterior]:
    """Outer loop over k: map, search by rescue moves, purge edges without copies that are surely absent, extend,
    estimate anew; at the end one full search with the error parameters. Every search scores reads on their mappings."""
    from helixframe.plans.durable import cut

    while True:
        mappings = cut(map_reads(g, reads, params_error))
        freqs = compact_freqs(g, hmm.mapping_freqs(mappings), coverage)
        g, post = sample_posterior(g, Problem(reads, params, genome_size, sigma, mappings), freqs, True, max_iter)
        if on_k is not None:
            on_k(g, post, mappings)
        if g.k >= k_final:
            break
        best = post.max_copy_nums()
        gone = [e for e, c in best.items() if c == 0 and post.p_edge(e, 0) > p0]
        g, _, _ = g.set_copy_nums(best).purge_and_extend(gone, k_final, True)
        usage = hmm.mapping_freqs(cut(map_reads(g, reads, params_error)))
        g = g.set_copy_nums(D.copy_nums_from_mappings(g, usage, coverage, n_haplotypes if g.facts("terminal") is not None else None))
    mappings = cut(map_reads(g, reads, params_error))
    freqs = compact_freqs(g, hmm.mapping_freqs(mappings), coverage)
    return sample_posterior(g, Problem(reads, params_error, genome_size, sigma, mappings), freqs, False, max_iter)


def true_edges_missed(g: Assembly, post: Posterior, true: dict[int, int], most: float = 0.8) -> list[int]:
    """Edges of the truth whose P(0) is above the bound."""
    return [e for e, c in true.items() if c > 0 and post.p_edge(e, 0) > most]


def is_highest_at(post: Posterior, true: dict[int, int]) -> bool:
    return vector(post.max_copy_nums()) == vector(true)
