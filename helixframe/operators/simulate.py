"""Data generators: random sequences, mutations, genomes, reads as walks of a hidden Markov model.

Seeded with numpy's generator; equal seeds give equal data. Reads are made by many tasks, each read from its own seed.
"""

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import hmm

BASES = np.array(list("ACGT"))


# ---- sequences and mutations


def generate(length: int, seed: int) -> str:
    return "".join(np.random.default_rng(seed).choice(BASES, length))


def tandem_repeat(unit: str, n: int) -> str:
    return unit * n


@dataclass(frozen=True)
class Profile:
    """Chance of an edit for each base, and weights of substitution, insertion, deletion."""

    rate: float
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


@dataclass(frozen=True, order=True)
class Edit:
    """Kinds in the order in which edits of one place apply: 0 substitution, 1 insertion before, 2 deletion."""

    pos: int
    kind: int
    base: str = ""


def pick_edit(rng: np.random.Generator, seq: str, profile: Profile) -> Edit:
    pos = int(rng.integers(len(seq)))
    w = np.array(profile.weights)
    kind = int(rng.choice(3, p=w / w.sum()))
    pool = [b for b in "ACGT" if b != seq[pos]] if kind == 0 else list("ACGT")
    return Edit(pos, kind, "" if kind == 2 else str(rng.choice(pool)))


def apply_edits(seq: str, edits: list[Edit]) -> str:
    """Edits, each once, in the order of place and kind, with a running offset."""
    out, off = list(seq), 0
    for e in sorted(set(edits)):
        at = e.pos + off
        if e.kind == 0:
            out[at] = e.base
        elif e.kind == 1:
            out.insert(at, e.base)
            off += 1
        else:
            del out[at]
            off -= 1
    return "".join(out)


def mutate(seq: str, profile: Profile, seed) -> tuple[str, list[Edit]]:
    rng = seed if isinstance(seed, np.random.Generator) else np.random.default_rng(seed)
    edits = sorted({pick_edit(rng, seq, profile) for _ in range(round(len(seq) * profile.rate))}) if seq else []
    return apply_edits(seq, edits), edits


# ---- genomes: lists of (style, sequence)


def simple(size: int, seed: int) -> list[tuple[str, str]]:
    return [("L", generate(size, seed))]


def simple_circular(size: int, seed: int) -> list[tuple[str, str]]:
    return [("C", generate(size, seed))]


def simple_diploid(size: int = 100, seed: int = 0) -> list[tuple[str, str]]:
    """Two haplotypes that differ by two substitutions."""
    a = generate(size, seed)
    change = {"A": "C", "C": "G", "G": "T", "T": "A"}
    return [("L", a), ("L", apply_edits(a, [Edit(p, 0, change[a[p]]) for p in (size // 3, 2 * size // 3)]))]


def diploid(size: int, hap_seed: int, rate: float, seed: int) -> list[tuple[str, str]]:
    a = generate(size, hap_seed)
    return [("L", a), ("L", mutate(a, Profile(rate), seed)[0])]


def tandem_haploid(unit: int, n: int, rate: float, unit_seed: int, hap_seed: int, ends: int = 0) -> list[tuple[str, str]]:
    """Mutated tandem repeat, between unique ends if they have a length."""
    body = mutate(tandem_repeat(generate(unit, unit_seed), n), Profile(rate), hap_seed)[0]
    return [("L", generate(ends, hap_seed + 1) + body + generate(ends, abs(hap_seed - 1)))]


def tandem_polyploid(unit: int, n: int, rate: float, unit_seed: int, hap_seed: int, ends: int, ploidy: int, div: float, div_seed: int, equal_ends: bool = True) -> list[tuple[str, str]]:
    """Haplotypes that diverge from one mutated repeat; the unique ends stay equal, or diverge too."""
    head, tail = generate(ends, hap_seed + 1), generate(ends, abs(hap_seed - 1))
    body = mutate(tandem_repeat(generate(unit, unit_seed), n), Profile(rate), hap_seed)[0]
    out = [head + body + tail]
    for i in range(1, ploidy):
        s = div_seed + i - 1
        out.append(head + mutate(body, Profile(div), s)[0] + tail if equal_ends else mutate(head + body + tail, Profile(div), s)[0])
    return [("L", x) for x in out]


def tandem_diploid(unit: int, n: int, rate: float, unit_seed: int, hap_seed: int, div: float, div_seed: int) -> list[tuple[str, str]]:
    return tandem_polyploid(unit, n, rate, unit_seed, hap_seed, 0, 2, div, div_seed)


def tandem_example(kind: int) -> list[tuple[str, str]]:
    """A repeat and the same with one edit: a substitution (0), insertion (1) or deletion (2) in its middle."""
    a = tandem_haploid(20, 10, 0.0, 0, 0, 50)[0][1]
    return [("L", a), ("L", apply_edits(a, [Edit(len(a) // 2, kind, "" if kind == 2 else "ACGT"[("ACGT".index(a[len(a) // 2]) + 1) % 4])]))]


def small_case(end: int, counts: list[int], unit: str = "GATTC", edits: list[Edit] = ()) -> list[tuple[str, str]]:
    """Small parametrised genome: blocks of a unit between random ends, with given edits on a second haplotype."""
    body = "".join(unit * c + generate(3, i) for i, c in enumerate(counts))
    a = generate(end, 100) + body + generate(end, 101)
    return [("L", a), ("L", apply_edits(a, list(edits)))]


def family(unit: int, n: int) -> list[tuple[str, str]]:
    """Diploid families u20, u500 and so on: n units with 1 percent divergence."""
    return tandem_diploid(unit, n, 0.01, 0, 1, 0.01, 2)


def haps_frame(spark: SparkSession, genome: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(genome)], "hap_id long, style string, seq string")


def genome_stats(haps: DataFrame) -> DataFrame:
    return haps.agg(F.count("*").alias("haplotypes"), F.sum((F.col("style") == "L").cast("int")).alias("linear"), F.sum(F.length("seq")).alias("genome_size"))


# ---- genome graph: one node for each base of each strand


def base_graph(genome: list[tuple[str, str]], both_strands: bool = True) -> tuple[hmm.Model, list[tuple[int, int, bool]], list[int]]:
    """(model, origin of each node (haplotype, position, reverse strand), start nodes). A circle closes on itself."""
    base, origin, src, tgt, starts = [], [], [], [], []
    comp = str.maketrans("ACGT", "TGCA")
    for h, (style, seq) in enumerate(genome):
        if style == "F":
            raise ValueError("fragments don't make a genome graph")
        for rev in ([False, True] if both_strands else [False]):
            at, n = len(base), len(seq)
            base += list(seq.translate(comp)[::-1] if rev else seq)
            origin += [(h, n - 1 - i if rev else i, rev) for i in range(n)]
            src += range(at, at + n - 1)
            tgt += range(at + 1, at + n)
            if style == "C":
                src.append(at + n - 1)
                tgt.append(at)
            starts.append(at)
    n = len(base)
    model = hmm.graph_model(np.array(base), src, tgt, np.ones(n, int), hmm.Params.default())
    return model, origin, starts


# ---- walks


@dataclass(frozen=True)
class ReadProfile:
    """length counts bases (``emit``: walks of another length are drawn again) or states; start: any node or ``starts``."""

    length: int
    how: str = "emit"
    starts: str = "any"
    endable: bool = False


def walk(rng: np.random.Generator, h: hmm.Model, profile: ReadProfile, start_nodes: list[int] | None = None) -> list[tuple[str, int, str | None]]:
    """States (M, I or D, node, base) of one walk: first from the begin state, then by transition weights."""
    p, childs = h.params, {}
    order = np.argsort(h.source, kind="stable")
    first = np.searchsorted(h.source[order], np.arange(h.n + 1))
    pool = np.asarray(start_nodes if start_nodes is not None else np.arange(h.n))
    w = h.init[pool]
    node = int(rng.choice(pool, p=w / w.sum()))
    kind, out, emitted = "M", [], 0
    kind = "MD"[int(rng.random() < p.p_open / (p.p_open + p.mm))] if p.p_open else "M"
    while True:
        if kind == "D":
            letter = None
        elif kind == "I":
            letter = str(rng.choice(BASES))
        else:
            e = np.array([p.p_match if b == h.base[node] else p.p_mismatch for b in BASES])
            letter = str(rng.choice(BASES, p=e / e.sum()))
        out.append((kind, node, letter))
        emitted += letter is not None
        if (emitted if profile.how == "emit" else len(out)) >= profile.length:
            return out
        to_m, to_d, to_i = {"M": (p.mm, p.p_open, p.p_open), "I": (p.im, p.p_open, p.p_ext), "D": (p.dm, p.p_ext, p.p_open)}[kind]
        if node not in childs:
            es = order[first[node] : first[node + 1]]
            childs[node] = (h.target[es], h.trans[es])
        nodes, tr = childs[node]
        if not len(nodes) or not tr.sum():
            to_m = to_d = 0.0
        end = p.p_end if profile.endable else 0.0
        total = to_m + to_d + to_i * (to_m + to_d > 0 or profile.endable) + end
        if total == 0:
            return out
        x = rng.random() * total
        if x < to_m + to_d:
            node = int(rng.choice(nodes, p=tr / tr.sum()))
            kind = "M" if x < to_m else "D"
        elif x < total - end:
            kind = "I"
        else:
            return out


def history_frame(walks: list[list[tuple]]) -> pd.DataFrame:
    return pd.DataFrame([(r, i, k, n, b) for r, w in enumerate(walks) for i, (k, n, b) in enumerate(w)], columns=["read", "step", "state", "node", "base"])


def node_uses(w: list[tuple], n: int) -> np.ndarray:
    return np.bincount([x[1] for x in w], minlength=n)


def edge_uses(w: list[tuple]) -> dict[tuple[int, int], int]:
    """Uses of each node pair; a step that stays at a node is none."""
    out: dict = {}
    for a, b in zip(w, w[1:], strict=False):
        if b[0] != "I":
            out[a[1], b[1]] = out.get((a[1], b[1]), 0) + 1
    return out


READS = "read_id long, seq string, is_revcomp boolean, origins array<struct<node:long,pos:long>>"


def sample_reads(spark: SparkSession, genome: list[tuple[str, str]], coverage: float, profile: ReadProfile, params: hmm.Params, seed: int = 0, both_strands: bool = True) -> DataFrame:
    """Positioned reads until their bases reach coverage times the genome; each read from its own seed."""
    model, origin, starts = base_graph(genome, both_strands)
    model = replace(model, params=params)
    goal = math.ceil(coverage * sum(len(s) for _, s in genome))
    shared = spark.sparkContext.broadcast((model, origin, starts))
    n = max(1, math.ceil(goal / max(1, profile.length)))

    def go(batches):
        h, org, st = shared.value
        for t in batches:
            rows = []
            for i in t["id"]:
                rng = np.random.default_rng([seed, int(i)])
                for _ in range(1000):
                    w = walk(rng, h, profile, st if profile.starts == "starts" else None)
                    e = [x for x in w if x[2] is not None]
                    if profile.how != "emit" or len(e) == profile.length:
                        break
                if not e:
                    continue
                pos = [None if k == "I" else {"node": org[v][0], "pos": org[v][1]} for k, v, _ in e]
                rows.append((int(i), "".join(b for _, _, b in e), bool(org[e[0][1]][2]), pos))
            yield pd.DataFrame(rows, columns=["read_id", "seq", "is_revcomp", "origins"])

    return spark.range(n).mapInPandas(go, READS)


def justify_strand(reads: DataFrame) -> DataFrame:
    """Reads of the reverse strand turned over, with their origins."""
    from helixframe.functions import sequence as S

    r = F.col("is_revcomp")
    return reads.select("read_id", F.when(r, S.revcomp("seq")).otherwise(F.col("seq")).alias("seq"), F.lit(False).alias("is_revcomp"), F.when(r, F.reverse("origins")).otherwise(F.col("origins")).alias("origins"))


def read_stats(reads: DataFrame, genome_size: int) -> DataFrame:
    return reads.agg(F.sum(F.length("seq")).alias("total_bases"), F.expr("sum(length(seq)) div count(*)").alias("average_length"), (F.sum(F.length("seq")) / F.lit(float(genome_size))).alias("coverage"))


def coverage_by_base(reads: DataFrame, haps: DataFrame) -> DataFrame:
    """(node, pos, depth) of matched bases, 0 where there are none."""
    depth = reads.select(F.explode("origins").alias("o")).where("o is not null").groupBy("o.node", "o.pos").agg(F.count("*").alias("depth"))
    every = haps.select(F.col("hap_id").alias("node"), F.posexplode(F.split("seq", "")).alias("pos", "b")).where("b <> ''").select("node", F.col("pos").cast("long"))
    return every.join(depth, ["node", "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))


# Parameters of the usual simulated sets: genome, coverage, read length, error rate.
DATASETS = {
    "simple_fragment": (lambda: simple(200, 0), 20, 50, 0.001),
    "tandem_fragment": (lambda: tandem_haploid(40, 4, 0.0, 0, 0, 20), 20, 50, 0.001),
    "difficult_diploid": (lambda: tandem_diploid(50, 20, 0.05, 0, 0, 0.05, 0), 20, 100, 0.01),
    "u1k": (lambda: tandem_diploid(1000, 1, 0.0, 0, 0, 0.01, 0), 20, 1000, 0.001),
    "u20": (lambda: family(20, 50), 20, 1000, 0.001),
    "u20n200": (lambda: family(20, 200), 20, 1000, 0.001),
    "u100": (lambda: family(100, 10), 20, 1000, 0.001),
    "simple_haploid": (lambda: simple(1000, 0), 20, 500, 0.005),
    "simple_diploid": (lambda: diploid(1000, 0, 0.01, 0), 20, 500, 0.005),
}


def dataset(spark: SparkSession, name: str, seed: int = 0) -> tuple[DataFrame, DataFrame, hmm.Params]:
    """(haplotypes, forward positioned reads, parameters) of a named set."""
    make, coverage, length, p = DATASETS[name]
    genome, params = make(), hmm.Params.uniform(p)
    return haps_frame(spark, genome), justify_strand(sample_reads(spark, genome, coverage, ReadProfile(length, "states"), params, seed)), params
