"""From reads to a draft graph with copy numbers."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import probability as P
from helixframe.functions import sequence as S
from helixframe.operators import graph as G
from helixframe.operators import kernels
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans.durable import cut


def network(g: Assembly, freqs: DataFrame, excluded, n_haplotypes: int | None = None, terminal: str = "split"):
    """(edges, frequencies by edge, demands, capacities) of the flow network over compact edges.

    ``freqs(edge_id, freq)`` of full edges; those where ``excluded`` holds don't count. The terminal is split and its
    halves joined by one more edge, of fixed flow if the number of haplotypes is known.
    """
    f = g.edges.where(~excluded).join(freqs, "edge_id", "left").select(F.col("edge_id").alias("full"), F.coalesce("freq", F.lit(0.0)).alias("freq"))
    rows = g.full_to_compact().join(f, "full").groupBy("compact").agg(F.collect_list("freq").alias("freqs")).collect()
    per = {r["compact"]: r["freqs"] for r in rows}
    t, edges = g.facts("terminal"), list(g.local())
    demand, capacity = [0] * len(edges), [kernels.CAPACITY] * len(edges)
    if t is not None and terminal != "whole":
        edges = [(e, s, "end" if b == t else b) for e, s, b in edges]
        if terminal == "split":
            d, c = kernels.bounds(n_haplotypes)
            edges.append(("terminal", "end", t))
            demand.append(d)
            capacity.append(c)
    return edges, per, demand, capacity


def solve(g: Assembly, freqs: DataFrame, excluded, cost: Callable, n_haplotypes: int | None = None) -> dict[int, int]:
    """Copy numbers of compact edges of least cost."""
    edges, per, demand, capacity = network(g, freqs, excluded, n_haplotypes)
    flow = kernels.min_cost_circulation(edges, demand, capacity, [lambda c, f=per.get(e[0], []): cost(f, c) for e in edges])
    if flow is None:
        raise ValueError("no copy numbers meet the demands")
    return {e[0]: c for e, c in zip(edges, flow, strict=True) if e[0] != "terminal"}


def copy_nums_from_counts(g: Assembly, coverage: float, n_haplotypes: int | None = None) -> dict[int, int]:
    """First estimate: squared error of raw counts over coverage; k-mers that hold an n don't count."""
    freqs = g.edges.select("edge_id", (F.col("copy_num") / coverage).alias("freq"))
    return solve(g, freqs, S.has_null("kmer"), kernels.cost_v1, n_haplotypes)


def copy_nums_from_mappings(g: Assembly, freqs: DataFrame, coverage: float, n_haplotypes: int | None = None) -> dict[int, int]:
    """Later estimates: relative error of the mapped usage over coverage; edges whose base is n don't count."""
    scaled = freqs.select(F.col("node").alias("edge_id"), (F.col("freq") / coverage).alias("freq"))
    return solve(g, scaled, F.col("base") == "n", kernels.cost_v4, n_haplotypes)


def largest_component(table: DataFrame) -> DataFrame:
    e = K.edges(table)
    best = G.largest_component(e.select(F.col("kmer").alias("edge_id"), "source", "target"))
    return table.join(best.select(F.col("edge_id").alias("kmer")), "kmer", "left_semi")


def draft(reads: DataFrame, k: int, p_error: float, genome_size: int, n_haplotypes: int | None = None, min_count: int = 2, min_dead_end: int | None = None) -> Assembly:
    """Counts, rare k-mers out, dead ends out, ends closed through the terminal, largest component, copy numbers."""
    size = reads.agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("b")).first()
    base_coverage = size["b"] / genome_size
    least = int(base_coverage / 4) if min_dead_end is None else min_dead_end
    table = cut(K.remove_rare(K.from_fragments(reads, k), min_count))
    table, _ = K.remove_dead_ends(table, least)
    table = cut(largest_component(cut(K.augment_dead_ends(table))))
    g = Assembly.from_kmers(table, k, ignore_copy_nums=True)
    coverage = P.kmer_coverage(k, size["b"] // size["n"], base_coverage, p_error)
    return g.set_copy_nums(copy_nums_from_counts(g, coverage, n_haplotypes))
