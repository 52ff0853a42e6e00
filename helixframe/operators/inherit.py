"""Mappings carried from k to k + 1, refined there, and compared with fresh ones.

A versioned frame ``(k, read_id, pos, node, lp)`` holds a mapping of every k; a step adds the rows of k + 1. A node of k
goes to the nodes of k + 1 that end with it, its weight in equal parts; weights of a base sum to 1 afterwards.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as S
from helixframe.operators import hmm
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans.durable import cut

VERSIONED = ("k", "read_id", "pos", "node", "lp")


def successors(nodes: DataFrame, longer: DataFrame) -> DataFrame:
    """(node, new_node) from tables (edge_id, kmer) of k and k + 1: the k-mers of k + 1 that end with one of k."""
    new = longer.select(F.col("edge_id").alias("new_node"), S.suffix("kmer").alias("kmer"))
    return nodes.select(F.col("edge_id").alias("node"), "kmer").join(new, "kmer").select("node", "new_node")


def normalised(mappings: DataFrame) -> DataFrame:
    """Weights of each (read_id, pos) summing to 1. The sum is taken relative to the largest, so that none underflows."""
    w = Window.partitionBy("read_id", "pos")
    top = mappings.withColumn("_top", F.max("lp").over(w))
    total = F.sum(F.exp(F.col("lp") - F.col("_top"))).over(w)
    return top.withColumn("lp", F.col("lp") - F.col("_top") - F.ln(total)).drop("_top")


def inherit(mappings: DataFrame, node_map: DataFrame, most: int | None = hmm.MAX_ACTIVE) -> DataFrame:
    """(read_id, pos, node, lp) moved along node_map(node, new_node). Nodes without a successor lose their weight to the
    others of their base; a base whose nodes all have none is left out. ``most``: best nodes kept for a base (None: all)."""
    ways = node_map.groupBy("node").agg(F.count("*").alias("ways"))
    moved = mappings.select("read_id", "pos", "node", "lp").join(node_map.join(ways, "node"), "node")
    # rows of a base meet once: the sum by node, the best ones and the total need no other shuffle
    moved = moved.repartition("read_id", "pos").withColumn("_top", F.max("lp").over(Window.partitionBy("read_id", "pos")))
    moved = moved.groupBy("read_id", "pos", "_top", F.col("new_node").alias("node")).agg((F.first("_top") + F.ln(F.sum(F.exp(F.col("lp") - F.col("_top")) / F.col("ways")))).alias("lp")).drop("_top")
    return normalised(moved if most is None else hmm.mapping_top(moved, most))


def version(mappings: DataFrame, k: int) -> DataFrame:
    return mappings.select(F.lit(k).alias("k"), "read_id", "pos", "node", "lp")


def extend(g: Assembly, versions: DataFrame, k_max: int, reads: DataFrame | None = None, params: hmm.Params | None = None) -> tuple[Assembly, DataFrame]:
    """(graph of k_max, versions): the newest version is g's; each k adds one. With reads and parameters an inherited
    version is refined on the model of its graph before it is carried on."""
    while g.k < k_max:
        nxt = g.to_kp1()
        now = inherit(versions.where(F.col("k") == g.k), successors(g.edges, nxt.edges))
        if reads is not None:
            now = refine(nxt, reads, now, params)
        versions = cut(versions.unionByName(version(now, nxt.k)))
        g = nxt
    return g, versions


def refine(g: Assembly, reads: DataFrame, mappings: DataFrame, params: hmm.Params) -> DataFrame:
    """Mapping computed anew where only the nodes of a mapping may be used. Reads that it leaves a base out of are mapped
    without it."""
    ids = reads.sparkSession.createDataFrame(list(enumerate(g.node_ids())), "i long, edge long")
    inside = mappings.join(ids, mappings["node"] == ids["edge"]).select("read_id", "pos", F.col("i").alias("node"))
    out = hmm.generate_mappings(reads, g.model(params, least=1), within=inside)
    return out.join(ids, out["node"] == ids["i"]).select("read_id", "pos", F.col("edge").alias("node"), "lp")


def by_context(reads: DataFrame, table: DataFrame, m: int) -> DataFrame:
    """Mapping (read_id, pos, node, lp) of each base to the k-mers (edge_id, kmer, copy_num) that agree with the read on the
    last m letters up to it, weighted by their copies. Before a read stand n. Bases without such a k-mer are left out;
    reads may be empty or null, k-mers without copies get no weight."""
    seqs = reads.where(F.length("seq") > 0).select("read_id", F.concat(F.lit(S.NULL_BASE * (m - 1)), "seq").alias("seq"))
    bases = K.kmer_rows(seqs, m, K.fragment_kmers, keep=("read_id",), position=True).select("read_id", "pos", F.col("kmer").alias("context"))
    ends = table.where("copy_num > 0").select(F.col("edge_id").alias("node"), F.col("copy_num").cast("double").alias("c"), F.right("kmer", F.lit(m)).alias("context"))
    share = ends.join(ends.groupBy("context").agg(F.sum("c").alias("t")), "context").select("context", "node", F.ln(F.col("c") / F.col("t")).alias("lp"))
    return bases.join(share, "context").select("read_id", "pos", "node", "lp")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(read_id, pos, top_a, top_b, same_top, shared, either, distance) of two mappings of one graph: best nodes (ties: the
    smallest), common and all nodes, and the total variation. A base that only one has is at distance 1."""
    side = lambda m, x: m.select("read_id", "pos", "node", F.exp("lp").alias(x))
    both = side(a, "p").join(side(b, "q"), ["read_id", "pos", "node"], "full")
    best = lambda x: F.max_by("node", F.when(F.col(x).isNotNull(), F.struct(F.col(x), -F.col("node"))))
    out = both.groupBy("read_id", "pos").agg(best("p").alias("top_a"), best("q").alias("top_b"), F.count(F.col("p") + F.col("q")).alias("shared"), F.count("*").alias("either"), (F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"), F.count("p").alias("_p"), F.count("q").alias("_q"))
    lone = (F.col("_p") == 0) | (F.col("_q") == 0)
    return out.select("read_id", "pos", "top_a", "top_b", F.coalesce(F.col("top_a") == F.col("top_b"), F.lit(False)).alias("same_top"), "shared", "either", F.when(lone, 1.0).otherwise(F.col("distance")).alias("distance"))


def check(g: Assembly, reads: DataFrame, params: hmm.Params, k_max: int) -> DataFrame:
    """(k, bases, same_top, distance) for each k up to k_max: inherited and refined mappings against fresh ones of the same
    graph; same_top is the share of bases with the same best node."""
    def fresh(g):
        ids = reads.sparkSession.createDataFrame(list(enumerate(g.node_ids())), "i long, edge long")
        m = hmm.generate_mappings(reads, g.model(params, least=1))
        return m.join(ids, m["node"] == ids["i"]).select("read_id", "pos", F.col("edge").alias("node"), "lp")

    versions, out = cut(version(fresh(g), g.k)), None
    while g.k < k_max:
        g, versions = extend(g, versions, g.k + 1, reads, params)
        now = compare(versions.where(F.col("k") == g.k), fresh(g)).agg(F.count("*").alias("bases"), F.avg(F.col("same_top").cast("int")).alias("same_top"), F.avg("distance").alias("distance"))
        now = cut(now.select(F.lit(g.k).alias("k"), "*"))
        out = now if out is None else out.unionByName(now)
    return out
