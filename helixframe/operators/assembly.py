"""Two-level sequence graph: full edges (k-mers) and compact edges (simple paths of full edges), as frames.

``nodes(node_id, km1mer, is_terminal)``, ``edges(edge_id, source, target, base, copy_num, kmer)`` and
``compact(edge_id, source, target, edges_in_full)``. Ids are keys and are never moved. A linear genome passes the
terminal node n...n; copy numbers are a circulation.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as S
from helixframe.operators import graph as G
from helixframe.operators import hmm, kernels
from helixframe.operators import kmers as K
from helixframe.operators.blocks import BlockModel
from helixframe.plans.durable import cut, lookup


class MissingKmers(ValueError):
    """k-mers of a sequence that the graph doesn't hold."""


@dataclass
class Assembly:
    k: int
    nodes: DataFrame
    edges: DataFrame
    compact: DataFrame
    _local: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_kmers(cls, table: DataFrame, k: int, ignore_copy_nums: bool = False) -> "Assembly":
        """Graph of a k-mer table; the counts are copy numbers and must be a circulation unless they are ignored."""
        table = cut(table)
        if not ignore_copy_nums and not K.is_consistent(table):
            raise ValueError("copy numbers in and out of a node differ")
        nodes, edges = K.numbered(table)
        nodes, edges = cut(nodes), cut(edges)
        keep = nodes.where("is_terminal").select(F.col("node_id").alias("node"))
        return cls(k, nodes, edges, cut(G.compact(edges, keep)))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    # ---- what the graph holds

    def table(self) -> DataFrame:
        return self.edges.select("kmer", F.col("copy_num").alias("n"))

    def kmer_set(self) -> DataFrame:
        return self.edges.select("kmer").distinct()

    def n_emittable_edges(self) -> int:
        return self.edges.where(F.col("base") != "n").count()

    def terminal(self) -> int | None:
        r = self.nodes.where("is_terminal").select("node_id").first()
        return None if r is None else r[0]

    def touching_terminal(self) -> DataFrame:
        """Compact edges that start or end at the terminal."""
        t = self.nodes.where("is_terminal").select(F.col("node_id").alias("_t"))
        return self.compact.join(F.broadcast(t.limit(1)), (F.col("source") == F.col("_t")) | (F.col("target") == F.col("_t")), "left_semi")

    def ways_out(self, node: int, level: str = "edges") -> DataFrame:
        return getattr(self, level).where(F.col("source") == node)

    def ways_in(self, node: int, level: str = "edges") -> DataFrame:
        return getattr(self, level).where(F.col("target") == node)

    def degree_stats(self) -> DataFrame:
        return G.degree_stats(self.compact)

    def n_ambiguous_nodes(self) -> int:
        return G.degrees(self.compact).where("n_in > 1 and n_out > 1").count()

    def node_copy_nums(self) -> DataFrame:
        """Copies of a node: the sum over its ways out."""
        return self.edges.groupBy(F.col("source").alias("node_id")).agg(F.sum("copy_num").alias("copy_num"))

    def n_haplotypes(self) -> int:
        t = self.terminal()
        return 0 if t is None else self.edges.where(F.col("source") == t).agg(F.coalesce(F.sum("copy_num"), F.lit(0))).first()[0]

    def genome_size(self) -> int:
        return self.edges.where(F.col("base") != "n").agg(F.coalesce(F.sum("copy_num"), F.lit(0))).first()[0]

    def max_copy_num(self) -> int:
        return self.edges.agg(F.max("copy_num")).first()[0]

    def is_copy_nums_valid(self) -> bool:
        return K.is_consistent(self.table())

    def full_to_compact(self) -> DataFrame:
        """(full, compact, i): compact edge of each full edge and its place in it."""
        return self.compact.select(F.col("edge_id").alias("compact"), F.posexplode("edges_in_full").alias("i", "full"))

    def compact_seqs(self) -> DataFrame:
        """(edge_id, source, target, seq, kmer, copy_num, n_bases) of compact edges; seq: emitted bases, kmer: with the
        k-1 bases before."""
        e = self.full_to_compact().join(self.edges.select(F.col("edge_id").alias("full"), "base", "copy_num", "kmer"), "full")
        seq = e.groupBy("compact").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda s: s["base"]), "").alias("seq"), F.min_by("kmer", "i").alias("_k"), F.min_by("copy_num", "i").alias("copy_num"), F.count("*").alias("n_bases"))
        return self.compact.select(F.col("edge_id").alias("compact"), "source", "target").join(seq, "compact").select(F.col("compact").alias("edge_id"), "source", "target", "seq", F.concat(S.prefix("_k"), "seq").alias("kmer"), "copy_num", "n_bases")

    def get_copy_nums(self) -> dict[int, int]:
        return {r["edge_id"]: r["copy_num"] for r in self.compact_seqs().select("edge_id", "copy_num").collect()}

    def set_copy_nums(self, copy_nums: dict[int, int]) -> "Assembly":
        """The graph with new copy numbers of its compact edges; they must be a circulation."""
        new = self.spark.createDataFrame([(int(e), int(c)) for e, c in copy_nums.items()], "compact long, c long")
        m = self.full_to_compact().join(new, "compact").select(F.col("full").alias("edge_id"), "c")
        edges = cut(self.edges.join(m, "edge_id", "left").withColumn("copy_num", F.coalesce("c", "copy_num")).select(*self.edges.columns))
        out = Assembly(self.k, self.nodes, edges, self.compact)
        if not out.is_copy_nums_valid():
            raise ValueError("copy numbers in and out of a node differ")
        return out

    def is_equivalent(self, other: "Assembly") -> bool:
        same = lambda f: f(self) == f(other)
        return all(map(same, (lambda g: g.nodes.count(), lambda g: g.edges.count(), lambda g: g.compact.count(), lambda g: g.genome_size())))

    def is_equal(self, other: "Assembly") -> bool:
        return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in ((self.nodes, other.nodes), (self.edges, other.edges), (self.compact, other.compact)))

    # ---- local form of the compacted graph, for algorithms on the driver

    def local(self) -> list[tuple[int, int, int]]:
        """Compact edges (id, source, target): small after compaction, and needed whole by the search."""
        if "edges" not in self._local:
            rows = self.compact_seqs().orderBy("edge_id").collect()
            self._local |= {"edges": [(r["edge_id"], r["source"], r["target"]) for r in rows], "bases": {r["edge_id"]: r["n_bases"] for r in rows}, "seqs": {r["edge_id"]: r["seq"] for r in rows}, "copies": {r["edge_id"]: r["copy_num"] for r in rows}, "terminal": self.terminal()}
        return self._local["edges"]

    def facts(self, name: str):
        self.local()
        return self._local[name]

    def n_euler_circuits(self, copies: dict[int, int] | None = None) -> float:
        c = copies or self.facts("copies")
        return kernels.euler_count([(s, t, c[e]) for e, s, t in self.local()])

    # ---- paths

    def paths_of(self, haps: DataFrame) -> DataFrame:
        """(path_id, i, edge_id) of styled sequences (hap_id, style, seq); an error that lists absent k-mers."""
        rows = K.windows_of(haps.select(F.col("hap_id").alias("path_id"), "style", "seq"), K.styled_text("seq", "style", self.k), self.k, ("path_id",), position=True).withColumnRenamed("pos", "i")
        known = lookup(self.edges.select("kmer", "edge_id"))
        # the windows are made twice, which costs less than to write them all
        missing = [r[0] for r in rows.select("kmer").distinct().join(known, "kmer", "left_anti").limit(20).collect()]
        if missing:
            raise MissingKmers(", ".join(sorted(missing)))
        return rows.join(known, "kmer").select("path_id", "i", "edge_id")

    def broken_paths(self, paths: DataFrame, level: str = "edges") -> DataFrame:
        """path_id of the paths that are not closed walks."""
        e = lookup(getattr(self, level).select("edge_id", "source", "target"))
        w = Window.partitionBy("path_id").orderBy("i")
        p = paths.join(e, "edge_id").select("path_id", "i", "source", "target").withColumn("_next", F.coalesce(F.lead("source").over(w), F.first("source").over(w)))
        return p.where("target <> _next").select("path_id").distinct()

    def path_in_compact(self, paths: DataFrame) -> DataFrame:
        """Full paths as compact paths: the compact edge at each full edge that begins one, in the order of the path. The
        path must start at such a place or it is rotated to the first one."""
        heads = lookup(self.full_to_compact().where("i = 0").select("full", "compact"))
        p = paths.join(heads, paths["edge_id"] == F.col("full"))
        return p.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("i")) - 1).alias("i"), F.col("compact").alias("edge_id"))

    def path_in_full(self, paths: DataFrame) -> DataFrame:
        p = paths.join(lookup(self.full_to_compact().withColumnRenamed("i", "at")), paths["edge_id"] == F.col("compact"))
        return p.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("i", "at")) - 1).alias("i"), F.col("full").alias("edge_id"))

    def copy_nums_of_paths(self, paths: DataFrame) -> DataFrame:
        """(edge_id, copy_num) of compact edges as often as full paths use them."""
        # counted without the order of the paths
        heads = lookup(self.full_to_compact().where("i = 0").select("full", F.col("compact").alias("_c")))
        used = paths.join(heads, paths["edge_id"] == F.col("full")).groupBy(F.col("_c").alias("edge_id")).agg(F.count("*").alias("copy_num"))
        return self.compact.select("edge_id").join(used, "edge_id", "left").withColumn("copy_num", F.coalesce("copy_num", F.lit(0).cast("long")))

    def circuits(self, copies: dict[int, int] | None = None) -> list[list[int]]:
        """Closed walks over compact edges that use every copy."""
        c = copies or self.facts("copies")
        return kernels.greedy_circuits(self.local(), c, {e: s[:1] for e, s in self.facts("seqs").items()}, self.facts("terminal"))

    def styled_seqs(self, copies: dict[int, int] | None = None) -> list[tuple[str, str, list[int]]]:
        """(style, sequence, walk) of each circuit, linear if it passes the terminal first; n is left out."""
        ends = {e: (s, t) for e, s, t in self.local()}
        out = []
        for walk in self.circuits(copies):
            seq = "".join(self.facts("seqs")[e] for e in walk).replace("n", "")
            out.append(("L" if ends[walk[0]][0] == self.facts("terminal") else "C", seq, walk))
        return out

    def euler_circuit(self, copies: dict[int, int] | None = None) -> list[int]:
        c = copies or self.facts("copies")
        multi = [((e, i), s, t) for e, s, t in self.local() for i in range(c[e])]
        start = self.facts("terminal") if self.facts("terminal") is not None else multi[0][1]
        return [e for e, _ in kernels.euler_circuit(multi, start)]

    def linear_haplotypes(self, copies: dict[int, int] | None = None) -> list[tuple[str, list[int]]]:
        """(sequence, walk) of one Euler circuit cut at the terminal."""
        ends, out, walk = {e: (s, t) for e, s, t in self.local()}, [], []
        for e in self.euler_circuit(copies):
            walk.append(e)
            if ends[e][1] == self.facts("terminal"):
                out.append(("".join(self.facts("seqs")[x] for x in walk).replace("n", ""), walk))
                walk = []
        return out

    # ---- k + 1

    def kp1_table(self) -> DataFrame:
        """(kmer, n) of the graph of k + 1: one k-mer for each way in and way out of a node that is not the terminal, its
        copies dealt out round robin; the ends of linear genomes grow by one n."""
        t = self.nodes.where("is_terminal").select(F.col("node_id").alias("node"))
        ends = self.edges.select(F.col("target").alias("node"), F.lit("in").alias("way"), "kmer", "base", "copy_num").unionByName(self.edges.select(F.col("source").alias("node"), F.lit("out").alias("way"), "kmer", "base", "copy_num")).join(t, "node", "left_anti")

        def deal(pdf):
            pdf = pdf.sort_values("kmer", kind="stable")
            a, b = pdf[pdf["way"] == "in"], pdf[pdf["way"] == "out"]
            c = kernels.split_copies(a["copy_num"].tolist(), b["copy_num"].tolist())
            return pd.DataFrame([(x + y, c[i][j]) for i, x in enumerate(a["kmer"]) for j, y in enumerate(b["base"])], columns=["kmer", "n"])

        inner = ends.groupBy("node").applyInPandas(deal, "kmer string, n long")
        null = "n" * (self.k - 1)
        outer = self.edges.where(F.startswith("kmer", F.lit(null)) & (F.col("base") != "n")).select(F.concat(F.lit("n"), "kmer").alias("kmer"), F.col("copy_num").alias("n"))
        outer = outer.unionByName(self.edges.where(F.endswith("kmer", F.lit(null)) & ~F.startswith("kmer", F.lit("n"))).select(F.concat("kmer", F.lit("n")).alias("kmer"), F.col("copy_num").alias("n")))
        return inner.unionByName(outer)

    def to_kp1(self) -> "Assembly":
        return Assembly.from_kmers(cut(self.kp1_table()), self.k + 1)

    def purge(self, gone: list[int]) -> tuple["Assembly", DataFrame]:
        """(graph, map(old_id, new_id) of full edges) without compact edges, the bridges between components that this
        leaves, and isolated nodes. Paths are not collapsed again."""
        drop = self.spark.createDataFrame([(int(e),) for e in gone], "compact long")
        left = cut(self.edges.join(self.full_to_compact().join(drop, "compact", "left_semi").select(F.col("full").alias("edge_id")), "edge_id", "left_anti"))
        left = cut(left.join(G.bridges(left).select("edge_id"), "edge_id", "left_anti"))
        nodes = cut(G.isolated_nodes_removed(self.nodes, left))
        alive = self.full_to_compact().join(left.select(F.col("edge_id").alias("full")), "full", "left_semi").select(F.col("compact").alias("edge_id")).distinct()
        out = Assembly(self.k, nodes, left, cut(self.compact.join(alive, "edge_id", "left_semi")))
        return out, G.purge(self.edges, self.edges.join(left.select("edge_id"), "edge_id", "left_anti"))[1]

    def purge_and_extend(self, gone: list[int], k_max: int, stop_when_ambiguous: bool, haps: DataFrame | None = None, mappings: DataFrame | None = None):
        """(graph, paths, mappings): purge, then k + 1 until k_max. With the flag it stops after the first extension of a
        graph that had an ambiguous node. Paths are those of the sequences ``haps`` (null if one lost a k-mer)."""
        g = self.purge(gone)[0] if gone else self
        if gone:
            g = Assembly.from_kmers(g.table(), g.k)
            if mappings is not None:
                names = self.edges.select(F.col("edge_id").alias("node"), "kmer").join(g.edges.select("kmer", F.col("edge_id").alias("new_node")), "kmer")
                mappings = cut(mappings.join(names, "node").select("read_id", "pos", F.col("new_node").alias("node"), "lp"))
        while g.k < k_max:
            ambiguous = g.n_ambiguous_nodes() > 0
            nxt = g.to_kp1()
            if mappings is not None:
                mappings = cut(hmm.map_nodes(mappings, g.node_map_to(nxt)))
            g = nxt
            if ambiguous and stop_when_ambiguous:
                break
        paths = None
        if haps is not None:
            try:
                paths = g.paths_of(haps)
            except MissingKmers:
                paths = None
        return g, paths, mappings

    def node_map_to(self, nxt: "Assembly") -> DataFrame:
        """(node, new_node): an edge of k goes to the edges of k + 1 that end with it."""
        new = nxt.edges.select(F.col("edge_id").alias("new_node"), F.substr("kmer", F.lit(2)).alias("kmer"))
        return self.edges.select(F.col("edge_id").alias("node"), "kmer").join(new, "kmer").select("node", "new_node")

    # ---- hidden Markov model

    def hmm_frames(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (node_id, base, copy_num) are full edges; edges (source, target) are pairs of them around a node that is
        not the terminal."""
        t = self.nodes.where("is_terminal").select(F.col("node_id").alias("node"))
        return self.edges.select(F.col("edge_id").alias("node_id"), "base", "copy_num"), G.line_graph(self.edges).join(t, "node", "left_anti").select(F.col("a").alias("source"), F.col("b").alias("target"))

    def model(self, params: hmm.Params, least: int = 0, uniform: bool = False, copies: dict[int, int] | None = None) -> hmm.Model:
        """The model as arrays; its warm-up is k."""
        if "hmm" not in self._local:
            n, e = self.hmm_frames()
            n, e = n.orderBy("node_id").toPandas(), e.orderBy("source", "target").toPandas()
            m = self.full_to_compact().toPandas().set_index("full")["compact"]
            self._local["hmm"] = (n, e, m.reindex(n["node_id"]).to_numpy())
        n, e, owner = self._local["hmm"]
        at = {x: i for i, x in enumerate(n["node_id"])}
        c = n["copy_num"].to_numpy() if copies is None else np.array([copies.get(int(x), 0) for x in owner])
        from dataclasses import replace

        return hmm.graph_model(n["base"].to_numpy(), e["source"].map(at).to_numpy(), e["target"].map(at).to_numpy(), c, replace(params, n_warmup=self.k), least=least, uniform=uniform)

    def blocks(self) -> BlockModel:
        """The model in blocks of the shared folder, for reads that are mapped."""
        if "blocks" not in self._local:
            self._local["blocks"] = BlockModel.of(self)
        return self._local["blocks"]

    def node_ids(self) -> list[int]:
        """Full edge of each node of the model."""
        self.model(hmm.Params.default())
        return self._local["hmm"][0]["node_id"].tolist()


def node_centric(edges: DataFrame, to_node: Callable[[], Column], to_edge: Callable[[], Column]) -> tuple[DataFrame, DataFrame]:
    """Generic line graph: a node for each edge and an edge for each consecutive pair, with values from the callables."""
    pairs = G.line_graph(edges)
    return edges.select(F.col("edge_id").alias("node_id"), to_node().alias("value")), pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), to_edge().alias("value"))
