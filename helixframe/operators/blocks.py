"""Graph models in blocks: scores of mapped reads without a whole model anywhere.

A block holds ``size`` neighbouring node ids in CSR form: each node's base, copies and owner (its compact edge), and its
ways out with the child's id, base, copies and owner, so that transition probabilities need no other block. Blocks are
files in the shared folder. A task fetches those that its reads' mappings touch and keeps the last few.

A mapped read uses its mapping's nodes alone, so the model of those nodes gives the same score as the whole one. A set of
changed copy numbers (a candidate) is scored on the reads that touch it: every path of a read has one start, so the
score of any other read only moves by the logarithm of the start weights' ratio.
"""

from collections import OrderedDict
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import hmm
from helixframe.plans.durable import cut, shared_folder, store

SIZE = 4096
#: Blocks that a task keeps; candidates that a row of a read carries at most.
KEPT, TOGETHER = 64, 256
NO_BASE = "n"


def write(nodes: DataFrame, arcs: DataFrame, size: int = SIZE) -> str:
    """Folder of the blocks of nodes(node_id, base, copy_num, owner) and arcs(source, target); block = node_id div size. A
    repeated task writes the same file again."""
    spark = nodes.sparkSession
    folder = shared_folder(spark, "model")
    system, path = store(folder)
    system.create_dir(path)
    child = nodes.select(F.col("node_id").alias("target"), F.struct(F.col("node_id").alias("t"), F.col("base").alias("b"), F.col("copy_num").cast("long").alias("c"), F.col("owner").alias("o")).alias("x"))
    ways = arcs.select("source", "target").join(child, "target").groupBy(F.col("source").alias("node_id")).agg(F.array_sort(F.collect_list("x")).alias("ways"))
    # a node has at most as many ways out as there are letters, so the row of a block is bounded
    row = F.struct("node_id", "base", F.col("copy_num").cast("long").alias("copy_num"), "owner", F.coalesce("ways", F.array().cast("array<struct<t:long,b:string,c:long,o:long>>")).alias("ways"))
    blocks = nodes.join(ways, "node_id", "left").groupBy(F.expr(f"node_id div {size}").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def put(batches):
        for b in batches:
            done = []
            for block, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = [w for r in rows for w in r["ways"]]
                table = {
                    "node": pa.array([r["node_id"] for r in rows], pa.int64()), "base": pa.array([r["base"] for r in rows]), "copies": pa.array([r["copy_num"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int64()), "ways": pa.array([len(r["ways"]) for r in rows], pa.int32()),
                }
                arcs = {"target": pa.array([w["t"] for w in out], pa.int64()), "base": pa.array([w["b"] for w in out], pa.string()), "copies": pa.array([w["c"] for w in out], pa.int64()), "owner": pa.array([w["o"] for w in out], pa.int64())}
                system, p = store(folder)
                for name, data in (("nodes", table), ("arcs", arcs)):
                    t = pa.table(data)
                    with system.open_output_stream(f"{p}/{block}.{name}") as f, pa.ipc.new_file(f, t.schema) as w:
                        w.write_table(t)
                done.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["block"])

    cut(blocks.mapInArrow(put, "block long"))
    return folder


class Blocks:
    """A task's view of a folder of blocks."""

    def __init__(self, folder: str, size: int, kept: int = KEPT):
        self.folder, self.size, self.kept, self.held, self.fetched = folder, size, kept, OrderedDict(), 0

    def block(self, i: int) -> tuple:
        """(nodes, base, copies, owner, first way of each node, target, base, copies, owner of each way)"""
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        system, p = store(self.folder)
        got = []
        for name in ("nodes", "arcs"):
            with system.open_input_file(f"{p}/{i}.{name}") as f:
                t = pa.ipc.open_file(f).read_all()
            got += [c.to_numpy() for c in t.columns]
        self.held[i] = (*got[:4], np.concatenate([[0], np.cumsum(got[4])]), *got[5:])
        self.fetched += 1
        if len(self.held) > self.kept:
            self.held.popitem(last=False)
        return self.held[i]

    def part(self, nodes: np.ndarray) -> "Part":
        """The model of some nodes (sorted, each once)."""
        base, copies, owner, parent, target, tb, tc, to = [], [], [], [], [], [], [], []
        at = 0
        for i in np.unique(nodes // self.size):
            ids, b, c, o, first, t, xb, xc, xo = self.block(int(i))
            own = nodes[nodes // self.size == i]
            j = np.searchsorted(ids, own)
            if (j >= len(ids)).any() or (ids[j] != own).any():
                raise KeyError("a mapping names a node that the graph has not")
            n = first[j + 1] - first[j]
            ways = np.repeat(first[j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            base.append(b[j])
            copies.append(c[j])
            owner.append(o[j])
            parent.append(np.repeat(np.arange(at, at + len(own)), n))
            target.append(t[ways])
            tb.append(xb[ways])
            tc.append(xc[ways])
            to.append(xo[ways])
            at += len(own)
        return Part(nodes, *[np.concatenate(x) if x else np.zeros(0) for x in (base, copies, owner, parent, target, tb, tc, to)])


@dataclass
class Part:
    """Some nodes of a graph and all ways out of them."""

    nodes: np.ndarray
    base: np.ndarray
    copies: np.ndarray
    owner: np.ndarray
    parent: np.ndarray
    target: np.ndarray
    child_base: np.ndarray
    child_copies: np.ndarray
    child_owner: np.ndarray

    def model(self, params: hmm.Params, weight: float, change: dict[int, int] | None = None, least: int = 0) -> hmm.Model:
        """As ``hmm.graph_model`` of the whole graph, cut to these nodes. weight: the start weights of the whole graph."""
        c, t = self.copies.astype(float), self.child_copies.astype(float)
        if change:
            more = np.vectorize(lambda o: change.get(o, 0), otypes=[float])
            c, t = c + (more(self.owner) if len(c) else 0), t + (more(self.child_owner) if len(t) else 0)
        w = np.maximum(c, least) * (self.base != NO_BASE)
        t = np.maximum(t, least) * (self.child_base != NO_BASE)
        total = np.bincount(self.parent.astype(int), weights=t, minlength=len(c))[self.parent.astype(int)]
        trans = np.divide(t, total, out=np.zeros(len(t)), where=total > 0)
        at = np.minimum(np.searchsorted(self.nodes, self.target), max(len(self.nodes) - 1, 0))
        here = self.nodes[at] == self.target if len(self.nodes) else np.zeros(0, bool)
        return hmm.Model(self.base, w / weight if weight else w, self.parent.astype(int)[here], at[here], trans[here], params, c.astype(int))


@dataclass
class BlockModel:
    """nodes(node_id, base, copy_num, owner), arcs(source, target), k for the warm-up, and the blocks' folder."""

    nodes: DataFrame
    arcs: DataFrame
    k: int
    size: int = SIZE
    folder: str = ""
    _weight: float | None = field(default=None, repr=False)

    def __post_init__(self):
        self.folder = self.folder or write(self.nodes, self.arcs, self.size)

    @classmethod
    def of(cls, g, size: int = SIZE) -> "BlockModel":
        """Blocks of an Assembly's model."""
        n, e = g.hmm_frames()
        owner = g.full_to_compact().select(F.col("full").alias("node_id"), F.col("compact").alias("owner"))
        return cls(cut(n.join(owner, "node_id")), cut(e), g.k, size)

    @property
    def weight(self) -> float:
        """Sum of the start weights."""
        if self._weight is None:
            self._weight = float(self.nodes.where(F.col("base") != NO_BASE).agg(F.coalesce(F.sum("copy_num"), F.lit(0))).first()[0])
        return self._weight

    def touched_nodes(self, changes: DataFrame) -> DataFrame:
        """(candidate, node): nodes whose copies a candidate changes, and those with a way to one."""
        c = changes.where("delta <> 0").select("candidate", F.col("edge").alias("owner")).distinct()
        own = self.nodes.select("owner", F.col("node_id").alias("node")).join(c, "owner").select("candidate", "node")
        before = own.join(self.arcs, own["node"] == self.arcs["target"]).select("candidate", F.col("source").alias("node"))
        return own.unionByName(before).distinct()

    def scores(self, reads: DataFrame, mappings: DataFrame, params: hmm.Params, more: DataFrame | None = None) -> DataFrame:
        """(read_id, lp) of reads(read_id, seq) on their mappings; reads that have none for a base are at minus infinity.
        With ``more`` (read_id, sets: array of (candidate, weight, changes: array of (edge, delta))): (read_id, candidate, lp)
        for those sets instead."""
        folder, size, weight, p = self.folder, self.size, self.weight, replace(params, n_warmup=self.k)
        rows = reads.select("read_id", "seq").join(hmm.mapping_lists(mappings), "read_id", "left")
        rows = rows.withColumn("sets", F.lit(None).cast("array<int>")) if more is None else rows.join(more, "read_id")

        def go(batches):
            view = Blocks(folder, size)
            for t in batches:
                out = []
                for r, x, m, sets in zip(t["read_id"], t["seq"], t["map"], t["sets"], strict=True):
                    ok = bool(x) and m is not None and len(m) == len(x)
                    if ok:
                        nodes = np.unique(np.concatenate(m).astype(np.int64))
                        part, local = view.part(nodes), [np.searchsorted(nodes, a) for a in m]
                    for s in [None] if sets is None else sets:
                        h = part.model(p, weight if s is None else s["weight"], s and {c["edge"]: c["delta"] for c in s["changes"]}) if ok else None
                        out.append((r, -1 if s is None else s["candidate"], hmm.score(h, x, local) if ok else -np.inf))
                yield pd.DataFrame(out, columns=["read_id", "candidate", "lp"])

        return rows.select("read_id", "seq", "map", "sets").mapInPandas(go, "read_id long, candidate long, lp double")

    def candidate_scores(self, reads: DataFrame, mappings: DataFrame, params: hmm.Params, changes: DataFrame) -> DataFrame:
        """(candidate, lp, rescored): log likelihood of all reads under each candidate(candidate, edge, delta), and how many
        reads were scored anew for it. A candidate whose deltas are all 0 is the model itself. All reads are scored once;
        then each candidate is scored on the reads whose mappings touch it."""
        changes = cut(changes.groupBy("candidate", "edge").agg(F.sum("delta").alias("delta")))
        base = cut(self.scores(reads, mappings, params).select("read_id", "lp"))
        gain = self.nodes.where(F.col("base") != NO_BASE).groupBy(F.col("owner").alias("edge")).agg(F.count("*").alias("n"))
        weights = changes.join(gain, "edge", "left").groupBy("candidate").agg((F.lit(self.weight) + F.sum(F.col("delta") * F.coalesce("n", F.lit(0)))).alias("weight"), F.collect_list(F.when(F.col("delta") != 0, F.struct("edge", "delta"))).alias("changes"))
        weights = cut(weights)
        nodes = mappings.select("read_id", "node").distinct()
        touch = nodes.join(self.touched_nodes(changes), "node").select("read_id", "candidate").distinct()
        sets = touch.join(weights, "candidate").withColumn("g", F.expr(f"candidate div {TOGETHER}"))
        sets = sets.groupBy("read_id", "g").agg(F.collect_list(F.struct("candidate", "weight", "changes")).alias("sets")).select("read_id", "sets")
        new = self.scores(reads, mappings, params, sets)
        # infinite scores are counted, as their differences are not numbers
        fin = lambda c: F.when(F.col(c) > float("-inf"), F.col(c)).otherwise(0.0)
        inf = lambda c: F.when(F.col(c) == float("-inf"), 1).otherwise(0)
        again = new.join(base.withColumnRenamed("lp", "was"), "read_id").groupBy("candidate").agg(F.sum(fin("lp") - fin("was")).alias("d"), F.sum(inf("lp") - inf("was")).alias("di"), F.sum(1 - inf("was")).alias("moved"), F.count("*").alias("rescored"))
        whole = base.agg(F.coalesce(F.sum(fin("lp")), F.lit(0.0)).alias("s"), F.coalesce(F.sum(inf("lp")), F.lit(0)).alias("i"), F.count("*").alias("n")).first()
        zero = F.lit(0).cast("long")
        out = weights.join(again, "candidate", "left").select("candidate", "weight", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("di", zero).alias("di"), F.coalesce("moved", zero).alias("moved"), F.coalesce("rescored", zero).alias("rescored"))
        others = F.lit(whole["n"] - whole["i"]) - F.col("moved")  # reads of finite score that are not scored anew
        shift = F.when(others == 0, 0.0).when(F.col("weight") > 0, others * (F.lit(float(np.log(self.weight) if self.weight else 0.0)) - F.ln("weight"))).otherwise(F.lit(float("-inf")))
        lp = F.when(F.lit(whole["i"]) + F.col("di") > 0, F.lit(float("-inf"))).otherwise(F.lit(whole["s"]) + F.col("d") + shift)
        return out.select("candidate", lp.alias("lp"), "rescored")
