"""Euler circuits of graphs larger than a task: pairs of ways at each node, merged cycles, places by list ranking.

Every use of an edge is a row. At each node the ways in are paired with the ways out, which gives cycles. Cycles that meet
at a node become one when the node's pairs are rotated among them; each cycle takes part at one node a round, so the
rounds never undo each other, and a fixed share of the cycles goes in each. Doubled pointers number the uses. Joins of
the rounds are merges, as hundreds of small broadcasts would pass through the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.plans.durable import cut, written

#: Parts in which the rows of one key are numbered.
PARTS = 64


def numbered_by(df: DataFrame, key: str, unique: str, out: str) -> DataFrame:
    """df with ``out``, the number from 0 of each row among those of its key. Rows are numbered in parts of a key and the
    parts' sizes are added up, so that no window holds all rows of a key."""
    rows = df.withColumn("_part", F.pmod(F.xxhash64(unique), F.lit(PARTS)))
    sizes = rows.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    base = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy(key, "_part").orderBy(unique)) - 1
    return rows.withColumn("_at", at).join(base.hint("merge"), [key, "_part"]).withColumn(out, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def uses(edges: DataFrame) -> DataFrame:
    """(u, edge_id, source, target): a row for each copy of edges(edge_id, source, target, copy_num), numbered."""
    rows = edges.where("copy_num > 0").select("edge_id", "source", "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copy_num").cast("long"))).alias("i"))
    return cut(cut(rows).select(F.monotonically_increasing_id().alias("u"), "edge_id", "source", "target"))


def paired(rows: DataFrame) -> DataFrame:
    """(u, next, node): the use after each one, by the order of uses at their node. Ways in and out that differ in number
    are an error."""
    ins = numbered_by(rows.select("u", F.col("target").alias("node")), "node", "u", "r")
    outs = numbered_by(rows.select(F.col("u").alias("next"), F.col("source").alias("node")), "node", "next", "r")
    both = cut(ins.join(outs.hint("merge"), ["node", "r"], "full").select("u", "next", "node"))
    odd = both.where("u is null or next is null").select("node").first()
    if odd is not None:
        raise ValueError(f"ways in and out of node {odd[0]} differ")
    return both


def cycles(pairs: DataFrame) -> DataFrame:
    """(u, cycle): the smallest use of each cycle of next pointers, by doubling: equal minima of neighbouring stretches
    mean that the stretches are the whole cycle, as uses differ."""
    ptr = written(pairs.select("u", F.col("next").alias("p"), F.least("u", "next").alias("low")))
    while True:
        up = ptr.select(F.col("u").alias("p"), F.col("p").alias("pp"), F.col("low").alias("ll"))
        new = written(ptr.join(up.hint("merge"), "p").select("u", F.col("pp").alias("p"), F.least("low", "ll").alias("low"), (F.col("ll") < F.col("low")).alias("moved")))
        done = new.where("moved").isEmpty()
        ptr = new.drop("moved")
        if done:
            return ptr.select("u", F.col("low").alias("cycle"))


def merged(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(u, next, node, cycle) with one cycle for each connected part of the graph."""
    state = written(pairs.join(cycles(pairs).hint("merge"), "u"))
    for turn in range(max_rounds):
        at = state.groupBy("node", "cycle").agg(F.min("u").alias("u"))
        at = cut(at.join(at.groupBy("node").agg(F.min("cycle").alias("_a"), F.max("cycle").alias("_b")).where("_a < _b").select("node").hint("merge"), "node"))
        if at.isEmpty():
            return state
        # each cycle goes to one node, in an order of nodes that changes each round
        chosen = at.groupBy("cycle").agg(F.min_by(F.struct("node", "u"), F.struct(F.xxhash64(F.lit(turn), "node"), "node")).alias("c")).select("cycle", "c.node", "c.u")
        size = chosen.groupBy("node").agg(F.count("*").alias("n"), F.min("cycle").alias("into")).where("n > 1")
        group = cut(numbered_by(chosen.join(size.hint("merge"), "node"), "node", "cycle", "r"))
        ring = group.select("node", "u", ((F.col("r") + 1) % F.col("n")).alias("r"))
        other = group.select("node", "r", F.col("u").alias("v"))
        swap = ring.join(other.hint("merge"), ["node", "r"]).select("u", "v").join(state.select(F.col("u").alias("v"), F.col("next").alias("new")).hint("merge"), "v").select("u", "new")
        names = group.select("cycle", "into")
        state = state.join(swap.hint("merge"), "u", "left").join(names.hint("merge"), "cycle", "left")
        state = written(state.select("u", F.coalesce("new", "next").alias("next"), "node", F.coalesce("into", "cycle").alias("cycle")))
    raise RuntimeError("cycles did not merge")


def places(state: DataFrame) -> DataFrame:
    """(u, cycle, i): place of each use in its circuit, which begins with the smallest use; pointers back are doubled."""
    back = state.select(F.col("next").alias("u"), F.col("u").alias("b"), "cycle")
    head = F.col("u") == F.col("cycle")
    # a cycle's name is its smallest use, which heads it
    ptr = written(back.select("u", "cycle", F.when(head, F.col("u")).otherwise(F.col("b")).alias("p"), F.when(head, 0).otherwise(1).cast("long").alias("i")))
    while not ptr.where("p <> cycle").isEmpty():
        up = ptr.select(F.col("u").alias("p"), F.col("p").alias("pp"), F.col("i").alias("ii"))
        ptr = written(ptr.join(up.hint("merge"), "p").select("u", "cycle", F.col("pp").alias("p"), (F.col("i") + F.col("ii")).alias("i")))
    return ptr.select("u", "cycle", "i")


def circuits(edges: DataFrame) -> DataFrame:
    """(circuit, i, edge_id, source, target): an Euler circuit of each connected part of edges(edge_id, source, target,
    copy_num) that uses every copy once. Edges without copies are not used; null copies count as none. Copies that are
    no circulation are an error; no edges, no circuits. Which of the circuits it is depends on the order of rows."""
    rows = uses(edges)
    state = merged(paired(rows))
    return places(state).join(rows.hint("merge"), "u").select(F.col("cycle").alias("circuit"), "i", "edge_id", "source", "target")


def broken(circuit: DataFrame) -> DataFrame:
    """(circuit, i): places after which the next use does not begin where this one ends."""
    size = circuit.groupBy("circuit").agg(F.count("*").alias("n"))
    here = circuit.join(size, "circuit").select("circuit", "i", "target", ((F.col("i") + 1) % F.col("n")).alias("j"))
    after = circuit.select("circuit", F.col("i").alias("j"), F.col("source").alias("start"))
    return here.join(after.hint("merge"), ["circuit", "j"], "left").where("start is null or start <> target").select("circuit", "i")
