"""Graph operators over edge frames ``edges(edge_id, source, target, ...)``.

Degree, join and fixpoint operators are DataFrame plans. Algorithms on one component (Euler circuits, shortest paths)
are numpy functions in ``kernels``, run by applyInPandas on the compacted graph.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.plans.durable import written as cut


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def degree_stats(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("n_in", "n_out").agg(F.count("*").alias("nodes"))


def remove_dead_end_nodes(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Edges left after removing nodes without a way in or out until there are none.

    Each round drops the edges at such nodes and then makes one edge of each simple path, so that a path of any length
    goes in one round and a tree in as many as the logarithm of its size."""
    live, levels = cut(edges.select("edge_id", "source", "target")), []
    for _ in range(max_rounds):
        gone = cut(degrees(live).where("n_in = 0 or n_out = 0").select("node"))
        if gone.isEmpty():
            break
        left = live.join(gone, live["source"] == gone["node"], "left_anti")
        left = cut(left.join(gone, left["target"] == gone["node"], "left_anti"))
        places = simple_paths(left, _inner(left))
        levels.append(places.select(F.col("e").alias("edge_id"), F.col("head")))
        live = _joined(left, places)
    else:
        raise RuntimeError("dead ends did not settle")
    alive = live.select("edge_id")
    for level in reversed(levels):
        alive = cut(level.join(alive.withColumnRenamed("edge_id", "head"), "head", "left_semi").select("edge_id"))
    return edges.join(alive, "edge_id", "left_semi")


def isolated_nodes_removed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id"))).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def subgraph(edges: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(F.col(node).alias("_n"))
    return edges.join(n, edges["source"] == n["_n"], "left_semi").join(n, edges["target"] == n["_n"], "left_semi")


def compact(edges: DataFrame, keep: DataFrame | None = None, circles: bool = True) -> DataFrame:
    """Simple paths as (edge_id, source, target, edges_in_full): every node with one way in and one out, not in
    ``keep(node)`` (the terminal) and without a loop of its own, is contracted by pointer doubling.

    An edge points to the edge before it across a contracted node; after r rounds a pointer spans 2**r steps, so
    paths take O(log length) joins. A cycle of contracted nodes alone ends as one loop, broken before its smallest
    edge; it begins and ends at no node that is kept, and without ``circles`` it is no path. Ids are the smallest edge of
    each path, in the order of ids.
    """
    e = edges.select("edge_id", "source", "target")
    paths = simple_paths(e, _inner(e, keep), circles)
    full = paths.join(e.withColumnRenamed("edge_id", "e"), "e")
    out = full.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("d", "e", "source", "target"))).alias("x"))
    out = out.select(F.array_min(F.transform("x", lambda s: s["e"])).alias("_low"), F.col("x")[0]["source"].alias("source"), F.element_at("x", -1)["target"].alias("target"), F.transform("x", lambda s: s["e"]).alias("edges_in_full"))
    from helixframe.operators.kmers import number

    return number(out.orderBy("_low"), "edge_id").select("edge_id", "source", "target", "edges_in_full")


def _inner(edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(node): nodes to contract."""
    inner = degrees(edges).where("n_in = 1 and n_out = 1").select("node")
    loops = edges.where("source = target").select(F.col("source").alias("node"))
    inner = inner.join(loops, "node", "left_anti")
    return inner if keep is None else inner.join(keep.select("node"), "node", "left_anti")


def simple_paths(e: DataFrame, inner: DataFrame, circles: bool = True) -> DataFrame:
    """(e, head, d): the simple path of each edge, named by its first edge, and the edge's place in it; by pointer doubling,
    in rows of fixed size.

    After each round a path has fewer edges whose pointer is not at its head, so when their number stays, what is left are
    circles; those turn on until no smallest id falls, as each has seen its whole circle then. Without ``circles`` they
    are left out."""
    inner = cut(inner)
    before = e.join(inner, e["target"] == inner["node"], "left_semi").select(F.col("edge_id").alias("prev"), F.col("target").alias("source"))
    start = F.col("prev").isNull()
    ptr = cut(e.join(before, "source", "left").select(F.col("edge_id").alias("e"), F.coalesce("prev", "edge_id").alias("p"), F.when(start, 0).otherwise(1).cast("long").alias("d"), F.least("edge_id", F.coalesce("prev", "edge_id")).alias("low"), start.alias("done"), (~start).alias("fell")))
    was, (left, fell) = None, _open(ptr)
    while left and (left != was or (circles and fell)):
        up = ptr.select(F.col("e").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"), F.col("low").alias("ll"), F.col("done").alias("at_head"))
        ptr = cut(ptr.join(up, "p").select("e", F.col("pp").alias("p"), (F.col("d") + F.col("dd")).alias("d"), F.least("low", "ll").alias("low"), F.col("at_head").alias("done"), (F.col("ll") < F.col("low")).alias("fell")))
        was, (left, fell) = left, _open(ptr)
    paths = ptr.where("done").select("e", F.col("p").alias("head"), "d")
    return cut(paths.unionByName(_rings(ptr.where("not done").select("e", "low"), e))) if left and circles else paths


def _open(ptr: DataFrame) -> tuple[int, int]:
    """Edges whose pointer is not at a head, and those of them whose smallest id fell."""
    return tuple(ptr.where("not done").agg(F.count("*"), F.count_if("fell")).first())


def _joined(e: DataFrame, places: DataFrame) -> DataFrame:
    """One edge (edge_id, source, target) for each simple path, under the id of its first edge."""
    at = places.join(e.withColumnRenamed("edge_id", "e"), "e")
    ends = at.groupBy("head").agg(F.min_by("source", "d").alias("source"), F.max_by("target", "d").alias("target"))
    return cut(ends.select(F.col("head").alias("edge_id"), "source", "target"))


def _rings(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """(e, head, d) for cycles of contracted nodes: distance from the smallest edge of each."""
    ring = cut(rings.withColumnRenamed("low", "head"))
    e = edges.join(ring, edges["edge_id"] == ring["e"]).select("e", "head", "source", "target")
    prev = e.select(F.col("e").alias("p"), F.col("target").alias("source"))
    ptr = e.join(prev, "source").select("e", "head", F.when(F.col("e") == F.col("head"), F.col("e")).otherwise(F.col("p")).alias("p"), F.when(F.col("e") == F.col("head"), 0).otherwise(1).cast("long").alias("d"))
    ptr = cut(ptr)
    while not ptr.where("p <> head").isEmpty():
        up = ptr.select(F.col("e").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        ptr = cut(ptr.join(up, "p").select("e", "head", F.col("pp").alias("p"), (F.col("d") + F.col("dd")).alias("d")))
    return ptr.select("e", "head", "d")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, scc): strongly connected components, named by their smallest node.

    The graph is first cut down: nodes without a way in or out are components of their own, and simple paths become
    edges, again and again while that helps; a path or tree takes O(log) rounds. What is left is coloured: colours spread
    forward from the smallest node, what a colour's root reaches backward inside the colour is a component, and the
    rest is cut down again. Last, the nodes of contracted paths join the component of both ends of their path, or are
    their own."""
    ids = edges.select("source", "target")
    nodes = cut(ids.select(F.col("source").alias("node")).unionByName(ids.select(F.col("target").alias("node"))).distinct())
    e, levels, found = _named_edges(ids), [], []
    for _ in range(max_rounds):
        e, more = _cut_down(e, max_rounds)
        levels += more
        left = cut(e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct())
        if left.isEmpty():
            break
        pairs = e.select("source", "target")
        colour = _spread(left.select("node", F.col("node").alias("c")), pairs)
        same = pairs.join(colour.withColumnRenamed("node", "source").withColumnRenamed("c", "cs"), "source").join(colour.withColumnRenamed("node", "target").withColumnRenamed("c", "ct"), "target").where("cs = ct")
        back = _reach(colour.where("node = c").select("node"), cut(same.select(F.col("target").alias("source"), F.col("source").alias("target"))))
        got = cut(colour.join(back, "node", "left_semi").select("node", F.col("c").alias("scc")))
        found.append(got)
        ways = e.join(got.withColumnRenamed("node", "source").drop("scc"), "source", "left_anti")
        e = cut(ways.join(got.withColumnRenamed("node", "target").drop("scc"), "target", "left_anti").select("edge_id", "source", "target"))
    else:
        raise RuntimeError("components did not settle")
    inside = reduce(DataFrame.unionByName, levels).select("node").distinct() if levels else nodes.limit(0)
    known = reduce(DataFrame.unionByName, found) if found else nodes.limit(0).withColumn("scc", F.col("node"))
    # nodes that were never contracted are coloured or alone; contracted ones follow, the last contracted first
    own = nodes.join(inside, "node", "left_anti").join(known, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))
    scc = cut(own)
    for level in reversed(levels):
        a = scc.select(F.col("node").alias("u"), F.col("scc").alias("a"))
        b = scc.select(F.col("node").alias("v"), F.col("scc").alias("b"))
        new = level.join(a, "u").join(b, "v").select("node", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("node")).alias("scc"))
        scc = cut(scc.unionByName(new))
    least = scc.groupBy("scc").agg(F.min("node").alias("least"))
    return scc.join(least, "scc").select("node", F.col("least").alias("scc"))


def _named_edges(pairs: DataFrame) -> DataFrame:
    """Edges (edge_id, source, target) of the different pairs, loops left out."""
    return cut(pairs.where("source <> target").distinct().withColumn("edge_id", F.monotonically_increasing_id()).select("edge_id", "source", "target"))


def _cut_down(e: DataFrame, max_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """(edges left, contracted nodes as frames (node, u, v) of the ends of their paths), after dropping ends and
    contracting paths until a round takes less than a twentieth of the edges."""
    levels, n = [], e.count()
    for _ in range(max_rounds):
        if not n:
            break
        gone = cut(degrees(e).where("n_in = 0 or n_out = 0").select("node"))
        left = e.join(gone, e["source"] == gone["node"], "left_anti")
        left = cut(left.join(gone, left["target"] == gone["node"], "left_anti"))
        places = simple_paths(left, _inner(left))
        paths = _joined(left, places)
        last = places.groupBy("head").agg(F.max("d").alias("last"))
        inner = places.join(last, "head").where("d < last").join(left.withColumnRenamed("edge_id", "e").drop("source"), "e")
        inner = inner.select("head", F.col("target").alias("node")).join(paths.select(F.col("edge_id").alias("head"), F.col("source").alias("u"), F.col("target").alias("v")), "head")
        inner = cut(inner.select("node", "u", "v"))
        if not inner.isEmpty():
            levels.append(inner)
        e = _named_edges(paths)
        was, n = n, e.count()
        if 20 * (was - n) < was:
            break
    return e, levels


def _spread(labels: DataFrame, e: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along edges; a round follows the labels that fell in the last one."""
    labels = moved = cut(labels)
    while not moved.isEmpty():
        push = moved.join(e, moved["node"] == e["source"]).select(F.col("target").alias("node"), "c", F.lit(None).cast(labels.schema["c"].dataType).alias("was"))
        nxt = cut(labels.withColumn("was", F.col("c")).unionByName(push).groupBy("node").agg(F.min("c").alias("c"), F.max("was").alias("was")))
        labels, moved = nxt.select("node", "c"), nxt.where("c <> was").select("node", "c")
    return labels


def _reach(frontier: DataFrame, e: DataFrame) -> DataFrame:
    seen = cut(frontier.select("node", F.lit(True).alias("new")))
    while not (fresh := seen.where("new")).isEmpty():
        step = fresh.join(e, fresh["node"] == e["source"]).select(F.col("target").alias("node"), F.lit(True).alias("new"))
        seen = cut(seen.select("node", F.lit(False).alias("new")).unionByName(step).groupBy("node").agg(F.min("new").alias("new")))
    return seen.select("node")


def component_sizes(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(scc, nodes, edges): sizes are counted in nodes; an edge belongs to the component of its target."""
    n = components.groupBy("scc").agg(F.count("*").alias("nodes"))
    m = edges.join(components, edges["target"] == components["node"]).groupBy("scc").agg(F.count("*").alias("edges"))
    return n.join(m, "scc", "left").select("scc", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges whose target is in the component with the most nodes (ties: the smallest id)."""
    c = strong_components(edges)
    best = c.groupBy("scc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scc").limit(1)
    inside = c.join(F.broadcast(best), "scc", "left_semi")
    return edges.join(inside, edges["target"] == inside["node"], "left_semi")


def bridges(edges: DataFrame) -> DataFrame:
    """Edges between different strongly connected components."""
    c = strong_components(edges)
    a = c.select(F.col("node").alias("source"), F.col("scc").alias("_a"))
    b = c.select(F.col("node").alias("target"), F.col("scc").alias("_b"))
    return edges.join(a, "source").join(b, "target").where("_a <> _b").drop("_a", "_b")


def split_node(edges: DataFrame, node, out_id, joined: Column | None = None) -> DataFrame:
    """Edges after splitting a node: ways out start at ``out_id``; optionally a new edge joins the two halves."""
    e = edges.withColumn("source", F.when(F.col("source") == node, F.lit(out_id)).otherwise(F.col("source")))
    return e if joined is None else e.unionByName(edges.sparkSession.range(1).select(joined.alias("_x")).select("_x.*"), allowMissingColumns=True)


def purge(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, map(old_id, new_id)): ids are keys and stay; new_id is null for a deleted edge."""
    left = edges.join(gone.select("edge_id"), "edge_id", "left_anti")
    m = edges.select(F.col("edge_id").alias("old_id")).join(left.select(F.col("edge_id").alias("old_id"), F.col("edge_id").alias("new_id")), "old_id", "left")
    return left, m


def compose(f: DataFrame, g: DataFrame) -> DataFrame:
    """Map f then g: (old_id, new_id)."""
    return f.join(g.select(F.col("old_id").alias("_m"), F.col("new_id").alias("_n")), F.col("new_id") == F.col("_m"), "left").select("old_id", F.col("_n").alias("new_id"))


def line_graph(edges: DataFrame, to_node: Callable[[], Column] | None = None) -> DataFrame:
    """(a, b, node): consecutive edge pairs, the node between them."""
    a = edges.select(F.col("edge_id").alias("a"), F.col("target").alias("node"))
    b = edges.select(F.col("edge_id").alias("b"), F.col("source").alias("node"))
    out = a.join(b, "node").select("a", "b", "node")
    return out if to_node is None else out.withColumn("value", to_node())


def node_path_to_edges(path: DataFrame, edges: DataFrame, cost: str) -> DataFrame:
    """(i, edge_id): the cheapest of the parallel edges between the nodes of path(i, source, target)."""
    best = edges.groupBy("source", "target").agg(F.min_by("edge_id", F.struct(F.col(cost), F.col("edge_id"))).alias("edge_id"))
    return path.join(best, ["source", "target"]).select("i", "edge_id")
