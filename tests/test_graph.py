"""Components and dead ends against brute force; long paths in few rounds."""

import random

import pytest

from helixframe.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, source long, target long")


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b in pairs:
            for v in nodes:
                if a in reach[v]:
                    reach[v].add(b)
    return {v: min(u for u in reach[v] if v in reach[u]) for v in nodes}


def brute_alive(pairs):
    live = dict(enumerate(pairs))
    while True:
        ins, outs = {b for _, b in live.values()}, {a for a, _ in live.values()}
        new = {i: (a, b) for i, (a, b) in live.items() if a in ins and b in outs and a in outs and b in ins}
        if len(new) == len(live):
            return set(new)
        live = new


def drawn(seed):
    rng = random.Random(seed)
    n = rng.randrange(8, 22)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n // 2, 2 * n))]
    for start in (100, 200):  # chains that hang on, join, or close to rings
        a, b = rng.randrange(n), rng.randrange(n)
        chain = [a, *range(start, start + rng.randrange(1, 7)), rng.choice([a, b, start + 50])]
        pairs += list(zip(chain, chain[1:], strict=False))
    return pairs + [(300, 301), (301, 302), (302, 300), (400, 400), (401, 402)]


@pytest.mark.parametrize("seed", [0, 3])
def test_random_graphs(spark, seed):
    pairs = drawn(seed)
    e = edges(spark, pairs)
    assert {r.node: r.scc for r in G.strong_components(e).collect()} == brute_scc(pairs)
    assert {r.edge_id for r in G.remove_dead_end_nodes(e).collect()} == brute_alive(pairs)


def rounds(monkeypatch):
    count = []
    plain = G.cut
    monkeypatch.setattr(G, "cut", lambda df: count.append(1) or plain(df))
    return count


def test_long_path_in_few_rounds(spark, monkeypatch):
    """A path of 100,000 nodes that ends in a ring of two: all but the ring are dead ends and components of their own."""
    n = 100_000
    e = spark.range(n).selectExpr("id as edge_id", "(id * 77777) % 100003 as source", "((id + 1) * 77777) % 100003 as target")
    last = (n * 77777) % 100003
    e = e.unionByName(spark.createDataFrame([(n, last, 200_000), (n + 1, 200_000, last)], "edge_id long, source long, target long"))
    count = rounds(monkeypatch)
    assert {r.edge_id for r in G.remove_dead_end_nodes(e).collect()} == {n, n + 1}
    assert len(count) < 40
    count.clear()
    sizes = G.strong_components(e).groupBy("scc").count().where("count > 1").collect()
    assert [(r["scc"], r["count"]) for r in sizes] == [(min(last, 200_000), 2)] and len(count) < 60


def test_no_edges(spark):
    e = spark.createDataFrame([], "edge_id long, source long, target long")
    assert G.strong_components(e).count() == 0 and G.remove_dead_end_nodes(e).count() == 0
