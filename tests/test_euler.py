"""Euler circuits by joins: every copy once, every step joined, one circuit for each connected part."""

import random

import pytest

from helixframe.operators import euler

EDGES = "edge_id long, source long, target long, copy_num long"


def closed_walks(seed, nodes, walks, offset=0):
    """Edges of random closed walks: a circulation."""
    rng = random.Random(seed)
    copies: dict = {}
    for _ in range(walks):
        walk = [rng.randrange(nodes) + offset for _ in range(rng.randrange(1, 7))]
        for a, b in zip(walk, walk[1:] + walk[:1], strict=True):
            copies[a, b] = copies.get((a, b), 0) + 1
    return copies


def parts(pairs):
    """Connected parts of the nodes."""
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    return {x: top(x) for x in up}


def check(rows, got):
    by = {}
    for r in got:
        by.setdefault(r.circuit, []).append(r)
    used: dict = {}
    for c in by.values():
        c.sort(key=lambda r: r.i)
        assert [r.i for r in c] == list(range(len(c)))
        assert all(a.target == b.source for a, b in zip(c, c[1:] + c[:1], strict=True))
        for r in c:
            used[r.edge_id] = used.get(r.edge_id, 0) + 1
    assert used == {e: n for e, _, _, n in rows if n}
    assert len(by) == len(set(parts([(s, t) for _, s, t, n in rows if n]).values()))


@pytest.mark.parametrize(("seed", "nodes", "walks"), [(1, 6, 5), (2, 30, 25), (3, 2, 40)])
def test_circuits(spark, monkeypatch, seed, nodes, walks):
    monkeypatch.setattr(euler, "PARTS", 3)
    copies = closed_walks(seed, nodes, walks) | closed_walks(seed + 50, 3, 2, 1000)
    rows = [(i, a, b, n) for i, ((a, b), n) in enumerate(sorted(copies.items()))] + [(9999, 0, 7777, 0)]
    got = euler.circuits(spark.createDataFrame(rows, EDGES))
    check(rows, got.collect())
    assert euler.broken(got).count() == 0


def test_many_cycles_at_one_node(spark):
    """A thousand loops and a thousand rings through one node, and a long chain of rings."""
    rows = [(0, 0, 0, 1000)] + [x for i in range(1, 300) for x in ((2 * i, 0, i, 1), (2 * i + 1, i, 0, 2 if i == 7 else 1))]
    rows += [(1, 0, 7, 1)]
    rows += [x for i in range(200) for x in ((10_000 + 2 * i, 5000 + i, 5001 + i, 1), (10_001 + 2 * i, 5001 + i, 5000 + i, 1))]
    check(rows, euler.circuits(spark.createDataFrame(rows, EDGES)).collect())


def test_odd_graphs(spark):
    assert euler.circuits(spark.createDataFrame([], EDGES)).count() == 0
    assert euler.circuits(spark.createDataFrame([(0, 1, 2, None), (1, 2, 1, 0)], EDGES)).count() == 0
    with pytest.raises(ValueError, match="differ"):
        euler.circuits(spark.createDataFrame([(0, 1, 2, 2), (1, 2, 1, 1)], EDGES))
