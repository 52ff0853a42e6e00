"""Known values of the numeric kernels."""

import itertools
import math
import random

import numpy as np
import pytest

from helixframe.operators import hmm, kernels


def test_split_copies():
    assert kernels.split_copies([2, 6, 0, 4], [9, 0, 1, 2]) == [[1, 0, 1, 0], [5, 0, 0, 1], [0, 0, 0, 0], [3, 0, 0, 1]]


def test_euler_counts():
    assert kernels.euler_count([(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, 1)]) == -math.inf
    assert kernels.euler_count([(0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, 1)], many=True) == pytest.approx(0)
    assert math.exp(kernels.euler_count([(0, 1, 2), (1, 0, 1), (1, 0, 1)])) == pytest.approx(1)
    assert math.exp(kernels.euler_count([(0, 0, 1), (0, 0, 1), (0, 0, 2)])) == pytest.approx(3)
    assert kernels.euler_count([(0, 1, 0), (1, 0, 0)]) == -math.inf


def test_euler_circuit_uses_every_edge_once():
    edges = [(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 1, 3), (4, 3, 1)]
    walk = kernels.euler_circuit(edges, 0)
    ends = {e: (s, t) for e, s, t in edges}
    assert sorted(walk) == [0, 1, 2, 3, 4]
    assert all(ends[a][1] == ends[b][0] for a, b in zip(walk, walk[1:] + walk[:1]))


def test_yen_against_all_simple_paths():
    rng = random.Random(1)
    for _ in range(40):
        edges = [(i, rng.randrange(5), rng.randrange(5)) for i in range(9)]
        cost = {i: rng.randrange(1, 9) for i in range(9)}
        best = {}
        for e, s, t in edges:
            if s != t and ((s, t) not in best or cost[e] < cost[best[s, t]]):
                best[s, t] = e
        want = []
        for n in range(0, 4):
            for mid in itertools.permutations([1, 2, 3], n):
                walk = [0, *mid, 4]
                if all(p in best for p in zip(walk, walk[1:])):
                    want.append(sum(cost[best[p]] for p in zip(walk, walk[1:])))
        got = kernels.k_shortest_simple_paths(edges, 0, 4, 100, lambda e: cost[e[0]])
        assert [sum(cost[e] for e in p) for p in got] == sorted(want)


def test_circulation_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        n, m = rng.randrange(2, 4), rng.randrange(3, 5)
        edges = [(i, rng.randrange(n), rng.randrange(n)) for i in range(m)]
        f = [rng.random() * 3 for _ in range(m)]
        demand, cap = [rng.random() < 0.3 for _ in range(m)], [4] * m
        cost = rng.choice([kernels.cost_v1, kernels.cost_v4])
        best = math.inf
        for c in itertools.product(range(5), repeat=m):
            net = np.zeros(n, int)
            for (_, s, t), x in zip(edges, c):
                net[s] -= x
                net[t] += x
            if not net.any() and all(x >= d for x, d in zip(c, demand)):
                best = min(best, sum(cost([y], x) for y, x in zip(f, c)))
        got = kernels.min_cost_circulation(edges, [int(d) for d in demand], cap, [lambda c, y=y: cost([y], c) for y in f])
        if best == math.inf:
            assert got is None
        else:
            assert sum(cost([y], x) for y, x in zip(f, got)) == pytest.approx(best)


def test_forward_and_backward_values():
    zero, high = (hmm.linear_model("ATTCGATCGT", p) for p in (hmm.Params.zero_error(), hmm.Params.high_error()))
    f = hmm.forward(zero, "CGATC")
    assert hmm.full_prob(f) == pytest.approx(-13.8155605, abs=1e-5)
    assert f[-1].lp(f[-1].m[7]) == pytest.approx(-2.3026350932, abs=1e-5)
    assert hmm.full_prob(hmm.forward(zero, "CGATT")) == -math.inf
    assert hmm.full_prob(hmm.forward(high, "CGATC")) == pytest.approx(-15.212633254, abs=1e-5)
    assert hmm.full_prob(hmm.forward(high, "CGATT")) == pytest.approx(-16.7862972, abs=1e-5)
    assert hmm.full_prob_backward(hmm.backward(zero, "CGATC")) == pytest.approx(-13.8155605, abs=1e-5)
    assert hmm.full_prob_backward(hmm.backward(high, "CGATC")) == pytest.approx(-15.2115765494, abs=1e-5)
    assert hmm.full_prob_backward(hmm.backward(high, "CGATT")) == pytest.approx(-16.7787277, abs=1e-5)


def test_mapping_and_usage():
    high, zero = (hmm.linear_model("ATTCGATCGT", p) for p in (hmm.Params.high_error(), hmm.Params.zero_error()))
    got = [t.tolist() for t, _ in hmm.map_read(high, "CGATC", top=3)]
    assert got == [[3, 2, 4], [4, 3, 5], [5, 6, 4], [6, 7, 5], [7, 8, 6]]
    assert hmm.node_freqs(*hmm.run(zero, "CGATC", "dense"), 10).round(6).tolist() == [0, 0, 0, 1, 1, 1, 1, 1, 0, 0]
    edge, init = hmm.edge_and_init_freqs(zero, "CGATC", *hmm.run(zero, "CGATC", "dense"))
    assert edge.round(6).tolist() == [0, 0, 0, 1, 1, 1, 1, 0, 0]
    assert init.sum() == pytest.approx(1)


def test_batched_sparse_and_dense_agree():
    rng = np.random.default_rng(3)
    seq = "".join(rng.choice(list("ACGT"), 300))
    h = hmm.linear_model(seq, hmm.Params.default())
    reads = [seq[20:90], seq[100:180], seq[5:6], seq[200:260].replace("A", "C", 2)]
    dense = [hmm.full_prob(hmm.forward(h, x)) for x in reads]
    assert hmm.forward_scores(h, reads) == pytest.approx(dense, abs=1e-9)
    assert [hmm.score(h, x) for x in reads] == pytest.approx(dense, abs=1e-2)
    f, b = hmm.run(h, reads[0])
    assert hmm.full_prob_backward(b) == pytest.approx(hmm.full_prob(f), abs=0.05)


def test_alignment():
    score, ops = kernels.align("ACGTACGT", "ACGTCGT")
    assert ops.count("D") == 1 and ops.count("M") == 7 and score == 7 - 6


def test_batched_scores_of_graphs_and_odd_reads():
    rng = random.Random(3)
    for _ in range(25):
        n = rng.randrange(1, 7)
        edges = list(dict.fromkeys((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 9))))
        base = [rng.choice("ACGTn") for _ in range(n - 1)] + ["A"]
        params = hmm.Params(0.03, 0.02, 0.05, max_gaps=rng.randrange(0, 5))
        h = hmm.graph_model(base, [s for s, _ in edges], [t for _, t in edges], [rng.randrange(0, 4) for _ in range(n)], params, least=1)
        reads = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40))) for _ in range(20)] + ["", "AXé中C"]
        reads += reads[:3]
        assert np.allclose(hmm.forward_scores(h, reads, 7), [hmm.full_prob(hmm.forward(h, x)) for x in reads], rtol=1e-10, atol=1e-9)
    assert len(hmm.forward_scores(h, [])) == 0
