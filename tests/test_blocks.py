"""Models in blocks against whole models."""

import math
import random

import numpy as np
import pytest

from helixframe.operators import blocks, hmm
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans import posterior as Q

PARAMS = hmm.Params.uniform(0.01)


@pytest.fixture(scope="module")
def mapped(spark):
    haps = spark.createDataFrame([(0, "L", "TCCCAGCAGCAGCAGGAATTCAGCAGTT")], "hap_id long, style string, seq string")
    g = Assembly.from_kmers(K.from_styled(haps, 4), 4)
    reads = spark.createDataFrame([(0, "CCCAGCAGCAG"), (1, "AGCAGGAATT"), (2, "TTCAGCAG"), (3, "GGAATTC")], "read_id long, seq string")
    m = Q.map_reads(g, reads, PARAMS)
    at = {n: i for i, n in enumerate(g.node_ids())}
    maps: dict = {}
    for r in m.collect():
        maps.setdefault(r.read_id, {}).setdefault(r.pos, []).append(at[r.node])
    return g, reads, m, {r.read_id: (r.seq, [maps[r.read_id][j] for j in range(len(r.seq))]) for r in reads.collect()}


def whole(g, reads, copies):
    return {i: hmm.score(g.model(PARAMS, copies=copies), x, m) for i, (x, m) in reads.items()}


@pytest.mark.parametrize("size", [3, 4096])
def test_candidates_equal_whole_models(mapped, size):
    g, reads, m, known = mapped
    base = g.facts("copies")
    cands = [base] + [c for c in (Q.kernels.apply_cycle(base, list(u.cycle)) for u in Q.moves(g, "S")) if min(c.values()) >= 0][:6]
    g._local["blocks"] = blocks.BlockModel.of(g, size)
    want = [sum(whole(g, known, c).values()) for c in cands]
    assert np.allclose(Q.likelihoods(g, reads, m, PARAMS, cands), want, rtol=1e-12)


def test_untouched_reads_are_not_scored(spark, mapped):
    g, reads, m, known = mapped
    model = blocks.BlockModel.of(g, 5)
    of = {r.full: r.compact for r in g.full_to_compact().collect()}
    owners: dict = {e: set() for e in g.facts("copies")}
    for r in m.collect():
        owners[of[r.node]].add(r.read_id)
    edge = min(owners, key=lambda e: (len(owners[e]) or 99))
    changes = spark.createDataFrame([(0, edge, 1), (1, edge, 0), (2, edge, 1), (2, edge, -1)], "candidate long, edge long, delta long")
    got = {r.candidate: r for r in model.candidate_scores(reads, m, PARAMS, changes).collect()}
    assert len(owners[edge]) <= got[0].rescored <= 4 and got[1].rescored == got[2].rescored == 0
    assert got[0].lp == pytest.approx(sum(whole(g, known, {**g.facts("copies"), edge: g.facts("copies")[edge] + 1}).values()), rel=1e-12)
    assert got[1].lp == got[2].lp == pytest.approx(sum(whole(g, known, None).values()), rel=1e-12)


def test_parts_fetch_only_their_blocks(mapped):
    g, _, m, _ = mapped
    model = blocks.BlockModel.of(g, 4)
    view = blocks.Blocks(model.folder, 4, kept=2)
    ids = np.array(sorted(g.node_ids()))
    view.part(ids[:3])
    assert view.fetched == 1
    for i in range(0, len(ids), 4):
        view.part(ids[i : i + 4])
    assert len(view.held) <= 2
    with pytest.raises(KeyError):
        view.part(np.array([ids[-1] + 1]))


def test_odd_reads(spark, mapped):
    g, reads, m, _ = mapped
    model = blocks.BlockModel.of(g)
    more = reads.unionByName(spark.createDataFrame([(8, ""), (9, "ACGT"), (10, None)], "read_id long, seq string"))
    got = {r.read_id: r.lp for r in model.scores(more, m, PARAMS).collect()}
    assert all(got[i] == -math.inf for i in (8, 9, 10)) and all(got[i] > -math.inf for i in range(4))
    changes = spark.createDataFrame([(0, 0, 1)], "candidate long, edge long, delta long")
    assert model.candidate_scores(more, m, PARAMS, changes).first().lp == -math.inf
    none = model.candidate_scores(reads.limit(0), m.limit(0), PARAMS, changes).first()
    assert none.lp == 0.0 and none.rescored == 0


def test_random_graph(spark):
    """Arcs, copies and reads at random: each read's score by its block model is that of the whole model."""
    rng = random.Random(8)
    n = 40
    nodes = [(i * 3, rng.choice("ACGTn"), rng.randrange(4), i % 7) for i in range(n)]
    arcs = sorted({(rng.randrange(n) * 3, rng.randrange(n) * 3) for _ in range(90)})
    model = blocks.BlockModel(spark.createDataFrame(nodes, "node_id long, base string, copy_num long, owner long"), spark.createDataFrame(arcs, "source long, target long"), 5, 7)
    h = hmm.graph_model([x[1] for x in nodes], [a // 3 for a, _ in arcs], [b // 3 for _, b in arcs], [x[2] for x in nodes], PARAMS)
    reads, maps = [], []
    for i in range(12):
        seq = "".join(rng.choice("ACGT") for _ in range(9))
        m = [sorted(rng.sample(range(n), 12)) for _ in seq]
        reads.append((i, seq, hmm.score(h, seq, m)))
        maps += [(i, j, 3 * v, 0.0) for j, vs in enumerate(m) for v in vs]
    got = model.scores(spark.createDataFrame([r[:2] for r in reads], "read_id long, seq string"), spark.createDataFrame(maps, "read_id long, pos int, node long, lp double"), PARAMS)
    assert {r.read_id: r.lp for r in got.collect()} == pytest.approx({r[0]: r[2] for r in reads})
