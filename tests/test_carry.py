"""Carried mappings and the posterior as a table, against brute force, recomputed mappings and the search's own object."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import hmm, inherit
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans import posterior as Q
from helixframe.plans import samples
from helixframe.sources import fasta, formats


def frame(spark, rows):
    return spark.createDataFrame(rows, "read_id long, pos long, node long, lp double")


def weights(df):
    return {(r.read_id, r.pos, r.node): round(math.exp(r.lp), 9) for r in df.collect()}


def test_inherit_splits_and_sums(spark):
    m = frame(spark, [(1, 0, 1, math.log(0.5)), (1, 0, 2, math.log(0.3)), (1, 0, 3, math.log(0.2)), (1, 1, 3, 0.0), (2, 0, 1, -2000.0), (2, 0, 2, -2000.0 + math.log(3))])
    ways = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (4, 12)], "node long, new_node long")
    got = weights(inherit.inherit(m, ways))  # 3 has no successor: its weight goes to the others; (1, 1) goes
    want = {(1, 0, 10): 0.25 / 0.8, (1, 0, 11): 0.55 / 0.8, (2, 0, 10): 0.125, (2, 0, 11): 0.875}
    assert got == {k: round(v, 9) for k, v in want.items()}
    assert weights(inherit.inherit(m, ways, 1)) == {(1, 0, 11): 1.0, (2, 0, 11): 1.0}
    assert inherit.inherit(m.limit(0), ways).count() == 0 and inherit.inherit(m, ways.limit(0)).count() == 0


def test_compare(spark):
    a = frame(spark, [(1, 0, 5, math.log(0.5)), (1, 0, 6, math.log(0.5)), (1, 1, 7, 0.0)])
    b = frame(spark, [(1, 0, 6, math.log(0.25)), (1, 0, 8, math.log(0.75)), (2, 0, 1, 0.0)])
    got = {(r.read_id, r.pos): tuple(r)[2:] for r in inherit.compare(a, b).collect()}
    assert got[1, 0] == (5, 8, False, 1, 3, pytest.approx(0.75))
    assert got[1, 1] == (7, None, False, 0, 1, 1.0) and got[2, 0] == (None, 1, False, 0, 1, 1.0)


def test_inherited_tops_are_recomputed_ones(spark):
    """Reads without errors of a genome with a repeat."""
    rng = random.Random(4)
    unit = "".join(rng.choice("ACGT") for _ in range(30))
    genome = "".join(rng.choice("ACGT") for _ in range(25)) + unit + "GATTA" + unit + "".join(rng.choice("ACGT") for _ in range(25))
    reads = spark.createDataFrame([(i, genome[at : at + 40]) for i, at in enumerate(range(0, len(genome) - 39, 9))] + [(99, "")], "read_id long, seq string")
    haps = spark.createDataFrame([(0, "L", genome)], "hap_id long, style string, seq string")
    g = Assembly.from_kmers(K.from_styled(haps, 8), 8)
    got = inherit.check(g, reads, hmm.Params.uniform(0.001), 10).orderBy("k").collect()
    assert [r.k for r in got] == [9, 10]
    assert all(r.bases == 40 * (reads.count() - 1) and r.same_top == 1.0 and r.distance < 1e-4 for r in got)


def test_context_mapping(spark):
    t = spark.createDataFrame([(1, "nAC", 3), (2, "GAC", 1), (3, "ACG", 2), (4, "CGT", 0)], "edge_id long, kmer string, copy_num long")
    reads = spark.createDataFrame([(1, "ACGT"), (2, ""), (3, None)], "read_id long, seq string")
    assert weights(inherit.by_context(reads, t, 2)) == {(1, 1, 1): 0.75, (1, 1, 2): 0.25, (1, 2, 3): 1.0}


# ---- samples


def store_of(spark, vectors, scores, shuffle=False):
    rows = [(i, sorted(v), [v[e] for e in sorted(v)] if not shuffle else [v[e] for e in sorted(v)], *s, f"[S(e{i}+)]") for i, (v, s) in enumerate(zip(vectors, scores, strict=True))]
    return samples.scored(spark.createDataFrame(rows, "sample_id long, edges array<long>, copy_nums array<long>, likelihood double, prior double, n_euler double, genome_size long, infos string"))


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(2)
    vectors = [{0: rng.randrange(3), 4: rng.randrange(3), 9: rng.randrange(2)} for _ in range(60)]
    scores = {}
    out = []
    for v in vectors:  # a vector has one score, and scores tie
        out.append(scores.setdefault(tuple(v.items()), (float(-rng.randrange(4)), -1.5, 0.25, sum(v.values()))))
    post = Q.Posterior()
    for v, s in zip(vectors, out, strict=True):
        post.add(Q.Sample(Q.vector(v), Q.Score(*s)))
    return vectors, out, post


def test_store_equals_the_object(spark, drawn):
    vectors, scores, post = drawn
    rows = store_of(spark, vectors, scores).repartition(7)
    s = samples.upsert(samples.upsert(samples.empty(spark), rows.where("sample_id < 20")), rows.where("sample_id >= 15"))
    got = s.orderBy("sample_id").collect()
    assert [tuple(zip(r.edges, r.copy_nums, strict=True)) for r in got] == list(post.samples)
    b = samples.best(s).first()
    assert tuple(zip(b.edges, b.copy_nums, strict=True)) == post.max_sample().copies  # of ties the last
    assert samples.total(s).first().z == pytest.approx(post.p()) and samples.total(s).first().samples == len(post.samples)
    dist = {}
    for r in samples.marginals(s).collect():
        dist.setdefault(r.edge, {})[r.x] = r.p
    for e in (0, 4, 9):
        assert dist[e] == pytest.approx(post.edge_distribution(e))
    ask = spark.createDataFrame([([9, 0, 4], [vectors[3][9], vectors[3][0], vectors[3][4]], "there"), ([0, 4], [0, 0], "other"), ([], [], "none")], "edges array<int>, copy_nums array<int>, name string")
    found = {r.name: r.p_lp for r in samples.find(s, ask).collect()}
    assert found["there"] == pytest.approx(sum(scores[3][:3])) and found["other"] is None and found["none"] is None
    assert [r.name for r in samples.contained(s, ask).collect()] == ["there"]


def test_equal_hashes_are_told_apart(spark, drawn):
    """Vectors of one hash stay two samples."""
    rows = store_of(spark, [{0: 1}, {0: 2}, {0: 1}], [(-1.0, 0.0, 0.0, 1)] * 3).withColumn("sign", F.lit(7).cast("long"))
    s = samples.upsert(samples.empty(spark).withColumn("sign", F.lit(7).cast("long")), rows.where("sample_id < 2"))
    assert s.count() == 2 and samples.upsert(s, rows).count() == 2


def test_odd_samples(spark):
    e = samples.empty(spark)
    assert samples.total(e).first().z == -math.inf and samples.best(e).count() == 0 and samples.marginals(e).count() == 0
    assert samples.upsert(e, e).count() == 0 and samples.edge_facts(e).count() == 0
    rows = spark.createDataFrame([(0, [1], [2], None, 0.0, 0.0, None, None), (1, [], [], -1.0, 0.0, 0.0, 0, "[]"), (2, [], [], -1.0, 0.0, 0.0, 0, "[]")], "sample_id long, edges array<long>, copy_nums array<long>, likelihood double, prior double, n_euler double, genome_size long, infos string")
    s = samples.upsert(e, samples.scored(rows))
    assert s.count() == 2 and samples.total(s).first().z == -1.0 and samples.best(s).first().sample_id == 1
    with pytest.raises(Exception, match="twice"):
        samples.scored(rows.withColumn("edges", F.lit([1, 1])).withColumn("copy_nums", F.lit([1, 2]))).collect()


def test_sample_files(spark, drawn, tmp_path):
    vectors, scores, post = drawn
    s = samples.upsert(samples.empty(spark), store_of(spark, vectors, scores))
    fasta.write_lines(samples.post_lines(s), str(tmp_path / "p"), formats.ORDER, one=False)
    lines = fasta.read_lines(spark, str(tmp_path / "p"))
    back = samples.read_post(lines, [0, 4, 9])
    key = lambda r: (tuple(r.edges), tuple(r.copy_nums), r.likelihood, r.prior, r.n_euler, r.genome_size, r.infos)
    assert [key(r) for r in back.orderBy("sample_id").collect()] == [key(r) for r in s.orderBy(F.desc("p_lp"), "sample_id").collect()]
    text = "\n".join(r.line for r in lines.orderBy("i").collect())
    assert formats.read_post(text, [0, 4, 9]).p() == pytest.approx(post.p())
    true = spark.createDataFrame([(0, 1), (4, 0), (9, 1)], "edge long, copy_num long")
    made = fasta.text_of(samples.inspect_lines(s, 6, {"genome_size": 12}, true), formats.ORDER)
    again = samples.read_inspect(fasta.lines_of(spark, "# note\n" + made), 6, [0, 4, 9])
    assert again.count() == s.count() and samples.total(again).first().z == pytest.approx(post.p())
    with pytest.raises(ValueError, match="k is 6"):
        samples.read_inspect(fasta.lines_of(spark, made), 7)
    rows = [x.split("\t") for x in made.splitlines()]
    c = [x for x in rows if x[1] == "C"]
    assert [int(x[2]) for x in c] == list(range(len(c)))
    assert all(int(x[8]) == sum(abs(a - b) for a, b in zip(eval(x[10]), (1, 0, 1), strict=True)) for x in c)
    e = {x[2]: x for x in rows if x[1] == "E"}
    for edge, t in ((0, 1), (4, 0), (9, 1)):
        d = post.edge_distribution(edge)
        assert float(e[f"e{edge}"][4]) == pytest.approx(sum(a * p for a, p in d.items()), abs=1e-5) and float(e[f"e{edge}"][5]) == pytest.approx(d.get(t, 0), abs=1e-5)
        assert e[f"e{edge}"][7] == ",".join(f"p({a})={p:.3f}" for a, p in d.items()) and int(e[f"e{edge}"][8]) == post.max_copy_nums()[edge]


def test_marked_graph_equals_the_object(spark):
    haps = spark.createDataFrame([(0, "L", "TCCCAGCAGCAGCAGGAA")], "hap_id long, style string, seq string")
    g = Assembly.from_kmers(K.from_styled(haps, 4), 4)
    base = g.facts("copies")
    move = next(c for c in (Q.kernels.apply_cycle(base, list(u.cycle)) for u in Q.moves(g, "S")) if min(c.values()) >= 0)
    post = Q.Posterior()
    for c, lp in ((base, -1.0), (move, -2.0)):
        post.add(Q.Sample(Q.vector(c), Q.Score(lp, 0.0, 0.0, 1)))
    s = samples.upsert(samples.empty(spark), store_of(spark, [base, move], [(-1.0, 0.0, 0.0, 1), (-2.0, 0.0, 0.0, 1)]))
    truth = spark.createDataFrame(list(base.items()), "edge long, copy_num long")
    for t, u in ((None, None), (truth, base)):
        assert fasta.text_of(samples.gfa_lines(g, s, t), formats.ORDER) == fasta.text_of(formats.gfa_posterior_lines(g, post, u), formats.ORDER)
