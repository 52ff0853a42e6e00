"""From simulated reads to a posterior, files there and back, comparisons."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import queries
from helixframe.functions import sequence as S
from helixframe.operators import compare, hmm, simulate
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans import draft as D
from helixframe.plans import posterior as Q
from helixframe.sources import fasta, formats


@pytest.fixture(scope="module")
def fragment(spark):
    genome = simulate.simple(120, 3)
    reads = simulate.justify_strand(simulate.sample_reads(spark, genome, 12, simulate.ReadProfile(40, "emit"), hmm.Params.uniform(0.0), 1, both_strands=False)).cache()
    return simulate.haps_frame(spark, genome), reads, genome


def test_edits():
    e = simulate.Edit
    assert simulate.apply_edits("ACGT", [e(0, 0, "T"), e(1, 1, "G"), e(2, 2)]) == "TGCT"
    s, edits = simulate.mutate(simulate.generate(200, 1), simulate.Profile(0.1), 2)
    assert s == simulate.apply_edits(simulate.generate(200, 1), edits) and len(edits) <= 20


def test_reads_lie_on_the_genome(fragment):
    haps, reads, genome = fragment
    rows = reads.collect()
    assert len(rows) == 36 and all(len(r["seq"]) == len(r["origins"]) == 40 for r in rows)
    for r in rows:
        assert all(genome[0][1][o["pos"]] == b for o, b in zip(r["origins"], r["seq"]) if o is not None)
    assert simulate.coverage_by_base(reads, haps).count() == 120


def test_draft_finds_the_genome(spark, fragment):
    haps, reads, genome = fragment
    inner = reads.agg(F.min("origins"), F.max("origins"))
    g = D.draft(reads, 12, 0.0, 120, 1, min_count=1, min_dead_end=0)
    assert g.is_copy_nums_valid() and inner is not None
    assert any(s in genome[0][1] and len(s) > 80 for _, s, _ in g.styled_seqs())


def test_files_there_and_back(spark, fragment, tmp_path):
    haps, reads, _ = fragment
    fasta.write_genome(haps, str(tmp_path / "g.fa"))
    assert fasta.read_genome(spark, str(tmp_path / "g.fa")).collect() == haps.collect()
    fasta.write_reads(reads, str(tmp_path / "r.fa.gz"))
    assert [r["seq"] for r in fasta.read_reads(spark, str(tmp_path / "r.fa.gz")).orderBy("read_id").collect()] == [r["seq"] for r in reads.orderBy("read_id").collect()]
    fasta.write_dataset(haps, reads, {"p": 0.1}, str(tmp_path / "d.json"))
    h, r, p = fasta.read_dataset(spark, str(tmp_path / "d.json"))
    assert h.collect() == haps.collect() and r.orderBy("read_id").select("seq", "origins").collect() == reads.orderBy("read_id").select("seq", "origins").collect() and p == {"p": 0.1}
    g = Assembly.from_kmers(K.from_styled(spark.createDataFrame([(0, "L", "TCCCAGCAGCAGCAGGAA")], "hap_id long, style string, seq string"), 4), 4)
    lines = formats.dbg_lines(g)
    back = formats.read_dbg(fasta.lines_of(spark, fasta.text_of(lines, formats.ORDER)))
    assert back.k == 4 and back.get_copy_nums() == g.get_copy_nums() and back.table().exceptAll(g.table()).isEmpty()
    assert fasta.text_of(formats.dbg_lines(back), formats.ORDER) == fasta.text_of(lines, formats.ORDER)
    paths = g.paths_of(spark.createDataFrame([(0, "L", "TCCCAGCAGCAGCAGGAA")], "hap_id long, style string, seq string"))
    text = fasta.text_of(formats.paths_lines(paths), formats.ORDER)
    assert formats.read_paths(fasta.lines_of(spark, text)).orderBy("i").select("edge_id").collect() == paths.orderBy("i").select("edge_id").collect()
    gfa = fasta.text_of(formats.gfa_lines(g), formats.ORDER).splitlines()
    assert {x[0] for x in gfa} == {"S", "L"}
    assert formats.dot_text(g).startswith("digraph")


def test_posterior_is_highest_at_the_truth(spark):
    seq = "TCCCAGCAGCAGCAGGAA"
    haps = spark.createDataFrame([(0, "L", seq)], "hap_id long, style string, seq string")
    g = Assembly.from_kmers(K.from_styled(haps, 4), 4)
    true = g.get_copy_nums()
    wrong = next(c for c in (Q.kernels.apply_cycle(true, list(u.cycle)) for u in Q.moves(g, "S")) if min(c.values()) >= 0)
    reads = spark.createDataFrame([(i, seq) for i in range(4)], "read_id long, seq string")
    h, post = Q.sample_posterior(g.set_copy_nums(wrong), Q.Problem(reads, hmm.Params.uniform(0.001), 18, 1), max_iter=5)
    assert Q.is_highest_at(post, true) and h.get_copy_nums() == true
    assert Q.true_edges_missed(g, post, true) == []
    d = post.edge_distribution(next(iter(true)))
    assert sum(d.values()) == pytest.approx(1)
    m = {(r["edge"], r["x"]): math.exp(r["x_lp"]) for r in Q.marginals(post.frame(spark)).collect()}
    assert all(m[e, x] == pytest.approx(post.p_edge(e, x)) for e, x in m)
    ids = [e for e, _, _ in g.local()]
    assert formats.read_post(formats.post_text(post), ids).p() == pytest.approx(post.p())
    assert formats.read_inspect(formats.inspect_text(g, post, true), 4, ids).max_copy_nums() == true
    assert not formats.gfa_posterior_lines(g, post, true).isEmpty()


def test_search_of_each_text(spark, tmp_path):
    texts = ["TCCCAGCAGCAGCAGGAA", "acgtnacgxgtt", "CCATTTTCAGTTGCATTGCA", "AC", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in queries.posterior_search(spark, str(tmp_path)).collect():
        got.setdefault(r["read_id"], {}).setdefault((r["edge"], r["seq"]), {})[r["x"]] = r["p"]
    assert sorted(got) == [0, 1, 2, 3]
    for i, edges in got.items():
        seq = "".join(c for c in texts[i].upper() if c in "ACGT")
        g = Q.TextGraph.of(seq, 4)
        assert sorted(edges) == sorted(g.facts("seqs").items())
        assert all(sum(d.values()) == pytest.approx(1, abs=1e-4) for d in edges.values())
        assert {e: max(d, key=d.get) for (e, _), d in edges.items()} == g.facts("copies")
    # the graph and its score are those of the assembly of the same text
    seq = texts[0]
    a, b = Assembly.from_kmers(K.from_styled(spark.createDataFrame([(0, "L", seq)], "hap_id long, style string, seq string"), 4), 4), Q.TextGraph.of(seq, 4)
    assert sorted((a.facts("seqs")[e], c) for e, c in a.facts("copies").items()) == sorted((b.facts("seqs")[e], c) for e, c in b.facts("copies").items())
    reads = spark.createDataFrame([(i, seq) for i in range(4)], "read_id long, seq string")
    x, y = Q.Problem(reads, hmm.Params.uniform(0.001), 18, 1).scores(a, [a.facts("copies")])[0], Q.TextProblem([(seq, 4)], hmm.Params.uniform(0.001), 18, 1).scores(b, [b.facts("copies")])[0]
    assert x.p == pytest.approx(y.p) and x.genome_size == y.genome_size == 18


def test_infer_scores_on_mappings(spark):
    """The outer loop from k = 4 to 5 gives the sequence again, and its searches score reads on their mappings."""
    from helixframe.operators import kmers as K
    from helixframe.operators.assembly import Assembly

    seq, seen = "ACTTGCCATAGGATCA", []
    haps = spark.createDataFrame([(0, "L", seq)], "hap_id long, style string, seq string")
    reads = spark.createDataFrame([(i, seq) for i in range(4)], "read_id long, seq string")
    g = Assembly.from_kmers(K.from_styled(haps, 4), 4)
    params = hmm.Params.uniform(0.01)
    out, post = Q.infer(g, reads, 5, params, params, len(seq), 2, 4.0, n_haplotypes=1, max_iter=2, on_k=lambda g, p, m: seen.append((g.k, m.count())))
    assert out.k == 5 and [k for k, _ in seen] == [4, 5] and all(n > 0 for _, n in seen)
    assert [(style, x) for style, x, _ in out.set_copy_nums(post.max_copy_nums()).styled_seqs()] == [("L", seq)]
    g = out.set_copy_nums(post.max_copy_nums())
    here = [g.facts("copies")]
    mapped = Q.likelihoods(g, reads, Q.map_reads(g, reads, params), params, here)[0]
    dense, sparse = Q.likelihoods(g, reads, None, params, here)[0], Q.likelihoods(g, reads, None, params, here, sparse=True)[0]
    assert mapped <= dense + 1e-9 and abs(mapped - dense) < 0.1 and abs(sparse - dense) < 0.1


def test_infos_text():
    u = [Q.Update("X", ((5, 1), (6, 1), (1, -1))), Q.Update("R", ((10, 1), (1, 1)), (0, 50, 111, "5.001", "Z")), Q.Update("S", ((5, -1),))]
    assert Q.infos_text(u) == "[X(e5+e6+e1-),R(e10+e1+|0|50|111|5.001|Z),S(e5-)]"
    assert Q.infos_text(Q.parse_infos(Q.infos_text(u))) == Q.infos_text(u)


def test_mappings(spark):
    h = hmm.linear_model("ATTCGATCGT", hmm.Params.high_error())
    reads = spark.createDataFrame([(0, "CGATC"), (1, "TTC")], "read_id long, seq string")
    m = hmm.generate_mappings(reads, h)
    assert [r["node"] for r in hmm.mapping_top(m, 1).where("read_id = 0").orderBy("pos").collect()] == [3, 4, 5, 6, 7]
    assert hmm.mapping_freqs(m).agg(F.sum("freq")).first()[0] == pytest.approx(8, abs=1)
    text = fasta.text_of(formats.map_lines(m, reads), ["i"])
    assert formats.read_map(fasta.lines_of(spark, text)).count() == m.count()
    assert hmm.score_reads(reads, h, m).where("read_id = 0").first()["lp"] == pytest.approx(-15.2126, abs=0.05)
    assert hmm.total_score(hmm.score_reads(reads, h)) < -15


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Tables of texts below and above the length of the models, with other letters, empty and null."""
    path = tmp_path_factory.mktemp("long")
    texts = ["ACGTTGCA" * 20, "ACGT" * 40 + "xyz" + "TTGCA" * 13, "acgt", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path), ["".join(c for c in (t or "").upper() if c in "ACGT") for t in texts]


def test_mapping_of_whole_reads(spark, long_texts):
    path, seqs = long_texts
    h, want = hmm.linear_model("ACGTTGCA" * 6, hmm.Params.mid_error()), {}
    for x in filter(None, seqs):
        for nodes, lps in hmm.map_read(h, x):
            for v, lp in zip(nodes, lps, strict=True):
                want[int(v)] = want.get(int(v), 0.0) + math.exp(lp)
    got = {r["node"]: r["freq"] for r in queries.hmm_mapping(spark, path).collect()}
    assert got == pytest.approx(want, abs=1e-5) and sum(got.values()) > 0.9 * sum(map(len, seqs))


def test_forward_score_of_whole_reads(spark, long_texts):
    path, seqs = long_texts
    h = hmm.linear_model("ACGT" * 16, hmm.Params.mid_error())
    got = {r["read_id"]: r["lp"] for r in queries.hmm_forward_score(spark, path).collect()}
    assert got == pytest.approx({i: hmm.full_prob(hmm.forward(h, x)) for i, x in enumerate(seqs) if x}, abs=1e-5)


def test_comparison(spark):
    sam = spark.createDataFrame([("q", 0, "t", 10, "2S5M2D3M", "NNACGTACGT")], "name string, flag int, target string, pos long, cigar string, seq string")
    assert compare.lift(sam, "t", 12).first()["q_pos"] == 4
    assert compare.lift(sam, "t", 16).first()["q_pos"] is None
    assert compare.trim_to_region(sam, "t", 12, 18).first()["seq"] == "GTACG"[0:4]
    paf = spark.createDataFrame([("q", "t", 0, 3, ":4*ac+gg-t:2")], "query string, target string, q_start long, t_start long, cs string")
    got = [(r["kind"], r["q"], r["t"], r["n"]) for r in compare.aligned_pairs(paf).orderBy("q", "t").collect()]
    assert got == [(":", 0, 3, 4), ("*", 4, 7, 1), ("+", 5, 8, 2), ("-", 7, 8, 1), (":", 7, 9, 2)]
    spans = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12)], "k string, s long, e long")
    assert compare.covered(spans, "k", "s", "e").first()["bases"] == 10
    assert spark.range(1).select(S.jaccard(F.array(*map(F.lit, (42, 3, 1))), F.array(*map(F.lit, (42, 3, 0))))).first()[0] == 0.5
    assert np.isclose(spark.range(1).select(F.lit(1.0)).first()[0], 1)
