"""Known values of the column functions, k-mer tables and graph operators."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import probability as P
from helixframe.functions import sequence as S
from helixframe.operators import graph as G
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly, MissingKmers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("how", "seq", "want"),
    [
        (K.linear_kmers, "ATCATCG", "nnnA nnAT nATC ATCA TCAT CATC ATCG TCGn CGnn Gnnn"),
        (K.circular_kmers, "ATCATCG", "ATCA TCAT CATC ATCG TCGA CGAT GATC"),
        (K.fragment_kmers, "ATCATCG", "ATCA TCAT CATC ATCG"),
        (K.linear_kmers, "ATC", "nnnA nnAT nATC ATCn TCnn Cnnn"),
        (K.circular_kmers, "ATC", "ATCA TCAT CATC"),
        (K.fragment_kmers, "ATC", ""),
        (K.linear_kmers, "", ""),
    ],
)
def test_kmers_of_sequences(spark, how, seq, want):
    assert one(spark, how("s", 4), s=seq) == want.split()


def test_profile_and_neighbours(spark):
    t = K.from_linear(spark.createDataFrame([("ATCGATTCGAT",), ("AT",)], ["seq"]), 4)
    got = {r["kmer"]: r["n"] for r in t.collect()}
    assert len(got) == 12 and K.nodes(t).count() == 11
    assert got["CGAT"] == got["TCGA"] == 2 and sum(got.values()) == 14
    assert {r["child"] for r in K.successors(t).where("kmer = 'CGAT'").collect()} == {"GATT", "GATn"}
    assert {r["sibling"] for r in K.sibling_pairs(t).where("kmer = 'ATCG'").collect()} == {"ATCG", "TTCG"}
    assert K.is_consistent(t)


def test_sequence_functions(spark):
    assert one(spark, S.revcomp("s"), s="ATCGGCCC") == "GGGCCGAT"
    assert one(spark, S.starting_kmers("s"), s="ATCG") == ["nATC", "nnAT", "nnnA"]
    assert one(spark, S.ending_kmers("s"), s="ATCG") == ["TCGn", "CGnn", "Gnnn"]
    assert one(spark, S.join("a", "b"), a="TCGA", b="ATCG") == "ATCGA"
    assert one(spark, S.concat_overlapping(F.array(F.lit("ATC"), F.lit("TCG"), F.lit("CGA")))) == "ATCGA"
    assert one(spark, S.quad_get(S.quad_set(F.lit(0).cast("long"), 31, 3), 31)) == 3
    with pytest.raises(Exception, match="not a base"):
        one(spark, S.sanitize("s"), s="ACNT")


@pytest.mark.parametrize(("origins", "want"), [([0, 1, 3, 4, 5, 8, None, 9], "2M1D3M2D1M1I1M"), ([None, None, None, 10, None, 15, 17, None, 18], "3I1M1I4D1M1D1M1I1M")])
def test_cigar(spark, origins, want):
    df = spark.createDataFrame([([None if o is None else (0, o) for o in origins],)], "o array<struct<node:long,pos:long>>")
    assert df.select(S.cigar("o")).first()[0] == want


def test_starts_and_ends(spark):
    haps = spark.createDataFrame([(0, "L", "GGGCAATAGC"), (1, "L", "GGGCTTCTGC"), (2, "L", "ATCGAAGCTG"), (3, "C", "ATCG")], "hap_id long, style string, seq string")
    got = {(r["which"], r["kmer"]): r["n"] for r in K.starts_and_ends(haps, 4).collect()}
    assert got == {("start", "GGGC"): 2, ("start", "ATCG"): 1, ("end", "TAGC"): 1, ("end", "CTGC"): 1, ("end", "GCTG"): 1}


def test_distribution(spark):
    import math

    df = spark.createDataFrame([("g", 0, math.log(0.5)), ("g", 0, math.log(0.2)), ("g", 1, math.log(0.2)), ("g", 0, math.log(0.1))], "g string, x long, lp double")
    d = P.distribution(df, ["g"], "x", "lp")
    assert {r["x"]: round(math.exp(r["x_lp"]), 9) for r in d.collect()} == {0: 0.8, 1: 0.2}
    assert P.distribution_mean(d, ["g"], "x").first()["mean"] == pytest.approx(0.2)
    assert P.distribution_text(d, ["g"], "x").first()["dist"] == "p(0)=0.800,p(1)=0.200"
    s = spark.createDataFrame([(0.0,), (10.0,)], ["v"]).agg(*P.stat("v")).first()
    assert tuple(s) == (5, 5, 0, 10)
    assert one(spark, F.exp(P.normal(F.lit(0.0), 0.0, 1.0))) == pytest.approx(0.3989, abs=1e-4)
    for x in (-4.0, -1.0, 0.0, 0.5, 2.9, 3.1, 6.0):
        assert one(spark, P.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1e-12)
    assert one(spark, P.p(F.lit(0.0))) == -math.inf
    assert one(spark, P.add(F.lit(-math.inf), F.lit(-1.0))) == -1.0


def test_compaction_and_components(spark):
    e = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0), (4, 2, 4), (5, 4, 3), (6, 7, 8), (7, 8, 9), (8, 9, 7)], "edge_id long, source long, target long")
    got = sorted((r["source"], r["target"], tuple(r["edges_in_full"])) for r in G.compact(e).collect())
    assert got == [(2, 3, (2,)), (2, 3, (4, 5)), (3, 2, (3, 0, 1)), (7, 7, (6, 7, 8))]
    sizes = sorted((r["nodes"], r["edges"]) for r in G.component_sizes(G.strong_components(e), e).collect())
    assert sizes == [(3, 3), (5, 6)]
    more = e.unionByName(spark.createDataFrame([(9, 0, 7)], e.schema))
    assert [r["edge_id"] for r in G.bridges(more).collect()] == [9]


def test_dead_ends(spark):
    t = K.from_pairs(spark, [("ATC", 5), ("TCA", 5), ("CAT", 5), ("TCG", 1), ("CGG", 9)])
    left, n = K.remove_dead_ends(t, 2)
    assert {r["kmer"] for r in left.collect()} == {"ATC", "TCA", "CAT", "TCG", "CGG"} and n == 0
    left, n = K.remove_dead_ends(t, 10)
    assert {r["kmer"] for r in left.collect()} == {"ATC", "TCA", "CAT"} and n == 2


def toy(spark, seq, k, style="L"):
    haps = spark.createDataFrame([(0, style, seq)], "hap_id long, style string, seq string")
    return Assembly.from_kmers(K.from_styled(haps, k), k), haps


@pytest.mark.parametrize(("seq", "style", "nodes", "edges"), [("ATCG", "C", 4, 4), ("TAGGC", "L", 8, 8), ("CTAAAAAAGC", "L", 10, 11), ("TCCCAGCAGCAGCAGGAA", "L", 14, 15)])
def test_toy_graphs(spark, seq, style, nodes, edges):
    g, haps = toy(spark, seq, 4, style)
    assert (g.nodes.count(), g.edges.count()) == (nodes, edges)
    assert g.genome_size() == len(seq) and g.is_copy_nums_valid()
    paths = g.paths_of(haps)
    assert g.broken_paths(paths).isEmpty()
    assert {r["edge_id"]: r["copy_num"] for r in g.copy_nums_of_paths(paths).collect()} == g.get_copy_nums()
    assert {s for _, s, _ in g.styled_seqs()} == {seq} or style == "C"


def test_extension_keeps_the_genome(spark):
    g, haps = toy(spark, "TCCCAGCAGCAGCAGGAA", 4)
    h = g.to_kp1()
    assert h.k == 5 and (h.nodes.count(), h.edges.count()) == (16, 18)
    assert h.genome_size() == 18 and h.is_copy_nums_valid()
    h.paths_of(haps)
    with pytest.raises(MissingKmers):
        h.paths_of(spark.createDataFrame([(0, "L", "ACGTTT")], "hap_id long, style string, seq string"))
    zero = [e for e, c in h.get_copy_nums().items() if c == 0]
    assert len(zero) == 1
    p, paths, _ = h.purge_and_extend(zero, 5, True, haps)
    assert paths is not None and p.genome_size() == 18
