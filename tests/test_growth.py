"""What must not grow faster than the input: tables computed once, nothing of the rounds through the driver, files by ranges."""

import random

import pytest
from pyspark.sql import functions as F

import helixframe.queries  # noqa: F401  (the queries import each other from here)
from helixframe import format_queries
from helixframe.operators import compare, euler
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly, MissingKmers

SF = "/root/testdata/sf0.001"


def test_graph_computes_its_table_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for t in batches:
            made.add(len(t))
            yield t

    rng = random.Random(2)
    haps = spark.createDataFrame([(i, "L", "".join(rng.choice("ACGT") for _ in range(30))) for i in range(3)], "hap_id long, style string, seq string")
    table = K.from_styled(haps, 5)
    n = table.count()
    g = Assembly.from_kmers(table.mapInPandas(seen, "kmer string, n long"), 5)
    assert made.value == n
    paths = g.paths_of(haps)
    assert "SortMergeJoin" not in paths._jdf.queryExecution().executedPlan().toString()
    assert paths.count() == 3 * 34 and g.broken_paths(paths).count() == 0
    got = {r["edge_id"]: r["copy_num"] for r in g.copy_nums_of_paths(paths).collect()}
    assert got == g.get_copy_nums()
    with pytest.raises(MissingKmers):
        g.paths_of(haps.withColumn("seq", F.lit("ACGTN")))


def test_circuits_broadcast_nothing(spark):
    e = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 0, 2), (2, 1, 1, 1)], "edge_id long, source long, target long, copy_num long")
    c = euler.circuits(e)
    assert "Broadcast" not in c._jdf.queryExecution().executedPlan().toString()
    assert c.count() == 5 and euler.broken(c).count() == 0


@pytest.mark.parametrize("name", ["map_file", "paths_file", "paths_file_read"])
def test_files_are_written_by_ranges(spark, monkeypatch, name):
    asked = []
    whole = format_queries.fasta.write_lines
    monkeypatch.setattr(format_queries.fasta, "write_lines", lambda *a, one=True, **k: asked.append(one) or whole(*a, one=one, **k))
    assert getattr(format_queries, name)(spark, SF).count() > 0
    assert asked == [False]


def test_differences_of_short_alignments_are_not_sorted(spark, monkeypatch):
    rows = [("r", "g", 10, 20, ":4*ag+tt:3-c*ct"), ("r", "h", 0, 5, None), ("s", "g", 1, 2, "+a:2-gg:1")]
    paf = spark.createDataFrame(rows, "query string, target string, q_start long, t_start long, cs string")
    want = [("r", "g", "*", 14, 24, 1), ("r", "g", "*", 20, 29, 1), ("r", "g", "+", 15, 25, 2), ("r", "g", "-", 20, 28, 1), ("s", "g", "+", 1, 2, 1), ("s", "g", "-", 4, 4, 2)]
    for most in (compare.SHORT, 3):
        monkeypatch.setattr(compare, "SHORT", most)
        got = compare.aligned_pairs(paf, ignore_match=True)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert compare.aligned_pairs(paf).count() == 10
