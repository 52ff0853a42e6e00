"""Order of text files, odd lines of graph files."""

import pytest

from helixframe.sources import fasta, formats


@pytest.mark.parametrize("one", [True, False])
def test_lines_keep_their_order(spark, tmp_path, one):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id AS i", "concat('line ', id, repeat('x', CAST(4999 - id AS INT) % 50)) AS line").repartition(5)
    fasta.write_lines(rows, str(tmp_path / "t"), ["i"], one=one)
    got = fasta.read_lines(spark, str(tmp_path / "t")).collect()
    assert sorted((r["i"], r["line"].split("x")[0]) for r in got) == [(i, f"line {i}") for i in range(5000)]


def test_records_of_many_files_keep_their_order(spark, tmp_path):
    reads = spark.createDataFrame([(i, "ACGT"[i % 4] * (1 + i % 9)) for i in range(500)], "read_id long, seq string").repartition(6)
    fasta.write_reads(reads, str(tmp_path / "r.fa"), one=False)
    got = fasta.scan(spark, str(tmp_path / "r.fa")).collect()
    assert sorted((r["record_id"], r["name"], r["seq"]) for r in got) == [(i, f"r{i}", "ACGT"[i % 4] * (1 + i % 9)) for i in range(500)]
    assert fasta.read_reads(spark, str(tmp_path / "r.fa")).count() == 500


def test_segments_without_depth_stay(spark):
    lines = fasta.lines_of(spark, "S\t1\tACn\nS\t2\tGG\tDP:f:0\nS\t3\tnn\tDP:f:2\nS\t4\tT\tDP:f:1.5\nL\t1\t+\t4\t-\t0M")
    seg, link = formats.read_gfa(lines)
    assert sorted((r["name"], r["strand"], r["seq"], r["depth"]) for r in seg.collect() if r["depth"]) == [("4", "+", "T", 1.5), ("4", "-", "A", 1.5)]
    assert sorted((r["strand"], r["seq"]) for r in seg.where("name = '1'").collect()) == [("+", "AC"), ("-", "GT")]
    assert sorted(tuple(r) for r in link.collect()) == [("1", "+", "4", "-"), ("4", "+", "1", "-")]
