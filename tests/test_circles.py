"""Circles of inner nodes alone: they end the doubling of paths early, and are no simple paths of dbg_unitigs."""

import duckdb

from helixframe.operators import graph as G
from helixframe.queries import REGISTRY, SQL


def test_circles_end_the_doubling(spark, monkeypatch):
    """Short paths and a circle of three: rounds follow the lengths of both, not the number of edges."""
    pairs = [(10 * i + j, 10 * i + j + 1) for i in range(500) for j in range(2)] + [(9001, 9002), (9002, 9003), (9003, 9001)]
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, source long, target long")
    count, plain = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: count.append(1) or plain(df))
    places = {r["e"]: (r["head"], r["d"]) for r in G.simple_paths(e, G._inner(e)).collect()}
    assert places == {i: (i - i % 2, i % 2) for i in range(1000)} | {1000 + i: (1000, i) for i in range(3)}
    assert len(count) <= 12


def test_unitigs_with_a_circle_equal_sql(spark, tmp_path):
    """A text that turns in a circle of 12, often, and a line; both above the threshold of five."""
    rows = [(0, "ACGTTGCAACTG" * 8)] + [(i, "GGATTTACCCAGATTCGTAA") for i in range(1, 7)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(SQL["dbg_unitigs"]).fetchall())
    assert sorted(tuple(r) for r in REGISTRY["dbg_unitigs"](spark, str(tmp_path)).collect()) == want and len(want) == 1
