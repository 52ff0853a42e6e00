"""Frames of the hidden Markov model: scores, uses, states, texts; and the SQL of a chain against the kernels."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.model_sql import Chain
from helixframe.operators import hmm

READS = [(1, "ACGTACG"), (2, "TTGCA"), (3, ""), (4, "ACGTACG")]


@pytest.fixture(scope="module")
def model():
    return hmm.linear_model("ACGTTGCAAC", hmm.Params.mid_error())


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(READS, "read_id long, seq string")


def test_backward_scores(reads, model):
    """The forward pass starts with no deletion, the backward pass may end in one: their scores are near, not equal."""
    back = {r["read_id"]: r["lp"] for r in hmm.backward_scores(reads, model).collect()}
    ahead = {r["read_id"]: r["lp"] for r in hmm.score_reads(reads, model, how="dense").collect()}
    assert back == pytest.approx({i: hmm.full_prob_backward(hmm.backward(model, x)) for i, x in READS if x}, abs=1e-9)
    assert ahead.pop(3) == -math.inf and back == pytest.approx(ahead, abs=0.1) and back[1] == back[4]
    sparse = {r["read_id"]: r["lp"] for r in hmm.backward_scores(reads, model, sparse=True).collect()}
    assert sparse == pytest.approx(back, abs=1e-6)


def test_uses_and_states_against_the_kernels(reads, model):
    for i, x in READS:
        if x:
            f, b = hmm.run(model, x, "dense")
            freq = hmm.node_freqs(f, b, model.n)
            got = {r["node"]: r["freq"] for r in hmm.node_usage(reads.where(F.col("read_id") == i), model, "dense").collect()}
            assert got == pytest.approx(dict(enumerate(freq)), abs=1e-9)
            edge, init = hmm.edge_and_init_freqs(model, x, f, b)
            rows = hmm.edge_usage(reads.where(F.col("read_id") == i), model).collect()
            assert {(r["source"], r["target"]): r["freq"] for r in rows} == pytest.approx({**{(k, k + 1): v for k, v in enumerate(edge)}, **{(None, k): v for k, v in enumerate(init)}}, abs=1e-9)
    states = hmm.state_rows(reads, model, "dense")
    sums = {(r["read_id"], r["node"]): r["x"] for r in hmm.sum_states(states, "read_id").where("node is not null").groupBy("read_id", "node").agg(F.sum(F.exp("lp")).alias("x")).collect()}
    uses = {(r["read_id"], r["node"]): r["freq"] for r in hmm.node_usage(reads, model, "dense").collect()}
    assert sums == pytest.approx(uses, abs=1e-9)


def test_tables_add_multiply_divide(spark):
    a = spark.createDataFrame([("M", 0, -1.0), ("M", 1, -800.0), ("IB", None, -2.0)], "state string, node long, lp double")
    b = spark.createDataFrame([("M", 0, -3.0), ("M", 1, -801.5), ("D", 2, -0.5), ("IB", None, -2.0)], "state string, node long, lp double")
    got = {(r["state"], r["node"]): r["lp"] for r in hmm.sum_states(a.unionByName(b)).collect()}
    assert got == pytest.approx({("M", 0): np.logaddexp(-1, -3), ("M", 1): np.logaddexp(-800, -801.5), ("D", 2): -0.5, ("IB", None): -2 + math.log(2)})
    got = {(r["state"], r["node"]): r["lp"] for r in hmm.divide_states(hmm.multiply_states(a, b), -1.5).collect()}
    assert got == {("M", 0): -2.5, ("M", 1): -1600.0, ("IB", None): -2.5}


def test_texts(spark):
    rows = spark.createDataFrame([(1, "M", 3, -0.25), (1, "IB", None, -0.5), (1, "D", 2, -9.0), (2, "I", 0, -1.0)], "pos int, state string, node long, lp double")
    assert {r["pos"]: r["text"] for r in hmm.summary(rows, 2, "pos").collect()} == {1: "3:M(n3)-0.25000,IB-0.50000", 2: "0:I(n0)-1.00000"}
    maps = spark.createDataFrame([(1, 0, 4, math.log(0.75)), (1, 0, 2, math.log(0.25))], hmm.MAPPING)
    assert hmm.mapping_texts(maps).collect()[0]["text"] == "4:75.0,2:25.0"


def test_sql_of_a_chain(model):
    c = duckdb.connect()
    c.execute("CREATE TABLE r AS SELECT * FROM (VALUES (1, 'ACGTACG'), (2, 'TTGCA')) v(read_id, seq)")
    chain = Chain("ACGTTGCAAC", 0.05)
    got = dict(c.execute(f"WITH RECURSIVE {chain.forward('r', last=True)} SELECT read_id, {chain.end()} FROM f").fetchall())
    back = dict(c.execute(f"WITH RECURSIVE {chain.backward('r', last=True)} SELECT read_id, ln(mb) + scale FROM b").fetchall())
    assert got == pytest.approx({i: hmm.full_prob(hmm.forward(model, x)) for i, x in READS[:2]}, abs=1e-9)
    assert back == pytest.approx({i: hmm.full_prob_backward(hmm.backward(model, x)) for i, x in READS[:2]}, abs=1e-9)
