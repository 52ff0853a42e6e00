"""Queries of the hidden Markov model over the benchmark's reads, and of mappings, and the same in SQL."""

from pyspark.sql import functions as F

from helixframe.operators import hmm
from helixframe.queries import BENCH, EIGHT, query, reads, table

WITH = "WITH RECURSIVE " + BENCH


def model() -> hmm.Model:
    return hmm.linear_model(EIGHT.bases, hmm.Params.mid_error())


def bench(spark, sf):
    return reads(spark, sf, "benchmark", "item_id").where("seq <> ''")


@query(f"{WITH}, {EIGHT.backward('r', last=True)} SELECT read_id, round(ln(mb) + scale, 6) AS lp FROM b")
def hmm_backward_score(spark, sf):
    return hmm.backward_scores(bench(spark, sf), model()).select("read_id", F.round("lp", 6).alias("lp"))


@query(f"{WITH}, {EIGHT.both('r')} SELECT read_id, CAST(node AS BIGINT) AS node, round(sum(m + i + d), 6) AS freq FROM st GROUP BY read_id, node")
def hmm_node_usage(spark, sf):
    return hmm.node_usage(bench(spark, sf), model(), "dense").select("read_id", "node", F.round("freq", 6).alias("freq"))


@query(f"{WITH}, {EIGHT.both('r')} SELECT CAST(node AS BIGINT) AS node, round(sum(m + i + d), 5) AS freq FROM st GROUP BY node")
def hmm_mapping_dense(spark, sf):
    """Uses of each node by the mapped reads. SQL takes all nodes; those that a mapping leaves out have less than e^-30 of
    the best one."""
    return hmm.mapping_freqs(hmm.generate_mappings(bench(spark, sf), model(), how="dense")).select("node", F.round("freq", 5).alias("freq"))


@query(f"{WITH}, {EIGHT.uses('r')} SELECT read_id, CAST(CASE WHEN way = 'edge' THEN node END AS BIGINT) AS source, CAST(CASE WHEN way = 'edge' THEN node + 1 ELSE node END AS BIGINT) AS target, round(sum(x), 6) AS freq FROM eu GROUP BY ALL")
def hmm_edge_usage(spark, sf):
    return hmm.edge_usage(bench(spark, sf), model()).select("read_id", "source", "target", F.round("freq", 6).alias("freq"))


@query(f"{WITH}, {EIGHT.uses('r')} SELECT read_id, round(sum(x) FILTER (way = 'start') * ln(1e0 / {EIGHT.n}), 6) AS q_start, 0e0 AS q_edge FROM eu GROUP BY read_id")
def hmm_q_scores(spark, sf):
    """Every edge of a chain is sure, so its part is 0."""
    return hmm.q_scores(bench(spark, sf), model()).select("read_id", F.round("q_start", 6).alias("q_start"), F.round("q_edge", 6).alias("q_edge"))


STATES = f"{WITH}, {EIGHT.both('r')}, sr AS (SELECT read_id, CAST(pos AS INT) AS pos, 'M' AS state, CAST(node AS BIGINT) AS node, ln(m) AS lp FROM st WHERE m > 0 UNION ALL SELECT read_id, CAST(pos AS INT), 'I', node, ln(i) FROM st WHERE i > 0 UNION ALL SELECT read_id, CAST(pos AS INT), 'D', node, ln(d) FROM st WHERE d > 0 UNION ALL SELECT DISTINCT read_id, CAST(pos AS INT), 'IB', CAST(NULL AS BIGINT), ln(ib) FROM st WHERE ib > 0)"


def state_rows(spark, sf):
    return hmm.state_rows(bench(spark, sf), model(), "dense")


@query(f"{STATES} SELECT read_id, pos, state, node, round(exp(lp), 6) AS p FROM sr")
def hmm_states(spark, sf):
    return state_rows(spark, sf).select("read_id", "pos", "state", "node", F.round(F.exp("lp"), 6).alias("p"))


@query(f"{STATES} SELECT read_id, state, node, round(sum(exp(lp)), 6) AS p FROM sr GROUP BY ALL")
def hmm_state_sums(spark, sf):
    return hmm.sum_states(state_rows(spark, sf), "read_id").select("read_id", "state", "node", F.round(F.exp("lp"), 6).alias("p"))


@query(f"{STATES} SELECT read_id, pos, state, node, round(exp(2 * lp) / 0.5e0, 6) AS p FROM sr")
def hmm_state_products(spark, sf):
    """Each table times itself, over a half."""
    t = state_rows(spark, sf)
    keys = ("read_id", "pos")
    got = hmm.divide_states(hmm.multiply_states(t, t.select("*"), *keys), -0.6931471805599453)
    return got.select(*keys, "state", "node", F.round(F.exp("lp"), 6).alias("p"))


MAPPED = "mapped AS (SELECT l_orderkey AS read_id, l_linenumber AS pos, CAST(l_suppkey % 7 AS BIGINT) AS node, max(l_quantity) / -10e0 AS lp FROM lineitem GROUP BY ALL)"


def mapped(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 7).cast("long").alias("node"))
    return rows.agg((F.max(F.col("l_quantity").cast("double")) / -10).alias("lp"))


@query(f"WITH {MAPPED}, t AS (SELECT read_id, CAST(0 AS INT) AS pos, node, CAST(max(lp) AS DOUBLE) AS lp FROM mapped GROUP BY read_id, node) SELECT read_id, pos, node, lp FROM t QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY lp DESC, node) <= 2")
def hmm_mapping_top(spark, sf):
    """The two best nodes of each order."""
    return hmm.mapping_top(_orders(spark, sf), 2)


def _orders(spark, sf):
    return mapped(spark, sf).groupBy("read_id", "node").agg(F.max("lp").alias("lp")).select("read_id", F.lit(0).alias("pos"), "node", "lp")


@query(f"WITH {MAPPED}, t AS (SELECT read_id, CAST(0 AS INT) AS pos, node, CAST(max(lp) AS DOUBLE) AS lp FROM mapped GROUP BY read_id, node) SELECT read_id, pos, node, lp FROM t QUALIFY max(lp) OVER (PARTITION BY read_id) - lp < 1.05e0")
def hmm_mapping_by_ratio(spark, sf):
    return hmm.mapping_by_ratio(_orders(spark, sf), 1.05)


@query(f"WITH {MAPPED}, t AS (SELECT read_id, node, CAST(max(lp) AS DOUBLE) AS lp FROM mapped GROUP BY read_id, node), nm AS (SELECT * FROM (VALUES (0, 10), (0, 11), (1, 10), (2, 12), (3, 12), (3, 13), (3, 14), (5, 10), (6, 14)) v(node, new_node)), k AS (SELECT node, count(*) AS k FROM nm GROUP BY node) SELECT read_id, CAST(0 AS INT) AS pos, CAST(new_node AS BIGINT) AS node, round(ln(sum(exp(lp) / k)), 6) AS lp FROM t JOIN nm USING (node) JOIN k USING (node) GROUP BY read_id, new_node")
def hmm_map_nodes(spark, sf):
    """Nodes 0..6 moved to 10..14: some split, some joined, node 4 gone."""
    node_map = spark.createDataFrame([(0, 10), (0, 11), (1, 10), (2, 12), (3, 12), (3, 13), (3, 14), (5, 10), (6, 14)], "node long, new_node long")
    return hmm.map_nodes(_orders(spark, sf), node_map).select("read_id", "pos", "node", F.round("lp", 6).alias("lp"))


@query(f"WITH {MAPPED}, t AS (SELECT read_id, node, CAST(max(lp) AS DOUBLE) AS lp FROM mapped GROUP BY read_id, node) SELECT read_id, CAST(0 AS INT) AS pos, string_agg(node || ':' || printf('%.1f', 100 * exp(lp)), ',' ORDER BY lp DESC, node) AS text FROM t GROUP BY read_id")
def hmm_mapping_texts(spark, sf):
    return hmm.mapping_texts(_orders(spark, sf))


@query(f"WITH {MAPPED}, t AS (SELECT read_id, node, CAST(max(lp) AS DOUBLE) AS lp FROM mapped GROUP BY read_id, node), n AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY lp DESC, node) AS r FROM t) SELECT read_id, string_agg(node || ':M(n' || node || ')' || printf('%.5f', lp), ',' ORDER BY r) AS text FROM n WHERE r <= 3 GROUP BY read_id")
def hmm_state_texts(spark, sf):
    return hmm.summary(_orders(spark, sf).withColumn("state", F.lit("M")), 3, "read_id")


PRESETS = {"uniform": 0.07, "default": 0.01, "mid_error_2": 0.02, "mid_error": 0.05, "high_error": 0.1, "zero_error": 0.0}


@query("SELECT name, p, 1 - p AS p_match, round(1 - 2 * p - 1e-5, 12) AS from_match, round(1 - 2 * p - 1e-5, 12) AS from_insertion, 3 * p AS p_error FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PRESETS.items()) + ") v(name, p)")
def hmm_presets(spark, sf):
    made = {k: hmm.Params.uniform(v) if k == "uniform" else getattr(hmm.Params, k)() for k, v in PRESETS.items()}
    rows = [(k, p.p_mismatch, p.p_match, round(p.mm, 12), round(p.im, 12), p.p_error) for k, p in made.items()]
    return spark.createDataFrame(rows, "name string, p double, p_match double, from_match double, from_insertion double, p_error double")
