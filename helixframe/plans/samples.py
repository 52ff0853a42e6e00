"""The posterior as a table: sampled copy-number vectors as rows, never as an object of the driver.

A store is a frame ``(sample_id, edges, copy_nums, sign, likelihood, prior, n_euler, genome_size, infos, p_lp)``: the vector
sorted by edge, a hash of it, the parts of its score and the score. Sample ids grow in the order of insertion; every
vector is there once, under its first id. Vectors are found by their hash and compared inside equal hashes.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import probability as P
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans.durable import cut
from helixframe.sources import formats

SCHEMA = "sample_id long, edges array<long>, copy_nums array<long>, sign long, likelihood double, prior double, n_euler double, genome_size long, infos string, p_lp double"
VECTOR = ["sign", "edges", "copy_nums"]
SCORE = ("likelihood", "prior", "n_euler", "genome_size")
SCORE_JSON = "likelihood double, prior double, n_euler double, genome_size long, time_likelihood long, time_euler long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def signed(vectors: DataFrame) -> DataFrame:
    """Frame with (edges, copy_nums) sorted by edge and their hash. An edge that stands twice is an error."""
    pairs = F.array_sort(F.arrays_zip(F.col("edges").cast("array<long>").alias("e"), F.col("copy_nums").cast("array<long>").alias("c")))
    out = vectors.withColumn("_z", pairs).withColumn("edges", F.transform("_z", lambda z: z["e"])).withColumn("copy_nums", F.transform("_z", lambda z: z["c"]))
    once = F.when(F.size(F.array_distinct("edges")) == F.size("edges"), F.xxhash64("edges", "copy_nums")).otherwise(F.raise_error(F.lit("an edge stands twice in a vector")).cast("long"))
    return out.withColumn("sign", once).drop("_z")


def scored(rows: DataFrame) -> DataFrame:
    """Rows (sample_id, edges, copy_nums, likelihood, prior, n_euler, genome_size, infos) in the form of a store, repeats and
    all. A null part of the score counts as impossible, null infos as none."""
    part = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c)
    s = signed(rows).select("sample_id", *VECTOR, *[part(c) for c in SCORE[:3]], F.col("genome_size").cast("long").alias("genome_size"), F.coalesce(F.col("infos").cast("string"), F.lit("[]")).alias("infos"))
    return s.withColumn("p_lp", F.col("likelihood") + F.col("prior") + F.col("n_euler")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def of_frame(rows: DataFrame) -> DataFrame:
    """Store of a search's samples (as of ``Posterior.frame``)."""
    infos = F.concat(F.lit("["), F.array_join("infos", ","), F.lit("]"))
    return upsert(empty(rows.sparkSession), scored(rows.withColumn("infos", infos).drop("p_lp")))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with the new rows (as of ``scored``) whose vector it doesn't hold, in the order of their ids behind its own; of
    equal new vectors the first. What is there stays as it is. An empty side is fine."""
    rest = [c for c in store.columns if c not in VECTOR]
    # copies are folded on the map side, so a hot vector costs a row a task
    first = new.groupBy(*VECTOR).agg(F.min_by(F.struct(*rest), "sample_id").alias("_r")).select(*VECTOR, "_r.*")
    fresh = first.join(store.select(*VECTOR), VECTOR, "left_anti")
    top = store.agg(F.max("sample_id")).first()[0]
    low = new.agg(F.min("sample_id")).first()[0]
    shift = 0 if top is None or low is None else max(0, top + 1 - low)
    return cut(store.unionByName(fresh.withColumn("sample_id", F.col("sample_id") + shift)))


def find(store: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors (edges, copy_nums, ..) with the sample_id and p_lp of their sample; null where the store has none."""
    s = store.select(*VECTOR, F.col("sample_id"), "p_lp")
    return signed(vectors).join(s, VECTOR, "left").drop("sign")


def contained(store: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that the store holds."""
    return signed(vectors).join(store.select(*VECTOR), VECTOR, "left_semi").drop("sign")


def total(store: DataFrame) -> DataFrame:
    """One row (z, samples): log of the summed scores; -infinity over none."""
    z = P.sum_by(store.select(F.lit(0).alias("_k"), "p_lp"), ["_k"], "p_lp", "z")
    n = store.agg(F.count("*").alias("samples")).withColumn("_k", F.lit(0))
    return n.join(z, "_k", "left").select(F.coalesce("z", F.lit(float("-inf"))).alias("z"), "samples")


def best(store: DataFrame) -> DataFrame:
    """The sample of the highest score, of equals the last one; no row over none."""
    row = F.max_by(F.struct(*store.columns), F.struct("p_lp", "sample_id"))
    return store.agg(row.alias("b")).where("b is not null").select("b.*")


def pairs(store: DataFrame) -> DataFrame:
    """(sample_id, p_lp, edge, x): one row for each edge of each vector."""
    z = F.explode(F.arrays_zip("edges", "copy_nums"))
    return store.select("sample_id", "p_lp", z.alias("z")).select("sample_id", "p_lp", F.col("z.edges").alias("edge"), F.col("z.copy_nums").alias("x"))


def marginals(store: DataFrame) -> DataFrame:
    """(edge, x, p): distribution of the copies of each edge over the samples that hold it."""
    return P.distribution(pairs(store), ["edge"], "x", "p_lp").select("edge", "x", F.exp("x_lp").alias("p"))


def edge_facts(store: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """(edge, copy_num_true, mean, p_true, p_zero, dist, best): what the samples say of each edge. true(edge, copy_num):
    the truth, null where it is not known."""
    m = marginals(store)
    t = m.select("edge").distinct().withColumn("copy_num_true", F.lit(None).cast("long")) if true is None else true.select("edge", F.col("copy_num").cast("long").alias("copy_num_true"))
    at = lambda c: F.coalesce(F.sum(F.when(F.col("x") == c, F.col("p"))), F.lit(0.0))
    text = F.format_string("p(%s)=%.3f", F.col("x").cast("string"), F.col("p"))
    dist = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", text.alias("t")))), lambda s: s["t"]), ",")
    rows = m.join(t, "edge", "left").groupBy("edge", "copy_num_true").agg(F.sum(F.col("x") * F.col("p")).alias("mean"), at(F.col("copy_num_true")).alias("p_true"), at(F.lit(0)).alias("p_zero"), dist.alias("dist"))
    top = pairs(best(store)).select("edge", F.col("x").alias("best"))
    return rows.withColumn("p_true", F.when(F.col("copy_num_true").isNotNull(), F.col("p_true"))).join(top, "edge", "left")


def distance(store: DataFrame, true: DataFrame) -> DataFrame:
    """(sample_id, dist): sum of the differences from the truth, over the edges of the vector that the truth knows."""
    t = true.select("edge", F.col("copy_num").cast("long").alias("t"))
    return pairs(store).join(t, "edge").groupBy("sample_id").agg(F.sum(F.abs(F.col("x") - F.col("t"))).alias("dist"))


# ---- files: lines (part, i, line) for ``fasta.write_lines``


def _numbers(c: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def _json() -> Column:
    return F.to_json(F.struct(*SCORE, F.lit(0).cast("long").alias("time_likelihood"), F.lit(0).cast("long").alias("time_euler")))


def _order() -> Column:
    """Best first, of equals the first."""
    return F.struct((-F.col("p_lp")).alias("a"), F.col("sample_id").alias("b"))


def post_lines(store: DataFrame) -> DataFrame:
    """Z with the total, then C for each sample, best first."""
    head = total(store).select(F.lit(0).alias("part"), F.struct(F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("b")).alias("i"), F.concat(F.lit("Z\t"), F.col("z").cast("string")).alias("line"))
    body = store.select(F.lit(1).alias("part"), _order().alias("i"), F.concat_ws("\t", F.lit("C"), F.col("p_lp").cast("string"), _numbers("copy_nums"), _json(), "infos").alias("line"))
    return head.unionByName(body)


def _samples(rows: DataFrame, edges: list[int] | None) -> DataFrame:
    """Store of rows (i, copies, json, infos)."""
    c = F.transform(F.regexp_extract_all("copies", F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("long"))
    known = F.sequence(F.lit(0), F.size("copy_nums") - 1) if edges is None else F.array(*[F.lit(e) for e in edges])
    rows = K.number(rows.orderBy("i"), "sample_id").withColumn("s", F.from_json("json", SCORE_JSON)).withColumn("copy_nums", c)
    rows = rows.withColumn("edges", F.when(F.size("copy_nums") > 0, known.cast("array<long>")).otherwise(F.array().cast("array<long>")))
    return upsert(empty(rows.sparkSession), scored(rows.select("sample_id", "edges", "copy_nums", "s.likelihood", "s.prior", "s.n_euler", "s.genome_size", "infos")))


def read_post(lines: DataFrame, edges: list[int] | None = None) -> DataFrame:
    """Store of the C lines (i, line), in their order; edges: ids of the vectors' places (else 0, 1, ..). Scores and total
    come from the parts again."""
    f = lines.where("startswith(line, 'C')").select("i", F.split("line", "\t").alias("f"))
    return _samples(f.select("i", F.col("f")[2].alias("copies"), F.col("f")[3].alias("json"), F.col("f")[4].alias("infos")), edges)


def graph_facts(g: Assembly) -> dict[str, int]:
    return {"n_edges_full": g.edges.count(), "n_edges_compact": g.compact.count(), "n_nodes_full": g.nodes.count(), "n_ambiguous": g.n_ambiguous_nodes(), "genome_size": g.genome_size()}


def inspect_lines(store: DataFrame, k: int, facts: dict[str, int] | None = None, true: DataFrame | None = None) -> DataFrame:
    """G (facts of the graph), C (samples, best first) and E (what they say of each edge)."""
    spark, first = store.sparkSession, F.lit(str(k))
    known = {**(facts or {}), "n_samples": store.count(), "n_copies_true": "?" if true is None else true.agg(F.sum("copy_num")).first()[0]}
    g = spark.createDataFrame([(0, i, f"{k}\tG\t{a}\t{b}") for i, (a, b) in enumerate(known.items())], "part int, i long, line string")
    z = total(store).select("z", F.lit(0).alias("_k"))
    c = K.number(store.orderBy(_order()), "rank").withColumn("_k", F.lit(0)).join(F.broadcast(z), "_k")
    c = c.withColumn("dist", F.lit("?")) if true is None else c.join(distance(store, true), "sample_id", "left").withColumn("dist", F.coalesce(F.col("dist").cast("string"), F.lit("0")))
    ten = lambda c: F.format_string("%.10f", c)
    c = c.select(F.lit(1).alias("part"), F.col("rank").alias("i"), F.concat_ws("\t", first, F.lit("C"), F.col("rank").cast("string"), ten(F.col("p_lp") - F.col("z")), *[ten(F.col(x)) for x in SCORE[:3]], F.col("genome_size").cast("string"), "dist", "infos", _numbers("copy_nums"), _json()).alias("line"))
    e, five = edge_facts(store, true), lambda c: F.coalesce(F.format_string("%.5f", c), F.lit("?"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    e = e.select(F.lit(2).alias("part"), F.col("edge").alias("i"), F.concat_ws("\t", first, F.lit("E"), F.concat(F.lit("e"), F.col("edge").cast("string")), shown("copy_num_true"), five(F.col("mean")), F.when(F.col("p_true").isNull(), "?").otherwise(five(F.col("p_true"))), five(F.col("p_zero")), "dist", shown("best")).alias("line"))
    return g.unionByName(c).unionByName(e)


def read_inspect(lines: DataFrame, k: int, edges: list[int] | None = None) -> DataFrame:
    """Store of the C lines (i, line); a line of another k is an error. No C line, no sample."""
    f = lines.where("line <> '' and not startswith(line, '#')").select("i", F.split("line", "\t").alias("f"))
    other = f.where(F.col("f")[0] != str(k)).select(F.col("f")[0]).first()
    if other is not None:
        raise ValueError(f"k is {other[0]}, not {k}")
    c = f.where("f[1] = 'C'")
    return _samples(c.select("i", F.col("f")[10].alias("copies"), F.col("f")[11].alias("json"), F.col("f")[9].alias("infos")), edges)


def gfa_lines(g: Assembly, store: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """GFA whose segments say mean, truth and distribution; redder the more the mean is above the graph's copies, bluer
    below."""
    c = g.compact_seqs().select(F.col("edge_id").alias("edge"), "copy_num")
    off = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mean") - F.col("copy_num")))
    byte = lambda x: F.lower(F.lpad(F.hex((255 * F.greatest(x, F.lit(0.0))).cast("long")), 2, "0"))
    label = F.concat(F.format_string("%.3f", F.col("mean")), F.lit("x "), F.coalesce(F.col("copy_num_true").cast("string"), F.lit("?")), F.lit("x ("), "dist", F.lit(")"))
    marks = edge_facts(store, true).join(c, "edge").select(F.col("edge").alias("edge_id"), label.alias("label"), F.concat(F.lit("#"), byte(off), F.lit("00"), byte(-off)).alias("colour"))
    return formats.gfa_marked_lines(g, marks)
