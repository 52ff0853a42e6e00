"""Queries of carried mappings, tables of samples and searches by joins, and the same in SQL. Their reads are the ACGT
letters of the pages' addresses."""

from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.more_queries import NET, net
from helixframe.operators import blocks, euler, hmm, inherit, search, spans
from helixframe.operators import graph as G
from helixframe.operators import kmers as K
from helixframe.plans import samples
from helixframe.plans.durable import cut, shared_folder
from helixframe.queries import READS, query, reads, table
from helixframe.sources import fasta, formats, ranges

URLS = "urls AS (SELECT page_id AS read_id, upper(regexp_replace(coalesce(url, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM pages)"


def urls(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("read_id"), F.explode(F.array(S.acgt_only(F.coalesce("url", F.lit(""))))).alias("seq"))


def linear_sql(k: int) -> str:
    return f"""p{k} AS (SELECT repeat('n', {k - 1}) || seq || repeat('n', {k - 1}) AS seq FROM urls WHERE length(seq) >= {k}),
t{k} AS (SELECT substr(seq, CAST(i AS BIGINT), {k}) AS kmer, CAST(count(*) AS DOUBLE) AS n FROM p{k}, generate_series(1, length(seq) - {k - 1}) t(i) GROUP BY 1)"""


def context_sql(k: int, m: int) -> str:
    """b, w: weights of the k-mers by the last m letters up to each base."""
    return f"""c{k} AS (SELECT read_id, CAST(i AS BIGINT) - 1 AS pos, substr(repeat('n', {m - 1}) || seq, CAST(i AS BIGINT), {m}) AS context FROM urls, generate_series(1, length(seq)) t(i)),
m{k} AS (SELECT read_id, pos, kmer, n / sum(n) OVER (PARTITION BY read_id, pos) AS p FROM c{k} JOIN t{k} ON right(kmer, {m}) = context)"""


INHERITED = f"""WITH {URLS}, {linear_sql(5)}, {linear_sql(6)}, {context_sql(5, 4)}, {context_sql(6, 5)},
ways AS (SELECT a.kmer, b.kmer AS new, count(*) OVER (PARTITION BY a.kmer) AS ways FROM t5 a JOIN t6 b ON substr(b.kmer, 2) = a.kmer),
moved AS (SELECT read_id, pos, new AS kmer, sum(p / ways) AS p FROM m5 JOIN ways USING (kmer) GROUP BY ALL),
carried AS (SELECT read_id, pos, kmer, p / sum(p) OVER (PARTITION BY read_id, pos) AS p FROM moved)"""


def numbered(table):
    """(edge_id, kmer, copy_num) of a k-mer table."""
    return K.numbered(table)[1].select("edge_id", "kmer", "copy_num")


def _inherited(spark, sf):
    """(inherited, fresh, k-mers of 6): a mapping by four letters on 5-mers carried to 6-mers, and one by five letters there."""
    r = urls(spark, sf)
    five, six = numbered(K.from_linear(r, 5)), numbered(K.from_linear(r, 6))
    carried = inherit.inherit(inherit.by_context(r, five, 4), inherit.successors(five, six), None)
    return carried, inherit.by_context(r, six, 5), six


@query(f"{INHERITED} SELECT read_id, CAST(pos AS BIGINT) AS pos, kmer, round(c.p, 6) AS inherited, round(f.p, 6) AS fresh FROM carried c FULL JOIN m6 f USING (read_id, pos, kmer)")
def map_inherited(spark, sf):
    """Weights of the 6-mers of each base: inherited from 5-mers, and mapped anew."""
    a, b, six = _inherited(spark, sf)
    side = lambda m, x: m.select("read_id", F.col("pos").cast("long").alias("pos"), "node", F.round(F.exp("lp"), 6).alias(x))
    both = side(a, "inherited").join(side(b, "fresh"), ["read_id", "pos", "node"], "full")
    return both.join(six, both["node"] == six["edge_id"]).select("read_id", "pos", "kmer", "inherited", "fresh")


@query(f"""{INHERITED}, x AS (SELECT read_id, pos, kmer, c.p AS p, f.p AS q FROM carried c FULL JOIN m6 f USING (read_id, pos, kmer))
SELECT read_id, CAST(pos AS BIGINT) AS pos, count(p + q) AS shared, count(*) AS either, round(CASE WHEN count(p) = 0 OR count(q) = 0 THEN 1e0 ELSE sum(abs(coalesce(p, 0e0) - coalesce(q, 0e0))) / 2 END, 6) AS distance FROM x GROUP BY ALL""")
def map_inherited_compared(spark, sf):
    """Common and all 6-mers of each base, and the total variation of inherited and fresh weights."""
    a, b, _ = _inherited(spark, sf)
    return inherit.compare(a, b).select("read_id", F.col("pos").cast("long").alias("pos"), "shared", "either", F.round("distance", 6).alias("distance"))


# ---- the posterior as a table: embeddings as samples of 64 edges, in two portions

SAMPLED = """WITH rows AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(abs(CAST(c AS DOUBLE)) * 3) AS BIGINT)) AS copies, 5 * CAST(embedding[1] AS DOUBLE) AS likelihood, -CAST(label AS DOUBLE) AS prior FROM embeddings),
scored AS (SELECT *, ln(1 + list_sum(copies)) AS n_euler, CAST(list_sum(copies) AS BIGINT) AS genome_size, 'v' || vec_id AS infos FROM rows),
store AS (SELECT *, likelihood + prior + n_euler AS p_lp, row_number() OVER (ORDER BY label >= 5, vec_id) AS i FROM scored QUALIFY row_number() OVER (PARTITION BY copies ORDER BY label >= 5, vec_id) = 1),
z AS (SELECT max(p_lp) + ln(sum(exp(p_lp - (SELECT max(p_lp) FROM store)))) AS z FROM store),
pairs AS (SELECT infos, p_lp, unnest(range(len(copies))) AS edge, unnest(copies) AS x FROM store),
dist AS (SELECT edge, x, sum(exp(p_lp - z)) AS p FROM pairs, z GROUP BY edge, x)"""


def sampled(spark, sf):
    """Store of the embeddings with labels below 5, then of the others."""
    copies = F.transform("embedding", lambda c: F.floor(F.abs(c.cast("double")) * 3).cast("long"))
    e = table(spark, sf, "embeddings").withColumn("copy_nums", copies).withColumn("size", F.aggregate("copy_nums", F.lit(0).cast("long"), lambda a, b: a + b))
    rows = samples.scored(e.select("label", F.col("vec_id").alias("sample_id"), F.transform("copy_nums", lambda _, i: i.cast("long")).alias("edges"), "copy_nums", (5 * F.col("embedding")[0].cast("double")).alias("likelihood"), (-F.col("label")).alias("prior"), F.ln(1 + F.col("size")).alias("n_euler"), F.col("size").alias("genome_size"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("infos")))
    first = e.where("label < 5").select(F.col("vec_id").alias("sample_id"))
    return samples.upsert(samples.upsert(samples.empty(spark), rows.join(first, "sample_id", "left_semi")), rows.join(first, "sample_id", "left_anti"))


def truth(spark):
    return spark.range(64).select(F.col("id").alias("edge"), (F.col("id") % 2).alias("copy_num"))


@query(f"{SAMPLED} SELECT infos, array_to_string(copies, ',') AS copy_nums, genome_size, round(p_lp, 6) AS p_lp FROM store")
def posterior_store(spark, sf):
    return sampled(spark, sf).select("infos", F.array_join(F.transform("copy_nums", lambda x: x.cast("string")), ",").alias("copy_nums"), "genome_size", F.round("p_lp", 6).alias("p_lp"))


@query(f"{SAMPLED} SELECT s.infos, round(s.p_lp, 6) AS p_lp, round(z, 6) AS z, (SELECT count(*) FROM store) AS samples FROM store s, z ORDER BY s.p_lp DESC, i DESC LIMIT 1")
def posterior_best(spark, sf):
    s = sampled(spark, sf)
    b, z = samples.best(s).withColumn("k", F.lit(0)), samples.total(s).withColumn("k", F.lit(0))
    return b.join(z, "k").select("infos", F.round("p_lp", 6).alias("p_lp"), F.round("z", 6).alias("z"), "samples")


@query(f"{SAMPLED} SELECT CAST(edge AS BIGINT) AS edge, x, round(p, 6) AS p FROM dist")
def posterior_marginals(spark, sf):
    return samples.marginals(sampled(spark, sf)).select("edge", "x", F.round("p", 6).alias("p"))


@query(f"{SAMPLED} SELECT infos, genome_size, round(p_lp, 6) AS p_lp, CAST(row_number() OVER (ORDER BY p_lp DESC, i) - 1 AS BIGINT) AS sample_id FROM store")
def posterior_post_file(spark, sf):
    """The samples in the order of a POST file, as read from it."""
    path = shared_folder(spark, "samples.post")
    fasta.write_lines(samples.post_lines(sampled(spark, sf)), path, formats.ORDER, one=False)
    return samples.read_post(fasta.read_lines(spark, path)).select("infos", "genome_size", F.round("p_lp", 6).alias("p_lp"), "sample_id")


@query(f"""{SAMPLED}, best AS (SELECT copies FROM store ORDER BY p_lp DESC, i DESC LIMIT 1)
SELECT CAST(5 AS INT) AS k, 'e' || edge AS edge, CAST(edge % 2 AS INT) AS copy_num_true, round(sum(x * p), 5) AS mean, round(coalesce(sum(p) FILTER (x = edge % 2), 0), 5) AS p_true, round(coalesce(sum(p) FILTER (x = 0), 0), 5) AS p_zero FROM dist GROUP BY edge""")
def posterior_inspect_edges(spark, sf):
    """Edges against a truth that has every other one, as read from an INSPECT file."""
    path = shared_folder(spark, "samples.inspect")
    fasta.write_lines(samples.inspect_lines(sampled(spark, sf), 5, None, truth(spark)), path, formats.ORDER, one=False)
    return formats.scan_inspect(spark, path)[2].drop("dist")


@query(f"{SAMPLED} SELECT infos, CAST(row_number() OVER (ORDER BY p_lp DESC, i) - 1 AS INT) AS rank, round(p_lp - z, 6) AS p_lp, CAST(list_sum(list_transform(copies, lambda c, j: abs(c - (j - 1) % 2))) AS INT) AS dist FROM store, z")
def posterior_inspect_samples(spark, sf):
    """Samples with their rank, probability and distance from the truth, as read from an INSPECT file."""
    path = shared_folder(spark, "samples.inspect")
    fasta.write_lines(samples.inspect_lines(sampled(spark, sf), 5, None, truth(spark)), path, formats.ORDER, one=False)
    return formats.scan_inspect(spark, path)[1].select("infos", "rank", F.round("p_lp", 6).alias("p_lp"), "dist")


# ---- block models: candidates of changed copies on the reads that they touch

LETTERS = "(VALUES ('A'), ('C'), ('G'), ('T'))"
CHANGED = f"""WITH {URLS}, {linear_sql(5)}, pair AS (SELECT x.b AS x, y.b AS y, CAST((position(x.b IN 'ACGT') - 1) * 4 + position(y.b IN 'ACGT') - 1 AS BIGINT) AS candidate FROM {LETTERS} x(b), {LETTERS} y(b)),
change AS (SELECT candidate, kmer, sum(delta) AS delta FROM (SELECT candidate, x || y || x || y || x AS kmer, 2 AS delta FROM pair UNION ALL SELECT candidate, y || x || y || x || y, 1 FROM pair) WHERE kmer IN (SELECT kmer FROM t5) GROUP BY ALL),
copies AS (SELECT c.candidate, t5.kmer, n + coalesce(delta, 0) AS n FROM (SELECT DISTINCT candidate FROM change) c CROSS JOIN t5 LEFT JOIN change USING (candidate, kmer)),
facts AS (SELECT *, sum(n) FILTER (right(kmer, 1) <> 'n') OVER (PARTITION BY candidate, left(kmer, 4)) AS ways, sum(n) FILTER (right(kmer, 1) <> 'n') OVER (PARTITION BY candidate) AS whole FROM copies),
steps AS (SELECT read_id, CAST(i AS BIGINT) AS i, substr('nnnn' || seq, CAST(i AS BIGINT), 5) AS kmer FROM urls, generate_series(1, length(seq)) t(i) WHERE length(seq) >= 5)"""


@query(f"""{CHANGED}, lps AS (SELECT candidate, sum(CASE WHEN i = 1 THEN ln(1e-5) + ln(n / whole) ELSE ln(n / ways) END + ln(1 - 1e-5)) AS lp FROM steps JOIN facts USING (kmer) GROUP BY candidate),
hit AS (SELECT candidate, kmer FROM change UNION SELECT candidate, t5.kmer FROM change JOIN t5 ON substr(t5.kmer, 2) = left(change.kmer, 4)),
again AS (SELECT candidate, count(DISTINCT read_id) AS rescored FROM hit JOIN steps USING (kmer) GROUP BY candidate)
SELECT candidate, round(lp, 3) AS lp, coalesce(rescored, 0) AS rescored FROM lps LEFT JOIN again USING (candidate)""")
def model_candidates(spark, sf):
    """Log likelihood of the addresses on their own graph of 5-mers under 16 candidates, which raise the copies of the 5-mers
    of two letters in turn, and the reads that were scored anew. Without errors, so that SQL can follow each base."""
    r = urls(spark, sf).where("length(seq) >= 5")
    nodes, edges = map(cut, K.numbered(K.from_linear(r, 5)))
    inner = G.line_graph(edges).join(nodes.where("is_terminal").select(F.col("node_id").alias("node")), "node", "left_anti")
    model = blocks.BlockModel(edges.select(F.col("edge_id").alias("node_id"), "base", "copy_num", F.col("edge_id").alias("owner")), inner.select(F.col("a").alias("source"), F.col("b").alias("target")), 5)
    rows = [(4 * i + j, z, d) for i, x in enumerate("ACGT") for j, y in enumerate("ACGT") for z, d in ((f"{x}{y}{x}{y}{x}", 2), (f"{y}{x}{y}{x}{y}", 1))]
    changes = spark.createDataFrame(rows, "candidate long, kmer string, delta long").join(edges.select("kmer", F.col("edge_id").alias("edge")), "kmer")
    got = model.candidate_scores(r, cut(inherit.by_context(r, edges, 5)), hmm.Params.zero_error(), changes)
    return got.select("candidate", F.round("lp", 3).alias("lp"), "rescored")


# ---- searches by joins on the graph of suppliers

FLOW = f"{NET}, f AS (SELECT *, edge_id % 3 AS flow, CAST(edge_id * 7 % 11 + 1 AS DOUBLE) AS cost FROM net)"
ARCS = "arcs AS (SELECT edge_id, 1 AS dir, source, target, cost FROM f UNION ALL SELECT edge_id, -1, target, source, cost FROM f WHERE flow > 0)"


def flow_net(spark, sf):
    return net(spark, sf).withColumn("flow", F.col("edge_id") % 3).withColumn("cost", (F.col("edge_id") * 7 % 11 + 1).cast("double")).withColumn("low", F.lit(0)).withColumn("high", F.col("flow") + 1)


TEXT = "array_to_string(list_transform(path, lambda a: 'e' || (abs(a) - 1) || CASE WHEN a > 0 THEN '+' ELSE '-' END), '')"


@query(f"""WITH RECURSIVE {FLOW}, {ARCS}, d AS (SELECT edge_id AS origin, target AS node, 1 AS hops, {{'cost': cost, 'path': [{{'e': edge_id, 'd': 1}}]}} AS best FROM arcs WHERE dir = 1 AND source <> target
UNION ALL SELECT origin, node, hops, best FROM (SELECT d.origin, a.target AS node, d.hops + 1 AS hops, min({{'cost': d.best.cost + a.cost, 'path': list_append(d.best.path, {{'e': a.edge_id, 'd': a.dir}})}}) AS best FROM d JOIN arcs a ON a.source = d.node AND a.edge_id <> d.origin WHERE d.hops < 12 AND d.node <> (SELECT source FROM f WHERE edge_id = d.origin) GROUP BY d.origin, a.target, d.hops)),
best AS (SELECT origin, min({{'cost': best.cost, 'hops': hops, 'path': best.path}}) AS b FROM d JOIN f ON f.edge_id = d.origin AND f.source = d.node GROUP BY origin)
SELECT edge_id, cost, CAST(1 AS INT) AS hops, 'e' || edge_id || '+' AS cycle FROM f WHERE source = target
UNION ALL SELECT origin, b.cost, CAST(b.hops AS INT), array_to_string(list_transform(b.path, lambda a: 'e' || a.e || CASE WHEN a.d > 0 THEN '+' ELSE '-' END), '') FROM best WHERE len(list_distinct(list_transform(b.path, lambda a: a.e))) = len(b.path)""")
def net_shortest_cycles(spark, sf):
    """The cheapest cycle of at most 12 arcs over each edge that raises it, in the residual graph; one search for all."""
    arcs = search.residual(flow_net(spark, sf), F.col("cost"))
    got = search.shortest_cycles(arcs, arcs.where("dir = 1"), 12)
    return got.select("edge_id", "cost", "hops", search.cycle_text().alias("cycle"))


@query(f"""WITH RECURSIVE {FLOW}, {ARCS}, p AS (SELECT source AS root, target AS node, [(edge_id + 1) * dir] AS path, [target] AS seen, 0 AS flips, dir FROM arcs WHERE target >= source
UNION ALL SELECT p.root, a.target, list_append(path, (a.edge_id + 1) * a.dir), list_append(seen, a.target), flips + CAST(p.dir <> a.dir AS INT), a.dir FROM p JOIN arcs a ON a.source = p.node
WHERE p.node <> p.root AND len(path) < 4 AND a.target >= p.root AND NOT list_contains(seen, a.target) AND NOT list_contains(path, a.edge_id + 1) AND NOT list_contains(path, -a.edge_id - 1) AND flips + CAST(p.dir <> a.dir AS INT) <= 2)
SELECT root, {TEXT} AS cycle, CAST(flips AS INT) AS flips FROM p WHERE node = root""")
def net_short_moves(spark, sf):
    """Changes of at most four edges and two turns that keep a circulation."""
    return search.short_moves(flow_net(spark, sf), 4, 2).select("root", search.cycle_text().alias("cycle"), "flips")


# ---- Euler circuits

RINGS = f"""WITH {URLS}, rings AS (SELECT left(repeat(seq, 4), CAST(length(seq) + 3 AS INT)) AS ring FROM urls WHERE length(seq) >= 1),
t AS (SELECT substr(ring, CAST(i AS BIGINT), 4) AS kmer FROM rings, generate_series(1, length(ring) - 3) t(i))"""


def rings(spark, sf):
    """(nodes, edges) of the 4-mers of the addresses as circles."""
    haps = urls(spark, sf).where("seq <> ''").select("seq", F.lit("C").alias("style"))
    return K.numbered(K.from_styled(haps, 4))


@query(f"{RINGS} SELECT kmer, CAST(count(*) AS BIGINT) AS uses, CAST(count(*) AS BIGINT) AS joined FROM t GROUP BY kmer")
def euler_circuit_uses(spark, sf):
    """How often the Euler circuits of all addresses pass each 4-mer, and how often the next use begins where it ends. SQL
    can't tell which circuit it is, but that each copy is used once and each step is joined."""
    _, edges = rings(spark, sf)
    c = cut(euler.circuits(edges))
    bad = euler.broken(c).withColumn("bad", F.lit(1))
    got = c.join(bad, ["circuit", "i"], "left").groupBy("edge_id").agg(F.count("*").alias("uses"), (F.count("*") - F.count("bad")).alias("joined"))
    return got.join(edges.select("edge_id", "kmer"), "edge_id").select("kmer", "uses", "joined")


@query(f"""WITH RECURSIVE {RINGS.removeprefix('WITH ')}, n AS (SELECT DISTINCT left(kmer, 3) AS a, substr(kmer, 2) AS b FROM t), reach AS (SELECT a, a AS b FROM n UNION SELECT r.a, n.b FROM reach r JOIN n ON n.a = r.b),
part AS (SELECT a, min(b) AS part FROM reach GROUP BY a) SELECT CAST(count(*) AS BIGINT) AS steps, min(t.kmer) AS first FROM t JOIN part ON part.a = left(t.kmer, 3) GROUP BY part""")
def euler_circuit_sizes(spark, sf):
    """Steps and smallest 4-mer of each circuit: there is one for each connected part."""
    _, edges = rings(spark, sf)
    got = euler.circuits(edges).join(edges.select("edge_id", "kmer"), "edge_id").groupBy("circuit").agg(F.count("*").alias("steps"), F.min("kmer").alias("first"))
    return got.select("steps", "first")


# ---- running totals, spans, FASTA by ranges


@query(f"""WITH {READS}, t AS (SELECT read_id, length(seq) AS bases, coalesce(sum(length(seq)) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(length(seq)) FROM reads) // 3 AS target FROM reads)
SELECT read_id, CAST(bases AS BIGINT) AS bases, CAST(before AS BIGINT) AS before FROM t WHERE before < target""")
def reads_up_to_target(spark, sf):
    """Reads in their order until they hold a third of all bases."""
    r = cut(reads(spark, sf).select("read_id", F.length("seq").cast("long").alias("bases")))
    target = r.agg(F.sum("bases")).first()[0] or 0
    return spans.up_to(r, ["read_id"], "bases", target // 3)


PLACES = "p AS (SELECT page_id, length(url) AS host, page_id * 37 % 5000 AS lo, page_id * 37 % 5000 + 1 + (page_id % 11) * (page_id % 13) AS hi FROM pages), q AS (SELECT page_id AS other, length(url) AS host, page_id * 91 % 5000 AS a, page_id * 91 % 5000 + CASE WHEN page_id % 97 = 0 THEN 600 ELSE page_id % 7 END AS b FROM pages)"


@query(f"WITH {PLACES} SELECT page_id, CAST(count(*) AS BIGINT) AS met, CAST(sum(least(hi, b) - greatest(lo, a)) AS BIGINT) AS shared FROM p JOIN q ON p.host = q.host AND lo < b AND a < hi AND a < b GROUP BY page_id")
def span_overlaps(spark, sf):
    """Spans of mixed sizes on as many lines as addresses have lengths: partners of each and what they share."""
    t, i = table(spark, sf, "pages"), F.col("page_id")
    host = F.length("url").cast("long").alias("host")
    p = t.select("page_id", host, (i * 37 % 5000).alias("lo"), (i * 37 % 5000 + 1 + (i % 11) * (i % 13)).alias("hi"))
    q = t.select(i.alias("other"), host, (i * 91 % 5000).alias("a"), (i * 91 % 5000 + F.when(i % 97 == 0, 600).otherwise(i % 7)).alias("b"))
    met = spans.overlaps(p, q, ["host"], ("lo", "hi"), ("a", "b"))
    return met.groupBy("page_id").agg(F.count("*").alias("met"), F.sum(F.least("hi", "b") - F.greatest("lo", "a")).alias("shared"))


@query(f"WITH {URLS}, t AS (SELECT substr(seq, CAST(i AS BIGINT), 5) AS kmer FROM urls, generate_series(1, length(seq) - 4) t(i) WHERE length(seq) >= 5) SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY kmer")
def fasta_range_kmers(spark, sf):
    """5-mers of the addresses, counted in FASTA files by ranges of 4 KiB that cut records, headers and lines anywhere."""
    path = shared_folder(spark, "urls.fa")
    fasta.write_reads(urls(spark, sf), path, one=False)
    return ranges.kmer_counts(spark, path, 5, 4096)
