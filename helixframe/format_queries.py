"""Queries that write the tables' reads and their graph in the file formats and read them again, and the same in SQL."""

import uuid

from pyspark.sql import functions as F

from helixframe.more_queries import AT, GRAPH, WALK, _haps, graph, linear
from helixframe.plans.durable import ensure_dir
from helixframe.queries import READS, query, reads, table
from helixframe.sources import fasta, formats


def folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# ---- FASTA, SAM, dataset


@query(f"WITH {READS} SELECT row_number() OVER (ORDER BY read_id) - 1 AS record_id, 'r' || read_id AS name, '' AS description, seq FROM reads")
def fasta_records(spark, sf):
    """Reads written in many files and scanned in their order."""
    path = folder(spark, "reads.fa")
    fasta.write_reads(reads(spark, sf), path, one=False)
    return fasta.scan(spark, path)


@query(f"WITH {READS} SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, seq FROM reads WHERE seq <> ''")
def fasta_reads(spark, sf):
    """Reads in compressed files."""
    path = folder(spark, "reads.fa") + ".gz"
    fasta.write_reads(reads(spark, sf).where("seq <> ''"), path, one=False)
    return fasta.read_reads(spark, path)


STYLED = f"{READS}, haps AS (SELECT row_number() OVER (ORDER BY read_id) - 1 AS hap_id, read_id, CASE WHEN read_id % 2 = 0 THEN 'C' ELSE 'L' END AS style, seq FROM reads WHERE seq <> '')"


def haps(spark, sf):
    return reads(spark, sf).where("seq <> ''").select(F.col("read_id").alias("hap_id"), F.when(F.col("read_id") % 2 == 0, "C").otherwise("L").alias("style"), "seq")


@query(f"WITH {STYLED} SELECT hap_id, style, seq FROM haps")
def fasta_genome(spark, sf):
    path = folder(spark, "genome.fa")
    fasta.write_genome(haps(spark, sf), path, one=False)
    return fasta.read_genome(spark, path)


@query(f"WITH {STYLED} SELECT '@SQ' || chr(9) || 'SN:g' || read_id || chr(9) || 'LN:' || length(seq) AS line FROM haps UNION ALL SELECT concat_ws(chr(9), 'r' || read_id, '0', 'g' || read_id, '3', '255', length(seq) || 'M', '*', '0', '0', seq, '*') FROM haps")
def sam_lines(spark, sf):
    """Each read placed from the third base of its own haplotype on."""
    h, path = haps(spark, sf), folder(spark, "reads.sam")
    place = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.struct(F.col("hap_id").cast("long").alias("node"), (i + 2).cast("long").alias("pos")))
    fasta.write_sam(h, h.select(F.col("hap_id").alias("read_id"), "seq", place.alias("origins")), path, one=False)
    return fasta.read_lines(spark, path).select("line")


SMALL = f"{READS}, s AS (SELECT row_number() OVER (ORDER BY read_id) - 1 AS id, seq FROM reads WHERE length(seq) BETWEEN 1 AND 60)"


def _dataset(spark, sf):
    """Short reads, as the document is one value; each read's bases match node 4 from base 7 on."""
    short, path = reads(spark, sf).where("length(seq) between 1 and 60"), folder(spark, "dataset.json")
    place = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.struct(F.lit(4).cast("long").alias("node"), (i + 7).cast("long").alias("pos")))
    rows = short.select("read_id", "seq", F.lit(False).alias("is_revcomp"), place.alias("origins"))
    fasta.write_dataset(short.select(F.col("read_id").alias("hap_id"), F.lit("C").alias("style"), "seq"), rows, {"p_mismatch": 0.01}, path)
    return fasta.read_dataset(spark, path)


@query(f"WITH {SMALL} SELECT CAST(id AS BIGINT) AS hap_id, 'C' AS style, seq FROM s")
def dataset_genome(spark, sf):
    return _dataset(spark, sf)[0].select("hap_id", "style", "seq")


@query(f"WITH {SMALL} SELECT CAST(id AS BIGINT) AS read_id, seq, false AS is_revcomp, CAST(length(seq) AS BIGINT) AS matches, CAST(7 AS BIGINT) AS first_pos, CAST(6 + length(seq) AS BIGINT) AS last_pos FROM s")
def dataset_reads(spark, sf):
    r = _dataset(spark, sf)[1]
    return r.select("read_id", "seq", "is_revcomp", F.size("origins").cast("long").alias("matches"), F.col("origins")[0]["pos"].alias("first_pos"), F.element_at("origins", -1)["pos"].alias("last_pos"))


# ---- DBG, PATHS, GFA


T = "chr(9)"
DBG_LINES = f"""SELECT 'K' || {T} || '5' AS line UNION ALL SELECT concat_ws({T}, 'N', CAST(node_id AS VARCHAR), node) FROM ids WHERE node_id IN (SELECT source FROM c UNION SELECT target FROM c)
UNION ALL SELECT concat_ws({T}, 'E', CAST(edge_id AS VARCHAR), CAST(source AS VARCHAR), CAST(target AS VARCHAR), kmer, CAST(copy_num AS VARCHAR), array_to_string(path, ',')) FROM c"""


@query(f"{WALK} {DBG_LINES}")
def dbg_file(spark, sf):
    """Lines of the DBG file, as read from it."""
    path = folder(spark, "graph.dbg")
    fasta.write_lines(formats.dbg_lines(graph(spark, sf)), path, formats.ORDER, one=False)
    return fasta.read_lines(spark, path).select("line")


@query(f"{GRAPH} SELECT CAST(edge_id AS BIGINT) AS edge_id, base, copy_num, kmer FROM e")
def dbg_file_edges(spark, sf):
    """Edges of the graph that is read from compressed files."""
    path = folder(spark, "graph") + ".dbz"
    fasta.write_lines(formats.dbg_lines(graph(spark, sf)), path, formats.ORDER, one=False)
    return formats.read_dbg(fasta.read_lines(spark, path)).edges.select("edge_id", "base", "copy_num", "kmer")


@query(f"{WALK} SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, array_to_string(path, ',') AS path FROM c")
def dbg_file_compact(spark, sf):
    g = formats.read_dbg(formats.dbg_lines(graph(spark, sf)).select("line"))
    return g.compact.select("edge_id", "source", "target", F.concat_ws(",", F.transform("edges_in_full", lambda x: x.cast("string"))).alias("path"))


@query(f"{GRAPH}{AT} SELECT 'P' || {T} || string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY i) AS line FROM p JOIN e ON p.kmer = e.kmer GROUP BY path_id")
def paths_file(spark, sf):
    path = folder(spark, "reads.paths")
    fasta.write_lines(formats.paths_lines(graph(spark, sf).paths_of(_haps(spark, sf))), path, formats.ORDER, one=False)
    return fasta.read_lines(spark, path).select("line")


@query(f"{GRAPH}{AT} SELECT CAST(dense_rank() OVER (ORDER BY path_id) - 1 AS BIGINT) AS path_id, i, CAST(edge_id AS BIGINT) AS edge_id FROM p JOIN e ON p.kmer = e.kmer")
def paths_file_read(spark, sf):
    path = folder(spark, "reads.paths")
    fasta.write_lines(formats.paths_lines(graph(spark, sf).paths_of(_haps(spark, sf))), path, formats.ORDER, one=False)
    return formats.read_paths(fasta.read_lines(spark, path))


LINKS = "SELECT a.edge_id AS a, b.edge_id AS b, a.target AS node FROM c a JOIN c b ON a.target = b.source JOIN ids ON ids.node_id = a.target WHERE ids.node <> 'nnnn'"


@query(f"""{WALK} SELECT concat_ws({T}, 'S', CAST(edge_id AS VARCHAR), seq, 'DP:f:' || copy_num, 'LN:i:' || length(seq), 'LB:Z:' || seq, 'CL:Z:#000000') AS line FROM c
UNION ALL SELECT concat_ws({T}, 'L', CAST(a AS VARCHAR), '+', CAST(b AS VARCHAR), '+', '0M', 'ID:Z:' || node) FROM ({LINKS})""")
def gfa_file(spark, sf):
    path = folder(spark, "graph.gfa")
    fasta.write_lines(formats.gfa_lines(graph(spark, sf)), path, formats.ORDER, one=False)
    return fasta.read_lines(spark, path).select("line")


@query(f"""{WALK}, s AS (SELECT CAST(edge_id AS VARCHAR) AS name, replace(seq, 'n', '') AS seq, CAST(copy_num AS DOUBLE) AS depth FROM c WHERE replace(seq, 'n', '') <> '' AND copy_num > 0)
SELECT name, '+' AS strand, seq, depth FROM s UNION ALL SELECT name, '-', reverse(translate(seq, 'ACGT', 'TGCA')), depth FROM s""")
def gfa_segments(spark, sf):
    return formats.read_gfa(formats.gfa_lines(graph(spark, sf)))[0]


@query(f"{WALK}, l AS ({LINKS}) SELECT CAST(a AS VARCHAR) AS a, '+' AS a_strand, CAST(b AS VARCHAR) AS b, '+' AS b_strand FROM l UNION ALL SELECT CAST(b AS VARCHAR), '-', CAST(a AS VARCHAR), '-' FROM l")
def gfa_links(spark, sf):
    return formats.read_gfa(formats.gfa_lines(graph(spark, sf)))[1]


@query(f"""{WALK}, m AS (SELECT edge_id, unnest(path) AS f, unnest(range(len(path))) AS i FROM c), x AS (SELECT m.edge_id, string_agg(e.base, '' ORDER BY i) AS seq, string_agg(CAST(e.copy_num AS VARCHAR), ',' ORDER BY i) AS counts, avg(e.copy_num) AS mean, count(*) AS n FROM m JOIN e ON e.edge_id = m.f GROUP BY m.edge_id)
SELECT concat_ws({T}, 'S', CAST(edge_id AS VARCHAR), seq, 'DP:f:' || round(mean, 3), 'LN:i:' || n, 'LB:Z:' || counts || '|', 'CL:Z:#000000') AS line FROM x UNION ALL SELECT concat_ws({T}, 'L', CAST(a AS VARCHAR), '+', CAST(b AS VARCHAR), '+', '*', 'ID:Z:' || node) FROM ({LINKS})""")
def gfa_raw(spark, sf):
    return formats.raw_gfa_lines(linear(spark, sf), 5).select("line")


# ---- MAP, BMAP, INSPECT: rows of orders


CELLS = "cells AS (SELECT l_orderkey AS read_id, CAST(l_linenumber - 1 AS INT) AS pos, CAST(l_suppkey % 9 AS BIGINT) AS node, max(CAST(l_quantity AS DOUBLE)) / -8 AS lp FROM lineitem GROUP BY ALL)"


def cells(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), (F.col("l_suppkey") % 9).cast("long").alias("node"))
    return rows.agg((F.max(F.col("l_quantity").cast("double")) / -8).alias("lp"))


def _map_lines(spark, sf):
    c = cells(spark, sf)
    return formats.map_lines(c, c.select("read_id").distinct().withColumn("seq", F.repeat(F.lit("ACGT"), F.lit(4))))


@query(f"WITH {CELLS} SELECT concat_ws({T}, CAST(read_id AS VARCHAR), CAST(pos AS VARCHAR), substr('ACGTACGTACGTACGT', pos + 1, 1), string_agg(node || ':' || lp, ',' ORDER BY lp DESC, node)) AS line FROM cells GROUP BY read_id, pos")
def map_file(spark, sf):
    path = folder(spark, "reads") + ".mpz"
    fasta.write_lines(_map_lines(spark, sf), path, formats.ORDER, one=False)
    return fasta.read_lines(spark, path).select("line")


@query(f"WITH {CELLS} SELECT * FROM cells")
def map_file_read(spark, sf):
    return formats.read_map(_map_lines(spark, sf).select("line"))


@query(f"WITH {CELLS}, x AS (SELECT read_id, pos, list(DISTINCT node) AS a, list(DISTINCT node) FILTER (node % 2 = 0) AS b FROM cells GROUP BY ALL) SELECT read_id, pos, len(b) / CAST(len(a) AS DOUBLE) AS jaccard FROM x WHERE b IS NOT NULL")
def map_likeness(spark, sf):
    """All candidates against the even ones."""
    c = cells(spark, sf)
    return formats.map_jaccards(c, c.where("node % 2 = 0"))


@query(f"{WALK}, {CELLS}, m AS (SELECT edge_id, unnest(path) AS f, unnest(range(len(path))) AS i FROM c) SELECT read_id, pos, CAST(m.edge_id AS BIGINT) AS compact, CAST(m.i AS INT) AS \"offset\", lp FROM cells JOIN m ON m.f = cells.node")
def map_in_compact(spark, sf):
    return formats.map_to_compact(cells(spark, sf), graph(spark, sf))


def _bmap(spark, sf, shift: float):
    value = F.col("lp") + F.lit(shift) * F.col("pos")
    state = F.concat_ws(":", F.concat(F.lit("n"), F.col("node").cast("string")), F.lit("0.5"))
    rows = cells(spark, sf).groupBy("read_id", "pos").agg(F.min("node").alias("node"), F.max("lp").alias("lp"))
    return formats.read_bmap(rows.select(F.concat_ws("\t", F.col("read_id").cast("string"), F.col("pos").cast("string"), F.lit("F"), value.cast("string"), state).alias("line")))


@query(f"WITH {CELLS}, r AS (SELECT read_id, pos, max(lp) AS lp FROM cells GROUP BY ALL) SELECT read_id, arg_max(lp, pos) AS x, count(*) AS x_cells, arg_max(lp + 0.5e0 * pos, pos) AS y, count(*) AS y_cells, arg_max(lp, pos) - arg_max(lp + 0.5e0 * pos, pos) AS diff FROM r GROUP BY read_id")
def bmap_ranking(spark, sf):
    return formats.bmap_ranking(_bmap(spark, sf, 0.0), _bmap(spark, sf, 0.5))


INSPECTED = "t AS (SELECT CAST(l_linenumber AS INT) AS k, 'e' || l_orderkey AS edge, CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey % 4 AS INT) END AS copy_num_true, max(l_quantity) / CAST(64 AS DOUBLE) AS p FROM lineitem GROUP BY ALL)"


def _inspected(spark, sf):
    """E rows of an INSPECT file: k, edge, truth (or ?), mean, probability of the truth and of 0."""
    li = table(spark, sf, "lineitem")
    truth = F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 4).cast("string")).otherwise("?")
    rows = li.groupBy("l_linenumber", "l_orderkey", truth.alias("t")).agg((F.max("l_quantity").cast("double") / 64).cast("string").alias("p"))
    path = folder(spark, "edges.inspect")
    rows.select(F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.lit("E"), F.concat(F.lit("e"), F.col("l_orderkey").cast("string")), "t", "p", F.when(F.col("t") == "?", "?").otherwise(F.col("p")), "p", F.lit("p(0)=0.5"), F.lit("1")).alias("line")).write.text(path)
    return formats.scan_inspect(spark, path)[2]


@query(f"WITH {INSPECTED} SELECT k, edge, copy_num_true, p AS mean, CASE WHEN copy_num_true IS NOT NULL THEN p END AS p_true, p AS p_zero, 'p(0)=0.5' AS dist FROM t")
def inspect_edges(spark, sf):
    return _inspected(spark, sf)


@query(f"WITH {INSPECTED} SELECT k, copy_num_true, round(avg(p), 9) AS p_zero, CASE WHEN copy_num_true IS NOT NULL THEN round(avg(p), 9) END AS p_true, count(*) AS edges FROM t GROUP BY k, copy_num_true")
def inspect_by_truth(spark, sf):
    got = formats.edges_by_truth(_inspected(spark, sf))
    return got.select("k", "copy_num_true", F.round("p_zero", 9).alias("p_zero"), F.round("p_true", 9).alias("p_true"), "edges")


@query(f"WITH {INSPECTED} SELECT k, edge, copy_num_true, p AS mean, p AS p_true, p AS p_zero, 'p(0)=0.5' AS dist FROM t WHERE copy_num_true > 0 AND p > 0.75")
def inspect_missed(spark, sf):
    return formats.false_positives(_inspected(spark, sf), 0.75)
