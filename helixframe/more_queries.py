"""Queries over the shared tables for column functions, k-mer tables and the sequence graph, and the same in SQL."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as S
from helixframe.operators import graph as G
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.queries import COUNTED, KMER, READS, TWO, dbg_scc, query, reads, table, two, unitigs, windows

LINEAR = f"WITH {READS}, padded AS (SELECT read_id, repeat('n', 4) || seq || repeat('n', 4) AS seq FROM reads WHERE length(seq) >= 5), {windows('padded', 5)}, kmers AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM rows GROUP BY kmer)"


def linear(spark, sf):
    return K.from_linear(reads(spark, sf), 5)


# ---- column functions on k-mers


@query(f"""{LINEAR} SELECT kmer, left(kmer, 1) AS first, right(kmer, 1) AS last, right(kmer, 1) AS emission, left(kmer, 4) AS prefix, substr(kmer, 2) AS suffix, translate(kmer, 'ACGT', 'TGCA') AS complement,
NOT regexp_matches(kmer, '[^n]') AS is_null, contains(kmer, 'n') AS has_null, right(kmer, 1) <> 'n' AS is_emittable, left(kmer, 4) = 'nnnn' AS is_head, substr(kmer, 2) = 'nnnn' AS is_tail,
left(kmer, 1) = 'n' AND right(kmer, 1) <> 'n' AS is_left_end, right(kmer, 1) = 'n' AND left(kmer, 1) <> 'n' AS is_right_end, kmer = 'nnnnn' AS is_null_kmer, 5 AS k FROM kmers""")
def kmer_parts(spark, sf):
    k = "kmer"
    return linear(spark, sf).select(
        k, S.first(k).alias("first"), S.last(k).alias("last"), S.emission(k).alias("emission"), S.prefix(k).alias("prefix"), S.suffix(k).alias("suffix"), S.complement(k).alias("complement"), S.is_null(k).alias("is_null"), S.has_null(k).alias("has_null"), S.is_emittable(k).alias("is_emittable"),
        S.is_head(k).alias("is_head"), S.is_tail(k).alias("is_tail"), S.is_left_end(k).alias("is_left_end"), S.is_right_end(k).alias("is_right_end"), (F.col(k) == S.null_kmer(5)).alias("is_null_kmer"), F.length(k).alias("k"),
    )


RELATIVES = {"childs": "substr(kmer, 2) || b", "parents": "b || left(kmer, 4)", "siblings": "b || substr(kmer, 2)", "preds": "b || kmer", "succs": "kmer || b"}


@query(f"{LINEAR}, bases AS (SELECT unnest(['A','C','G','T','n']) AS b) " + " UNION ALL ".join(f"SELECT kmer, '{k}' AS kind, {v} AS other FROM kmers, bases" for k, v in RELATIVES.items())
       + " UNION ALL SELECT kmer, 'same_k', substr(kmer, 2) || b FROM kmers, bases UNION ALL SELECT kmer, 'same_k', b || left(kmer, 4) FROM kmers, bases")
def kmer_relatives(spark, sf):
    kinds = {"childs": S.childs, "parents": S.parents, "siblings": S.siblings, "preds": S.preds, "succs": S.succs, "same_k": S.same_k_neighbors}
    rows = F.explode(F.concat(*[F.arrays_zip(F.array_repeat(F.lit(k), F.size(f("kmer"))).alias("kind"), f("kmer").alias("other")) for k, f in kinds.items()]))
    return linear(spark, sf).select("kmer", rows.alias("x")).select("kmer", "x.kind", "x.other")


@query(f"{LINEAR} SELECT kmer, 'A' || kmer AS before, kmer || 'C' AS after, 'n' || kmer AS head, kmer || 'n' AS tail FROM kmers")
def kmer_extensions(spark, sf):
    return linear(spark, sf).select("kmer", S.extend_first("kmer", "A").alias("before"), S.extend_last("kmer", "C").alias("after"), S.extend_head("kmer").alias("head"), S.extend_tail("kmer").alias("tail"))


@query(f"{LINEAR} SELECT a.kmer, b.kmer AS child, true AS adjacent, a.kmer || right(b.kmer, 1) AS joined, a.kmer || right(b.kmer, 1) AS joined_back, a.kmer || substr(b.kmer, 5) AS overlapped, a.kmer || right(b.kmer, 1) AS spelled, a.kmer || ',' || b.kmer AS listed, '[' || a.kmer || ',' || b.kmer || ']' AS pretty FROM kmers a JOIN kmers b ON substr(a.kmer, 2) = left(b.kmer, 4)")
def kmer_joins(spark, sf):
    both = F.array("kmer", "child")
    return K.successors(linear(spark, sf)).select("kmer", "child", S.adjacent("kmer", "child").alias("adjacent"), S.join("kmer", "child").alias("joined"), F.when(S.adjacent("child", "kmer"), S.join("kmer", "child")).otherwise(S.join("child", "kmer")).alias("joined_back"), S.overlap("kmer", "child", 4).alias("overlapped"), S.concat_overlapping(both).alias("spelled"), S.format_kmers(both).alias("listed"), S.format_kmers(both, True).alias("pretty"))


@query(f"WITH {READS}, f AS (SELECT read_id, left(seq, {KMER}) AS kmer FROM reads WHERE length(seq) >= {KMER}) SELECT read_id, CAST(i AS INT) - 1 AS i, repeat('n', {KMER} - CAST(i AS INT)) || left(kmer, CAST(i AS INT)) AS kmer FROM f, generate_series(1, {KMER - 1}) t(i)")
def starting_kmers_growing(spark, sf):
    r = reads(spark, sf).where(F.length("seq") >= KMER)
    return r.select("read_id", F.posexplode(S.starting_kmers_growing(F.left("seq", F.lit(KMER)))).alias("i", "kmer"))


# ---- column functions on sequences, styles, positions, packed cells


STYLED = f"WITH {READS}, s AS (SELECT read_id, seq, ['C', 'L', 'F'][CAST(read_id % 3 AS INT) + 1] AS style FROM reads WHERE length(seq) >= {KMER})"


@query(f"""{STYLED} SELECT read_id, style, style || ':' || seq AS text, style = 'C' AS circular, style = 'L' AS with_prefix, style IN ('L', 'C') AS with_suffix, style = 'F' AS fragment, style AS parsed_style, seq AS parsed_seq,
CASE WHEN style = 'L' THEN left(seq, {KMER}) END AS start_kmer, CASE WHEN style = 'L' THEN right(seq, {KMER}) END AS end_kmer FROM s""")
def styled_sequences(spark, sf):
    r = reads(spark, sf).where(F.length("seq") >= KMER).withColumn("style", S.parse_style(F.element_at(F.array(F.lit("C"), F.lit("L"), F.lit("F")), (F.col("read_id") % 3).cast("int") + 1)))
    r = r.withColumn("text", S.format_styled("style", "seq")).withColumn("p", S.parse_styled("text"))
    return r.select("read_id", "style", "text", S.is_circular("style").alias("circular"), S.has_prefix("style").alias("with_prefix"), S.has_suffix("style").alias("with_suffix"), S.is_fragment("style").alias("fragment"), F.col("p.style").alias("parsed_style"), F.col("p.seq").alias("parsed_seq"), S.start_kmer("seq", "style", KMER).alias("start_kmer"), S.end_kmer("seq", "style", KMER).alias("end_kmer"))


@query(f"WITH {READS} SELECT read_id, seq AS sanitized, seq AS without_null, seq AS without_n, repeat(seq, 3) AS tandem, array_to_string(list_filter(['A','C','G','T'], lambda x: x <> left(seq, 1)), '') AS others FROM reads WHERE seq <> ''")
def sequence_edits(spark, sf):
    r = reads(spark, sf).where("seq <> ''")
    return r.select("read_id", S.sanitize(F.lower("seq")).alias("sanitized"), S.drop_nulls(F.concat(F.lit("nn"), "seq", F.lit("n"))).alias("without_null"), S.sanitize_assembly(F.concat(F.lit("Nn"), F.lower("seq"))).alias("without_n"), S.tandem_repeat("seq", 3).alias("tandem"), F.array_join(S.different_bases(S.first("seq")), "").alias("others"))


@query("SELECT l_orderkey, l_linenumber, CAST((x >> 6) & 3 AS BIGINT) AS cell, CAST((x & ~(3::BIGINT << 10)) | (2::BIGINT << 10) AS BIGINT) AS changed, CAST(x >> 2 AS BIGINT) AS front, CAST(x * 4 AS BIGINT) AS back FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7919 + l_suppkey AS BIGINT) AS x FROM lineitem)")
def packed_cells(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7919 + F.col("l_suppkey")).cast("long").alias("x"))
    return x.select("l_orderkey", "l_linenumber", S.quad_get("x", 3).cast("long").alias("cell"), S.quad_set("x", 5, 2).alias("changed"), S.quad_shift_front("x").alias("front"), S.quad_shift_back("x").alias("back"))


ORIGINS = """WITH o AS (SELECT l_orderkey, l_linenumber AS i, CASE WHEN l_suppkey % 4 <> 0 THEN l_orderkey % 5 END AS node, CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber * 3 + l_suppkey % 3 END AS pos FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
l AS (SELECT *, last_value(pos IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
t AS (SELECT *, CASE WHEN pos IS NULL THEN 'I' ELSE repeat('D', CAST(greatest(coalesce(pos - before - 1, 0), 0) AS INT)) || 'M' END AS op, CASE WHEN pos IS NULL THEN 'I' ELSE node || '/' || pos END AS one FROM l),
a AS (SELECT l_orderkey, string_agg(op, '' ORDER BY i) AS ops, repeat('A', CAST(count(*) AS INT)) AS seq, string_agg(one, ',' ORDER BY i) AS ones, arg_min(node, i) FILTER (pos IS NOT NULL) AS node, arg_min(pos, i) FILTER (pos IS NOT NULL) AS pos, count(pos) AS matches, arg_min(CASE WHEN pos IS NULL THEN 0 ELSE 1 END, i) = 1 AS head, arg_max(CASE WHEN pos IS NULL THEN 0 ELSE 1 END, i) = 1 AS tail FROM t GROUP BY l_orderkey),
c AS (SELECT *, array_to_string(list_transform(regexp_extract_all(ops, 'D+|M+|I+'), lambda x: CAST(length(x) AS VARCHAR) || left(x, 1)), '') AS cigar FROM a)"""


def _origins(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    li = li.select("l_orderkey", F.col("l_linenumber").alias("i"), F.when(F.col("l_suppkey") % 4 != 0, F.struct((F.col("l_orderkey") % 5).cast("long").alias("node"), (F.col("l_linenumber") * 3 + F.col("l_suppkey") % 3).cast("long").alias("pos"))).alias("o"))
    return li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x["o"]).alias("origins"))


@query(f"""{ORIGINS} SELECT l_orderkey, ops, cigar, CAST(node AS BIGINT) AS node, CAST(pos AS BIGINT) AS pos, head, tail, seq || ':+:' || ones AS text, false AS is_revcomp,
CASE WHEN matches > 0 THEN concat_ws('\t', 'r', '0', 'g' || node, CAST(pos + 1 AS VARCHAR), '255', cigar, '*', '0', '0', seq, '*') END AS sam FROM c""")
def read_origins(spark, sf):
    o = _origins(spark, sf).withColumn("seq", F.repeat(F.lit("A"), F.size("origins"))).withColumn("text", S.format_positioned("seq", F.lit(False), "origins"))
    o = o.withColumn("p", S.parse_positioned("text")).withColumn("back", F.col("p.origins"))
    sam = F.when(S.first_match_origin("back").isNotNull(), S.sam_line(F.lit("r"), "p.seq", "back"))
    return o.select("l_orderkey", S.cigar_ops("back").alias("ops"), S.cigar("back", "p.is_revcomp").alias("cigar"), S.origin_node("back").alias("node"), S.origin_pos("back").alias("pos"), S.is_match(S.head_origin("back")).alias("head"), S.is_match(S.tail_origin("back")).alias("tail"), "text", "p.is_revcomp", sam.alias("sam"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 <> 0 THEN l_partkey || ':' || (l_suppkey % 3) ELSE 'I' END AS text, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_partkey AS BIGINT) END AS node, l_suppkey % 4 <> 0 AND l_suppkey % 3 = 0 AS first_base FROM lineitem")
def base_positions(spark, sf):
    o = F.when(F.col("l_suppkey") % 4 != 0, F.struct(F.col("l_partkey").cast("long").alias("node"), (F.col("l_suppkey") % 3).cast("long").alias("pos")))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.format_position(o).alias("text")).withColumn("o", S.parse_position("text"))
    return li.select("l_orderkey", "l_linenumber", "text", F.col("o.node").alias("node"), S.is_first_base("o").alias("first_base"))


# ---- k-mer tables


@query(f"{TWO} SELECT * FROM ref UNION ALL SELECT * FROM asm WHERE kmer NOT IN (SELECT kmer FROM ref)")
def kmer_set_counts(spark, sf):
    ref, asm = two(spark, sf)
    return K.set_counts(asm, ref)


@query(f"{TWO} SELECT ref.kmer, coalesce(asm.n, 0) AS n FROM ref LEFT JOIN asm ON ref.kmer = asm.kmer")
def kmer_get_counts(spark, sf):
    ref, asm = two(spark, sf)
    return K.get_counts(ref.select("kmer"), asm)


@query(f"{TWO} SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM ref UNION ALL SELECT * FROM asm) GROUP BY kmer")
def kmer_add_counts(spark, sf):
    ref, asm = two(spark, sf)
    return K.add_counts(ref, asm)


@query(f"{TWO} SELECT * FROM asm WHERE kmer IN (SELECT kmer FROM ref)")
def kmer_having(spark, sf):
    ref, asm = two(spark, sf)
    return K.having(asm, ref)


@query(f"{TWO} SELECT kmer, n, CAST((SELECT count(*) FROM ref) AS BIGINT) AS size FROM ref")
def kmer_profile(spark, sf):
    """The table as one map and back, from pairs added to an empty table."""
    ref, _ = two(spark, sf)
    prof = K.add_counts(K.empty(spark), ref).agg(K.profile(ref).alias("m"))
    return prof.select(F.explode("m").alias("kmer", "n"), F.size("m").cast("long").alias("size"))


@query(f"{COUNTED} SELECT 'in' AS way, kmer, n FROM kmers WHERE substr(kmer, 2) = 'TATATAT' UNION ALL SELECT 'out', kmer, n FROM kmers WHERE left(kmer, 7) = 'TATATAT'")
def dbg_edges_of_node(spark, sf):
    t = K.from_fragments(reads(spark, sf), KMER)
    return K.edges_in(t, "TATATAT").select(F.lit("in").alias("way"), "kmer", "n").unionByName(K.edges_out(t, "TATATAT").select(F.lit("out").alias("way"), "kmer", "n"))


@query(f"WITH {READS} SELECT which, kmer, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'start' AS which, left(seq, 6) AS kmer FROM reads WHERE length(seq) >= 6 UNION ALL SELECT 'end', right(seq, 6) FROM reads WHERE length(seq) >= 6) GROUP BY 1, 2")
def haplotype_ends(spark, sf):
    return K.starts_and_ends(reads(spark, sf).where("length(seq) >= 6").select(F.col("read_id").alias("hap_id"), F.lit("L").alias("style"), "seq"), 6)


@query(f"{TWO}, places AS (SELECT r.read_id AS hap_id, CAST(t.i AS INT) - 1 AS pos, substr(r.seq, CAST(t.i AS BIGINT), {KMER}) AS kmer FROM refs r, generate_series(1, length(r.seq) - {KMER - 1}) t(i) WHERE length(r.seq) >= {KMER}) SELECT hap_id, pos, places.kmer, coalesce(asm.n, 0) AS n FROM places LEFT JOIN asm ON places.kmer = asm.kmer WHERE coalesce(asm.n, 0) <= 3")
def true_but_rare(spark, sf):
    haps = reads(spark, sf, "benchmark", "item_id").select(F.col("read_id").alias("hap_id"), F.lit("F").alias("style"), "seq")
    return K.true_but_rare(K.from_fragments(reads(spark, sf), KMER), haps, KMER, 3)




# ---- the sequence graph of the reads, as linear genomes


def numbered_sql(kmers: str, k: int) -> str:
    """Numbered nodes (ids) and edges (e) of a k-mer table."""
    return f"""ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS node_id FROM (SELECT left(kmer, {k - 1}) AS node FROM {kmers} UNION SELECT substr(kmer, 2) FROM {kmers})),
e AS (SELECT row_number() OVER (ORDER BY kmer) - 1 AS edge_id, a.node_id AS source, b.node_id AS target, right(kmer, 1) AS base, n AS copy_num, kmer FROM {kmers} JOIN ids a ON a.node = left(kmer, {k - 1}) JOIN ids b ON b.node = substr(kmer, 2))"""


def walk_sql(k: int) -> str:
    """Simple paths (c) of the numbered edges; every path begins at a node that is not an inner one."""
    return f"""deg AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY node),
inner_nodes AS (SELECT d.node FROM deg d JOIN ids ON ids.node_id = d.node WHERE n_in = 1 AND n_out = 1 AND ids.node <> '{'n' * (k - 1)}' AND d.node NOT IN (SELECT source FROM e WHERE source = target)),
walk AS (SELECT edge_id AS head, source, target, [edge_id] AS path, base AS seq, kmer AS first_kmer, copy_num FROM e WHERE source NOT IN (SELECT node FROM inner_nodes)
UNION ALL SELECT w.head, w.source, e.target, list_append(w.path, e.edge_id), w.seq || e.base, w.first_kmer, w.copy_num FROM walk w JOIN e ON e.source = w.target WHERE w.target IN (SELECT node FROM inner_nodes)),
c AS (SELECT row_number() OVER (ORDER BY list_min(path)) - 1 AS edge_id, source, target, path, seq, left(first_kmer, {k - 1}) || seq AS kmer, copy_num, len(path) AS n_bases FROM walk WHERE target NOT IN (SELECT node FROM inner_nodes))"""


GRAPH = f"{LINEAR}, {numbered_sql('kmers', 5)}"
WALK = f"WITH RECURSIVE {GRAPH.removeprefix('WITH ')}, {walk_sql(5)}"


def graph(spark, sf) -> Assembly:
    return Assembly.from_kmers(linear(spark, sf), 5)


AUGMENTED = f"""{COUNTED}, few AS (SELECT kmer, n FROM kmers WHERE n >= 5), dead AS (SELECT kmer, n, substr(kmer, 2) NOT IN (SELECT left(kmer, {KMER - 1}) FROM few) AS no_child, left(kmer, {KMER - 1}) NOT IN (SELECT substr(kmer, 2) FROM few) AS no_parent FROM few),
more AS (SELECT repeat('n', CAST(i AS INT)) || left(kmer, {KMER} - CAST(i AS INT)) AS kmer, n FROM dead, generate_series(1, {KMER - 1}) t(i) WHERE no_parent UNION ALL SELECT substr(kmer, CAST(i AS INT) + 1) || repeat('n', CAST(i AS INT)), n FROM dead, generate_series(1, {KMER - 1}) t(i) WHERE no_child),
aug AS (SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM few UNION ALL SELECT * FROM more) GROUP BY kmer), {numbered_sql('aug', KMER)}"""


#: Of the component of the end of all linear genomes, which is what it reaches and what reaches it, and of the rest by closure.
query(f"""WITH RECURSIVE {AUGMENTED.removeprefix('WITH ')}, n AS (SELECT DISTINCT source, target FROM e), t AS (SELECT node_id FROM ids WHERE node = '{'n' * (KMER - 1)}'),
fore AS (SELECT node_id AS v FROM t UNION SELECT n.target FROM fore JOIN n ON n.source = fore.v), back AS (SELECT node_id AS v FROM t UNION SELECT n.source FROM back JOIN n ON n.target = back.v), core AS (SELECT v FROM fore INTERSECT SELECT v FROM back),
rest AS (SELECT node_id AS v FROM ids WHERE node_id NOT IN (SELECT v FROM core)), inside AS (SELECT * FROM n WHERE source IN (SELECT v FROM rest) AND target IN (SELECT v FROM rest)),
reach AS (SELECT v AS a, v AS b FROM rest UNION SELECT r.a, i.target FROM reach r JOIN inside i ON r.b = i.source),
scc AS (SELECT x.a AS node, min(x.b) AS scc FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a UNION ALL SELECT v, (SELECT min(v) FROM core) FROM core), m AS (SELECT scc, count(*) AS edges FROM e JOIN scc ON e.target = scc.node GROUP BY scc)
SELECT CAST(s.scc AS BIGINT) AS scc, CAST(count(*) AS BIGINT) AS nodes, CAST(coalesce(any_value(m.edges), 0) AS BIGINT) AS edges FROM scc s LEFT JOIN m ON s.scc = m.scc GROUP BY s.scc""")(dbg_scc)


@query(f"WITH RECURSIVE {AUGMENTED.removeprefix('WITH ')}, {walk_sql(KMER)} SELECT CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, array_to_string(path, ',') AS path FROM c")
def dbg_unitigs(spark, sf):
    """Simple paths of the frequent 8-mers, from one node that is not an inner one to the next. Circles of inner nodes alone
    have no such node and are no rows, as in SQL; ``G.compact`` gives them as loops unless told otherwise."""
    return unitigs(spark, sf).select("source", "target", F.concat_ws(",", F.transform("edges_in_full", lambda x: x.cast("string"))).alias("path"))


@query(f"{GRAPH} SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, base, copy_num, kmer FROM e")
def graph_edges(spark, sf):
    return graph(spark, sf).edges


@query(f"{GRAPH} SELECT CAST(node_id AS BIGINT) AS node_id, node AS km1mer, node = 'nnnn' AS is_terminal FROM ids")
def graph_nodes(spark, sf):
    return graph(spark, sf).nodes


@query(f"{WALK} SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, array_to_string(path, ',') AS path FROM c")
def graph_compact(spark, sf):
    return graph(spark, sf).compact.select("edge_id", "source", "target", F.concat_ws(",", F.transform("edges_in_full", lambda x: x.cast("string"))).alias("path"))


@query(f"{WALK} SELECT CAST(edge_id AS BIGINT) AS edge_id, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, seq, kmer, copy_num, CAST(n_bases AS BIGINT) AS n_bases FROM c")
def graph_compact_seqs(spark, sf):
    return graph(spark, sf).compact_seqs()


@query(f"{WALK} SELECT CAST(unnest(path) AS BIGINT) AS \"full\", CAST(edge_id AS BIGINT) AS compact, CAST(unnest(range(len(path))) AS INT) AS i FROM c")
def graph_full_to_compact(spark, sf):
    return graph(spark, sf).full_to_compact().select("full", "compact", "i")


@query(f"{WALK}, cd AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM c UNION ALL SELECT target, 1, 0 FROM c) GROUP BY node) SELECT CAST(n_in AS BIGINT) AS n_in, CAST(n_out AS BIGINT) AS n_out, CAST(count(*) AS BIGINT) AS nodes FROM cd GROUP BY 1, 2")
def graph_compact_degrees(spark, sf):
    return graph(spark, sf).degree_stats()


@query(f"""{WALK}, cd AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM c UNION ALL SELECT target, 1, 0 FROM c) GROUP BY node), z AS (SELECT node_id FROM ids WHERE node = 'nnnn')
SELECT CAST((SELECT count(*) FROM e WHERE base <> 'n') AS BIGINT) AS n_emittable, CAST((SELECT sum(copy_num) FROM e WHERE base <> 'n') AS BIGINT) AS genome_size, CAST((SELECT max(copy_num) FROM e) AS BIGINT) AS max_copy_num, CAST((SELECT sum(copy_num) FROM e, z WHERE source = node_id) AS BIGINT) AS n_haplotypes,
CAST((SELECT count(*) FROM cd WHERE n_in > 1 AND n_out > 1) AS BIGINT) AS n_ambiguous, CAST((SELECT node_id FROM z) AS BIGINT) AS terminal, true AS valid, CAST((SELECT count(*) FROM e) AS BIGINT) AS kmers, CAST((SELECT count(*) FROM c, z WHERE source = node_id OR target = node_id) AS BIGINT) AS touching, true AS equal""")
def graph_facts(spark, sf):
    g = graph(spark, sf)
    row = (g.n_emittable_edges(), g.genome_size(), g.max_copy_num(), g.n_haplotypes(), g.n_ambiguous_nodes(), g.terminal(), g.is_copy_nums_valid(), g.kmer_set().count(), g.touching_terminal().count(), g.is_equal(g) and g.is_equivalent(g))
    return spark.createDataFrame([row], "n_emittable long, genome_size long, max_copy_num long, n_haplotypes long, n_ambiguous long, terminal long, valid boolean, kmers long, touching long, equal boolean")


@query(f"{GRAPH} SELECT CAST(source AS BIGINT) AS node_id, CAST(sum(copy_num) AS BIGINT) AS copy_num FROM e GROUP BY source")
def graph_node_copy_nums(spark, sf):
    return graph(spark, sf).node_copy_nums()


@query(f"{GRAPH} SELECT 'out' AS way, kmer FROM e WHERE source = 0 UNION ALL SELECT 'in', kmer FROM e WHERE target = 0")
def graph_ways_of_node(spark, sf):
    g = graph(spark, sf)
    return g.ways_out(0).select(F.lit("out").alias("way"), "kmer").unionByName(g.ways_in(0).select(F.lit("in").alias("way"), "kmer"))


AT = ", p AS (SELECT r.read_id AS path_id, CAST(t.i AS INT) - 1 AS i, substr(r.seq, CAST(t.i AS BIGINT), 5) AS kmer FROM padded r, generate_series(1, length(r.seq) - 4) t(i))"


def _haps(spark, sf):
    return reads(spark, sf).where("length(seq) >= 5").select(F.col("read_id").alias("hap_id"), F.lit("L").alias("style"), "seq")


@query(f"{GRAPH}{AT} SELECT path_id, i, CAST(edge_id AS BIGINT) AS edge_id FROM p JOIN e ON p.kmer = e.kmer")
def graph_paths(spark, sf):
    return graph(spark, sf).paths_of(_haps(spark, sf))


@query(f"{WALK}{AT}, h AS (SELECT path_id, i, edge_id FROM p JOIN e ON p.kmer = e.kmer) SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY i) - 1 AS INT) AS i, CAST(c.edge_id AS BIGINT) AS edge_id FROM h JOIN c ON c.path[1] = h.edge_id")
def graph_paths_in_compact(spark, sf):
    g = graph(spark, sf)
    return g.path_in_compact(g.paths_of(_haps(spark, sf)))


@query(f"{GRAPH}{AT} SELECT path_id, i, CAST(edge_id AS BIGINT) AS edge_id FROM p JOIN e ON p.kmer = e.kmer")
def graph_paths_in_full(spark, sf):
    """Paths to compact edges and back."""
    g = graph(spark, sf)
    return g.path_in_full(g.path_in_compact(g.paths_of(_haps(spark, sf))))


@query(f"{WALK} SELECT CAST(edge_id AS BIGINT) AS edge_id, copy_num FROM c")
def graph_copy_nums_of_paths(spark, sf):
    """The reads' own paths use each compact edge as often as its copies."""
    g = graph(spark, sf)
    return g.copy_nums_of_paths(g.paths_of(_haps(spark, sf)))


@query(f"WITH {READS} SELECT read_id AS path_id FROM reads WHERE length(seq) >= 5 AND left(seq, 4) <> right(seq, 4)")
def graph_broken_paths(spark, sf):
    """Reads as fragments close no walk, unless they end with the four bases that they begin with."""
    g = graph(spark, sf)
    return g.broken_paths(g.paths_of(_haps(spark, sf).withColumn("style", F.lit("F"))))


@query(f"{GRAPH} SELECT CAST(a.edge_id AS BIGINT) AS source, CAST(b.edge_id AS BIGINT) AS target FROM e a JOIN e b ON a.target = b.source JOIN ids ON ids.node_id = a.target WHERE ids.node <> 'nnnn'")
def graph_model_edges(spark, sf):
    return graph(spark, sf).hmm_frames()[1]


@query(f"{GRAPH} SELECT DISTINCT a.kmer || b.base AS kmer FROM e a JOIN e b ON a.target = b.source JOIN ids ON ids.node_id = a.target WHERE ids.node <> 'nnnn' UNION SELECT 'n' || kmer FROM e WHERE left(kmer, 4) = 'nnnn' AND base <> 'n' UNION SELECT kmer || 'n' FROM e WHERE right(kmer, 4) = 'nnnn' AND left(kmer, 1) <> 'n'")
def graph_kp1_kmers(spark, sf):
    return graph(spark, sf).kp1_table().select("kmer")


@query(f"{GRAPH} SELECT CAST(a.node_id AS BIGINT) AS node_id, CAST(sum(c) AS BIGINT) AS copies FROM (SELECT target AS node_id, copy_num AS c FROM e) a JOIN ids ON ids.node_id = a.node_id WHERE ids.node <> 'nnnn' GROUP BY a.node_id")
def graph_kp1_copies(spark, sf):
    """Copies of the (k+1)-mers around each node: dealt out, but none lost."""
    g = graph(spark, sf)
    t = g.kp1_table().where(~(F.startswith("kmer", F.lit("nnnnn")) | F.endswith("kmer", F.lit("nnnnn"))))
    mid = t.select(F.substr("kmer", F.lit(2), F.lit(4)).alias("km1mer"), "n").groupBy("km1mer").agg(F.sum("n").alias("copies"))
    return mid.join(g.nodes.where("not is_terminal"), "km1mer").select("node_id", "copies")


# ---- graph operators on a graph of suppliers and parts

NET = "net AS (SELECT CAST(s_suppkey AS BIGINT) AS edge_id, CAST(s_suppkey % 60 AS BIGINT) AS source, CAST((s_suppkey * 37 + s_nationkey) % 60 AS BIGINT) AS target FROM supplier)"
REACH = f"WITH RECURSIVE {NET}, nodes AS (SELECT source AS node FROM net UNION SELECT target FROM net), reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, n.target FROM reach r JOIN net n ON r.b = n.source), scc AS (SELECT x.a AS node, min(x.b) AS scc FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


def net(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("edge_id"), (F.col("s_suppkey") % 60).cast("long").alias("source"), ((F.col("s_suppkey") * 37 + F.col("s_nationkey")) % 60).cast("long").alias("target"))


@query(f"{REACH} SELECT node, scc FROM scc")
def net_strong_components(spark, sf):
    return G.strong_components(net(spark, sf))


@query(f"{REACH}, m AS (SELECT scc, count(*) AS edges FROM net JOIN scc ON net.target = scc.node GROUP BY scc) SELECT s.scc, CAST(count(*) AS BIGINT) AS nodes, CAST(coalesce(any_value(m.edges), 0) AS BIGINT) AS edges FROM scc s LEFT JOIN m ON s.scc = m.scc GROUP BY s.scc")
def net_component_sizes(spark, sf):
    return G.component_sizes(G.strong_components(net(spark, sf)), net(spark, sf))


@query(f"{REACH} SELECT net.edge_id, source, target FROM net JOIN scc a ON a.node = source JOIN scc b ON b.node = target WHERE a.scc <> b.scc")
def net_bridges(spark, sf):
    return G.bridges(net(spark, sf)).select("edge_id", "source", "target")


@query(f"{REACH}, best AS (SELECT scc FROM scc GROUP BY scc ORDER BY count(*) DESC, scc LIMIT 1) SELECT edge_id, source, target FROM net JOIN scc ON scc.node = target WHERE scc.scc IN (SELECT scc FROM best)")
def net_largest_component(spark, sf):
    return G.largest_component(net(spark, sf)).select("edge_id", "source", "target")


@query(f"{REACH}, ring AS (SELECT DISTINCT scc.node FROM scc WHERE scc IN (SELECT scc FROM scc GROUP BY scc HAVING count(*) > 1) OR node IN (SELECT source FROM net WHERE source = target)), fore AS (SELECT DISTINCT r.b AS node FROM reach r JOIN ring ON ring.node = r.a), back AS (SELECT DISTINCT r.a AS node FROM reach r JOIN ring ON ring.node = r.b), alive AS (SELECT node FROM fore INTERSECT SELECT node FROM back) SELECT edge_id, source, target FROM net WHERE source IN (SELECT node FROM alive) AND target IN (SELECT node FROM alive)")
def net_remove_dead_ends(spark, sf):
    """What is left lies on a walk from a circle to a circle."""
    return G.remove_dead_end_nodes(net(spark, sf)).select("edge_id", "source", "target")


@query(f"WITH {NET} SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT source AS node, 0 AS i, 1 AS o FROM net UNION ALL SELECT target, 1, 0 FROM net) GROUP BY node")
def net_degrees(spark, sf):
    return G.degrees(net(spark, sf))


@query(f"WITH {NET} SELECT edge_id, source, target FROM net WHERE source < 30 AND target < 30")
def net_subgraph(spark, sf):
    return G.subgraph(net(spark, sf), spark.range(30).withColumnRenamed("id", "node_id"))


@query(f"WITH {NET} SELECT CAST(i AS BIGINT) AS node_id FROM generate_series(0, 99) t(i) WHERE i IN (SELECT source FROM net UNION SELECT target FROM net)")
def net_joined_nodes(spark, sf):
    return G.isolated_nodes_removed(spark.range(100).withColumnRenamed("id", "node_id"), net(spark, sf))


@query(f"WITH {NET} SELECT a.edge_id AS a, b.edge_id AS b, a.target AS node FROM net a JOIN net b ON a.target = b.source")
def net_line_graph(spark, sf):
    return G.line_graph(net(spark, sf))


@query(f"WITH {NET} SELECT edge_id, CASE WHEN source = 7 THEN 1007 ELSE source END AS source, target FROM net UNION ALL SELECT -1, 7, 1007")
def net_split_node(spark, sf):
    return G.split_node(net(spark, sf), 7, 1007, F.struct(F.lit(-1).cast("long").alias("edge_id"), F.lit(7).cast("long").alias("source"), F.lit(1007).cast("long").alias("target"))).select("edge_id", F.col("source").cast("long").alias("source"), "target")


@query(f"WITH {NET} SELECT edge_id AS old_id, CASE WHEN edge_id % 3 <> 0 AND edge_id % 5 <> 0 THEN edge_id END AS new_id FROM net")
def net_purge(spark, sf):
    """Two deletions, one after the other, as one map."""
    n = net(spark, sf)
    left, one = G.purge(n, n.where("edge_id % 3 = 0"))
    return G.compose(one, G.purge(left, left.where("edge_id % 5 = 0"))[1])


@query(f"WITH {NET} SELECT CAST(row_number() OVER (ORDER BY source, target) AS BIGINT) AS i, arg_min(edge_id, (edge_id * 7) % 11 * 100000 + edge_id) AS edge_id FROM net GROUP BY source, target")
def net_cheapest_parallel(spark, sf):
    n = net(spark, sf).withColumn("cost", F.col("edge_id") * 7 % 11)
    path = n.select("source", "target").distinct().withColumn("i", F.row_number().over(Window.orderBy("source", "target")).cast("long"))
    return G.node_path_to_edges(path, n, "cost")
