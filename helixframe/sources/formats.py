"""Graph, path, mapping and posterior files as frames of lines: DBG, PATHS, MAP, GFA, POST, INSPECT, DOT; readers too.

Every writer gives a frame of ordered lines; ``fasta.write_lines`` puts it into a file and ``fasta.text_of`` into a string.
Every reader takes lines (i, line).
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import probability as P
from helixframe.functions import sequence as S
from helixframe.operators import kmers as K
from helixframe.operators.assembly import Assembly
from helixframe.plans.durable import cut
from helixframe.plans.posterior import Posterior, Sample, Score, infos_text, parse_infos, vector

ORDER = ["part", "i"]


def _tab(*cols):
    return F.concat_ws("\t", *[F.lit(c) if isinstance(c, str) and len(c) == 1 else c if not isinstance(c, str) else F.col(c).cast("string") for c in cols])


# ---- DBG


def dbg_lines(g: Assembly) -> DataFrame:
    """K, then N (id, (k-1)-mer) of compact nodes, then E (id, ends, sequence, copies, full edges) of compact edges."""
    c = g.compact_seqs().join(g.compact.select("edge_id", F.array_join(F.transform("edges_in_full", lambda e: e.cast("string")), ",").alias("full")), "edge_id")
    ends = c.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    head = g.spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("i"), F.lit(f"K\t{g.k}").alias("line"))
    n = g.nodes.join(ends, "node_id").select(F.lit(1).alias("part"), F.col("node_id").alias("i"), _tab("N", "node_id", "km1mer").alias("line"))
    e = c.select(F.lit(2).alias("part"), F.col("edge_id").alias("i"), _tab("E", "edge_id", "source", "target", "kmer", "copy_num", "full").alias("line"))
    return head.unionByName(n).unionByName(e)


def read_dbg(lines: DataFrame) -> Assembly:
    """Graph of a DBG file: the k-mers of its edges, with their ids and copy numbers. Lines that begin with # are comments."""
    rows = cut(lines.where("line <> '' and not startswith(line, '#')").select(F.split("line", "\t").alias("f")))
    k = int(rows.where("f[0] = 'K'").first()["f"][1])
    e = rows.where("f[0] = 'E'").select(F.col("f")[1].cast("long").alias("edge_id"), F.col("f")[2].cast("long").alias("source"), F.col("f")[3].cast("long").alias("target"), F.col("f")[4].alias("seq"), F.col("f")[5].cast("long").alias("copy_num"), F.transform(F.split(F.col("f")[6], ","), lambda x: x.cast("long")).alias("edges_in_full"))
    full = e.select("copy_num", F.posexplode(F.arrays_zip("edges_in_full", K.fragment_kmers("seq", k).alias("kmer"))).alias("at", "z")).select(F.col("z.edges_in_full").alias("edge_id"), F.col("z.kmer").alias("kmer"), "copy_num")
    nodes = K.number(full.select(F.explode(F.array(S.prefix("kmer"), S.suffix("kmer"))).alias("km1mer")).distinct().orderBy("km1mer"), "n_id")
    known = rows.where("f[0] = 'N'").select(F.col("f")[1].cast("long").alias("named"), F.col("f")[2].alias("km1mer"))
    top = known.agg(F.coalesce(F.max("named") + 1, F.lit(0))).first()[0]
    nodes = cut(nodes.join(known, "km1mer", "left").select(F.coalesce("named", F.col("n_id") + top).alias("node_id"), "km1mer", S.is_null("km1mer").alias("is_terminal")))
    a = nodes.select(F.col("km1mer").alias("_p"), F.col("node_id").alias("source"))
    b = nodes.select(F.col("km1mer").alias("_s"), F.col("node_id").alias("target"))
    edges = cut(full.join(a, S.prefix("kmer") == F.col("_p")).join(b, S.suffix("kmer") == F.col("_s")).select("edge_id", "source", "target", S.last("kmer").alias("base"), "copy_num", "kmer"))
    return Assembly(k, nodes, edges, cut(e.select("edge_id", "source", "target", "edges_in_full")))


# ---- PATHS, MAP


def paths_lines(paths: DataFrame) -> DataFrame:
    p = paths.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "edge_id"))), lambda s: s["edge_id"].cast("string")), ",").alias("p"))
    return p.select(F.lit(0).alias("part"), F.col("path_id").alias("i"), F.concat(F.lit("P\t"), "p").alias("line"))


def read_paths(lines: DataFrame) -> DataFrame:
    rows = lines.where("startswith(line, 'P')").select("i", F.split(F.split_part("line", F.lit("\t"), F.lit(2)), ",").alias("p"))
    rows = K.number(rows.orderBy("i"), "path_id")
    return rows.select("path_id", F.posexplode("p").alias("i", "e")).select("path_id", "i", F.col("e").cast("long").alias("edge_id"))


def map_lines(mappings: DataFrame, reads: DataFrame) -> DataFrame:
    """read, pos, base, node:lp list, best first."""
    m = mappings.groupBy("read_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("lp")).alias("a"), "node", "lp"))), lambda s: F.concat_ws(":", s["node"].cast("string"), s["lp"].cast("string"))), ",").alias("t"))
    m = m.join(reads.select("read_id", "seq"), "read_id")
    base = F.substr("seq", F.col("pos") + 1, F.lit(1))
    return m.select(F.lit(0).alias("part"), F.struct("read_id", "pos").alias("i"), F.concat_ws("\t", F.col("read_id").cast("string"), F.col("pos").cast("string"), base, "t").alias("line"))


def read_map(lines: DataFrame) -> DataFrame:
    rows = lines.where("line <> '' and not startswith(line, '#')").select(F.split("line", "\t").alias("f"))
    rows = rows.select(F.col("f")[0].cast("long").alias("read_id"), F.col("f")[1].cast("int").alias("pos"), F.explode(F.split(F.col("f")[3], ",")).alias("x"))
    return rows.where("x <> ''").select("read_id", "pos", F.split_part("x", F.lit(":"), F.lit(1)).cast("long").alias("node"), F.split_part("x", F.lit(":"), F.lit(2)).cast("double").alias("lp"))


def map_jaccards(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of the candidates of two mappings at each base."""
    f = lambda m, n: m.groupBy("read_id", "pos").agg(F.collect_set("node").alias(n))
    return f(a, "x").join(f(b, "y"), ["read_id", "pos"]).select("read_id", "pos", S.jaccard("x", "y").alias("jaccard"))


def map_to_compact(mappings: DataFrame, g: Assembly) -> DataFrame:
    return mappings.join(g.full_to_compact(), mappings["node"] == F.col("full")).select("read_id", "pos", "compact", F.col("i").alias("offset"), "lp")


# ---- GFA


def gfa_lines(g: Assembly, label=None, colour=None) -> DataFrame:
    """S for each compact edge with copies, length, label and colour; L for each way through a node that is not the
    terminal. A graph without a terminal has no L lines."""
    c = g.compact_seqs()
    label = F.col("seq") if label is None else label
    colour = F.lit("#000000") if colour is None else colour
    s = c.select(F.lit(0).alias("part"), F.struct("edge_id", F.lit(0).cast("long").alias("b")).alias("i"), F.concat(F.lit("S\t"), F.col("edge_id").cast("string"), F.lit("\t"), "seq", F.lit("\tDP:f:"), F.col("copy_num").cast("string"), F.lit("\tLN:i:"), F.length("seq").cast("string"), F.lit("\tLB:Z:"), label, F.lit("\tCL:Z:"), colour).alias("line"))
    if g.terminal() is None:
        return s
    t = g.nodes.where("is_terminal").select(F.col("node_id").alias("node"))
    a = g.compact.select(F.col("edge_id").alias("a"), F.col("target").alias("node"))
    b = g.compact.select(F.col("edge_id").alias("b"), F.col("source").alias("node"))
    link = a.join(b, "node").join(t, "node", "left_anti")
    return s.unionByName(link.select(F.lit(1).alias("part"), F.struct(F.col("a").alias("edge_id"), "b").alias("i"), F.concat_ws("\t", F.lit("L"), F.col("a").cast("string"), F.lit("+"), F.col("b").cast("string"), F.lit("+"), F.lit("0M"), F.concat(F.lit("ID:Z:"), F.col("node").cast("string"))).alias("line")))


def gfa_posterior_lines(g: Assembly, post: Posterior, true: dict[int, int] | None = None) -> DataFrame:
    """GFA labelled with the mean, the truth and the distribution; redder the more the mean is above the copies, bluer
    below."""
    rows = []
    for e, _, _ in g.local():
        d = post.edge_distribution(e)
        mean = sum(x * p for x, p in d.items())
        t = "?" if true is None else true[e]
        off = max(-1.0, min(1.0, mean - g.facts("copies")[e]))
        rows.append((e, f"{mean:.3f}x {t}x ({','.join(f'p({x})={p:.3f}' for x, p in d.items())})", f"#{int(255 * max(off, 0)):02x}00{int(255 * max(-off, 0)):02x}"))
    return gfa_marked_lines(g, g.spark.createDataFrame(rows, "edge_id long, label string, colour string"))


def gfa_marked_lines(g: Assembly, marks: DataFrame) -> DataFrame:
    """GFA of the segments that marks(edge_id, label, colour) names, so marked, and of all links."""
    base = gfa_lines(g, F.lit(""), F.lit(""))
    fixed = base.where("part = 0").withColumn("edge_id", F.col("i.edge_id")).join(marks, "edge_id").select("part", "i", F.concat(F.regexp_extract("line", r"^(.*)\tLB:Z:\tCL:Z:$", 1), F.lit("\tLB:Z:"), "label", F.lit("\tCL:Z:"), "colour").alias("line"))
    return fixed.unionByName(base.where("part = 1"))


def raw_gfa_lines(table: DataFrame, k: int, haps: DataFrame | None = None) -> DataFrame:
    """GFA of raw counts: mean and all counts of each simple path, true counts if the genome is given; red if a true
    k-mer has a count of at most 1."""
    g = Assembly.from_kmers(table, k, ignore_copy_nums=True)
    e = g.full_to_compact().join(g.edges.select(F.col("edge_id").alias("full"), "kmer", "base", "copy_num"), "full")
    if haps is not None:
        e = e.join(K.from_styled(haps, k).withColumnRenamed("n", "true"), "kmer", "left").withColumn("true", F.coalesce("true", F.lit(0).cast("long")))
    else:
        e = e.withColumn("true", F.lit(None).cast("long"))
    x = e.groupBy("compact").agg(F.array_sort(F.collect_list(F.struct("i", "base", "copy_num", "true"))).alias("x"), F.avg("copy_num").alias("mean"), F.max((F.col("true") > 0) & (F.col("copy_num") <= 1)).alias("lost"))
    part = lambda name: F.array_join(F.transform("x", lambda s: s[name].cast("string")), "," if name != "base" else "")
    line = F.concat(F.lit("S\t"), F.col("compact").cast("string"), F.lit("\t"), part("base"), F.lit("\tDP:f:"), F.round("mean", 3).cast("string"), F.lit("\tLN:i:"), F.size("x").cast("string"), F.lit("\tLB:Z:"), part("copy_num"), F.lit("|"), part("true"), F.lit("\tCL:Z:"), F.when(F.coalesce("lost", F.lit(False)), "#ff0000").otherwise("#000000"))
    s = x.select(F.lit(0).alias("part"), F.struct(F.col("compact").alias("edge_id"), F.lit(0).cast("long").alias("b")).alias("i"), line.alias("line"))
    link = gfa_lines(g).where("part = 1").select("part", "i", F.regexp_replace("line", "\t0M\t", "\t*\t").alias("line"))
    return s.unionByName(link)


def read_gfa(lines: DataFrame, ignore_n: bool = True, ignore_zero: bool = True) -> tuple[DataFrame, DataFrame]:
    """(segments(name, strand, seq, depth), links(a, a_strand, b, b_strand)) on both strands. Segments without a depth
    have a null one and stay."""
    f = lines.select(F.split("line", "\t").alias("f"))
    s = f.where("f[0] = 'S'").select(F.col("f")[1].alias("name"), F.col("f")[2].alias("seq"), F.regexp_extract(F.array_join("f", "\t"), r"DP:f:([0-9.]+)", 1).try_cast("double").alias("depth"))
    s = s.withColumn("seq", F.translate("seq", "n", "")) if ignore_n else s
    s = s.where("seq <> ''") if ignore_n else s
    s = s.where("depth > 0 or depth is null") if ignore_zero else s
    both = s.select("name", F.lit("+").alias("strand"), "seq", "depth").unionByName(s.select("name", F.lit("-").alias("strand"), S.revcomp("seq").alias("seq"), "depth"))
    link = f.where("f[0] = 'L'").select(F.col("f")[1].alias("a"), F.col("f")[2].alias("a_strand"), F.col("f")[3].alias("b"), F.col("f")[4].alias("b_strand"))
    return both, link.unionByName(link.select(F.col("b").alias("a"), F.translate("b_strand", "+-", "-+").alias("a_strand"), F.col("a").alias("b"), F.translate("a_strand", "+-", "-+").alias("b_strand")))


def dot_text(g: Assembly) -> str:
    body = [f'  {s} -> {t} [label="e{e} {g.facts("seqs")[e]} {g.facts("copies")[e]}x"];' for e, s, t in g.local()]
    return "\n".join(["digraph {", *body, "}"])


# ---- POST, INSPECT


def copies_text(sample: Sample) -> str:
    return "[" + ",".join(str(c) for _, c in sample.copies) + "]"


def ranked(post: Posterior) -> list[Sample]:
    return sorted(post.samples.values(), key=lambda s: -s.score.p)


def post_text(post: Posterior) -> str:
    return "\n".join([f"Z\t{post.p()}", *[f"C\t{s.score.p}\t{copies_text(s)}\t{s.score.to_json()}\t{infos_text(list(s.infos))}" for s in ranked(post)]])


def _sample(copies: str, score: str, infos: str, ids: list[int] | None) -> Sample:
    c = [int(x) for x in re.findall(r"\d+", copies)]
    return Sample(vector(dict(zip(ids if ids is not None else range(len(c)), c, strict=True))), Score.from_json(score), tuple(parse_infos(infos)))


def read_post(text: str, ids: list[int] | None = None) -> Posterior:
    """Posterior of a POST file; ids: the compact edges in order. The total comes from the samples again."""
    post = Posterior()
    for line in text.splitlines():
        f = line.split("\t")
        if f[0] == "C":
            post.add(_sample(f[2], f[3], f[4], ids))
    return post


def inspect_text(g: Assembly, post: Posterior, true: dict[int, int] | None = None) -> str:
    """G (graph properties), C (ranked samples) and E (marginals of each edge) rows."""
    k, z = g.k, post.p()
    best = post.max_copy_nums()
    n_true = "?" if true is None else sum(true.values())
    rows = [f"{k}\tG\t{a}\t{b}" for a, b in (("n_edges_full", g.edges.count()), ("n_edges_compact", len(g.local())), ("n_nodes_full", g.nodes.count()), ("n_ambiguous", g.n_ambiguous_nodes()), ("genome_size", g.genome_size()), ("n_samples", len(post.samples)), ("n_copies_true", n_true))]
    for i, s in enumerate(ranked(post)):
        dist = "?" if true is None else sum(abs(s.as_dict()[e] - c) for e, c in true.items())
        x = s.score
        rows.append(f"{k}\tC\t{i}\t{s.score.p - z:.10f}\t{x.likelihood:.10f}\t{x.prior:.10f}\t{x.n_euler:.10f}\t{x.genome_size}\t{dist}\t{infos_text(list(s.infos))}\t{copies_text(s)}\t{x.to_json()}")
    for e, _, _ in g.local():
        d = post.edge_distribution(e)
        t = None if true is None else true[e]
        rows.append(f"{k}\tE\te{e}\t{'?' if t is None else t}\t{sum(a * p for a, p in d.items()):.5f}\t{'?' if t is None else f'{d.get(t, 0):.5f}'}\t{d.get(0, 0):.5f}\t{','.join(f'p({a})={p:.3f}' for a, p in d.items())}\t{best[e]}")
    return "\n".join(rows)


def read_inspect(text: str, k: int, ids: list[int] | None = None) -> Posterior | None:
    """Posterior of the C rows; None if there are none; every k must be the graph's."""
    post = Posterior()
    for line in text.splitlines():
        f = line.split("\t")
        if line.startswith("#") or len(f) < 2:
            continue
        if int(f[0]) != k:
            raise ValueError(f"k is {f[0]}, not {k}")
        if f[1] == "C":
            post.add(_sample(f[10], f[11], f[9], ids))
    return post if post.samples else None


def scan_inspect(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(G, C, E) frames of one or many INSPECT files; ? becomes null."""
    f = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    v = lambda i, kind: F.when(F.col("f")[i] != "?", F.col("f")[i]).cast(kind)
    k = F.col("f")[0].cast("int").alias("k")
    g = f.where("f[1] = 'G'").select(k, F.col("f")[2].alias("key"), F.col("f")[3].alias("value"))
    c = f.where("f[1] = 'C'").select(k, v(2, "int").alias("rank"), v(3, "double").alias("p_lp"), v(4, "double").alias("likelihood"), v(5, "double").alias("prior"), v(6, "double").alias("n_euler"), v(7, "long").alias("genome_size"), v(8, "int").alias("dist"), F.col("f")[9].alias("infos"), F.col("f")[10].alias("copy_nums"))
    e = f.where("f[1] = 'E'").select(k, F.col("f")[2].alias("edge"), v(3, "int").alias("copy_num_true"), v(4, "double").alias("mean"), v(5, "double").alias("p_true"), v(6, "double").alias("p_zero"), F.col("f")[7].alias("dist"))
    return g, c, e


def posterior_by_k(c: DataFrame) -> DataFrame:
    """Mass, samples and mean size by k, the truth and the rest apart."""
    return c.groupBy("k", (F.col("dist") == 0).alias("is_true")).agg(F.sum(F.exp("p_lp")).alias("p"), F.count("*").alias("samples"), F.avg("genome_size").alias("genome_size"), F.max("likelihood").alias("likelihood"), F.max("prior").alias("prior"))


def edges_by_truth(e: DataFrame) -> DataFrame:
    return e.groupBy("k", "copy_num_true").agg(F.avg("p_zero").alias("p_zero"), F.avg("p_true").alias("p_true"), F.count("*").alias("edges"))


def false_positives(e: DataFrame, most: float = 0.8) -> DataFrame:
    """True edges that the posterior calls absent."""
    return e.where((F.col("copy_num_true") > 0) & (F.col("p_zero") > most))


# ---- BMAP


def read_bmap(lines: DataFrame) -> DataFrame:
    """(read_id, pos, kind, value, nodes) of rows read, pos, F / B / S, value, state list."""
    f = lines.where("line <> '' and not startswith(line, '#')").select(F.split("line", "\t").alias("f"))
    one = lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("state"), F.split_part(s, F.lit(":"), F.lit(2)).cast("double").alias("p"))
    return f.select(F.col("f")[0].cast("long").alias("read_id"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[2].alias("kind"), F.col("f")[3].cast("double").alias("value"), F.transform(F.filter(F.split(F.col("f")[4], ","), lambda s: s != ""), one).alias("states"))


def bmap_ranking(a: DataFrame, b: DataFrame, kind: str = "F") -> DataFrame:
    """Reads by the difference of their last forward (kind F) or first backward (kind B) score in two files."""
    pick = F.max_by if kind == "F" else F.min_by
    f = lambda m, n: m.where(F.col("kind") == kind).groupBy("read_id").agg(pick("value", "pos").alias(n), F.sum(F.size("states")).alias(f"{n}_cells"))
    return f(a, "x").join(f(b, "y"), "read_id").withColumn("diff", F.col("x") - F.col("y")).orderBy(F.desc("diff"), "read_id")


def bmap_bases(a: DataFrame, b: DataFrame, read_id: int, kind: str = "S") -> DataFrame:
    """Per base of one read: values and states of both files."""
    f = lambda m, n: m.where((F.col("read_id") == read_id) & (F.col("kind") == kind)).select("pos", F.col("value").alias(n), F.col("states.state").alias(f"{n}_states"))
    return f(a, "x").join(f(b, "y"), "pos", "full_outer").orderBy("pos")
