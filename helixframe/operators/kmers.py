"""k-mer tables: from sequences to counted k-mers, and the de Bruijn relation over them.

Frames: ``reads(read_id, seq)``, ``haps(hap_id, style, seq)``, ``kmers(kmer, n)``. Counting is explode + group-by, so
Spark sums on the map side before its one shuffle; neighbour look-ups are equi-joins on (k-1)-mers.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as S
from helixframe.plans.durable import cut

#: Windows of a piece of a sequence: longer ones are cut, so that no row grows with a sequence's length.
CHUNK = 1 << 14

# ---- table functions: sequence to rows


def _windows(s: Column, k: int) -> Column:
    """All k-letter windows of a string; empty if it is shorter (sequence(1, 0) would count down). Sequences are ASCII: a
    slice of bytes is found at once, where a slice of characters counts them from the start of the read."""
    n, b = F.octet_length(s) - k + 1, s.cast("binary")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(b, i, F.lit(k)).cast("string"))).otherwise(F.array().cast("array<string>"))


def fragment_text(seq, k: int) -> Column:
    return S._c(seq)


def linear_text(seq, k: int) -> Column:
    s, pad = S._c(seq), F.lit(S.NULL_BASE * (k - 1))
    return F.when(F.length(s) > 0, F.concat(pad, s, pad)).otherwise(F.lit(""))


def circular_text(seq, k: int) -> Column:
    s = S._c(seq)
    turns = F.repeat(s, F.ceil(F.lit(k) / F.greatest(F.length(s), F.lit(1))).cast("int") + 1)
    return F.when(F.length(s) >= k, F.concat(s, F.left(s, F.lit(k - 1)))).when(F.length(s) > 0, F.substr(turns, F.lit(1), F.length(s) + k - 1)).otherwise(F.lit(""))


def styled_text(seq, style, k: int) -> Column:
    """The string whose windows are the k-mers of a styled sequence."""
    st = S._c(style)
    return F.when(st == "C", circular_text(seq, k)).when(st == "L", linear_text(seq, k)).when(st == "F", fragment_text(seq, k)).otherwise(F.raise_error(F.concat(F.lit("unknown style: "), st)))


def fragment_kmers(seq, k: int) -> Column:
    """k-mers of a fragment; none if it is shorter than k."""
    return _windows(fragment_text(seq, k), k)


def linear_kmers(seq, k: int) -> Column:
    """k-mers of a linear sequence with n before and after. A sequence shorter than k gives mixed k-mers only."""
    return _windows(linear_text(seq, k), k)


def circular_kmers(seq, k: int) -> Column:
    """Exactly as many k-mers as the circle has bases."""
    return _windows(circular_text(seq, k), k)


def styled_kmers(seq, style, k: int) -> Column:
    return _windows(styled_text(seq, style, k), k)


TEXTS = {fragment_kmers: fragment_text, linear_kmers: linear_text, circular_kmers: circular_text}


def windows_of(df: DataFrame, text: Column, k: int, keep: tuple[str, ...] = (), position: bool = False) -> DataFrame:
    """One row for each k-letter window of a text, in time linear in its length: the text is made once (a generator is a
    barrier for the optimizer, which would put it into every window), then cut into pieces of CHUNK windows."""
    made = df.select(*keep, F.explode(F.array(text)).alias("_t")).select(*keep, F.col("_t").cast("binary").alias("_t"))
    n = F.octet_length("_t") - k + 1
    starts = F.when(n >= 1, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(CHUNK)))
    pieces = made.select(*keep, "_t", F.explode(starts).alias("_s")).select(*keep, "_s", F.substr("_t", F.col("_s") + 1, F.lit(CHUNK + k - 1)).cast("string").alias("_w"))
    pieces = pieces.select(*keep, "_s", F.explode(F.array("_w")).alias("_w"))
    if not position:
        return pieces.select(*keep, F.explode(_windows(F.col("_w"), k)).alias("kmer"))
    return pieces.select(*keep, "_s", F.posexplode(_windows(F.col("_w"), k)).alias("_i", "kmer")).select(*keep, (F.col("_s") + F.col("_i")).alias("pos"), "kmer")


def kmer_rows(df: DataFrame, k: int, how=fragment_kmers, seq: str = "seq", keep: tuple[str, ...] = (), position: bool = False) -> DataFrame:
    """One row for each k-mer of each sequence, with its 0-based place if asked for."""
    return windows_of(df, TEXTS[how](seq, k), k, keep, position)


# ---- tables


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "kmer string, n long")


def from_pairs(spark: SparkSession, pairs: list[tuple[str, int]]) -> DataFrame:
    """Table from (k-mer, count) pairs; a later pair replaces an earlier one."""
    return spark.createDataFrame(list(dict(pairs).items()), "kmer string, n long")


def count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kmer").agg(F.count("*").alias("n"))


def from_fragments(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Counts over reads; those shorter than k give nothing, and strands stay apart."""
    return count(kmer_rows(reads, k, fragment_kmers, seq))


def from_linear(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Counts over n-padded linear sequences of at least k bases."""
    return count(kmer_rows(seqs.where(F.length(seq) >= k), k, linear_kmers, seq))


def from_styled(haps: DataFrame, k: int) -> DataFrame:
    """Counts over styled sequences of any length."""
    return count(windows_of(haps, styled_text("seq", "style", k), k))


def set_counts(table: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same k-mer."""
    return table.join(new, "kmer", "left_anti").unionByName(new)


def add_counts(table: DataFrame, more: DataFrame) -> DataFrame:
    return table.unionByName(more).groupBy("kmer").agg(F.sum("n").alias("n"))


def get_counts(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """wanted(kmer) with its count, 0 if absent."""
    return wanted.join(table, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def remove(table: DataFrame, kmers: DataFrame) -> DataFrame:
    return table.join(kmers.select("kmer"), "kmer", "left_anti")


def having(table: DataFrame, kmers: DataFrame) -> DataFrame:
    return table.join(kmers.select("kmer"), "kmer", "left_semi")


def profile(table: DataFrame) -> Column:
    return F.map_from_entries(F.collect_list(F.struct("kmer", "n")))


# ---- de Bruijn relation


def edges(table: DataFrame) -> DataFrame:
    """(kmer, source, target, base, n)."""
    return table.select("kmer", S.prefix("kmer").alias("source"), S.suffix("kmer").alias("target"), S.last("kmer").alias("base"), "n")


def nodes(table: DataFrame) -> DataFrame:
    e = table.select(F.explode(F.array(S.prefix("kmer"), S.suffix("kmer"))).alias("node"))
    return e.distinct()


def _pairs(table: DataFrame, left: Column, right: Column, out: str) -> DataFrame:
    a = table.select(F.col("kmer"), left.alias("_k"))
    b = table.select(F.col("kmer").alias(out), right.alias("_k"))
    return a.join(b, "_k").select("kmer", out)


def successors(table: DataFrame) -> DataFrame:
    return _pairs(table, S.suffix("kmer"), S.prefix("kmer"), "child")


def predecessors(table: DataFrame) -> DataFrame:
    return _pairs(table, S.prefix("kmer"), S.suffix("kmer"), "parent")


def sibling_pairs(table: DataFrame) -> DataFrame:
    """(kmer, sibling): k-mers of the same suffix, the k-mer itself included."""
    return _pairs(table, S.suffix("kmer"), S.suffix("kmer"), "sibling")


def extended(table: DataFrame) -> DataFrame:
    """(kmer, upper): every (k+1)-mer of two adjacent k-mers, and the most copies that it can have."""
    a, b = table.select("kmer", "n"), table.select(F.col("kmer").alias("child"), F.col("n").alias("_n"))
    return successors(table).join(a, "kmer").join(b, "child").select(S.join("kmer", "child").alias("kmer"), F.least("n", "_n").alias("upper"))


def size_stats(table: DataFrame) -> DataFrame:
    """(genome_size, max_copy_num, n_emittable) of the k-mers that end with a base."""
    return table.where(S.is_emittable("kmer")).agg(F.sum("n").alias("genome_size"), F.max("n").alias("max_copy_num"), F.count("*").alias("n_emittable"))


def node_copy_nums(table: DataFrame) -> DataFrame:
    """(node, copy_num): the sum over the k-mers out of each node."""
    return edges(table).groupBy(F.col("source").alias("node")).agg(F.sum("n").alias("copy_num"))


def transitions(table: DataFrame) -> DataFrame:
    """(kmer, child, p): each successor's share of the counts of all successors. The children of a k-mer are those of its
    suffix, so shares are found by suffix before the k-mers meet them."""
    w = Window.partitionBy("_k")
    b = table.select(F.col("kmer").alias("child"), S.prefix("kmer").alias("_k"), "n").select("child", "_k", (F.col("n").cast("double") / F.sum("n").over(w)).alias("p"))
    return table.select("kmer", S.suffix("kmer").alias("_k")).join(b, "_k").select("kmer", "child", "p")


def start_probabilities(table: DataFrame) -> DataFrame:
    """(kmer, p): each k-mer's share of all counts; the sum is one row."""
    return table.crossJoin(F.broadcast(table.agg(F.sum("n").alias("_t")))).select("kmer", (F.col("n").cast("double") / F.col("_t")).alias("p"))


def edges_in(table: DataFrame, node: str) -> DataFrame:
    return table.where(S.suffix("kmer") == node)


def edges_out(table: DataFrame, node: str) -> DataFrame:
    return table.where(S.prefix("kmer") == node)


def degrees(table: DataFrame) -> DataFrame:
    """(node, n_in, n_out, sum_in, sum_out) in one aggregation: each k-mer counts for two nodes."""
    ends = table.select(F.explode(F.array(F.struct(S.prefix("kmer").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("si"), F.col("n").alias("so")), F.struct(S.suffix("kmer").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("n").alias("si"), F.lit(0).cast("long").alias("so")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum("si").alias("sum_in"), F.sum("so").alias("sum_out"))


def degree_stats(table: DataFrame) -> DataFrame:
    return degrees(table).groupBy("n_in", "n_out").agg(F.count("*").alias("nodes"))


def count_stats(table: DataFrame) -> DataFrame:
    return table.groupBy("n").agg(F.count("*").alias("kmers"))


def ambiguous_nodes(table: DataFrame) -> DataFrame:
    """Nodes with more than one way in and more than one way out."""
    return degrees(table).where("n_in > 1 and n_out > 1")


def inconsistent_nodes(table: DataFrame) -> DataFrame:
    """Nodes where the counts in and out differ."""
    return degrees(table).where("sum_in <> sum_out")


def is_consistent(table: DataFrame) -> bool:
    return inconsistent_nodes(table).isEmpty()


def remove_rare(table: DataFrame, least: int) -> DataFrame:
    return table.where(F.col("n") >= least)


def dead_ends(table: DataFrame) -> DataFrame:
    """(kmer, n, no_child, no_parent) of k-mers without a successor or without a predecessor."""
    ins = table.select(S.suffix("kmer").alias("_s")).distinct()
    outs = table.select(S.prefix("kmer").alias("_p")).distinct()
    t = table.join(outs, S.suffix("kmer") == F.col("_p"), "left").join(ins, S.prefix("kmer") == F.col("_s"), "left")
    return t.where(F.col("_p").isNull() | F.col("_s").isNull()).select("kmer", "n", F.col("_p").isNull().alias("no_child"), F.col("_s").isNull().alias("no_parent"))


def remove_dead_ends(table: DataFrame, least: int, max_rounds: int = 10_000) -> tuple[DataFrame, int]:
    """(table, number removed): dead ends with n < least go, then every neighbour that becomes a dead end, whatever its
    count. One round removes a whole frontier; lineage is cut each round."""
    live = cut(table)
    gone = cut(dead_ends(live).where(F.col("n") < least).select("kmer"))
    removed = 0
    for _ in range(max_rounds):
        k = gone.count()
        if not k:
            return live, removed
        removed += k
        live = cut(live.join(gone, "kmer", "left_anti"))
        touched = gone.select(S.suffix("kmer").alias("k"), F.lit(True).alias("down")).unionByName(gone.select(S.prefix("kmer").alias("k"), F.lit(False).alias("down"))).distinct()
        near = live.join(touched, ((S.prefix("kmer") == F.col("k")) & F.col("down")) , "left_semi").unionByName(live.join(touched, (S.suffix("kmer") == F.col("k")) & ~F.col("down"), "left_semi")).distinct()
        gone = cut(dead_ends(live).join(near.select("kmer"), "kmer", "left_semi").select("kmer"))
    raise RuntimeError("dead ends did not settle")


def augment_dead_ends(table: DataFrame) -> DataFrame:
    """Table with n-prefixed k-mers before each k-mer without parent and n-suffixed ones after each without child."""
    d = dead_ends(table)
    start = d.where("no_parent").select(F.explode(S.starting_kmers("kmer")).alias("kmer"), "n")
    end = d.where("no_child").select(F.explode(S.ending_kmers("kmer")).alias("kmer"), "n")
    return add_counts(table.select("kmer", "n"), start.unionByName(end))


def starts_and_ends(haps: DataFrame, k: int) -> DataFrame:
    """(which, kmer, n): first and last k-mers of the linear haplotypes."""
    e = haps.where("style = 'L'").select(F.explode(F.array(F.struct(F.lit("start").alias("which"), F.left("seq", F.lit(k)).alias("kmer")), F.struct(F.lit("end").alias("which"), F.right("seq", F.lit(k)).alias("kmer")))).alias("x")).select("x.*")
    return e.groupBy("which", "kmer").agg(F.count("*").alias("n"))


def true_but_rare(table: DataFrame, haps: DataFrame, k: int, most: int = 1) -> DataFrame:
    """(hap_id, pos, kmer, n): k-mers of the genome, without n, that the table holds at most ``most`` times."""
    t = windows_of(haps, styled_text("seq", "style", k), k, ("hap_id",), position=True).where(~S.has_null("kmer"))
    return t.join(table, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where(F.col("n") <= most).select("hap_id", "pos", "kmer", "n")


def top(table: DataFrame, k: int) -> DataFrame:
    return table.orderBy(F.desc("n"), "kmer").limit(k)


def numbered(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_id, km1mer, is_terminal), edges(edge_id, source, target, base, copy_num, kmer)) with ids in the order of
    the k-mers: numbers are counted by range partition, never in one sorted task. The table is computed once."""
    table = cut(table)
    e = number(edges(table).orderBy("kmer"), "edge_id")
    n = number(nodes(table).orderBy("node"), "node_id")
    ids = n.select("node_id", "node")
    out = e.join(ids.withColumnRenamed("node", "source").withColumnRenamed("node_id", "_s"), "source").join(ids.withColumnRenamed("node", "target").withColumnRenamed("node_id", "_t"), "target")
    return n.select("node_id", F.col("node").alias("km1mer"), S.is_null("node").alias("is_terminal")), out.select("edge_id", F.col("_s").alias("source"), F.col("_t").alias("target"), "base", F.col("n").alias("copy_num"), "kmer")


def number(ordered: DataFrame, name: str) -> DataFrame:
    """Gapless numbers from 0 in the order of an ordered frame: place in the partition plus the sizes before it."""
    rows = cut(ordered.withColumn("_u", F.monotonically_increasing_id()))
    part = F.shiftright("_u", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a partition
    return rows.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_u").bitwiseAND((1 << 33) - 1)).drop("_p", "_b", "_u")
