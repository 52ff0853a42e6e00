"""Comparison of assemblies: k-mers of two sets, alignments (PAF, SAM, cs strings), lifting, trimming, dot plots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.functions import sequence as S
from helixframe.operators import kmers as K

#: Pieces of a cs string whose places are summed up in one row, at most.
SHORT = 1024


def kmers_with_position(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, places): every k-mer on both strands with (name, pos, strand)."""
    a = seqs.select("name", F.posexplode(K.fragment_kmers("seq", k)).alias("pos", "kmer"), F.lit("+").alias("strand"))
    b = seqs.select("name", F.posexplode(K.fragment_kmers(S.revcomp("seq"), k)).alias("pos", "kmer"), F.lit("-").alias("strand"))
    return a.unionByName(b).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("name", "pos", "strand"))).alias("places"))


def disjoint(ref: DataFrame, asm: DataFrame) -> tuple[DataFrame, DataFrame]:
    return K.remove(ref, asm), K.remove(asm, ref)


def unique_in_ref(ref: DataFrame, asm: DataFrame) -> DataFrame:
    u = ref.where("n = 1").join(asm.select("kmer", F.lit(1).alias("hit")), "kmer", "left")
    return u.agg(F.count("*").alias("unique"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


def same_counts(ref: DataFrame, asm: DataFrame) -> DataFrame:
    b = ref.join(asm.withColumnRenamed("n", "m"), "kmer", "full_outer")
    return b.groupBy((F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).alias("same")).agg(F.count("*").alias("kmers"))


def kmer_jaccard(ref: DataFrame, asm: DataFrame) -> DataFrame:
    """(jaccard) of two sets of k-mers, in one shuffle of both."""
    both = ref.select("kmer", F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(asm.select("kmer", F.lit(0).alias("r"), F.lit(1).alias("a"))).groupBy("kmer").agg(F.max("r").alias("r"), F.max("a").alias("a"))
    return both.agg((F.sum(F.col("r") * F.col("a")).cast("double") / F.count("*")).alias("jaccard"))


def dot_plot(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(x, y): places of equal k-mers of two sequences."""
    x = a.select(F.posexplode(K.fragment_kmers("seq", k)).alias("x", "kmer"))
    y = b.select(F.posexplode(K.fragment_kmers("seq", k)).alias("y", "kmer"))
    return x.join(y, "kmer").select("x", "y")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("f"), "value")
    n = lambda i: F.col("f")[i].cast("long")
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:[AifZ]:([^\t]*)", 1)
    return f.select(F.col("f")[0].alias("query"), n(1).alias("q_len"), n(2).alias("q_start"), n(3).alias("q_end"), F.col("f")[4].alias("strand"), F.col("f")[5].alias("target"), n(6).alias("t_len"), n(7).alias("t_start"), n(8).alias("t_end"), n(9).alias("matches"), n(10).alias("block"), n(11).alias("quality"), F.nullif(tag("tp"), F.lit("")).alias("tp"), tag("NM").cast("long").alias("nm"), F.nullif(tag("cs"), F.lit("")).alias("cs"))


def covered(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, bases): bases that intervals cover, overlaps once: gaps and islands by a running maximum of the ends."""
    w = Window.partitionBy(key).orderBy(start, end)
    s = spans.withColumn("_m", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return s.groupBy(key).agg(F.sum(F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_m", F.col(start))), F.lit(0))).alias("bases"))


def recall(paf: DataFrame) -> DataFrame:
    """Share of each target that alignments cover."""
    c = covered(paf, "target", "t_start", "t_end")
    return c.join(paf.groupBy("target").agg(F.max("t_len").alias("t_len")), "target").select("target", (F.col("bases") / F.col("t_len")).alias("recall"))


def identity(paf: DataFrame) -> DataFrame:
    return paf.groupBy("query").agg((F.sum("matches") / F.sum("block")).alias("identity"))


def mismatch_share(paf: DataFrame) -> DataFrame:
    """Differences over query bases of the primary records."""
    return paf.where("tp = 'P'").agg((F.sum("nm") / F.sum("q_len")).alias("share"))


def cigar_steps(cigar) -> Column:
    """array of (n, op) of a CIGAR string."""
    return F.transform(F.regexp_extract_all(S._c(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda s: F.struct(F.regexp_extract(s, r"(\d+)", 1).cast("long").alias("n"), F.right(s, F.lit(1)).alias("op")))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).where("value <> '' and not startswith(value, '@')").select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("target"), (F.col("f")[3].cast("long") - 1).alias("pos"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"))


def blocks(sam: DataFrame) -> DataFrame:
    """(name, target, op, n, t, q): every CIGAR step with its start on the target and on the read."""
    s = sam.select("name", "target", "pos", F.posexplode(cigar_steps("cigar")).alias("i", "x")).select("name", "target", "pos", "i", F.col("x.n").alias("n"), F.col("x.op").alias("op"))
    w = Window.partitionBy("name", "target", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = F.when(F.col("op").isin("M", "D", "N", "=", "X"), F.col("n")).otherwise(0)
    q = F.when(F.col("op").isin("M", "I", "S", "=", "X"), F.col("n")).otherwise(0)
    return s.select("name", "target", "op", "n", (F.col("pos") + F.coalesce(F.sum(t).over(w), F.lit(0))).alias("t"), F.coalesce(F.sum(q).over(w), F.lit(0)).alias("q"))


def lift(sam: DataFrame, target: str, pos: int) -> DataFrame:
    """(name, q_pos): the place on each read of a place on the target; null where it is deleted."""
    b = blocks(sam).where((F.col("target") == target) & F.col("op").isin("M", "D", "N", "=", "X") & (F.col("t") <= pos) & (F.col("t") + F.col("n") > pos))
    return b.select("name", F.when(F.col("op").isin("M", "=", "X"), F.col("q") + F.lit(pos) - F.col("t")).alias("q_pos"))


def trim_to_region(sam: DataFrame, target: str, start: int, end: int) -> DataFrame:
    """(name, seq): the part of each read over [start, end) of the target."""
    b = blocks(sam).where((F.col("target") == target) & F.col("op").isin("M", "=", "X") & (F.col("t") < end) & (F.col("t") + F.col("n") > start))
    lo = F.min(F.col("q") + F.greatest(F.lit(start) - F.col("t"), F.lit(0)))
    hi = F.max(F.col("q") + F.least(F.col("n"), F.lit(end) - F.col("t")))
    return b.groupBy("name").agg(lo.alias("a"), hi.alias("b")).join(sam.select("name", "seq"), "name").select("name", F.substr("seq", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("seq"))


def breakpoints(sam: DataFrame, target: str, start: int, end: int) -> DataFrame:
    """(name, q_start, q_end): where each query enters and leaves a region."""
    a = lift(sam, target, start).withColumnRenamed("q_pos", "q_start")
    b = lift(sam, target, end - 1).select("name", (F.col("q_pos") + 1).alias("q_end"))
    return a.join(b, "name", "full_outer")


def cs_steps(cs) -> Column:
    """array of pieces of a cs string, the delimiter kept."""
    return F.regexp_extract_all(S._c(cs), F.lit(r"([:*+\-=~][^:*+\-=~]*)"), F.lit(1))


def aligned_pairs(paf: DataFrame, ignore_match: bool = False) -> DataFrame:
    """(query, target, kind, q, t, n): runs of matches (:), substitutions (*), insertions (+) and deletions (-)."""
    named = ["query", "target", "q_start", "t_start"]
    rows = paf.where("cs is not null").select(*named, cs_steps("cs").alias("xs"))
    kind = lambda x: F.left(x, F.lit(1))
    n = lambda x: F.when(kind(x) == ":", F.substr(x, F.lit(2)).cast("long")).when(kind(x) == "*", 1).otherwise(F.length(x) - 1)
    # the places of a short alignment are summed up in its row, without a sort; those of a long one by a window
    none = F.struct(F.col("q_start").cast("long").alias("q"), F.col("t_start").cast("long").alias("t"), F.array().cast("array<struct<kind:string,q:bigint,t:bigint,n:bigint>>").alias("out"))

    def step(a, x):
        size = n(x).cast("long")
        one = F.struct(kind(x).alias("kind"), a["q"].alias("q"), a["t"].alias("t"), size.alias("n"))
        return F.struct((a["q"] + F.when(kind(x) != "-", size).otherwise(0)).alias("q"), (a["t"] + F.when(kind(x) != "+", size).otherwise(0)).alias("t"), F.concat(a["out"], F.array(one)).alias("out"))

    short = rows.where(F.size("xs") <= SHORT).select("query", "target", F.explode(F.aggregate("xs", none, step)["out"]).alias("x")).select("query", "target", "x.*")
    s = rows.where(F.size("xs") > SHORT).select(*named, F.posexplode("xs").alias("i", "x"))
    s = s.select(*named, "i", kind(F.col("x")).alias("kind"), n(F.col("x")).cast("long").alias("n"))
    w = Window.partitionBy(*named).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    q = F.sum(F.when(F.col("kind") != "-", F.col("n")).otherwise(0)).over(w)
    t = F.sum(F.when(F.col("kind") != "+", F.col("n")).otherwise(0)).over(w)
    long = s.select("query", "target", "kind", (F.col("q_start") + F.coalesce(q, F.lit(0))).alias("q"), (F.col("t_start") + F.coalesce(t, F.lit(0))).alias("t"), "n")
    out = short.unionByName(long)
    return out.where("kind <> ':'") if ignore_match else out


def join_records(seqs: DataFrame, parts: list[str], name: str) -> DataFrame:
    """One sequence from records named ``id+`` or ``id-`` in order."""
    want = seqs.sparkSession.createDataFrame([(i, p[:-1], p[-1]) for i, p in enumerate(parts)], "i int, name string, strand string")
    s = want.join(seqs, "name").withColumn("seq", F.when(F.col("strand") == "-", S.revcomp("seq")).otherwise(F.col("seq")))
    return s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "seq"))), lambda x: x["seq"]), "").alias("seq")).select(F.lit(name).alias("name"), "seq")


def copy_num_errors(estimate: DataFrame, true: DataFrame) -> DataFrame:
    """Edges over, under and right, from (edge_id, copy_num) frames."""
    b = estimate.join(true.withColumnRenamed("copy_num", "true"), "edge_id")
    return b.groupBy(F.signum(F.col("copy_num") - F.col("true")).cast("int").alias("sign")).agg(F.count("*").alias("edges"), F.sum(F.abs(F.col("copy_num") - F.col("true"))).alias("copies"))


def with_context(segments: DataFrame, links: DataFrame, length: int, rounds: int = 64) -> DataFrame:
    """Segments with the ``length`` bases before them: each round takes bases from the smallest predecessor."""
    from helixframe.plans.durable import cut

    pred = links.where("a_strand = '+' and b_strand = '+'").groupBy(F.col("b").alias("at")).agg(F.min("a").alias("prev"))
    bases = segments.where("strand = '+'").select(F.col("name").alias("prev"), F.col("seq").alias("more"))
    cur = cut(segments.where("strand = '+'").select("name", "seq", F.col("name").alias("at"), F.lit("").alias("ctx")))
    for _ in range(rounds):
        nxt = cut(cur.join(pred, "at", "left").join(bases, "prev", "left").select("name", "seq", F.when(F.length("ctx") >= length, None).otherwise(F.col("prev")).alias("at"), F.when(F.length("ctx") >= length, F.col("ctx")).otherwise(F.concat(F.coalesce("more", F.lit("")), "ctx")).alias("ctx")))
        cur = nxt
        if cur.where("at is not null").isEmpty():
            break
    return cur.select("name", F.concat(F.right("ctx", F.lit(length)), "seq").alias("seq"))
