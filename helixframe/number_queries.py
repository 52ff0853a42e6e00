"""Queries for probabilities, histograms, alignments and coverage over the shared tables, and the same in SQL."""

from pyspark.sql import functions as F

from helixframe.format_queries import folder
from helixframe.functions import probability as P
from helixframe.operators import compare, simulate
from helixframe.queries import query, reads, table

# ---- probabilities


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS a, CAST(l_tax AS DOUBLE) + 0.01e0 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a = 0 AS is_zero, b = 1 AS is_one, round(a + b, 9) AS total, round(a * b, 9) AS product, round(a / b, 9) AS ratio, round(a * 3, 9) AS thrice, round(a / 3, 9) AS third, round(abs(a - b), 9) AS apart, CASE WHEN a = 0 THEN false ELSE abs(ln(a) - ln(b)) < 0.5e0 END AS near, round(ln(b), 9) AS text_lp FROM t""")
def prob_arithmetic(spark, sf):
    """Logarithms of probabilities: sums, products, ratios, counts, differences and their text form."""
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.p(F.col("l_discount").cast("double")).alias("a"), P.p(F.col("l_tax").cast("double") + 0.01).alias("b"))
    value = lambda lp, name: F.round(P.to_value(lp), 9).alias(name)
    return t.select(
        "l_orderkey", "l_linenumber", P.is_zero("a").alias("is_zero"), P.is_one("b").alias("is_one"), value(P.add("a", "b"), "total"), value(P.mul("a", "b"), "product"), value(P.div("a", "b"), "ratio"), value(P.mul_int("a", 3), "thrice"), value(P.div_int("a", 3), "third"),
        F.round(P.diff("a", "b"), 9).alias("apart"), (P.log_diff("a", "b") < 0.5).alias("near"), F.round(P.parse(P.fmt(P.non_nan("b"))), 9).alias("text_lp"),
    )


@query("SELECT DISTINCT CAST(l_quantity AS INT) AS n, round(lgamma(CAST(l_quantity AS INT) + 1), 8) AS lf FROM lineitem")
def log_factorials(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("n")).distinct().select("n", F.round(P.log_factorial("n"), 8).alias("lf"))


@query("SELECT value, CAST(count(*) AS BIGINT) AS count FROM (SELECT CAST(l_linenumber AS BIGINT) AS value FROM lineitem UNION ALL SELECT CAST(l_suppkey % 11 AS BIGINT) FROM lineitem) GROUP BY value")
def histogram_sum(spark, sf):
    li = table(spark, sf, "lineitem")
    return P.histogram_add(P.histogram(li.select(F.col("l_linenumber").cast("long").alias("value")), "value"), "value", li.select((F.col("l_suppkey") % 11).cast("long").alias("value")))


@query("SELECT min(l_suppkey) AS lo, max(l_suppkey) AS hi, CAST(count(*) AS BIGINT) AS len FROM lineitem")
def histogram_span(spark, sf):
    return P.histogram_range(P.histogram(table(spark, sf, "lineitem"), "l_suppkey"), "l_suppkey")


# ---- alignments: PAF and SAM files of the order lines

LINES = "a AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS q, CAST(l_suppkey % 40 AS BIGINT) AS s, CAST(l_partkey % 900 AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS n FROM lineitem)"


def _lines(spark, sf):
    c = lambda x, name: x.cast("long").alias(name)
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), c(F.col("l_linenumber"), "q"), c(F.col("l_suppkey") % 40, "s"), c(F.col("l_partkey") % 900, "t"), c(F.col("l_quantity"), "n")).distinct()


def _paf(spark, sf):
    """An alignment for each line: n matches, then a substitution, two inserted and one deleted base."""
    s = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    n = F.col("n")
    line = F.concat_ws(
        "\t", F.concat(F.lit("r"), s("k")), F.lit("500"), s(F.col("q") * 50), s(F.col("q") * 50 + n + 3), F.lit("+"), F.concat(F.lit("g"), s("s")), F.lit("1000"), s("t"), s(F.col("t") + n + 2), s("n"), s(n + 4), F.lit("60"),
        F.concat(F.lit("tp:A:"), F.when(F.col("q") % 2 == 0, "P").otherwise("S")), F.concat(F.lit("NM:i:"), s("q")), F.concat(F.lit("cs:Z::"), s("n"), F.lit("*ag+tt-c")),
    )
    path = folder(spark, "lines.paf")
    _lines(spark, sf).select(line.alias("line")).write.text(path)
    return compare.read_paf(spark, path)


@query(f"WITH {LINES} SELECT 'r' || k AS query, CAST(500 AS BIGINT) AS q_len, q * 50 AS q_start, q * 50 + n + 3 AS q_end, '+' AS strand, 'g' || s AS target, CAST(1000 AS BIGINT) AS t_len, t AS t_start, t + n + 2 AS t_end, n AS matches, n + 4 AS block, CAST(60 AS BIGINT) AS quality, CASE WHEN q % 2 = 0 THEN 'P' ELSE 'S' END AS tp, q AS nm, ':' || n || '*ag+tt-c' AS cs FROM a")
def paf_records(spark, sf):
    return _paf(spark, sf)


@query(f"WITH {LINES}, b AS (SELECT s, t, t + n + 2 AS e, max(t + n + 2) OVER (PARTITION BY s ORDER BY t, t + n + 2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a) SELECT 'g' || s AS target, CAST(sum(greatest(e - greatest(t, coalesce(m, t)), 0)) AS DOUBLE) / 1000 AS recall FROM b GROUP BY s")
def paf_recall(spark, sf):
    return compare.recall(_paf(spark, sf))


@query(f"WITH {LINES} SELECT 'r' || k AS query, CAST(sum(n) AS DOUBLE) / CAST(sum(n + 4) AS DOUBLE) AS identity FROM a GROUP BY k")
def paf_identity(spark, sf):
    return compare.identity(_paf(spark, sf))


@query(f"WITH {LINES} SELECT CAST(sum(q) AS DOUBLE) / CAST(500 * count(*) AS DOUBLE) AS share FROM a WHERE q % 2 = 0")
def paf_mismatch_share(spark, sf):
    return compare.mismatch_share(_paf(spark, sf))


@query(f"WITH {LINES}, u AS (SELECT DISTINCT ON (k, s, q, t) * FROM a ORDER BY k, s, q, t, n) SELECT 'r' || k AS query, 'g' || s AS target, x.kind AS kind, q * 50 + x.dq AS q, t + x.dt AS t, x.n AS n FROM (SELECT k, s, q, t, unnest([{{'kind': '*', 'dq': n, 'dt': n, 'n': CAST(1 AS BIGINT)}}, {{'kind': '+', 'dq': n + 1, 'dt': n + 1, 'n': CAST(2 AS BIGINT)}}, {{'kind': '-', 'dq': n + 3, 'dt': n + 1, 'n': CAST(1 AS BIGINT)}}]) AS x FROM u)")
def paf_differences(spark, sf):
    """Differences of each alignment; of alignments that begin at one place the shortest one."""
    p = _paf(spark, sf)
    first = p.groupBy("query", "target", "q_start", "t_start").agg(F.min_by("cs", "matches").alias("cs"))
    return compare.aligned_pairs(first, ignore_match=True).select("query", "target", "kind", "q", "t", F.col("n").cast("long").alias("n"))


def _sam(spark, sf):
    """A read for each line, as 5 matched bases, 2 inserted ones, 3 that are left out and 10 matched ones."""
    seq = F.concat(F.lit("ACGTA"), F.lit("GG"), F.lit("CATTAGACAT"))
    line = F.concat_ws("\t", F.concat_ws("_", *[F.col(c).cast("string") for c in ("k", "q", "s", "t", "n")]), F.lit("0"), F.lit("g"), (F.col("t") + 1).cast("string"), F.lit("60"), F.lit("5M2I3D10M"), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*"))
    path = folder(spark, "lines.sam")
    _lines(spark, sf).select(line.alias("line")).write.text(path)
    return compare.read_sam(spark, path)


NAMED = f"{LINES}, r AS (SELECT concat_ws('_', k, q, s, t, n) AS name, t AS pos FROM a)"
LIFT = "CASE WHEN {p} < pos + 5 THEN {p} - pos WHEN {p} >= pos + 8 THEN {p} - pos - 1 END"


@query(f"WITH {NAMED} SELECT name, 'g' AS target, x.op AS op, x.n AS n, pos + x.t AS t, x.q AS q FROM (SELECT *, unnest([{{'op': 'M', 'n': 5::BIGINT, 't': 0::BIGINT, 'q': 0::BIGINT}}, {{'op': 'I', 'n': 2::BIGINT, 't': 5::BIGINT, 'q': 5::BIGINT}}, {{'op': 'D', 'n': 3::BIGINT, 't': 5::BIGINT, 'q': 7::BIGINT}}, {{'op': 'M', 'n': 10::BIGINT, 't': 8::BIGINT, 'q': 7::BIGINT}}]) AS x FROM r)")
def sam_blocks(spark, sf):
    return compare.blocks(_sam(spark, sf))


@query(f"WITH {NAMED} SELECT name, {LIFT.format(p=300)} AS q_pos FROM r WHERE pos <= 300 AND pos + 18 > 300")
def sam_lift(spark, sf):
    return compare.lift(_sam(spark, sf), "g", 300)


@query(f"WITH {NAMED}, x AS (SELECT name, pos, CASE WHEN pos + 5 > 300 THEN greatest(300 - pos, 0) ELSE 7 + greatest(300 - pos - 8, 0) END AS a, CASE WHEN pos + 8 < 310 THEN 7 + least(10, 310 - pos - 8) ELSE least(5, 310 - pos) END AS b, (pos < 310 AND pos + 5 > 300) OR (pos + 8 < 310 AND pos + 18 > 300) AS hit FROM r) SELECT name, substr('ACGTAGGCATTAGACAT', a + 1, b - a) AS seq FROM x WHERE hit")
def sam_trim(spark, sf):
    return compare.trim_to_region(_sam(spark, sf), "g", 300, 310)


@query(f"WITH {NAMED} SELECT name, CASE WHEN pos <= 300 AND pos + 18 > 300 THEN {LIFT.format(p=300)} END AS q_start, CASE WHEN pos <= 309 AND pos + 18 > 309 THEN {LIFT.format(p=309)} + 1 END AS q_end FROM r WHERE (pos <= 300 AND pos + 18 > 300) OR (pos <= 309 AND pos + 18 > 309)")
def sam_breakpoints(spark, sf):
    return compare.breakpoints(_sam(spark, sf), "g", 300, 310)


# ---- comparison of sequences, coverage

REFS = "refs AS (SELECT item_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark), strands AS (SELECT CAST(item_id AS VARCHAR) AS name, '+' AS strand, seq FROM refs UNION ALL SELECT CAST(item_id AS VARCHAR), '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM refs)"


def refs(spark, sf):
    return reads(spark, sf, "benchmark", "item_id")


@query(f"WITH {REFS}, w AS (SELECT name, strand, CAST(t.i AS INT) - 1 AS pos, substr(seq, CAST(t.i AS BIGINT), 6) AS kmer FROM strands, generate_series(1, length(seq) - 5) t(i) WHERE length(seq) >= 6) SELECT kmer, string_agg(name || ':' || pos || strand, ',' ORDER BY name, pos, strand) AS places FROM w GROUP BY kmer")
def kmer_places(spark, sf):
    """Places of each k-mer on both strands."""
    got = compare.kmers_with_position(refs(spark, sf).select(F.col("read_id").cast("string").alias("name"), "seq"), 6)
    return got.select("kmer", F.array_join(F.transform("places", lambda p: F.concat(p["name"], F.lit(":"), p["pos"].cast("string"), p["strand"])), ",").alias("places"))


@query(f"WITH {REFS}, w AS (SELECT item_id, CAST(t.i AS INT) - 1 AS pos, substr(seq, CAST(t.i AS BIGINT), 10) AS kmer FROM refs, generate_series(1, length(seq) - 9) t(i) WHERE length(seq) >= 10) SELECT a.pos AS x, b.pos AS y, CAST(count(*) AS BIGINT) AS pairs FROM w a JOIN w b USING (kmer) GROUP BY 1, 2")
def dot_plot(spark, sf):
    return compare.dot_plot(refs(spark, sf), refs(spark, sf), 10).groupBy("x", "y").agg(F.count("*").alias("pairs"))


@query("WITH e AS (SELECT l_partkey AS edge_id, count(*) AS c, count(DISTINCT l_suppkey) + max(l_linenumber) // 3 AS x FROM lineitem GROUP BY l_partkey) SELECT CAST(sign(c - x) AS INT) AS sign, CAST(count(*) AS BIGINT) AS edges, CAST(sum(abs(c - x)) AS BIGINT) AS copies FROM e GROUP BY 1")
def copy_num_errors(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("edge_id"))
    return compare.copy_num_errors(li.agg(F.count("*").alias("copy_num")), li.agg((F.count_distinct("l_suppkey") + F.floor(F.max("l_linenumber") / 3)).alias("copy_num")))


@query(f"WITH {REFS}, own AS (SELECT item_id AS node, seq, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM refs WHERE seq <> '') SELECT node, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN pos < length(seq) // 2 THEN 1 + node % 2 ELSE 1 - node % 2 END AS BIGINT) AS depth FROM own")
def base_coverage(spark, sf):
    """Whole reads of even references; the first half, twice, of odd ones, one of them reversed and turned over again."""
    h = refs(spark, sf).where("seq <> ''").select(F.col("read_id").alias("hap_id"), "seq")
    odd = F.col("hap_id") % 2 == 1
    r = h.select("hap_id", "seq", F.explode(F.when(odd, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("is_revcomp"))
    size = F.when(odd, F.floor(F.length("seq") / 2)).otherwise(F.length("seq")).cast("int")
    at = F.transform(F.filter(F.sequence(F.lit(0), F.length("seq")), lambda i: i < size), lambda i: F.struct(F.col("hap_id").cast("long").alias("node"), i.cast("long").alias("pos")))
    r = r.select(F.col("hap_id").alias("read_id"), "seq", "is_revcomp", F.when(F.col("is_revcomp"), F.reverse(at)).otherwise(at).alias("origins"))
    return simulate.coverage_by_base(simulate.justify_strand(r), h)


@query(f"WITH {REFS} SELECT CAST(sum(length(seq)) AS BIGINT) AS total_bases, CAST(sum(length(seq)) // count(*) AS BIGINT) AS average_length, CAST(sum(length(seq)) AS DOUBLE) / 250 AS coverage FROM refs")
def sample_stats(spark, sf):
    return simulate.read_stats(refs(spark, sf), 250)
