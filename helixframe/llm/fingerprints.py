"""Document fingerprints: canonical exact digest (native).

Canonical form: NFKC, full Unicode case folding, NFKC again, runs of Unicode white space as one blank, ends
trimmed. ICU ships with Spark and is called by Spark SQL's java_method. The digest is two xxhash64 values of
the canonical UTF-8 bytes under different seeds (128 bits). Documents are grouped by it, and inside a group the
canonical bytes are compared: a group that holds different bytes gets a number appended for each, in byte order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import cut, only, read, rest

#: Most buckets of neighbours by id; each is sorted in one task, with spilling.
MAX_BUCKETS = 10_000
BUCKET_ROWS = 4096


def canonical(text: Column) -> Column:
    """Canonical form of a string column; null counts as the empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(t), F.lit(True))
    # ASCII text is its own normal form, and its case folding is lower()
    wide = F.when(t.rlike(r"[^\x00-\x7F]"), nfkc(fold)).otherwise(F.lower(t))
    return F.trim(F.regexp_replace(wide, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def digest(canon: Column) -> Column:
    """32 lowercase hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), canon)), 16, "0")))


def collisions(docs: DataFrame, text: str = "text") -> DataFrame | None:
    """Canonical texts that share a digest with different bytes: (_fp, _canon, _i); None if there are none.

    Copies are folded by map-side min and max before the shuffle, so that a hot group costs one row a task.
    """
    keyed = docs.select(canonical(F.col(f"`{text}`")).alias("_canon")).select("_canon", digest(F.col("_canon")).alias("_fp"))
    seen = cut(keyed.groupBy("_fp").agg(F.min("_canon").alias("lo"), F.max("_canon").alias("hi")).where("lo <> hi").select("_fp"))
    if seen.isEmpty():
        return None
    odd = keyed.join(seen, "_fp", "left_semi").distinct()
    return odd.withColumn("_i", F.row_number().over(Window.partitionBy("_fp").orderBy("_canon")))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``fingerprint``; null text counts as empty, an empty table gives no rows, repeated rows stay. An input
    column of that name gives way to it.

    Equal canonical texts have equal fingerprints and different ones different fingerprints, as the bytes are
    compared inside each bucket.
    """
    keyed = docs.select(rest(docs, "fingerprint"), canonical(F.col(f"`{text}`")).alias("_canon")).withColumn("_fp", digest(F.col("_canon")))
    return _named(keyed, collisions(docs, text)).select("r.*", "fingerprint").drop("_")


def _named(keyed: DataFrame, odd: DataFrame | None) -> DataFrame:
    if odd is None:
        return keyed.withColumnRenamed("_fp", "fingerprint")
    out = keyed.join(odd, ["_fp", "_canon"], "left")
    return out.withColumn("fingerprint", F.concat("_fp", F.coalesce(F.concat(F.lit("-"), F.col("_i").cast("string")), F.lit("")))).drop("_fp", "_i")


def with_next(docs: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """docs with the value of the row that follows by key (after the last: the first), without one sorted task.

    Rows go to buckets between quantiles of the key, a window finds the next row in the bucket, and the first
    row of each bucket serves the last row of the bucket before. Ties are ordered by the value; nulls are first.
    """
    n = docs.count()
    parts = min(MAX_BUCKETS, max(1, n // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    a = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    size = len(set(cuts or []))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))]).cast("array<int>")
    search = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= size) & (F.try_element_at(a, at + s) < F.col(key)), at + s).otherwise(at))
    docs = docs.withColumn("_b", F.coalesce(search, F.lit(0)))
    firsts = cut(docs.groupBy("_b").agg(F.min(F.struct(F.col(key), F.col(value))).alias("f")))
    order = Window.orderBy("_b")  # one row for each bucket, MAX_BUCKETS at most
    firsts = firsts.select("_b", F.coalesce(F.lead("f").over(order), F.first("f").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_nf"))
    w = Window.partitionBy("_b").orderBy(F.asc_nulls_first(key), F.asc_nulls_first(value))
    b = docs.withColumn("_in", F.lead(F.struct(F.col(value))).over(w)).join(F.broadcast(firsts), "_b")
    return b.withColumn(out, F.when(F.col("_in").isNull(), F.col(f"_nf.{value}")).otherwise(F.col(f"_in.{value}"))).drop("_b", "_in", "_nf")


def op3_exact_digest(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and of an edited text of it, and the likeness of the two (1 or 0)."""
    docs = only(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    odd = collisions(docs)
    rows = with_next(docs, "doc_id", "text", "next").withColumn("_q", F.expr("cast(length(text) div 4 as int)"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, length(text) - _q), left(next, _q))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("_canon"), canonical(F.col("edited")).alias("_ec"), canonical(F.col("next")).alias("_nc"))
    rows = rows.withColumn("_fp", digest(F.col("_canon"))).withColumn("edited_fingerprint", digest(F.col("_ec"))).withColumn("near_edited", (F.col("_canon") == F.col("_ec")).cast("double")).withColumn("near_next", (F.col("_canon") == F.col("_nc")).cast("double"))
    if odd is not None:
        e = odd.select(F.col("_fp").alias("edited_fingerprint"), F.col("_canon").alias("_ec"), F.col("_i").alias("_e"))
        rows = rows.join(e, ["edited_fingerprint", "_ec"], "left").withColumn("edited_fingerprint", F.concat("edited_fingerprint", F.coalesce(F.concat(F.lit("-"), F.col("_e").cast("string")), F.lit(""))))
    return _named(rows, odd).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
