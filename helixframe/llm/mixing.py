"""Mixing sources to target weights by a low-discrepancy schedule.

All sources' targets are cut into blocks of one number of words, such that there are about ``SLOTS`` of them. Slot t gets
the golden-ratio point frac(t * phi), mapped through the cumulative targets to a source; the slots of a source are
ranked in order of t, and the slot of rank r takes the source's block r, until the source has all its blocks. Where the
points leave a source short, slots behind the others follow. Each source's documents, shuffled by a hash, are one stream
of tokens that begins again after its end; its last block ends at its target. Slots and blocks meet in an equi-join on
(source, block), which says when a document's words come and how many of them.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import cut, only, prepare, read, rest

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: No document is used more often than this.
EPOCHS = 2
#: Blocks of a schedule, but for each source's last one: how finely the sources alternate.
SLOTS = 1 << 17
#: The driver computes the targets; more sources than this are refused.
MAX_SOURCES = 100_000
BUCKETS = 256
PHI = 0.6180339887498949


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: float = EPOCHS) -> list[float]:
    """Targets of the sources in order; those over cap times their size stop there and the rest share the excess."""
    total = share * sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(cap * sizes[i] for i in full)
        ws = sum(w[i] for i in rest)
        over = {i for i in rest if left * w[i] / ws > cap * sizes[i]}
        if not over:
            return [float(cap * sizes[i]) if i in full else left * w[i] / ws for i in range(len(sizes))]
        full |= over


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", size=None, phi: float = PHI, slots: int = SLOTS) -> DataFrame:
    """Columns of docs but the text, plus size, source_size, target, taken, first_slot, n_slots; one row per input row.

    taken: words that the mix takes of a document; first_slot and n_slots: the first slot that takes some (null: none), and
    how many do.

    Size: number of white-space separated words (null: 0), or the column expression ``size``. Documents without
    words take nothing. Null is a source of its own, the last one. Repeated rows are documents of their own. An
    empty table gives no rows. An input column with the name of a result gives way to it. The order of a source's documents comes from a hash of key and text, so reruns agree.
    """
    spark = docs.sparkSession
    prepare(spark)
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") if size is None else size
    h = F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("mix"))
    rows = cut(docs.select(rest(docs, text, "size", "source_size", "target", "taken", "first_slot", "n_slots"), F.col(f"`{source}`").alias("s"), words.alias("z"), h.alias("h"), F.xxhash64(F.col(f"`{text}`")).alias("x"), F.monotonically_increasing_id().alias("u")))
    per = rows.groupBy("s").agg(F.sum("z").alias("z")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per = sorted(((x["s"], x["z"]) for x in per), key=lambda x: (x[0] is None, x[0] or ""))
    want = targets([z for _, z in per]) if sum(z for _, z in per) else [0.0] * len(per)
    block = max(1, -(-int(sum(want)) // slots))
    goals = [int(t + 0.5) for t in want]
    facts = spark.createDataFrame([(i, s, int(z), float(t), g, -(-g // block)) for i, ((s, z), t, g) in enumerate(zip(per, want, goals, strict=True))], "i int, s string, source_size long, target double, goal long, need long")
    plan = schedule(spark, want, [-(-g // block) for g in goals], phi)
    # each document's place in its source's stream: sums of hash buckets, then sums within a bucket
    rows = rows.join(F.broadcast(facts), rows["s"].eqNullSafe(facts["s"])).select("r", "i", "z", "h", "x", "u", "source_size", "target", "goal", F.shiftrightunsigned("h", 64 - 8 - _bits(rows)).alias("b"))
    sums = rows.groupBy("i", "b").agg(F.sum("z").alias("bz"))
    sums = sums.withColumn("base", F.coalesce(F.sum("bz").over(Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("i", "b").orderBy("h", "x", "u").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("a", F.coalesce(F.sum("z").over(w), F.lit(0))).join(sums.select("i", "b", "base"), ["i", "b"]).withColumn("a", F.col("a") + F.col("base"))
    # a document's words in each round of the stream, against the blocks between 0 and the source's target
    turns = rows.where("z > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn("a", F.col("a") + F.col("turn") * F.col("source_size")).where("a < goal")
    turns = turns.withColumn("e", F.least(F.col("a") + F.col("z"), F.col("goal")))
    parts = turns.select("i", "u", "a", "e", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(e - 1) div {block}"))).alias("block"))
    part = F.least("e", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    # the schedule holds slots + sources rows at most
    used = parts.withColumn("part", part).join(F.broadcast(plan), ["i", "block"]).groupBy("u").agg(F.sum("part").alias("taken"), F.min("t").alias("first_slot"), F.count("*").alias("n_slots"))
    out = rows.join(used, "u", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("r.*", F.col("z").alias("size"), "source_size", "target", count("taken"), "first_slot", count("n_slots")).drop("_")


def schedule(spark: SparkSession, want: list[float], need: list[int], phi: float = PHI) -> DataFrame:
    """(i, block, t): the slot of each of the ``need`` blocks of each source, by golden-ratio points through the cumulative
    targets ``want``. Points of a source that has all its blocks stay empty; blocks that no point is left for come behind
    the last slot, in the order of sources."""
    edges, total = np.cumsum(want) / max(sum(want), 1e-300), sum(need)

    def assign(batches):
        for b in batches:
            x = b["id"].to_numpy() * phi
            yield pd.DataFrame({"t": b["id"], "i": np.minimum(np.searchsorted(edges, x - np.floor(x), side="right"), len(edges) - 1).astype("int32")})

    facts = spark.createDataFrame([(i, n) for i, n in enumerate(need) if n], "i int, need long")
    points = spark.range(1, total + 1).mapInPandas(assign, "t long, i int") if total else spark.createDataFrame([], "t long, i int")
    ranked = points.withColumn("block", (F.row_number().over(Window.partitionBy("i").orderBy("t")) - 1).cast("long"))
    ranked = cut(ranked.join(F.broadcast(facts), "i").where("block < need").select("i", "block", "t"))
    have = ranked.groupBy("i").agg(F.count("*").alias("n"))
    short = facts.join(have, "i", "left").select("i", "need", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n < need")
    # sources are MAX_SOURCES at most
    before = F.coalesce(F.sum(F.col("need") - F.col("n")).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = short.withColumn("before", before).withColumn("block", F.explode(F.sequence("n", F.col("need") - 1)))
    return cut(ranked.unionByName(more.select("i", "block", (F.lit(total + 1) + F.col("before") + F.col("block") - F.col("n")).cast("long").alias("t"))))


def _bits(rows: DataFrame) -> int:
    """Extra hash bits so that a bucket of one source has some ten thousand rows at most."""
    return max(0, int(np.ceil(np.log2(max(1, rows.count()) / (BUCKETS * 10_000)))))


def op5_golden_schedule(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and the slots that take them; odd rows behave as in ``mix``."""
    docs = only(read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
