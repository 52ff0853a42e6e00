"""Running totals with a stop, and joins of overlapping spans, for tables of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.plans.durable import cut

LEVELS = 62


def running_total(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """df with ``out``, the sum of the values of all rows before each one, by the order columns (name a unique one last: ties
    are else taken as they come). Null values count as 0.

    The rows are sorted in ranges; each range is summed once, the ranges' sums are added up, and a window inside each range
    does the rest. No task holds more than a range."""
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    sums = rows.groupBy("_range").agg(F.sum(v).alias("_s"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = sums.select("_range", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"))
    inside = F.sum(v).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_in", inside).join(F.broadcast(base), "_range").withColumn(out, F.col("_base") + F.coalesce("_in", F.lit(0))).drop("_at", "_range", "_in", "_base")


def up_to(df: DataFrame, order: list[str], value: str, target, out: str = "before") -> DataFrame:
    """The first rows, by the order columns, whose values sum to the target or just pass it, with the sum before each. No
    row if the target is 0 or less; all rows if they stay below."""
    return running_total(df, order, value, out).where(F.col(out) < target)


def overlaps(a: DataFrame, b: DataFrame, on: list[str], span_a: tuple[str, str], span_b: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b with equal ``on`` whose half-open spans overlap, as a's columns, then b's other columns (their
    names must differ). Empty or null spans overlap with nothing.

    A span has the level of the power of two that is no shorter, so it meets two bins of its level at most. Pairs meet in
    the bins of the longer span's level: a row is laid out on its own level and on the longer ones that the other table
    has. A pair that shares two bins counts in the first."""
    def laid(df, span, other_levels, longer_only):
        lo, hi = (F.col(c).cast("long") for c in span)
        own = F.ceil(F.log2((hi - lo).cast("double"))).cast("int")
        rows = df.where(hi > lo).withColumn("_own", own)
        if not longer_only:
            return rows.withColumn("_level", F.col("_own"))
        levels = F.array(*[F.lit(x) for x in other_levels]).cast("array<int>")
        return rows.withColumn("_level", F.explode(F.filter(levels, lambda x: x > F.col("_own"))))

    def binned(df, span):
        lo, hi = (F.col(c).cast("long") for c in span)
        width = F.expr("shiftleft(1L, _level)")
        first, last = F.floor(lo / width).cast("long"), F.floor((hi - 1) / width).cast("long")
        return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    def levels(df, span):
        lo, hi = (F.col(c).cast("long") for c in span)
        return [r[0] for r in df.where(hi > lo).select(F.ceil(F.log2((hi - lo).cast("double"))).cast("int")).distinct().collect()]

    la, lb = levels(a, span_a), levels(b, span_b)  # LEVELS numbers at most
    rest = [c for c in b.columns if c not in on]
    keys = [*on, "_level", "_bin"]

    def met(x, y):
        y = y.select(*keys, F.col("_first").alias("_other"), *rest)
        both = x.join(y, keys).where(F.col("_bin") == F.greatest("_first", "_other"))
        return both.where((F.col(span_a[0]) < F.col(span_b[1])) & (F.col(span_b[0]) < F.col(span_a[1]))).select(*a.columns, *rest)

    own_a, own_b = binned(laid(a, span_a, [], False), span_a), binned(laid(b, span_b, [], False), span_b)
    up_a, up_b = binned(laid(a, span_a, lb, True), span_a), binned(laid(b, span_b, la, True), span_b)
    # equal levels, then the shorter of a under the longer of b, then the other way
    return met(own_a, own_b).unionByName(met(up_a, own_b)).unionByName(met(own_a, up_b))
