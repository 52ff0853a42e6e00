"""Embedding whitening: MLlib's computeSVD on centred distributed rows, its singular values rescaled by the divisor n.

Entries become integers, so that counts, sums and deviations are exact; a row is centred as (n x - S) / n. With y the
centred rows, computeSVD gives y = U s V', so the covariance (divisor n) has the eigenvectors V and the eigenvalues
s s / n. The total variance does not come from the SVD but from the exact deviations: sum of (n x - S)^2 over n^3.

All passes are in the JVM. The driver holds the sums, one number for each dimension, and the components; up to
``FULL`` dimensions MLlib takes the Gram matrix apart on the driver (FULL squared numbers), beyond it iterates with
distributed products.
"""

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cut, only, read

SCALE, SHIFT = 1024, 100_000
#: Entries from here on would not fit 64 bits.
WIDEST = 9.0e15
FULL = 2048
#: Singular values below this share of the first are zero to the precision of the Gram matrix.
RANK = 1e-7
EXACT = "decimal(38,0)"


def _dot(v: Column, w: list[float]) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(c)) for c in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", top: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than the
    most frequent one (ties: the longer). Repeated rows count each. Directions without variance are no components (equal
    vectors have none at all, so they give no rows); an empty table gives no rows. Entries are to fit 64 bits after
    scaling; deviation is a decimal of 38 digits, and more is an error of Spark.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # only entries that fit are scaled, as Spark may do it for a row before it is left out
    whole = lambda c: F.when(F.abs(c) < F.lit(WIDEST), F.floor(c * SCALE) + F.lit(SHIFT)).when(F.abs(c) < F.lit(float("inf")), F.raise_error(F.lit("an entry passes 64 bits after scaling")).cast("long"))
    good = rows.where(v.isNotNull() & fine).select(F.col(f"`{key}`").alias("key"), F.transform(v, whole).alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = rows.sparkSession
    names = f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double"
    if sizes is None or sizes["d"] == 0:
        return spark.createDataFrame([], names)
    d, n = sizes["d"], sizes["count"]
    good = good.where(F.size("x") == d)
    facts = good.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(19,0)")).cast(EXACT).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).orderBy("i").collect()
    # 64 bits are enough if the widest deviation leaves room in them; the result is the same
    widest = n * max(f["hi"] - f["lo"] for f in facts)
    kind = "long" if d * widest * widest < 1 << 63 and n * max(abs(x) for f in facts for x in (f["lo"], f["hi"])) < 1 << 63 else EXACT
    sums = F.array(*[F.lit(str(f["s"])).cast(kind) for f in facts])
    off = F.zip_with("x", sums, lambda c, s: c.cast(kind) * F.lit(n).cast(kind) - s)
    centred = good.select("key", off.alias("off")).withColumn("y", F.transform("off", lambda c: c.cast("double") / F.lit(float(n))))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("y").alias("y")), "y"), n, d)
    svd = matrix.computeSVD(d if d <= FULL else min(top, d), False, RANK)
    axes, sigma = svd.V.toArray(), svd.s.toArray()
    k = min(top, sum(s > 0 for s in sigma))
    if not k:
        return spark.createDataFrame([], names)
    square = F.aggregate("off", F.lit(0).cast(EXACT), lambda s, c: (s + c.cast(EXACT) * c.cast(EXACT)).cast(EXACT)) if kind == EXACT else F.aggregate("off", F.lit(0).cast("long"), lambda s, c: s + c * c).cast(EXACT)
    eigen = [float(s) ** 2 / n for s in sigma[:k]]
    out = cut(centred.select("key", square.alias("deviation"), *[(_dot(F.col("y"), axes[:, j]) / F.lit(eigen[j] ** 0.5)).alias(f"w{j}") for j in range(k)]))
    stats = out.agg(F.sum("deviation").alias("t"), *[F.avg(f"w{j}").alias(f"m{j}") for j in range(k)]).first()
    trace = float(stats["t"]) / float(n) ** 3
    mean = [stats[f"m{j}"] for j in range(k)]
    cross = out.agg(*[F.avg((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(cross[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
    each = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(f"w{j}").alias("whitened"), F.lit(eigen[j] / trace).alias("explained")) for j in range(k)])
    out = out.select("key", "deviation", F.explode(each).alias("e"))
    return out.select(F.col("key").alias(key), "e.component", F.lit(n).cast("long").alias("n"), "deviation", "e.whitened", "e.explained", F.lit(float(error)).alias("identity_error"))


def op12_svd_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first 8 whitened components; odd rows behave as in ``whiten``. Where the exact deviation
    passes 64 bits, ``deviation`` is null and ``deviation_wide`` has it."""
    out = whiten(only(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return out.withColumnRenamed("deviation", "deviation_wide").withColumn("deviation", F.expr("try_cast(deviation_wide as long)"))
