"""Probabilities as natural logarithms (columns named *_lp; zero is -inf), distributions, histograms and densities."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEG = float("-inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def p(value) -> Column:
    """Log of a probability; ln(0) is -inf, not null."""
    v = _c(value)
    return F.when(v == 0, F.lit(NEG)).otherwise(F.ln(v))


def to_value(lp) -> Column:
    return F.exp(_c(lp))


def is_zero(lp) -> Column:
    return _c(lp) == F.lit(NEG)


def is_one(lp) -> Column:
    return _c(lp) == 0


def add(a, b) -> Column:
    x, y = _c(a), _c(b)
    hi, lo = F.greatest(x, y), F.least(x, y)
    return F.when(lo == F.lit(NEG), hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def mul(a, b) -> Column:
    return _c(a) + _c(b)


def div(a, b) -> Column:
    return _c(a) - _c(b)


def mul_int(lp, c) -> Column:
    return _c(lp) + p(_c(c))


def div_int(lp, c) -> Column:
    n = _c(c)
    return F.when(n == 0, F.raise_error(F.lit("division of a probability by zero"))).otherwise(_c(lp) - F.ln(n))


def diff(a, b) -> Column:
    return F.abs(to_value(a) - to_value(b))


def log_diff(a, b) -> Column:
    x, y = _c(a), _c(b)
    return F.when(is_zero(x) & is_zero(y), 0.0).when(is_zero(x) | is_zero(y), float("inf")).otherwise(F.abs(x - y))


def parse(text) -> Column:
    """``log(value)`` text: the front counts."""
    return F.regexp_extract(_c(text), r"^([^(]*)", 1).cast("double")


def fmt(lp) -> Column:
    return F.format_string("%s(%s)", _c(lp).cast("string"), to_value(lp).cast("string"))


def non_nan(x) -> Column:
    c = _c(x)
    return F.when(F.isnan(c), F.raise_error(F.lit("NaN"))).otherwise(c)


def product_agg(lp) -> Column:
    return F.sum(_c(lp))


def sum_by(df: DataFrame, keys: Sequence[str], lp: str, out: str) -> DataFrame:
    """Log-sum-exp by keys in one shuffle: the largest and the list of partial sums are built-in aggregates.

    Two aggregates can't see each other's maximum, so the rows are summed relative to a bound of each task: the
    maximum by key is joined from the same grouping.
    """
    top = df.groupBy(*keys).agg(F.max(lp).alias("_top"))
    joined = df.join(top, list(keys)) if keys else df.crossJoin(F.broadcast(top))
    rel = F.when(F.col("_top") == F.lit(NEG), 0.0).otherwise(F.exp(F.col(lp) - F.col("_top")))
    s = joined.groupBy(*keys, "_top").agg(F.sum(rel).alias("_s"))
    return s.select(*keys, F.when(F.col("_top") == F.lit(NEG), F.lit(NEG)).otherwise(F.col("_top") + F.ln("_s")).alias(out))


def distribution(df: DataFrame, keys: Sequence[str], x: str, lp: str) -> DataFrame:
    """(keys, x, x_lp): normalised distribution of weighted occurrences of x."""
    by_x = sum_by(df, [*keys, x], lp, "_w")
    total = sum_by(by_x, keys, "_w", "_t")
    out = by_x.join(total, list(keys)) if keys else by_x.crossJoin(F.broadcast(total))
    return out.select(*keys, x, (F.col("_w") - F.col("_t")).alias(f"{x}_lp"))


def distribution_mean(dist: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return dist.groupBy(*keys).agg(F.sum(F.col(x) * F.exp(f"{x}_lp")).alias("mean"))


def distribution_text(dist: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """``p(x)=0.000`` list in the order of x."""
    item = F.struct(F.col(x), F.format_string("p(%s)=%.3f", F.col(x).cast("string"), F.exp(f"{x}_lp")).alias("t"))
    return dist.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), ",").alias("dist"))


def histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("count"))


def histogram_add(hist: DataFrame, value: str, more: DataFrame) -> DataFrame:
    return hist.unionByName(histogram(more, value)).groupBy(value).agg(F.sum("count").alias("count"))


def histogram_range(hist: DataFrame, value: str) -> DataFrame:
    return hist.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.coalesce(F.sum("count"), F.lit(0)).alias("len"))


def stat(value) -> list[Column]:
    """mean, population sd, min, max; zeros over no rows."""
    v = _c(value)
    return [F.coalesce(f(v).cast("double"), F.lit(0.0)).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))]


def normal(x, mu, sigma) -> Column:
    """Log density of the normal distribution (a density: it can exceed 0)."""
    z = (_c(x) - _c(mu)) / _c(sigma)
    return -z * z / 2 - F.ln(_c(sigma)) - F.lit(math.log(2 * math.pi) / 2)


def erf(x) -> Column:
    """Error function to about 1e-16 from built-ins: the Maclaurin series below 3 in size, else the continued tail."""
    v = _c(x)
    a = F.abs(v)
    z = -v * v
    term = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(v.alias("t"), v.alias("s")), lambda acc, n: F.struct((acc["t"] * z / n).alias("t"), (acc["s"] + acc["t"] * z / n / (2 * n + 1)).alias("s")))["s"] * (2 / math.sqrt(math.pi))
    frac = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda acc, n: a + n / 2 / acc)
    tail = F.exp(-a * a) / math.sqrt(math.pi) / frac
    return F.when(a < 3, term).otherwise(F.signum(v) * (1 - tail))


def normal_cdf(x, mu, sigma) -> Column:
    """Log of the normal distribution function."""
    return p((1 + erf((_c(x) - _c(mu)) / (_c(sigma) * math.sqrt(2)))) / 2)


def normal_bin(x, mu, sigma) -> Column:
    """Log mass of [x, x + 1)."""
    return p(to_value(normal_cdf(_c(x) + 1, mu, sigma)) - to_value(normal_cdf(x, mu, sigma)))


def log_factorial(n) -> Column:
    c = _c(n).cast("int")
    return F.when(c < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(c, F.lit(2))), F.lit(0.0), lambda s, i: s + F.ln(i)))


def kmer_coverage(k: int, read_length, base_coverage: float, p_error: float):
    """Coverage of error-free k-mers: C (L - k) / L (1 - p)^k; 0 if k is above L. A column of lengths gives a column."""
    left = F.greatest(read_length - k, F.lit(0)) if isinstance(read_length, Column) else max(read_length - k, 0)
    return base_coverage * left / read_length * (1 - p_error) ** k


def poisson(x, mean) -> Column:
    return F.exp(F.ln(_c(mean)) * _c(x) - _c(mean) - log_factorial(x))


def kmer_survival(p_error, k) -> Column:
    """Chance that a k-mer has no error."""
    return F.pow(1 - _c(p_error), _c(k))


def binomial_kmers(c, k, p_error, x) -> Column:
    """Chance that x of c copies of a k-mer have no error."""
    q = kmer_survival(p_error, k)
    return F.exp(log_factorial(c) - log_factorial(x) - log_factorial(_c(c) - _c(x))) * F.pow(q, _c(x)) * F.pow(1 - q, _c(c) - _c(x))


def kmer_loss(c, k, p_error, t) -> Column:
    """Chance that fewer than t of c copies have no error."""
    top = F.least(_c(t).cast("int"), _c(c).cast("int") + 1)
    terms = F.transform(F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0))), lambda x: binomial_kmers(c, k, p_error, x))
    return F.when(top <= 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def mixed_kmer_loss(mean: float, k: int, p_error: float, t: int, most: int = 200) -> Column:
    """kmer_loss with a Poisson number of copies."""
    c = F.sequence(F.lit(0), F.lit(most))
    return F.aggregate(F.transform(c, lambda n: poisson(n, mean) * kmer_loss(n, k, p_error, t)), F.lit(0.0), lambda s, x: s + x)
