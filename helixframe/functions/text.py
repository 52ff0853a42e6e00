"""Small helpers of the analysis commands: split lists, optional numbers, breakpoints, histories, timers."""

import resource
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_after(text, delimiters: str) -> Column:
    """Pieces of a text, each with the delimiter that ends it: ``e5+e6-`` at ``+-`` gives e5+ and e6-."""
    d = "".join("\\" + x for x in delimiters)
    return F.regexp_extract_all(_c(text), F.lit(f"([^{d}]*[{d}])"), F.lit(1))


def option_int(text) -> Column:
    """``?`` is -1."""
    return F.when(_c(text) == "?", -1).otherwise(F.try_to_number(_c(text), F.lit("999999999999")).cast("long"))


def option_float(text) -> Column:
    return F.when(_c(text) == "?", -1.0).otherwise(_c(text).try_cast("double"))


def state_list(text) -> Column:
    """``node:prob,node:prob`` as array of struct(node, p)."""
    one = lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("node"), F.split_part(s, F.lit(":"), F.lit(2)).try_cast("double").alias("p"))
    return F.transform(F.filter(F.split(_c(text), ","), lambda s: s != ""), one)


def flip_strand(strand) -> Column:
    return F.translate(_c(strand), "+-", "-+")


def breakpoints(rows: DataFrame, order: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows at which the key differs from the row before."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)
    return rows.withColumn("_p", F.lag(key).over(w)).where(F.col("_p") != F.col(key)).drop("_p")


def history(copies: dict[int, int], cycles: list[list[tuple[int, int]]]) -> list[dict[int, int]]:
    """Copy numbers before, between and after a list of moves, found by undoing them from the end."""
    out = [dict(copies)]
    for cycle in reversed(cycles):
        c = dict(out[-1])
        for e, d in cycle:
            c[e] -= d
        out.append(c)
    return out[::-1]


def bipartite(in_nodes: DataFrame, out_nodes: DataFrame, value: Column) -> DataFrame:
    """Complete bipartite container of a few ways in and out of one node: (i, j, edge, value), edge = i * n_out + j."""
    n = out_nodes.count()
    return in_nodes.crossJoin(F.broadcast(out_nodes)).select("i", "j", (F.col("i") * n + F.col("j")).alias("edge"), value.alias("value"))


def timed(f: Callable, unit: float = 1e3) -> tuple[object, int]:
    """(result, milliseconds), or microseconds for unit 1e6."""
    t = time.perf_counter()
    out = f()
    return out, int((time.perf_counter() - t) * unit)


def spaces(n: int) -> Column:
    return F.repeat(F.lit(" "), n)


def peak_memory_mb() -> float:
    """Largest resident memory of the driver's Python so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
