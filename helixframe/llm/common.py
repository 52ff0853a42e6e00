"""Shared helpers: sessions, clash-free columns, distributed components, durable cuts of lineage."""

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an Arrow batch; texts are long, so the default of 10,000 would make batches of many MB.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Set the checkpoint folder that the session names and small Arrow batches. A session of one machine that names none
    gets a folder of its own; on a cluster that is an error, as executors would not share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="hx-checkpoint-"))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def cut(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there (survives lost executors). ``arrow_rows``: rows of
    an Arrow batch meanwhile, where a row is wide."""
    spark = df.sparkSession
    prepare(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, str(arrow_rows or was))
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, was)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def rest(df: DataFrame, text: str, *results: str):
    """Struct r of the columns of df but the text and those with the name of a result, which gives way to it."""
    taken = {text.lower(), *(n.lower() for n in results)}
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]).alias("r")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Frame of a few rows that the driver holds, without a Python worker: they travel as a literal."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    struct = ", ".join(": ".join(f.split()) for f in schema.split(", "))
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{struct}>>")).alias("x")).select("x.*")


def wider(df: DataFrame, **more: str) -> str:
    """Schema text of df with more columns."""
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{k}` {v}" for k, v in more.items()]])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component = smallest node reached.

    Alternating large-star and small-star rounds; each is two shuffles of the edges that remain, as repeated edges and
    the smallest neighbours are found in the shuffled partitions themselves. No node's neighbours are gathered in one
    row, and lineage is cut every round. An empty edge list gives no rows.
    """
    w = Window.partitionBy("u")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    was = state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u").distinct()
        large = both.withColumn("m", F.least(F.min("v").over(w), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.repartition("u").distinct().withColumn("m", F.min("v").over(w))
        # the row of u's smallest neighbour m stays, any other neighbour v goes to m
        e = cut(down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        now = state(e)
        if was == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        was = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
