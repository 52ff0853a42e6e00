"""Cutting lineage so that lost executors cost little: checkpoints in the folder that the cluster names."""

import re
import tempfile
import uuid
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most.
LOOKUP_ROWS = 100_000


def ensure_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; where it is unset a folder of our own on one machine, and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="hx-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. A checkpoint keeps what Spark knows of the columns of a frame; where a loop makes a
    frame from its own last state that grows with each round, and planning with it. A table knows nothing."""
    path = shared_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame) -> DataFrame:
    """df, marked to be broadcast if it has few rows: what is joined with it is not shuffled then, whatever its keys."""
    return F.broadcast(df) if df.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared checkpoint folder."""
    ensure_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=64)
def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI, for tasks that read and write it themselves, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")
