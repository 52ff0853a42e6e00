"""Token counts of flat token files by a separator scan.

A token file is a plain run of 2- or 4-byte ids without an index; an end-of-document id closes each document. Files
are cut into blocks of fixed size. Each block is searched for the separator in one vectorised pass and leaves a
summary (tokens, first and last separator, counts of the documents inside). A prefix scan over a file's summaries
gives each block its place and the last separator before it, which closes the documents that cross blocks.
"""

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import cut, only, prepare, read
from helixframe.llm.web_archives import store

BLOCK_TOKENS = 1 << 16
#: Files above this are read by ranges of so many ids.
WHOLE_BYTES, RANGE_TOKENS = 256 << 20, 1 << 22
EOD = 50256
SUMMARY = "file string, block long, sub long, tokens long, seps long, first long, last long, inner array<long>"


def read_token_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Ranges (file, block, data) of flat token files in any store that Spark reads; none for an empty folder.

    Files up to WHOLE_BYTES are one range. Those above are listed by length alone and read in the tasks, by ranges of
    RANGE_TOKENS ids whose last one is shorter; an incomplete id at their end is an error.
    """
    listed = spark.read.format("binaryFile").load(path)
    small = listed.where(F.col("length") <= WHOLE_BYTES).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("content").alias("data"))
    big = listed.where(F.col("length") > WHOLE_BYTES).select(F.col("path").alias("file"), "length")
    odd = big.where(F.col("length") % width != 0).first()
    if odd is not None:
        raise ValueError(f"{odd['file']}: {odd['length']} bytes are no whole ids of {width} bytes")
    return small if big.isEmpty() else small.unionByName(_ranges(big, width))


def _ranges(files: DataFrame, width: int, tokens: int = RANGE_TOKENS) -> DataFrame:
    """(file, block, data) of files(file, length): only offsets are shuffled, and a task holds one range at a time."""
    step = tokens * width
    starts = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start"))

    def fetch(batches):
        for b in batches:
            for f, length, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, p = store(f)
                with system.open_input_file(p) as h:
                    data = h.read_at(min(step, length - at), at)
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([at // step], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    parts = starts.sparkSession.sparkContext.defaultParallelism
    return starts.repartition(max(parts, 200), "file", "start").mapInArrow(fetch, "file string, block long, data binary")


def count_tokens(ranges: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens): tokens of each document of each file, separators not counted.

    Ranges: (file, block, data), of whole ids but the last of a file, where bytes behind the last whole id are left out.
    Tokens after the last separator of a file are a document of their own if there are any; two separators in a row
    enclose an empty document; an empty file has none.
    """
    kind = np.dtype("<u2" if width == 2 else "<u4")
    names = [f.split()[0] for f in SUMMARY.split(", ")]

    def scan(batches):
        for b in batches:
            for f, k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = memoryview(d.as_buffer() or b"")
                ids, out = np.frombuffer(data[: len(data) // width * width], dtype=kind), []
                for i in range(0, len(ids), BLOCK_TOKENS):
                    own = ids[i : i + BLOCK_TOKENS]
                    at = np.flatnonzero(own == eod)
                    out.append((f, k, i // BLOCK_TOKENS, len(own), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, (np.diff(at) - 1).tolist()))
                if out:
                    kinds = (pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    # files are wide rows: one of them is in memory at a time, and they are read once
    return stitch(cut(ranges.select("file", F.col("block").cast("long"), "data").mapInArrow(scan, SUMMARY), 1))


def stitch(summaries: DataFrame) -> DataFrame:
    """Documents of files from the summaries of their blocks."""
    w = Window.partitionBy("file").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    s = summaries.withColumn("base", F.coalesce(F.sum("tokens").over(w), F.lit(0))).withColumn("docs", F.coalesce(F.sum("seps").over(w), F.lit(0)))
    s = s.withColumn("prev", F.coalesce(F.max(F.col("base") + F.col("last")).over(w), F.lit(-1)))
    inside = s.where("seps > 0").select("file", F.posexplode(F.concat(F.array(F.col("base") + F.col("first") - F.col("prev") - 1), "inner")).alias("i", "n"), "docs")
    ends = s.groupBy("file").agg(F.sum("tokens").alias("t"), F.max(F.coalesce(F.col("base") + F.col("last"), F.lit(-1))).alias("l"), F.sum("seps").alias("docs"))
    tail = ends.where("t - 1 > l").select("file", F.col("docs").alias("ordinal"), (F.col("t") - F.col("l") - 1).alias("n_tokens"))
    return inside.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), F.col("n").alias("n_tokens")).unionByName(tail)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> tuple[str, str]:
    """Place and split pattern of the installed public byte-level vocabulary."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def write_token_files(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocab: tuple[str, str] | None = None) -> None:
    """Write the flat token files of docs, one for each task, to path/kind=tokens, and their lists of keys to
    path/kind=keys, by Spark's own committed writer: a lost executor leaves no part of a file.

    The end-of-document id is the writer's line separator. Null and empty texts are documents without tokens. A key is
    a flag (1: there), 8 bytes and the separator. An empty table gives no files.
    """
    spark = docs.sparkSession
    prepare(spark)
    name, pattern = vocab or vocabulary()

    def encode(batches):
        enc = encoder(name, pattern)
        for b in batches:
            data = [np.array(enc.encode_ordinary(t.as_py() or ""), dtype="<u2").tobytes() for t in b.column(0)]
            keys = [bytes(9) if k is None else b"\x01" + k.to_bytes(8, "little", signed=True) for k in b.column(1).to_pylist()]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(data + keys, pa.binary()), pa.array(["tokens"] * n + ["keys"] * n)], names=["value", "kind"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{key}`").cast("long").alias("k")).mapInArrow(encode, "value binary, kind string")
    end = int(EOD).to_bytes(2, "little").decode("latin-1")
    # two open files for each task instead of a sort: rows stay in order
    with_conf = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(with_conf)
    try:
        spark.conf.set(with_conf, "8")
        rows.select(F.col("value").cast("string"), "kind").write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", 0).option("compression", "none").text(path)
    finally:
        spark.conf.set(with_conf, was)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, key) of the lists that write_token_files left."""

    def parse(batches):
        for b in batches:
            for f, d in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                r = np.frombuffer(d.as_buffer(), dtype=np.dtype([("there", "u1"), ("key", "<i8"), ("end", "<u2")]))
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(r), pa.int32()), pa.array(np.arange(len(r))), pa.array(r["key"].copy(), mask=r["there"] == 0)], names=["part", "ordinal", "key"])

    files = spark.read.format("binaryFile").load(f"{path}/kind=keys").select(_part("path"), "content")
    return files.mapInArrow(parse, "part int, ordinal long, key long")


def _part(path: str):
    return F.regexp_extract(path, r"/part-(\d+)-[^/]*$", 1).cast("int").alias("part")


def counts_of(docs: DataFrame, text: str = "text", key: str = "doc_id", vocab: tuple[str, str] | None = None) -> DataFrame:
    """(key, file, ordinal, n_tokens) of each row of docs, found by a scan of flat token files in the shared folder.

    Null and empty texts have no tokens; repeated rows and rows without a key are documents of their own. An empty table
    gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, text, key, vocab)
    try:
        found, keys = count_tokens(read_token_files(spark, f"{path}/kind=tokens")), read_keys(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"`{key}` long, file string, ordinal long, n_tokens long")
    out = keys.join(found.withColumn("part", _part("file")), ["part", "ordinal"])
    return out.select(F.col("key").alias(key), "file", "ordinal", "n_tokens")


def op8_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, found in the flat token files of the table."""
    out = counts_of(only(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", F.regexp_extract("file", r"/(part-\d+)", 1).alias("file"), "ordinal", "n_tokens")
