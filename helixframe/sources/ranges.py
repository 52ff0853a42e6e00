"""FASTA files of any record size by byte ranges: records larger than a task are read by many.

A first pass leaves a summary of each range: the records that begin in it, its bases, and whether it ends inside a header.
A scan over the summaries gives each range the number of its record, its place in that record and whether it begins
inside a header. The second pass gives pieces of sequences, each with the bases of the next ranges that its last windows
reach into. Both passes read the bytes of their ranges alone, through pyarrow's file systems."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.operators import kmers as K
from helixframe.plans.durable import cut, store

SIZE = 64 << 20
AHEAD = 1 << 16
BLANK = bytes(range(33))


def split(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """(file, start, stop, length): byte ranges of the files under a path; empty files have none. Only listed, not read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return files.select("file", "length", starts.alias("start")).withColumn("stop", F.least(F.col("start") + size, "length")).select("file", "start", "stop", "length")


def _lines(data: bytes, before: bytes) -> list[tuple[int, int, bool]]:
    """(begin, end, is a header) of the lines of some bytes; the first one may go on from the range before (None then)."""
    out, at = [], 0
    fresh = before == b"\n"
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        out.append((at, end, data[at : at + 1] == b">" if fresh else None))
        at, fresh = end + 1, True
    return out


def _bases(data: bytes) -> bytes:
    return data.translate(None, BLANK)


def _read(f, start: int, stop: int) -> tuple[bytes, bytes]:
    """(bytes, byte before); the start of a file counts as a line's."""
    return f.read_at(stop - start, start), f.read_at(1, start - 1) if start else b"\n"


def summaries(ranges: DataFrame) -> DataFrame:
    """(file, start, stop, length, headers, first, rest, last, ends): records that begin, bases of the line that goes on (if
    it is sequence), of the other lines, of those behind the last header, and whether the range ends inside a header
    (null: as it began)."""
    def go(batches):
        for b in batches:
            rows = []
            for file, start, stop, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, p = store(file)
                with system.open_input_file(p) as f:
                    data, before = _read(f, start, stop)
                first = rest = last = headers = 0
                ends = None
                for i, j, head in _lines(data, before):
                    closed = j < len(data)
                    if head is None:
                        first, ends = len(_bases(data[i:j])), False if closed else None
                    elif head:
                        headers, last, ends = headers + 1, 0, not closed
                    else:
                        n = len(_bases(data[i:j]))
                        rest, last, ends = rest + n, last + n, False
                rows.append((file, start, stop, length, headers, first, rest, last, ends))
            kinds = (pa.string(), *[pa.int64()] * 7, pa.bool_())
            names = ("file", "start", "stop", "length", "headers", "first", "rest", "last", "ends")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return cut(ranges.select("file", "start", "stop", "length").mapInArrow(go, "file string, start long, stop long, length long, headers long, first long, rest long, last long, ends boolean"))


def placed(summary: DataFrame) -> DataFrame:
    """(file, start, stop, length, inside, record_id, at): whether a range begins inside a header, the record it begins in
    (-1 before the first of all) and the place of its first base there. Records are numbered by files' names and places.
    What stands before the first header of a file belongs to no record and has a null record_id."""
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    s = summary.withColumn("inside", F.coalesce(F.last("ends", ignorenulls=True).over(w), F.lit(False)))
    s = s.withColumn("first", F.when(F.col("inside"), 0).otherwise(F.col("first"))).withColumn("n", F.col("first") + F.col("rest"))
    s = s.withColumn("seen", F.coalesce(F.sum("headers").over(w), F.lit(0))).withColumn("cum", F.coalesce(F.sum("n").over(w), F.lit(0)))
    begun = F.max(F.when(F.col("headers") > 0, F.col("cum") + F.col("n") - F.col("last"))).over(w)
    s = s.withColumn("at", F.col("cum") - F.coalesce(begun, F.lit(0)))
    files = s.groupBy("file").agg(F.sum("headers").alias("k"))
    base = files.select("file", F.coalesce(F.sum("k").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a file
    s = s.join(base, "file")
    return s.select("file", "start", "stop", "length", "inside", F.when(F.col("seen") > 0, F.col("base") + F.col("seen") - 1).alias("record_id"), "at", "base", "seen")


def _ahead(f, at: int, length: int, need: int) -> bytes:
    """Up to ``need`` bases of the same record from a place inside a sequence line on."""
    out, fresh = b"", False
    while at < length and len(out) < need:
        data = f.read_at(min(AHEAD, length - at), at)
        for line in data.split(b"\n"):
            if fresh and line.startswith(b">"):
                return out[:need]
            out += _bases(line)
            fresh = True
        fresh = data.endswith(b"\n")
        at += len(data)
    return out[:need]


def pieces(spark: SparkSession, path: str, k: int, size: int = SIZE) -> DataFrame:
    """(record_id, name, at, n, seq): pieces of the records' sequences, each with its place, its own number of bases, and k - 1
    bases more where the record goes on, so that its windows of k letters are those that begin in it. A record gives a
    piece in every range that it has bases in; name stands at the piece of a record's header, which may be empty."""
    def go(batches):
        for b in batches:
            for file, start, stop, length, inside, record, at, base, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, p = store(file)
                out = []
                with system.open_input_file(p) as f:
                    data, before = _read(f, start, stop)
                    current, name, parts, place, tail = record, None, [], at, False
                    for i, j, head in _lines(data, before):
                        if head or (head is None and inside):
                            if head:
                                if current is not None and (parts or name is not None):
                                    out.append((current, name, place, parts))
                                line = data[i:j]
                                while j == len(data) and not line.endswith(b"\n") and start + j < length:
                                    more = f.read_at(min(AHEAD, length - start - j), start + j)
                                    j, line = j + len(more), line + more
                                    if b"\n" in more:
                                        line = line[: line.index(b"\n") + 1]
                                current, seen = base + seen, seen + 1
                                name, parts, place = line[1:].strip().decode("utf-8", "replace"), [], 0
                            tail = False
                        else:
                            parts.append(_bases(data[i:j]))
                            tail = True
                    ends_header = not tail
                    if current is not None and (parts or name is not None):
                        seq = b"".join(parts)
                        more = b"" if ends_header or not seq or stop >= length else _ahead_from(f, stop, length, data, k - 1)
                        out.append((current, name, place, [seq, more]))
                rows = []
                for i, (r, n, a, ps) in enumerate(out):
                    own = b"".join(ps) if i < len(out) - 1 else ps[0] if ps else b""
                    rows.append((r, n, a, len(own), (b"".join(ps)).decode("ascii", "replace")))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "name", "at", "n", "seq"])

    where = placed(summaries(split(spark, path, size)))
    tasks = max(spark.sparkContext.defaultParallelism, min(where.count(), 100_000))
    return where.repartition(tasks, "file", "start").mapInArrow(go, "record_id long, name string, at long, n long, seq string")


def _ahead_from(f, stop: int, length: int, data: bytes, need: int) -> bytes:
    """Bases behind a range that ended in a sequence: a header may begin right there."""
    if need <= 0 or (data.endswith(b"\n") and f.read_at(1, stop) == b">"):
        return b""
    return _ahead(f, stop, length, need)


def kmer_counts(spark: SparkSession, path: str, k: int, size: int = SIZE) -> DataFrame:
    """(kmer, n) of FASTA files; the same as those of the whole records."""
    rows = pieces(spark, path, k, size).where("n > 0").select("record_id", F.upper("seq").alias("seq"))
    return K.count(K.kmer_rows(rows, k))


def records(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """(record_id, name, bases) of each record, without its sequence in a row."""
    p = pieces(spark, path, 1, size)
    return p.groupBy("record_id").agg(F.max("name").alias("name"), F.sum("n").alias("bases"))
