"""FASTA source and sink, and the dataset document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators.kmers import number


def in_order(raw: DataFrame) -> DataFrame:
    """Rows of a text source in the order of their files' names and places. Spark reads one file in its order, but packs
    several files by size, so those are sorted."""
    if len(raw.inputFiles()) < 2:
        return raw
    placed = raw.withColumn("_file", F.input_file_name()).withColumn("_at", F.input_file_block_start()).withColumn("_row", F.monotonically_increasing_id())
    return placed.orderBy("_file", "_at", "_row").drop("_file", "_at", "_row")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, name, description, seq) of a FASTA file or folder, gzip by extension; record_id is the order in the
    input, files by name. Records are split by Spark, so a large file is read by many tasks."""
    raw = in_order(spark.read.text(path, lineSep=">")).where("trim(value) <> ''")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    body = F.translate(F.substr("value", F.length(head) + 2), "\r\n\t ", "")
    name = F.regexp_extract(head, r"^(\S*)", 1)
    rows = raw.select(name.alias("name"), F.trim(F.regexp_replace(head, r"^\S*\s*", "")).alias("description"), body.alias("seq"))
    return number(rows, "record_id").select("record_id", "name", "description", "seq")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path).select(F.col("record_id").alias("read_id"), S.sanitize("seq").alias("seq"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """Haplotypes; a description that is exactly C means circular."""
    return scan(spark, path).select(F.col("record_id").alias("hap_id"), F.when(F.col("description") == "C", "C").otherwise("L").alias("style"), S.sanitize("seq").alias("seq"))


def write_lines(lines: DataFrame, path: str, order: list, text: str = "line", one: bool = True) -> None:
    """Text in the given order, gzip if the path ends in gz, dbz or mpz. ``one`` file is sorted and written by one task;
    else a file for each range of the order, whose names are in order too (for lines that are too many for a task)."""
    rows = lines.orderBy(*order).select(text)
    out = (rows.coalesce(1) if one else rows).write.mode("overwrite")
    (out.option("compression", "gzip") if path.endswith(("gz", "dbz", "mpz")) else out).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of the file, or of the files' names in a folder: (i, line)."""
    return number(in_order(spark.read.text(path)).withColumnRenamed("value", "line"), "i")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "i long, line string")


def text_of(lines: DataFrame, order: list) -> str:
    """The lines as one string, for small files."""
    return "\n".join(r["line"] for r in lines.orderBy(*order).collect())


def write_reads(reads: DataFrame, path: str, one: bool = True) -> None:
    write_lines(reads.select("read_id", F.concat(F.lit(">r"), F.col("read_id").cast("string"), F.lit("\n"), "seq").alias("line")), path, ["read_id"], one=one)


def write_genome(haps: DataFrame, path: str, one: bool = True) -> None:
    write_lines(haps.select("hap_id", F.concat(F.lit(">g"), F.col("hap_id").cast("string"), F.lit(" "), "style", F.lit("\n"), "seq").alias("line")), path, ["hap_id"], one=one)


def write_sam(haps: DataFrame, reads: DataFrame, path: str, one: bool = True) -> None:
    """One @SQ line for each haplotype, then one line for each forward read."""
    head = haps.select(F.lit(0).alias("part"), F.col("hap_id").alias("i"), F.concat(F.lit("@SQ\tSN:g"), F.col("hap_id").cast("string"), F.lit("\tLN:"), F.length("seq").cast("string")).alias("line"))
    body = reads.select(F.lit(1).alias("part"), F.col("read_id").alias("i"), S.sam_line(F.concat(F.lit("r"), F.col("read_id").cast("string")), "seq", "origins").alias("line"))
    write_lines(head.unionByName(body), path, ["part", "i"], one=one)


DATASET = "genome array<string>, genome_size long, reads array<string>, phmm_params map<string,double>"


def dataset_frame(haps: DataFrame, reads: DataFrame, params: dict) -> DataFrame:
    """The one-row dataset document. Its form is one JSON value, so all reads meet in one row: for toy data."""
    g = haps.agg(F.transform(F.array_sort(F.collect_list(F.struct("hap_id", S.format_styled("style", "seq").alias("t")))), lambda s: s["t"]).alias("genome"), F.sum(F.length("seq")).alias("genome_size"))
    r = reads.agg(F.transform(F.array_sort(F.collect_list(F.struct("read_id", S.format_positioned("seq", "is_revcomp", "origins").alias("t")))), lambda s: s["t"]).alias("reads"))
    p = F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, float(v))])
    return g.crossJoin(r).withColumn("phmm_params", p)


def write_dataset(haps: DataFrame, reads: DataFrame, params: dict, path: str) -> None:
    dataset_frame(haps, reads, params).coalesce(1).write.mode("overwrite").json(path)


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    d = spark.read.schema(DATASET).json(path)
    haps = d.select(F.posexplode("genome").alias("hap_id", "t")).select(F.col("hap_id").cast("long"), S.parse_styled("t").alias("x")).select("hap_id", "x.style", "x.seq")
    reads = d.select(F.posexplode("reads").alias("read_id", "t")).select(F.col("read_id").cast("long"), S.parse_positioned("t").alias("x")).select("read_id", "x.*")
    return haps, reads, d.first()["phmm_params"]
