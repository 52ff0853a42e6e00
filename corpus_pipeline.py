"""Corpus pipeline: five stages, each an operator of helixframe.llm, from documents to sentence pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes each stage's
result to the shared checkpoint folder and reads it again for the next one.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import jaccard_join, languages, mixing, quality, sentence_pieces
from helixframe.llm.common import cut, only, prepare, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with ``row``, a key of each row: the id if ids are there and different, else a number fixed by a checkpoint."""
    docs = only(docs, *COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    return cut(docs.withColumn("row", F.monotonically_increasing_id()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; texts that are null or empty are rejected."""
    docs = only(docs, *COLUMNS)
    labels = only(read(spark, sf_dir, "labels"), "doc_id", "quality")
    model = quality.train(quality.sample(only(docs, "doc_id", "text"), labels, "quality", ~languages.held_out(4, 2)))
    kept = quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD)
    return kept.where(F.length(F.trim("text")) > 0).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go. The score decides nothing, as it grows with the length of
    the text: clean texts of a few words are below 0.3. Every text with a letter has a nearest language."""
    docs = only(docs, *COLUMNS)
    prototypes = languages.learn(docs.where(~F.coalesce(languages.held_out(5, 0), F.lit(False))))
    kept = languages.predict(docs, prototypes).where(F.col("lang_pred") != "und")
    return kept.select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id (null ids last), of each class of near duplicates (5 words, similarity 0.8). Rows
    of one id are documents of their own; of equal rows one stays."""
    docs = with_row(docs)
    classes = jaccard_join.join(only(docs, "row", "text"), k=5, num=80, den=100, key="row", unique_ids=True)
    named = cut(classes.select(F.col("doc_id").alias("row"), F.col("component_id").alias("c")).join(only(docs, "row", "doc_id"), "row"))
    kept = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    gone = cut(named.select("row").join(kept, "row", "left_anti"))
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: words taken over words, rounded, 0 to 2 times. Rows with null or repeated ids
    are documents of their own."""
    docs = with_row(docs)
    mixed = mixing.mix(only(docs, "doc_id", "text", "source", "row"))
    times = cut(mixed.where("taken > 0").select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0"))
    return docs.join(times, "row").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentence pieces of each document."""
    return sentence_pieces.encode(only(docs, "doc_id", "text"), verify=True).select("doc_id", "n_pieces", "pieces", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentence pieces", piece_stage),
]

#: SQL can't express the trained stages; tests/llm hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    for i, (_, stage) in enumerate(STAGES):
        path = f"{root}/pipeline-{uuid.uuid4().hex}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
