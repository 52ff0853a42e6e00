"""License scan by diagonal voting (native).

All rolling word pairs of all texts are hashed and joined with the pair positions of the templates; the words of a hit
are compared too. A hit of a template's pair ``j`` at word ``w`` votes for the diagonal ``w - j``, the place where the
template would start. Votes are aggregated by diagonal, and a diagonal is merged with those up to ``GAP`` behind it
(words put in or left out). A merged diagonal counts if enough *different* pairs of the template voted for it and its
span is about as long as the template; of counting diagonals at most ``GAP`` apart the best one is the place.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import only, read, rest, small

# Phrases that must stand word for word, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Usual wordings of license notices, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 3
SHARE = 0.75
#: Pairs of a template that are marked in one number.
BITS = 62
RESULT = ("n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per input row: its columns but the text, n_words, places (label, first word, last word, coverage,
    exact), n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no places. An empty table gives no rows; repeated rows stay rows. Of equally
    good places the first counts. An input column with the name of a result gives way to it.
    Templates are a fixed, short list, so their positions are broadcast.
    """
    spark = docs.sparkSession
    temps = [(i, p.split(), lab, i < len(base)) for i, (p, lab) in enumerate([*base, *notices])]
    masks = [f"m{i}" for i in range(-(-max(len(w) - 1 for _, w, _, _ in temps) // BITS))]
    pairs = small(
        spark,
        [(t, j, w[j], w[j + 1], len(w) - 1, lab, exact, *[1 << j - i * BITS if i * BITS <= j < (i + 1) * BITS else 0 for i in range(len(masks))]) for t, w, lab, exact in temps for j in range(len(w) - 1)],
        f"t int, j int, a string, b string, need int, label string, exact boolean, {', '.join(f'{m} long' for m in masks)}",
    ).withColumn("h", F.xxhash64("a", "b"))
    words = docs.select(rest(docs, text, *RESULT), F.array_remove(F.split(F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER), BREAK), "").alias("words"))
    # a text's last word has no second one, so its pair equals no template pair
    gram = lambda w, i: F.struct(F.xxhash64(w, F.try_element_at("words", i + 2)).alias("h"), w.alias("a"), F.try_element_at("words", i + 2).alias("b"))
    grams = words.select("r", F.monotonically_increasing_id().alias("u"), F.size("words").cast("long").alias("n"), F.transform("words", gram).alias("g"))
    hits = grams.select("r", "u", "n", F.posexplode_outer("g").alias("w", "g")).select("r", "u", "n", "w", "g.h", "g.a", "g.b").join(F.broadcast(pairs), ["h", "a", "b"], "left").where(F.col("t").isNotNull() | (F.coalesce("w", F.lit(0)) == 0))
    first = lambda *cs: [F.first(c).alias(c) for c in cs]
    votes = hits.groupBy("u", "t", (F.col("w") - F.col("j")).alias("d")).agg(*first("r", "n", "need", "label", "exact"), F.min("w").alias("lo"), (F.max("w") + 1).alias("hi"), *[F.bit_or(m).alias(m) for m in masks])
    by = Window.partitionBy("u", "t").orderBy("d")
    # a phrase of the base has to stand on one diagonal; a notice may go on up to GAP further
    near = by.rangeBetween(0, GAP)
    pick = lambda f, c: F.when(F.col("exact"), F.col(c)).otherwise(f(c).over(near))
    seen = sum((F.bit_count(pick(F.bit_or, m)) for m in masks[1:]), F.bit_count(pick(F.bit_or, masks[0])))
    votes = votes.withColumns({"v": seen, "lo": pick(F.min, "lo"), "hi": pick(F.max, "hi")})
    span = F.col("hi") - F.col("lo")
    whole = F.when(F.col("exact"), (F.col("v") == F.col("need")) & (span == F.col("need"))).otherwise((F.col("v") >= SHARE * F.col("need")) & (span <= F.col("need") + GAP))
    votes = votes.withColumn("hit", F.coalesce(whole, F.lit(False)))
    before = F.last(F.when(F.col("hit"), F.col("d")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    far = F.col("exact") | before.isNull() | (F.col("d") - before > GAP)
    votes = votes.withColumn("new", F.col("hit") & far)
    votes = votes.withColumn("k", F.when(F.col("hit"), F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    best = F.max(F.struct("v", (-F.col("hi") + F.col("lo")).alias("short"), (-F.col("d")).alias("d"), "lo", "hi"))
    spots = votes.groupBy("u", "t", "k").agg(*first("r", "n", "need", "label", "exact", "hit"), best.alias("p")).select("u", "r", "n", "label", "exact", "hit", "p.lo", "p.hi", (F.col("p.v") / F.col("need")).alias("share"))
    place = F.when(F.col("hit"), F.struct("label", F.col("lo").cast("long").alias("first"), F.col("hi").cast("long").alias("last"), F.col("share").alias("coverage"), "exact"))
    exact = F.col("hit") & F.col("exact")
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spots.groupBy("u").agg(
        F.first("r").alias("r"), F.max("n").alias("n_words"), F.array_sort(F.collect_list(place)).alias("places"), F.count(F.when(exact, 1)).alias("n_base"), F.min(F.when(exact, F.col("lo"))).cast("long").alias("first_word"), F.max(F.when(exact, F.col("lo"))).cast("long").alias("last_word"),
        join(F.when(exact, F.col("label"))).alias("base_labels"), join(F.when(F.col("hit"), F.col("label"))).alias("labels"), F.coalesce(F.max(F.when(F.col("hit"), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.select("r.*", *RESULT).drop("_")


def op4_diagonal_voting(spark, sf_dir: str) -> DataFrame:
    """License places and labels of every whole text."""
    out = scan(only(read(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
