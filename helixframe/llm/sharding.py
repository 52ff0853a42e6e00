"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Native: DataFrame functions only. The driver holds, for each node of a level of the tree, extents and one histogram of
at most ``CELLS`` numbers per refinement round (fewer if nodes are many, ``HELD`` in all), never rows. Rows carry their
node; a level's cuts are a broadcast table with one row for each node, so the plan does not grow with the leaves.

Law: ``bytes``. Every node is cut in proportion to the leaves below it, so leaf sizes differ by about the
largest single unit of placement. A unit is a group of equal texts; a group above ``target / HEAVY`` bytes is a
unit that the driver places itself (there are at most ``HEAVY`` of them per leaf, ``UNITS`` in all) so that the cut among the
others can make up for it, and a group above half a leaf is dealt out in pieces by row, as no leaf could hold it.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm.common import cut, rest, small

CELLS, HELD = 2048, 1 << 22
HEAVY, UNITS = 64, 1 << 20
#: Copies of a text are dealt to so many parts before their group is summed.
SALT = 64
RESULT = ("size", "text_crc32", "shard", "slot")
#: A position is 20 bits of the coordinate, then 24 bits of the text's hash, so that ties are cut at group borders.
COORD_BITS, TIE_BITS = 20, 24


def _order(c: Column) -> Column:
    """A number that orders strings by their first 6 bytes; null is before all."""
    head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double") + 1, F.lit(0.0))


def shard(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, text: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows of docs without their text, plus size, text_crc32, shard, slot; one row per input row.

    Leaves: as many as total / target_bytes, or ``shards``. Dimensions: log2 of the size, and the metadata
    columns ``dims`` (those that exist; a group of equal texts counts with the smallest value of its rows).
    Nulls, empty texts and repeated rows are ordinary rows: size 1 for an empty or null text. An empty table
    gives no rows. Slots count from 0 without gaps in each shard. An input column with the name of a result gives way.
    """
    spark = docs.sparkSession
    have = [d for d in dims if d in docs.columns]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(rest(docs, text, *RESULT), F.encode(t, "UTF-8").alias("b"), *[_order(F.col(f"`{d}`")).alias(f"d{i + 1}") for i, d in enumerate(have)])
    rows = cut(rows.select("r", F.monotonically_increasing_id().alias("u"), (F.octet_length("b") + 1).cast("long").alias("z"), F.crc32("b").alias("c"), F.xxhash64("b").alias("g"), *[f"d{i + 1}" for i in range(len(have))]))
    nd = len(have) + 1
    total = rows.agg(F.sum("z")).first()[0]
    k = shards or max(1, math.ceil((total or 1) / target_bytes))
    leaf = max(1, math.ceil((total or 1) / k))
    most = max(2, min(HEAVY, UNITS // k))
    # groups of equal texts: one coordinate each; the parts of a hot group are summed before they meet
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALT)))
    part = rows.groupBy("g", "salt").agg(F.count("*").alias("n"), F.sum("z").alias("gz"), *[F.min(f"d{i + 1}").alias(f"m{i + 1}") for i in range(len(have))])
    groups = part.groupBy("g").agg(F.sum("n").alias("n"), F.sum("gz").alias("gz"), *[F.min(f"m{i + 1}").alias(f"m{i + 1}") for i in range(len(have))]).where("n > 1")
    rows = rows.join(part.select("g", "salt").join(groups, "g"), ["g", "salt"], "left")
    pieces = F.when(F.col("gz") * 2 > leaf, F.ceil(F.col("gz") * 8 / leaf)).otherwise(1)
    rows = rows.select("r", "u", "z", "c", F.xxhash64("g", F.pmod(F.col("u"), pieces)).alias("g"), (F.col("gz") > leaf / most).alias("big"), F.log2(F.col("z").cast("double")).alias("d0"), *[F.coalesce(f"m{i + 1}", f"d{i + 1}").alias(f"d{i + 1}") for i in range(len(have))])
    rows = cut(rows.withColumn("big", F.coalesce("big", F.lit(False))))
    heavy = {x["g"]: x for x in rows.where("big").groupBy("g").agg(F.sum("z").alias("z"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(nd)]).where(F.col("z") > leaf / most).collect()}
    light = rows.where("not big") if not heavy else rows.join(F.broadcast(small(spark, [(g,) for g in heavy], "g long")), "g", "left_anti")
    ext = [F.min(f"d{i}").alias(f"a{i}") for i in range(nd)] + [F.max(f"d{i}").alias(f"b{i}") for i in range(nd)]
    root = rows.agg(*ext).first()
    span = [((root[f"a{i}"] or 0.0), max((root[f"b{i}"] or 0.0) - (root[f"a{i}"] or 0.0), 1e-12)) for i in range(nd)]

    def place(dim: Column) -> Column:
        """Position of a row along the dimension that a column names."""
        at = F.lit(None).cast("long")
        for i in range(nd):
            cell = F.least(F.floor((F.col(f"d{i}") - span[i][0]) / span[i][1] * (1 << COORD_BITS)), F.lit((1 << COORD_BITS) - 1)).cast("long")
            at = F.when(dim == i, cell * (1 << TIE_BITS) + F.col("g").bitwiseAND((1 << TIE_BITS) - 1)).otherwise(at)
        return at

    at = {g: (0, k) for g in heavy}  # node of each heavy unit; a node is (first leaf, leaves)
    light = light.withColumn("node", F.lit(0).cast("long"))
    level = [(0, k)] if k > 1 and total else []
    while level:
        seen = {x["node"]: x for x in light.groupBy("node").agg(F.sum("z").alias("z"), *ext).collect()}
        mine: dict[tuple[int, int], list[int]] = {}
        for g, node in at.items():
            mine.setdefault(node, []).append(g)
        dim, want, low, width = {}, {}, {}, {}
        for first, n in level:
            s, own = seen.get(first), mine.get((first, n), [])
            ends = [[heavy[g][f"d{i}"] for g in own] + ([s[f"a{i}"], s[f"b{i}"]] if s else []) for i in range(nd)]
            spread = [(max(e, default=0) - min(e, default=0)) / span[i][1] for i, e in enumerate(ends)]
            dim[first] = max(range(nd), key=lambda i: (spread[i], -i))
            left, bulk = n // 2, s["z"] if s else 0
            all_z = bulk + sum(heavy[g]["z"] for g in own)
            room = [all_z * left / n, all_z * (n - left) / n]
            for g in sorted(own, key=lambda g: (heavy[g][f"d{dim[first]}"], g)):
                side = 0 if room[0] >= heavy[g]["z"] or room[0] >= room[1] else 1
                room[side] -= heavy[g]["z"]
                at[g] = (first, left) if side == 0 else (first + left, n - left)
            want[first], low[first], width[first] = min(max(room[0], 0), bulk), 0, 1 << (COORD_BITS + TIE_BITS)
        cells = max(16, min(CELLS, HELD // len(level)))
        while any(w > 1 for w in width.values()):
            step = {f: -(-w // cells) for f, w in width.items()}
            facts = small(spark, [(f, dim[f], low[f], step[f], width[f]) for f in dim], "node long, dim int, low long, step long, width long")
            here = light.join(F.broadcast(facts), "node").withColumn("off", place(F.col("dim")) - F.col("low")).where("off < width")
            hist: dict[int, list[tuple[int, int]]] = {}
            for x in here.groupBy("node", F.when(F.col("off") < 0, -1).otherwise(F.expr("off div step")).alias("cell")).agg(F.sum("z").alias("z")).collect():
                hist.setdefault(x["node"], []).append((x["cell"], x["z"]))
            for f in dim:
                run, hit = 0, None
                for c, z in sorted(hist.get(f, [])):
                    if run + z > want[f] and c >= 0:
                        hit = c + 1 if step[f] == 1 and want[f] - run > run + z - want[f] else c
                        break
                    run += z
                if hit is None:
                    low[f], width[f] = low[f] + width[f], 1
                else:
                    low[f], width[f] = low[f] + hit * step[f], step[f]
        cuts = small(spark, [(f, dim[f], low[f], f + n // 2) for f, n in level], "node long, dim int, low long, right long")
        light = light.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(place(F.col("dim")) >= F.col("low"), F.col("right")).otherwise(F.col("node"))).drop("dim", "low", "right")
        level = [x for f, n in level for x in ((f, n // 2), (f + n // 2, n - n // 2)) if x[1] > 1]
    out = light.select("r", "u", "z", "c", F.col("node").cast("int").alias("shard"))
    if heavy:
        where = small(spark, [(g, a[0]) for g, a in at.items()], "g long, shard int")
        out = out.unionByName(rows.join(F.broadcast(where), "g").select("r", "u", "z", "c", "shard"))
    # slots: rows of a shard are numbered by input partition, then by place in it; both windows stay small
    out = cut(out.select("r", "u", "z", "c", "shard", F.shiftright("u", 33).alias("p")))
    sizes = out.groupBy("shard", "p").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "p", F.coalesce("base", F.lit(0)).alias("base"))
    out = out.withColumn("i", F.row_number().over(Window.partitionBy("shard", "p").orderBy("u")) - 1).join(base, ["shard", "p"])
    return out.select("r.*", F.col("z").alias("size"), F.col("c").alias("text_crc32"), "shard", (F.col("i") + F.col("base")).cast("long").alias("slot")).drop("_")


def op1_kd_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 8 shards of near equal bytes."""
    from helixframe.llm.common import only, read

    out = shard(only(read(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
