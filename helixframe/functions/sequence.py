"""Column functions on sequences, k-mers, positions and packed arrays. All are built-in expressions (no UDF)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
NULL_BASE = "n"
ALL_BASES = (*BASES, NULL_BASE)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rest(c: Column, start: int = 2) -> Column:
    """The string from a 1-based place to its end."""
    return F.substr(c, F.lit(start))


def first_n(c: Column, n) -> Column:
    return F.left(c, F.lit(n) if isinstance(n, int) else n)


# ---- bases and sequences


def sanitize(seq) -> Column:
    """Upper case; an error if a letter is not one of acgtACGT (N included)."""
    s = _c(seq)
    return F.when(s.rlike("^[ACGTacgt]*$"), F.upper(s)).when(s.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a base in: "), first_n(s, 40))))


def acgt_only(text) -> Column:
    """Text reduced to its ACGT letters in upper case."""
    return F.upper(F.regexp_replace(_c(text), "[^ACGTacgt]+", ""))


def drop_nulls(seq) -> Column:
    return F.translate(_c(seq), NULL_BASE, "")


def sanitize_assembly(seq) -> Column:
    """Upper case without N."""
    return F.translate(F.upper(_c(seq)), "N", "")


def complement(base) -> Column:
    return F.translate(_c(base), "ACGTacgt", "TGCATGCA")


def revcomp(seq) -> Column:
    return F.reverse(complement(seq))


def different_bases(base) -> Column:
    b = _c(base)
    ok = F.filter(F.array(*[F.lit(x) for x in BASES]), lambda x: x != b)
    return F.when(b.isin(*BASES), ok).otherwise(F.raise_error(F.concat(F.lit("not a base: "), b)))


def tandem_repeat(unit, n: int) -> Column:
    return F.repeat(_c(unit), n)


# ---- styles: C circular, L linear, F linear fragment


def parse_style(text) -> Column:
    t = _c(text)
    return F.when(t.isin("C", "L", "F"), t).otherwise(F.raise_error(F.concat(F.lit("unknown style: "), t)))


def is_circular(style) -> Column:
    return _c(style) == "C"


def has_prefix(style) -> Column:
    return _c(style) == "L"


def has_suffix(style) -> Column:
    return _c(style).isin("L", "C")


def is_fragment(style) -> Column:
    return _c(style) == "F"


def parse_styled(text) -> Column:
    """``L:ACGT`` as struct(style, seq)."""
    t = _c(text)
    return F.struct(parse_style(F.split_part(t, F.lit(":"), F.lit(1))).alias("style"), sanitize(F.split_part(t, F.lit(":"), F.lit(2))).alias("seq"))


def format_styled(style, seq) -> Column:
    return F.concat_ws(":", _c(style), _c(seq))


def start_kmer(seq, style, k: int) -> Column:
    return F.when(has_prefix(style), first_n(_c(seq), k))


def end_kmer(seq, style, k: int) -> Column:
    return F.when(has_prefix(style), F.right(_c(seq), F.lit(k)))


# ---- k-mers


def null_kmer(k: int) -> Column:
    return F.lit(NULL_BASE * k)


def is_null(kmer) -> Column:
    return ~_c(kmer).rlike(f"[^{NULL_BASE}]")


def has_null(kmer) -> Column:
    return F.contains(_c(kmer), F.lit(NULL_BASE))


def prefix(kmer) -> Column:
    k = _c(kmer)
    return F.left(k, F.length(k) - 1)


def suffix(kmer) -> Column:
    return rest(_c(kmer))


def first(kmer) -> Column:
    return first_n(_c(kmer), 1)


def last(kmer) -> Column:
    return F.right(_c(kmer), F.lit(1))


emission = last


def is_emittable(kmer) -> Column:
    return last(kmer) != NULL_BASE


def is_head(kmer) -> Column:
    return is_null(prefix(kmer))


def is_tail(kmer) -> Column:
    return is_null(suffix(kmer))


def is_left_end(kmer) -> Column:
    return (first(kmer) == NULL_BASE) & (last(kmer) != NULL_BASE)


def is_right_end(kmer) -> Column:
    return (last(kmer) == NULL_BASE) & (first(kmer) != NULL_BASE)


def adjacent(a, b) -> Column:
    return suffix(a) == prefix(b)


def _each(make, bases=ALL_BASES) -> Column:
    return F.array(*[make(F.lit(b)) for b in bases])


def childs(kmer) -> Column:
    return _each(lambda b: F.concat(suffix(kmer), b))


def parents(kmer) -> Column:
    return _each(lambda b: F.concat(b, prefix(kmer)))


def siblings(kmer) -> Column:
    return _each(lambda b: F.concat(b, suffix(kmer)))


def neighbors(kmer) -> Column:
    """The eight (k+1)-mers with a real base on either side."""
    return F.concat(_each(lambda b: F.concat(_c(kmer), b), BASES), _each(lambda b: F.concat(b, _c(kmer)), BASES))


def same_k_neighbors(kmer) -> Column:
    return F.concat(childs(kmer), parents(kmer))


def preds(kmer) -> Column:
    return _each(lambda b: F.concat(b, _c(kmer)))


def succs(kmer) -> Column:
    return _each(lambda b: F.concat(_c(kmer), b))


def extend_first(kmer, base) -> Column:
    return F.concat(F.lit(base) if isinstance(base, str) and len(base) == 1 else base, _c(kmer))


def extend_last(kmer, base) -> Column:
    return F.concat(_c(kmer), F.lit(base) if isinstance(base, str) and len(base) == 1 else base)


def extend_head(kmer) -> Column:
    return extend_first(kmer, NULL_BASE)


def extend_tail(kmer) -> Column:
    return extend_last(kmer, NULL_BASE)


def _steps(kmer, make) -> Column:
    k = _c(kmer)
    return F.when(F.length(k) > 1, F.transform(F.sequence(F.lit(1), F.length(k) - 1), make)).otherwise(F.array().cast("array<string>"))


def starting_kmers(kmer) -> Column:
    """``ATCG`` gives nATC, nnAT, nnnA."""
    k = _c(kmer)
    return _steps(kmer, lambda i: F.concat(F.repeat(F.lit(NULL_BASE), i), F.left(k, F.length(k) - i)))


def ending_kmers(kmer) -> Column:
    """``ATCG`` gives TCGn, CGnn, Gnnn."""
    k = _c(kmer)
    return _steps(kmer, lambda i: F.concat(F.substr(k, i + 1), F.repeat(F.lit(NULL_BASE), i)))


def starting_kmers_growing(kmer) -> Column:
    """The starting k-mers in growing order: nnnA, nnAT, nATC."""
    return F.reverse(starting_kmers(kmer))


def join(a, b) -> Column:
    """(k+1)-mer of two adjacent k-mers in either order; an error if they are not adjacent."""
    x, y = _c(a), _c(b)
    return F.when(adjacent(x, y), F.concat(x, last(y))).when(adjacent(y, x), F.concat(y, last(x))).otherwise(F.raise_error(F.lit("k-mers are not adjacent")))


def overlap(a, b, k: int) -> Column:
    x, y = _c(a), _c(b)
    return F.when(F.right(x, F.lit(k)) == first_n(y, k), F.concat(x, rest(y, k + 1))).otherwise(F.raise_error(F.lit("no overlap of that length")))


def concat_overlapping(kmers) -> Column:
    """Sequence of a list of overlapping k-mers."""
    a = _c(kmers)
    return F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), a[0], lambda s, x: F.concat(s, last(x)))


def format_kmers(kmers, pretty: bool = False) -> Column:
    s = F.concat_ws(",", _c(kmers))
    return F.concat(F.lit("["), s, F.lit("]")) if pretty else s


# ---- 32 cells of two bits in a LONG


def quad_get(x, i: int) -> Column:
    return F.shiftrightunsigned(_c(x), 2 * i).bitwiseAND(3)


def quad_set(x, i: int, value: int) -> Column:
    mask, bits = 3 << (2 * i), value << (2 * i)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return _c(x).bitwiseAND(F.lit(signed(~mask & ((1 << 64) - 1)))).bitwiseOR(F.lit(signed(bits)))


def quad_shift_front(x) -> Column:
    return F.shiftrightunsigned(_c(x), 2)


def quad_shift_back(x) -> Column:
    return F.shiftleft(_c(x), 2)


# ---- positions: array of struct(node, pos), null for an inserted base


def is_match(origin) -> Column:
    return _c(origin).isNotNull()


def is_first_base(origin) -> Column:
    return F.coalesce(_c(origin)["pos"] == 0, F.lit(False))


def head_origin(origins) -> Column:
    return F.try_element_at(_c(origins), F.lit(1))


def tail_origin(origins) -> Column:
    return F.try_element_at(_c(origins), F.lit(-1))


def first_match_origin(origins) -> Column:
    return F.try_element_at(F.filter(_c(origins), lambda o: o.isNotNull()), F.lit(1))


def origin_node(origins) -> Column:
    return first_match_origin(origins)["node"]


def origin_pos(origins) -> Column:
    return first_match_origin(origins)["pos"]


def parse_position(text) -> Column:
    """``node:pos`` as struct, ``I`` (insertion) as null."""
    t = _c(text)
    return F.when(t.rlike("^[0-9]+:[0-9]+$"), F.struct(F.split_part(t, F.lit(":"), F.lit(1)).cast("long").alias("node"), F.split_part(t, F.lit(":"), F.lit(2)).cast("long").alias("pos")))


def format_position(origin) -> Column:
    o = _c(origin)
    return F.when(o.isNull(), F.lit("I")).otherwise(F.concat_ws(":", o["node"].cast("string"), o["pos"].cast("string")))


def parse_positioned(text) -> Column:
    """``SEQ:+:pos,pos`` (positions written node/pos or I) as struct(seq, is_revcomp, origins)."""
    p = F.split(_c(text), ":", 3)
    one = lambda s: F.when(F.contains(s, F.lit("/")), F.struct(F.split_part(s, F.lit("/"), F.lit(1)).cast("long").alias("node"), F.split_part(s, F.lit("/"), F.lit(2)).cast("long").alias("pos")))
    return F.struct(sanitize(p[0]).alias("seq"), (p[1] == "-").alias("is_revcomp"), F.transform(F.split(p[2], ","), one).alias("origins"))


def format_positioned(seq, is_revcomp, origins) -> Column:
    one = lambda o: F.when(o.isNull(), F.lit("I")).otherwise(F.concat_ws("/", o["node"].cast("string"), o["pos"].cast("string")))
    return F.concat_ws(":", _c(seq), F.when(_c(is_revcomp), "-").otherwise("+"), F.array_join(F.transform(_c(origins), one), ","))


def cigar_ops(origins) -> Column:
    """Alignment letters from origins: M for a match, I for an insertion, and D for every position jumped over."""
    start = F.named_struct(F.lit("last"), F.lit(None).cast("long"), F.lit("ops"), F.lit(""))

    def step(acc, o):
        gap = F.when(acc["last"].isNotNull(), F.greatest(o["pos"] - acc["last"] - 1, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
        match = F.named_struct(F.lit("last"), o["pos"].cast("long"), F.lit("ops"), F.concat(acc["ops"], F.repeat(F.lit("D"), gap.cast("int")), F.lit("M")))
        return F.when(o.isNull(), F.named_struct(F.lit("last"), acc["last"], F.lit("ops"), F.concat(acc["ops"], F.lit("I")))).otherwise(match)

    return F.aggregate(_c(origins), start, step)["ops"]


def run_lengths(text) -> Column:
    """Run-length encoding of a string: array of struct(value, n)."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"((.)\2*)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(first_n(r, 1).alias("value"), F.length(r).alias("n")))


def cigar(origins, is_revcomp=None) -> Column:
    text = F.array_join(F.transform(run_lengths(cigar_ops(origins)), lambda r: F.concat(r["n"].cast("string"), r["value"])), "")
    return text if is_revcomp is None else F.when(_c(is_revcomp), F.raise_error(F.lit("CIGAR needs the forward strand"))).otherwise(text)


def sam_line(name, seq, origins) -> Column:
    """SAM record of one forward read: flag 0, reference g{node}, 1-based position, quality 255, CIGAR."""
    return F.concat_ws("\t", _c(name), F.lit("0"), F.concat(F.lit("g"), origin_node(origins).cast("string")), (origin_pos(origins) + 1).cast("string"), F.lit("255"), cigar(origins), F.lit("*"), F.lit("0"), F.lit("0"), _c(seq), F.lit("*"))


def paf_line(*_args) -> Column:
    raise NotImplementedError("PAF output has no defined form")


def aligned_rows(*_args) -> Column:
    raise NotImplementedError("aligned rows have no defined form")


# ---- lists


def same_set(a, b) -> Column:
    return (F.size(F.array_except(_c(a), _c(b))) == 0) & (F.size(F.array_except(_c(b), _c(a))) == 0)


def single_value(values) -> Column:
    """The one value that all elements have, else null."""
    v = _c(values)
    return F.when(F.array_min(v) == F.array_max(v), F.array_min(v))


def jaccard(a, b) -> Column:
    x, y = _c(a), _c(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def overlap_share(a, b) -> Column:
    x, y = _c(a), _c(b)
    return F.size(F.array_intersect(x, y)) / F.size(y)
