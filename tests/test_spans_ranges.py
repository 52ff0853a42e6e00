"""Running totals, overlapping spans and FASTA by byte ranges against brute force."""

import random
from collections import Counter

import pytest

from helixframe.operators import spans
from helixframe.sources import ranges


@pytest.mark.parametrize("parts", [1, 7])
def test_running_total(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.randrange(4), rng.choice([None, 0, 1, 5, 2**40])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, v long").repartition(parts)
    want, total = {}, 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += v or 0
    assert {r.id: r.before for r in spans.running_total(df, ["g", "id"], "v").collect()} == want
    for target in (0, 1, 2**41, total, total + 1):
        assert {r.id for r in spans.up_to(df, ["g", "id"], "v", target).collect()} == {i for i, b in want.items() if b < target}
    assert spans.running_total(df.limit(0), ["id"], "v").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps(spark, seed):
    rng = random.Random(seed)
    span = lambda: (a := rng.randrange(-500, 500), a + rng.choice([-3, 0, 1, 2, 3, 7, 8, 9, 64, 500, 4000]))
    a = [(i, rng.choice(["x", "y", None]), *span()) for i in range(120)] + [(900, "x", None, 5), (901, "x", 0, 2**40)]
    b = [(i, rng.choice(["x", "y"]), *span()) for i in range(120)] + [(900, "x", -(2**40), 2**40), (901, "y", 3, None)]
    da, db = spark.createDataFrame(a, "i long, k string, lo long, hi long"), spark.createDataFrame(b, "j long, k string, s long, t long")
    ok = lambda x, y: None not in (*x[2:], *y[2:]) and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]) and x[2] < x[3] and y[2] < y[3]
    got = Counter((r.i, r.j) for r in spans.overlaps(da, db, ["k"], ("lo", "hi"), ("s", "t")).collect())
    assert got == Counter((x[0], y[0]) for x in a for y in b if ok(x, y))
    assert spans.overlaps(da.limit(0), db, ["k"], ("lo", "hi"), ("s", "t")).count() == 0


FILES = {
    "a.fa": b">r0 first read\nACGTAC\nGTTTACG\n>r1\n\n>r2 " + b"long name " * 9 + b"\nACGT" + b"GATTACA" * 30 + b"\r\n" + b"CC\n>r3\nA",
    "b.fa": b"",
    "c.fa": b"TTTT\n>r4\nACGTACGTAC\n\n\nAC GT\n>r5\nAC>GT\n",
    "d.fa": b">r6\n" + b"ACGGT" * 100,
}


def whole():
    out, names = [], []
    for name in sorted(FILES):
        lines = FILES[name].split(b"\n")
        for x in lines:
            if x.startswith(b">"):
                names.append(x[1:].strip().decode())
                out.append("")
            elif out and (name != "c.fa" or len(out) > 4):
                out[-1] += "".join(x.decode().split())
    return out, names


@pytest.mark.parametrize("size", [1, 2, 5, 17, 64, 1 << 20])
def test_fasta_by_ranges(spark, tmp_path, size):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    seqs, names = whole()
    got = ranges.pieces(spark, str(tmp_path), 4, size).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert set(by) == set(range(len(seqs)))
    for i, rows in by.items():
        rows.sort(key=lambda r: (r.at, r.n))
        assert "".join(r.seq[: r.n] for r in rows) == seqs[i] and max(r.name or "" for r in rows) == names[i]
        at = 0
        for r in rows:
            assert r.at == at and r.seq == seqs[i][at : at + r.n + 3][: len(r.seq)] and (r.n == 0 or len(r.seq) == min(r.n + 3, len(seqs[i]) - at))
            at += r.n
    if size in (5, 64):
        want = Counter(s[i : i + 4] for s in seqs for i in range(len(s) - 3))
        assert {r.kmer: r.n for r in ranges.kmer_counts(spark, str(tmp_path), 4, size).collect()} == want
        assert {r.record_id: (r.name, r.bases) for r in ranges.records(spark, str(tmp_path), size).collect()} == {i: (n, len(s)) for i, (n, s) in enumerate(zip(names, seqs, strict=True))}
