"""The mix against a schedule that is worked out slot by slot."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing


def brute(sizes, slots, phi):
    """Blocks by source and slot of each: (block size, {(source, block): slot})."""
    want = mixing.targets(sizes)
    block = max(1, -(-int(sum(want)) // slots))
    need = [-(-int(t + 0.5) // block) for t in want]
    taken, out = [0] * len(sizes), {}
    for t in range(1, sum(need) + 1):
        x, run = (t * phi) % 1, 0.0
        for i, w in enumerate(want):
            run += w / sum(want)
            if x < run or i == len(want) - 1:
                break
        if taken[i] < need[i]:
            out[i, taken[i]] = t
            taken[i] += 1
    at = sum(need)
    for i, n in enumerate(need):
        for b in range(taken[i], n):
            at += 1
            out[i, b] = at
    return block, out


@pytest.mark.parametrize(("phi", "slots"), [(mixing.PHI, 40), (0.1234, 40), (mixing.PHI, 1 << 17)])
def test_slots_of_sources_of_one_document(spark, phi, slots):
    """A source of one document takes it from its first block on: its slots are those of the source."""
    sizes = [300, 7, 120, 0, 55, 1]
    df = spark.createDataFrame([(i, f"s{i}", z) for i, z in enumerate(sizes)], "doc_id long, source string, z long").withColumn("text", F.lit("x"))
    got = {r.doc_id: r for r in mixing.mix(df, size=F.col("z"), phi=phi, slots=slots).collect()}
    block, plan = brute(sizes, slots, phi)
    want = mixing.targets(sizes)
    for i, z in enumerate(sizes):
        own = [t for (j, _), t in plan.items() if j == i]
        assert got[i].taken == int(want[i] + 0.5) and got[i].first_slot == min(own, default=None)
        # a document that is taken twice may share the block in which its second time begins
        twice = got[i].taken > z and z % block != 0
        assert got[i].n_slots == len(own) + twice


def test_schedule_decides_when(spark):
    """Another phi moves the slots and leaves the words; each slot takes a block, a source's blocks follow each other."""
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randrange(0, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, z long").withColumn("text", F.col("doc_id").cast("string"))
    a, b = ({r.doc_id: r for r in mixing.mix(df, size=F.col("z"), phi=phi, slots=200).collect()} for phi in (mixing.PHI, 0.1234))
    assert all(a[i].taken == b[i].taken and a[i].n_slots == b[i].n_slots for i in a)
    assert sum(a[i].first_slot != b[i].first_slot for i in a if a[i].taken) > 200
    assert all((a[i].first_slot is None) == (a[i].taken == 0) and a[i].taken <= 2 * a[i].size for i in a)
    plan = mixing.schedule(spark, [50.0, 30.0, 20.0], [50, 30, 20]).collect()
    assert sorted((r.i, r.block) for r in plan) == [(i, k) for i, n in enumerate((50, 30, 20)) for k in range(n)] and len({r.t for r in plan}) == 100
    for i in range(3):
        own = sorted((r.block, r.t) for r in plan if r.i == i)
        assert [t for _, t in own] == sorted(t for _, t in own)
        # low discrepancy: a source's slots stay near their even places
        n = len(own)
        assert max(abs(t - (k + 0.5) * 100 / n) for k, t in own) < 4 * 100 / n
