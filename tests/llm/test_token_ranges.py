"""Token files above the size that is read whole: ranges of one length, whatever the number of ids."""

import numpy as np
import pytest

from helixframe.llm import token_counts


def brute(ids, eod):
    out, n = [], 0
    for x in ids:
        if x == eod:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


@pytest.mark.parametrize("width", [2, 4])
def test_a_prime_number_of_ids(spark, tmp_path, monkeypatch, width):
    """200,003 ids are four ranges of 64 Ki ids, not one for each id."""
    monkeypatch.setattr(token_counts, "WHOLE_BYTES", 1000)
    ids = np.random.default_rng(1).integers(0, 300, 200_003).astype("<u2" if width == 2 else "<u4")
    ids.tofile(tmp_path / "a.bin")
    ids[:100].tofile(tmp_path / "b.bin")
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), 200_003 * width)], "file string, length long")
    got = sorted((r.block, len(r.data)) for r in token_counts._ranges(files, width, 1 << 16).collect())
    assert got == [(i, width << 16) for i in range(3)] + [(3, (200_003 - (3 << 16)) * width)]
    cut_up = token_counts._ranges(files, width, 1 << 16).selectExpr("file", "block", "data")
    counts = {r.ordinal: r.n_tokens for r in token_counts.count_tokens(cut_up, 7, width).collect()}
    assert [counts[i] for i in range(len(counts))] == brute(ids.tolist(), 7)
    both = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), width), 7, width).collect()
    by = {}
    for r in sorted(both, key=lambda r: r.ordinal):
        by.setdefault(r.file.rpartition("/")[2], []).append(r.n_tokens)
    assert by == {"a.bin": brute(ids.tolist(), 7), "b.bin": brute(ids[:100].tolist(), 7)}


def test_no_whole_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "WHOLE_BYTES", 10)
    (tmp_path / "a.bin").write_bytes(b"x" * 101)
    with pytest.raises(ValueError, match="no whole ids"):
        token_counts.read_token_files(spark, str(tmp_path))
