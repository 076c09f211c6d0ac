"""Hard negatives against all scores, the bounds of every plane, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxforge.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id long, anchor int, score string, rank int, `a.b` string"


def brute(rows):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    good = [r for r in good if all(abs(x) < 2**24 for x in r[1])]
    chosen = {}
    for r in sorted((r for r in good if r[0] % 100 == 0), key=lambda r: (r[2], r[1])):
        chosen.setdefault(r[0], r)
    dims = max((len(r[1]) for r in chosen.values()), default=0)
    out = []
    for a, va, ca in chosen.values():
        score = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, c) for i, v, c in good if i != a]
        assert dims >= len(va)
        for ps, p, _ in sorted(s for s in score if s[2] == ca)[:5]:
            fits = sorted(s for s in score if s[2] != ca and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            out += [(a, p, k, i, -ps, -s) for k, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def table(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist(), int(i % 4)) for i in range(1, 700)] + [(700 + i, [0.5] * 16, i % 3) for i in range(300)]  # a third of all rows are one vector
    rows += [(0, [0.4] * 16, 1), (1000, [-0.1] * 16, 1), (1100, [0.0] * 16, 2), (1200, [0.3] * 5, 1), (-100, [0.2] * 16, 3), (1300, [], 1)]
    rows += [(5, rows[4][1], 5 % 4)] * 3 + [(0, [0.4] * 16, 1), (0, [9.0] * 16, 2)]  # repeated rows, an anchor's id twice
    rows += [(1400, None, 1), (1500, [0.1] * 16, None), (None, [0.1] * 16, 1), (1600, [None] + [0.1] * 15, 1), (2000, [float("nan")] * 16, 1), (2001, [float("inf")] * 16, 1), (2002, [1e30] * 16, 1), (2003, [2.0] * 30, 1), (2004, [60000.0] * 16, 2)]
    return rows, spark.createDataFrame([(*x, 1, 2, "s", 3, "d") for x in rows], SCHEMA)


@pytest.mark.parametrize("block_bytes", [hn.BLOCK_BYTES, 300])
def test_hard_negatives(spark, block_bytes):
    rows, d = table(spark)
    got = hn.hard_negatives(d.repartition(5), F.col("vec_id") % 100 == 0, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert ", ".join(" ".join(x).replace("bigint", "long") for x in got.dtypes) == hn.SCHEMA
    assert len({x[0] for x in brute(rows)}) > 5


def test_no_rows(spark):
    _, d = table(spark)
    for none in (d.limit(0), d.where("vec_id % 100 <> 0"), d.where("label IS NULL")):
        assert hn.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("large", [1, 1 << 13])
def test_intervals(large):
    """Every plane's bounds hold the score and tighten; dropping by a bound loses none; most pairs are dropped before the last plane."""
    r = np.random.default_rng(1)
    a, rows = (r.normal(size=(7, 64)) * 32 * large).astype(np.int64), (r.normal(size=(900, 64)) * 32 * large).astype(np.int64)
    more, less = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    want, seen, sizes = a @ rows.T, {}, {i: [] for i in range(7)}

    def watch(i, low, high):
        old = seen.get(i, (-np.inf, np.inf))
        assert (low <= want[i]).all() and (want[i] <= high).all() and (low >= old[0]).all() and (high <= old[1]).all()
        seen[i] = low, high
        return np.ones(len(low), bool)

    for i, at, score in hn.sliced_scores(a, more, less, rows, np.ones((7, 900), bool), watch):
        assert (score == want[i, at]).all() and len(at) == 900

    def cut(i, low, high):
        sizes[i].append(len(low))
        return high >= hn.nth(low, 5)

    for i, at, score in hn.sliced_scores(a, more, less, rows, np.ones((7, 900), bool), cut):
        best = np.sort(want[i])[-5:]
        assert set(best) <= set(score) and (score == want[i, at]).all()
    assert all(s[-1] < 90 for s in sizes.values())


def test_windows_of_whole_numbers():
    for p in range(-500, 500, 7):
        lo, hi = hn.window(np.array([p]), 30, 90)
        fits = [n for n in range(-600, 600) if 30 * p <= 100 * n <= 90 * p]
        assert fits == list(range(int(lo[0]), int(hi[0]) + 1))
