"""Ranks within windows by counting against windows that are really built."""

import numpy as np
import pytest

from laggard.operators import marginals
from laggard.operators import window_ranks as wr


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 200])
def test_count_below(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 9, 1000):
        values = rng.integers(0, top, n)
        upto, below = rng.integers(0, n + 1, 300), rng.integers(0, top + 3, 300)
        want = [int((values[:a] < b).sum()) for a, b in zip(upto, below, strict=True)]
        assert wr.count_below(values, upto, below).tolist() == want


def cells(spark):
    rng = np.random.default_rng(4)
    rows = [(s, int(t), c, float(rng.normal()) if c == 0 else float(rng.integers(0, 3)) if c == 1 else 7.0)
            for s, n in ((1, 150), (2, 40), (3, 1)) for c in range(3) for t in np.sort(rng.choice(3 * n, n, replace=False))]
    return spark.createDataFrame(rows, "stream_id long, t long, col int, v double").repartition(4)


@pytest.mark.parametrize(("w", "side"), [(1, 8), (10, 8), (60, 16), (1000, 8), (25, 4096)])
def test_counts_equal_built_windows(spark, w, side):
    c = cells(spark)
    want = {(r.stream_id, r.col, r.t): (len(r.win), sum(a <= r.v for a in r.win), sum(a < r.v for a in r.win))
            for r in marginals.window_values(c, w).collect()}
    got = {(r.stream_id, r.col, r.t): (r.win_n, r.win_le, r.win_lt) for r in wr.window_counts(c, w, side=side).collect()}
    assert got == want
    assert wr.window_counts(c.where("false"), w).count() == 0


def test_latents_equal_the_short_form(spark):
    c = cells(spark)
    for long, short, cols in ((wr.long_window_cont_latent, marginals.window_cont_latent, ["z"]), (wr.long_window_ord_interval, marginals.window_ord_interval, ["lo", "hi"])):
        key = lambda df: {(r.stream_id, r.col, r.t): [r[k] for k in cols] for r in df.collect()}  # noqa: E731, B023
        assert key(long(c, 12)) == key(short(c, 12))


def test_hot_column_and_long_windows(spark):
    """One column with one value in a third of its cells, windows of 10,000: places and ranks spread over many blocks."""
    df = spark.range(60_000).selectExpr("1L AS stream_id", "id AS t", "0 AS col", "CASE WHEN id % 3 = 0 THEN 5.0D ELSE (id * 7919 % 1000) / 100.0D END AS v")
    v = np.array([5.0 if i % 3 == 0 else (i * 7919 % 1000) / 100.0 for i in range(60_000)])
    got = {r.t: (r.win_n, r.win_le, r.win_lt) for r in wr.window_counts(df, 10_000).where("t % 997 = 0").collect()}
    for t, (n, le, lt) in got.items():
        win = v[max(0, t - 9999):t + 1]
        assert (n, le, lt) == (len(win), int((win <= v[t]).sum()), int((win < v[t]).sum()))
    assert len(got) == 61
