"""Scores of wide rows in one scan, and window shares that are counted once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laggard.operators import marginals


@pytest.fixture(scope="module")
def rows(spark):
    rng, rows = np.random.default_rng(9), []
    for s, n in ((1, 1), (2, 7), (3, 200), (None, 5)):
        rows += [(s, t, None if rng.random() < 0.2 else float(np.round(rng.normal(), 1)), int(rng.integers(4)), [float(t)], f"{s}-{t}") for t in range(n)]
    return spark.createDataFrame(rows, "stream_id long, t long, a double, b int, x array<double>, name string").repartition(5).checkpoint()


def test_wide_scores_equal_those_by_value(rows):
    got = {r.name: r for r in marginals.latent_columns(rows, ["stream_id"], ["a", "b"], latent_sd=2.0, whole=100).collect()}
    want = {r.name: r for r in marginals._latent_by_value(rows, ["stream_id"], ["a", "b"], "z_", 2.0).collect()}
    assert set(got) == set(want) and len(got) == 213
    for k, w in want.items():
        for c in w.asDict():
            a, b = got[k][c], w[c]
            assert a == b or (c.startswith("z_") and a is not None and b is not None and abs(a - b) < 1e-12), (k, c)


def test_wide_scores_send_rows_once(rows):
    """They were joined to their scores, column by column."""
    plan = marginals.latent_columns(rows.where("stream_id IS NOT NULL"), ["stream_id"], ["a", "b"], whole=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan


def test_window_shares_are_counted_once(rows):
    """The quantile's text named the counts of a window some forty times."""
    cells = rows.where("a IS NOT NULL AND stream_id IS NOT NULL").select("stream_id", "t", F.lit(0).alias("col"), F.col("a").alias("v"))
    d = marginals.window_ord_interval(cells, 4)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 2
    by = {}
    for r in cells.orderBy("stream_id", "t").collect():
        by.setdefault(r.stream_id, []).append((r.t, r.v))
    got = {(r.stream_id, r.t): (r.lo, r.hi) for r in d.collect()}
    assert len(got) == cells.count()
    from statistics import NormalDist
    inv = lambda q: -np.inf if q <= 0 else np.inf if q >= 1 else NormalDist().inv_cdf(q)
    for s, seq in by.items():
        for i, (t, v) in enumerate(seq):
            win = [x for _, x in seq[max(0, i - 3):i + 1]]
            want = (-np.inf, np.inf) if len(set(win)) == 1 else tuple(inv(sum(f) / len(win)) for f in ([x < v for x in win], [x <= v for x in win]))
            assert all(g == w or abs(g - w) < 1e-9 for g, w in zip(got[s, t], want, strict=True))
