"""Streams that fit a task, whole in one scan, against the way over tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from laggard.operators import copula, marginals, pattern_em, whole_em
from laggard.operators.whole import by_length
from laggard.operators.whole_em import thousandths

IS_ORD = [False, True, True]
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def wide(spark):
    """Streams of 1 to 300 rows with ties, gaps, a column without values and rows without a stream."""
    rng, rows = np.random.default_rng(5), []
    for s, n in enumerate([1, 2, 3, 40, 300, 90]):
        for t in range(n):
            a, b, c = float(np.round(rng.normal(), 1)), float(rng.integers(3)), float(rng.integers(6))
            rows.append((s, t, None if s == 5 or rng.random() < 0.4 else a, None if rng.random() < 0.3 else b, None if rng.random() < 0.3 else c))
    rows += [(None, t, 1.0, 2.0, 3.0) for t in range(4)]
    return spark.createDataFrame(rows, "stream_id long, t long, a double, b double, c double").repartition(7).checkpoint()


def cells_of(df):
    return df.select("stream_id", "t", F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("v")) for i, c in enumerate(COLS)])))


def near(x, y):
    return (x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-9)


def test_scores_and_intervals_equal_those_of_cells(wide):
    short, long, rest = by_length(wide, ["stream_id"])
    assert long is None and rest.count() == 4
    cells = cells_of(wide).where("v IS NOT NULL")
    n = wide.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_rows"))
    z = {(r.stream_id, r.t): r.z for r in marginals.cont_latent(cells.where("col = 0"), n).collect()}
    iv = {(r.stream_id, r.t, r.col): (r.lo, r.hi) for r in marginals.ord_interval(cells.where("col > 0")).collect()}
    got = whole_em.latent_scan(short, COLS, IS_ORD, keep=["c"]).collect()
    assert len(got) == 436
    for r in got:
        assert near(r.z0, z.get((r.stream_id, r.t)))
        for j in (1, 2):
            lo, hi = iv.get((r.stream_id, r.t, j), (None, None))
            assert near(r[f"lo{j}"], lo) and near(r[f"hi{j}"], hi)


def fit_rows(wide):
    rows = whole_em.latent_scan(wide.where("stream_id IS NOT NULL AND stream_id > 2"), COLS, IS_ORD, keep=COLS)
    inf = F.lit(math.inf)
    rows = rows.select("stream_id", "t", *COLS, F.array("z0", *[F.when(F.col(f"lo{j}").isNotNull(), 0.0) for j in (1, 2)]).alias("z"),
                       F.array(-inf, *[F.coalesce(f"lo{j}", -inf) for j in (1, 2)]).alias("lo"), F.array(inf, *[F.coalesce(f"hi{j}", inf) for j in (1, 2)]).alias("hi"))
    return copula.initial_latent(rows, 3, IS_ORD, seed=3)


@pytest.mark.parametrize("sweeps", [1, 2])
def test_whole_streams_equal_long_ones(wide, sweeps):
    rows = fit_rows(wide).checkpoint()
    whole, sigma = pattern_em.fit_offline(rows, 3, IS_ORD, num_ord_updates=sweeps)
    long, want = pattern_em.fit_offline(rows, 3, IS_ORD, num_ord_updates=sweeps, whole=0)
    mixed, _ = pattern_em.fit_offline(rows, 3, IS_ORD, num_ord_updates=sweeps, whole=100, keep=["c"])
    want = {r.stream_id: r for r in want.collect()}
    assert {r.stream_id for r in sigma.collect()} == set(want) == {3, 4, 5}
    for r in sigma.collect():
        assert r.rounds == want[r.stream_id].rounds and np.allclose(r.sigma, want[r.stream_id].sigma, atol=1e-9)
    long = {(r.stream_id, r.t): r.z_imp for r in long.collect()}
    for got in (whole, mixed):
        got = {(r.stream_id, r.t): r.z_imp for r in got.collect()}
        assert set(got) == set(long) and all(np.allclose(got[k], long[k], atol=1e-9) for k in got)


def test_rounds_start_no_jobs(spark, wide):
    """A round of the EM used to write and send the rows again: three jobs or more each."""
    rows = fit_rows(wide).checkpoint()
    spark.sparkContext.setJobGroup("em", "")
    try:
        z_imp, sigma = pattern_em.fit_offline(rows, 3, IS_ORD, max_iter=12, tol=0.0)
        assert z_imp.count() == 430 and {r.rounds for r in sigma.collect()} == {12}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("em")) < 16


def test_imputed_rows_equal_imputed_cells(wide):
    rows = fit_rows(wide)
    z_imp, _ = pattern_em.fit_offline(rows, 3, IS_ORD, dealt=True, keep=COLS)
    got = marginals.impute_rows(z_imp, COLS, IS_ORD).checkpoint()
    cells = got.select("stream_id", "t", F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("v"), F.get("z_imp", F.lit(i)).alias("z"))
                                                            for i, c in enumerate(COLS)]))).withColumn("q", marginals.phi_col("z"))
    x, med = marginals.impute_with_medians(cells, cells.where("v IS NOT NULL").select("stream_id", "t", "col", "v"), {0: "cont", 1: "ord", 2: "ord"}, "q")
    x = {(r.stream_id, r.t, r.col): r.x_imp for r in x.collect()}
    med = {(r.stream_id, r.col): r.med for r in med.collect()}
    assert (5, 0) not in med
    for r in got.collect():
        for i in range(3):
            assert near(r.x_imp[i], x.get((r.stream_id, r.t, i))) and near(r.med[i], med.get((r.stream_id, i)))


def test_thousandths_round_half_even(spark):
    x = [0.0005, 0.0015, 0.0025, 1.0005, 2.6755, 3.9995, -0.0005, 17.0, 8.12349999999, 0.3]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.bround("x", 3)).collect()]
    assert thousandths(np.array(x)).tolist() == want
