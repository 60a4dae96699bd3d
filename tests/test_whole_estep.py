"""The E-step of streams that fit a task, and tasks of the change test."""

import numpy as np
from pyspark.sql import functions as F

from laggard.operators import change, copula, pattern_em
from tests.test_pattern_em import rows_of


def test_estep_in_one_scan_equals_joined_regressions(spark):
    """Rows used to be joined to a regression of p x p numbers each."""
    is_ord = [False, True, True]
    df, _ = rows_of(spark, is_ord, 70, streams=(1, 2, 3))
    df = df.unionByName(df.where("stream_id = 1").withColumn("stream_id", F.lit(None).cast("long"))).checkpoint()
    s0 = copula.initial_sigma(df, 3).where("stream_id < 3").checkpoint()      # the third stream has no Sigma
    scan = pattern_em.expect(df, s0, 3, is_ord, sweeps=2)
    plan = pattern_em.expect(df.where("stream_id IS NOT NULL"), s0, 3, is_ord)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    by = lambda d: {(r.stream_id, r.t): r for r in d.collect()}
    got, want = by(scan), by(pattern_em.expect(df, s0, 3, is_ord, sweeps=2, whole=0))
    assert len(got) == 140 and set(got) == set(want)
    number = lambda a: np.array([np.nan if x is None else x for x in a])
    for k, w in want.items():
        assert got[k].pattern == w.pattern
        assert all(np.allclose(number(got[k][c]), number(w[c]), atol=1e-9, equal_nan=True) for c in ("z", "z_imp", "c_diag", "v"))


def test_windows_are_dealt_to_all_tasks(spark):
    """The replicas' own partitioning was dropped after the join by the same keys, so that few bytes became few tasks."""
    rng = np.random.default_rng(3)
    rows = [(s, t // 20, t, rng.normal(size=2).tolist()) for s in range(6) for t in range(80)]
    d = spark.createDataFrame(rows, "stream_id long, win long, t long, z array<double>").checkpoint()
    r = change.change_test(d, copula.initial_sigma(d, 2), 2, nsample=10)
    assert r.count() == 24
    tree = r._jdf.queryExecution().executedPlan().toString()
    assert tree.count("REPARTITION_BY_NUM") >= 1 and r.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_replicas_without_ordinals_equal_one_by_one():
    sigma, counts = np.array([[1.0, 0.4], [0.4, 1.0]]), [("00", 20), ("01", 7), ("10", 6), ("11", 2)]
    got = change.replicas([np.random.default_rng(k) for k in range(5)], sigma, counts, [None, None])
    assert np.allclose(got, [change.replica(np.random.default_rng(k), sigma, counts, [None, None]) for k in range(5)], atol=1e-12)
