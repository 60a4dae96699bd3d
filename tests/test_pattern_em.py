"""The EM by missing patterns against a loop over rows in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laggard.operators.copula import expect_block, initial_sigma, project_to_correlation, truncnorm_mv
from laggard.operators import pattern_em


def rows_of(spark, is_ord, n=160, seed=1, streams=(1, 2)):
    rng = np.random.default_rng(seed)
    p, rows, data = len(is_ord), [], {}
    for s in streams:
        a = rng.normal(size=(p, p))
        x = rng.multivariate_normal(np.zeros(p), project_to_correlation(a @ a.T), n)
        z, lo, hi = x.copy(), np.full((n, p), -np.inf), np.full((n, p), np.inf)
        for j in np.flatnonzero(is_ord):
            edges = np.array([-np.inf, -0.5, 0.7, np.inf])
            k = np.digitize(x[:, j], edges[1:-1])
            lo[:, j], hi[:, j] = edges[k], edges[k + 1]
            z[:, j] = np.clip((np.clip(lo[:, j], -2, 2) + np.clip(hi[:, j], -2, 2)) / 2, -2, 2)
        z[rng.random((n, p)) < 0.3] = np.nan
        z[0] = np.nan
        data[s] = z, lo, hi
        rows += [(s, t, [None if np.isnan(v) else float(v) for v in z[t]], lo[t].tolist(), hi[t].tolist()) for t in range(n)]
    return spark.createDataFrame(rows, "stream_id long, t long, z array<double>, lo array<double>, hi array<double>").repartition(5), data


def plain_em(z, lo, hi, is_ord, sweeps=1, tol=0.01, most=50):
    p = z.shape[1]
    cov = np.cov(np.nan_to_num(z), rowvar=False)
    sigma = project_to_correlation(cov)
    for k in range(1, most + 1):
        c, full, z, _ = expect_block(z, lo, hi, np.array(is_ord), sigma, sweeps)
        new = project_to_correlation(np.cov(full, rowvar=False) + c / len(z))
        change = np.linalg.norm(new - sigma) / np.linalg.norm(sigma)
        sigma = new
        if change < tol:
            break
    return full, sigma, k


@pytest.mark.parametrize(("is_ord", "sweeps"), [([False] * 3, 1), ([False, True, False, True], 1), ([True, True], 2)])
def test_em_equals_a_loop_in_one_task(spark, is_ord, sweeps):
    df, data = rows_of(spark, is_ord)
    rows, sigma = pattern_em.fit_offline(df, len(is_ord), is_ord, num_ord_updates=sweeps)
    got = {(r.stream_id, r.t): r.z_imp for r in rows.collect()}
    assert len(got) == df.count()
    for r in sigma.collect():
        full, want, rounds = plain_em(*data[r.stream_id], is_ord, sweeps)
        assert r.rounds == rounds and np.allclose(np.reshape(r.sigma, want.shape), want, atol=1e-9)
        assert np.allclose([got[r.stream_id, t] for t in range(len(full))], full, atol=1e-8)


def test_diagonal_and_refreshed_cells_equal_blocks(spark):
    is_ord = [False, True, True]
    df, data = rows_of(spark, is_ord, 60)
    s0 = initial_sigma(df, 3).checkpoint()
    sigma = {r.stream_id: np.reshape(r.sigma, (3, 3)) for r in s0.collect()}
    got = {(r.stream_id, r.t): r for r in pattern_em.expect(df, s0, 3, is_ord).collect()}
    mean = {r.stream_id: np.reshape(r.c, (3, 3)) for r in pattern_em.expected_covariance(df, s0, 3, is_ord).collect()}
    for s, (z, lo, hi) in data.items():
        c, full, fresh, diagonal = expect_block(z, lo, hi, np.array(is_ord), sigma[s])
        assert np.allclose(mean[s], c / len(z), atol=1e-10)
        for t in range(len(z)):
            r = got[s, t]
            assert np.allclose(r.z_imp, full[t], atol=1e-10) and np.allclose(r.c_diag, diagonal[t], atol=1e-10)
            assert np.allclose([np.nan if v is None else v for v in r.z], fresh[t], atol=1e-10, equal_nan=True)


def test_rows_that_never_change_are_not_read_again(spark, monkeypatch):
    """Without ordinals a round sees patterns only: sums are taken once."""
    df, _ = rows_of(spark, [False] * 3)
    calls = []
    own = pattern_em.sums
    monkeypatch.setattr(pattern_em, "sums", lambda *a: calls.append(1) or own(*a))
    monkeypatch.setattr(pattern_em, "refresh", None)
    _, sigma = pattern_em.fit_offline(df, 3, [False] * 3)
    assert len(calls) == 1 and max(r.rounds for r in sigma.collect()) > 2


def test_no_rows(spark):
    df, _ = rows_of(spark, [False, True], 5)
    rows, sigma = pattern_em.fit_offline(df.where("false"), 2, [False, True])
    assert rows.count() == 0 and sigma.count() == 0


def test_moments_in_far_intervals(spark):
    cases = [(-1.0, 2.0), (float("-inf"), 0.3), (1.2, float("inf")), (8.0, 9.0), (-9.0, -8.5), (6.0, float("inf")), (float("-inf"), float("inf")), (50.0, 51.0), (1.0, 1.0)]
    df = spark.createDataFrame(cases, "a double, b double").select("a", "b", F.expr(pattern_em.moments("a", "b")).alias("m"))
    for a, b, m in df.collect():
        want = truncnorm_mv(a, b)
        assert [m["mean"], m["var"]] == [None, None] if np.isnan(want[0]) else np.allclose([m["mean"], m["var"]], want, atol=1e-9)


def test_one_round_without_ordinals_leaves_rows_alone(spark, monkeypatch):
    """Sums of rows that nothing refreshes are taken without a regression beside each row."""
    df, data = rows_of(spark, [False] * 3, 60)
    s0 = initial_sigma(df, 3).checkpoint()
    monkeypatch.setattr(pattern_em, "refresh", None)
    got = {r.stream_id: r for r in pattern_em.expected_covariance(df, s0, 3, [False] * 3).collect()}
    for r in s0.collect():
        z, lo, hi = data[r.stream_id]
        c, full, _, _ = expect_block(z, lo, hi, np.zeros(3, dtype=bool), np.reshape(r.sigma, (3, 3)))
        assert np.allclose(np.reshape(got[r.stream_id].c, (3, 3)), c / len(z), atol=1e-10)
        assert np.allclose(np.reshape(got[r.stream_id].sigma, (3, 3)), project_to_correlation(np.cov(full, rowvar=False) + c / len(z)), atol=1e-10)


def test_refresh_by_blocks_of_rows(spark):
    """Rows are refreshed as matrices: cells stay null, other columns stay, rows without intervals keep their values."""
    df = spark.createDataFrame([(1, [0.5, None], [None, None], [None, None], [0.0] * 4, [None, None]),
                                (2, [0.5, 0.1], [None, -1.0], [None, 1.0], [0.0, 0.0, 0.6, 0.0], [None, 0.64]),
                                (3, [0.5, 0.1], None, None, [0.0, 0.0, 0.6, 0.0], [None, 0.64])],
                               "t long, z array<double>, lo array<double>, hi array<double>, gain array<double>, spread array<double>")
    d = pattern_em.refresh(df, 2)
    assert "ArrowMap" in d._jdf.queryExecution().toString() or "MapInArrow" in d._jdf.queryExecution().toString()
    got = {r.t: r for r in d.collect()}
    mean, var = truncnorm_mv((-1 - 0.3) / 0.8, (1 - 0.3) / 0.8)
    assert got[1].z == [0.5, None] and got[1].v == [0.0, 0.0] and got[3].z == [0.5, 0.1] and got[3].v == [0.0, 0.0]
    assert np.allclose(got[2].z, [0.5, 0.3 + 0.8 * mean]) and np.allclose(got[2].v, [0.0, 0.64 * var])
