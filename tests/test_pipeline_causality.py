"""The drift pipeline looks at nothing later than the row it predicts; its stages one by one."""

import numpy as np
import pytest

from laggard.operators.density import (arrived, class_probability, fuse_views, guard, linear_self_training, peaks, propagate_soft,
                                       propagation_rounds, sliding_windows, structure_labels, window_class_sums)
from laggard.operators.learner import FtrlParams, FtrlState, carried_class_matrix, speculative_learner
from laggard.plans import m5, pipeline
from laggard.sources.params import PROFILE_SCHEMA
from tests.conftest import SF

N, CUT = 42, 26


def stream(spark, flip_from=None, move_from=None):
    rng = np.random.default_rng(3)
    rows = []
    for s in (1, 2):
        x = rng.normal(size=(N, 3))
        y = (x[:, 0] + 0.3 * rng.normal(size=N) > 0).astype(int)
        for t in range(N):
            label = 1 - y[t] if flip_from is not None and t >= flip_from else y[t]
            shift = 5.0 if move_from is not None and t >= move_from else 0.0
            rows.append((s, t, *[float(v) + shift for v in x[t]], int(label)))
    return spark.createDataFrame(rows, "stream_id long, t long, x0 double, x1 double, x2 double, y int")


def run(spark, **kw):
    third = spark.createDataFrame([("third", 4, 0.01, 2, 3, False)], PROFILE_SCHEMA)
    return {(r.stream_id, r.t, r.method): r.prob for r in pipeline.predictions(stream(spark, **kw), profiles=third, dataset="third").collect()}


def test_predictions_do_not_know_the_future(spark):
    base = run(spark)
    assert len(base) == 2 * N * 6
    late_labels = run(spark, flip_from=CUT)
    late_rows = run(spark, move_from=CUT)
    for (s, t, m), p in base.items():
        if t < CUT + pipeline.D:
            assert late_labels[s, t, m] == p, (s, t, m)
        if t < CUT:
            assert late_rows[s, t, m] == p, (s, t, m)
    assert any(late_labels[k] != p for k, p in base.items()) and any(late_rows[k] != p for k, p in base.items())


def test_window_knows_arrived_labels_only(spark):
    df = spark.createDataFrame([(1, t, t % 2) for t in range(12)], "stream_id long, pos long, y_obs int")
    for r in arrived(sliding_windows(df, 6, 1), 4).collect():
        assert (r.y_obs is not None) == (r.pos <= r.win - 4)


def test_speculation_never_writes_back(spark):
    rng = np.random.default_rng(4)
    n, d, prm = 50, 4, FtrlParams()
    x = np.hstack([np.ones((n, 1)), rng.normal(size=(n, 2))])
    y = (x[:, 1] > 0).astype(int)
    soft = rng.random((n, n))
    rows = spark.createDataFrame([(1, t, x[t].tolist(), [(k, float(soft[t, k])) for k in range(max(0, t - 6), t)]) for t in range(n)],
                                 "stream_id long, t long, x array<double>, spec array<struct<t:bigint,p:double>>")
    arr = spark.createDataFrame([(1, t + d, t, int(y[t])) for t in range(n - d) if t % 3], "stream_id long, t_arrive long, t_orig long, y int")
    got = {r.t: r for r in speculative_learner(rows, arr, d).collect()}
    st = FtrlState(3, prm)
    for t in range(n):
        if t >= d and (t - d) % 3:
            st.fit(x[t - d].tolist(), float(y[t - d]), prm)
        spec = FtrlState(3, prm)
        for k in FtrlState.__slots__:
            v = getattr(st, k)
            setattr(spec, k, list(v) if isinstance(v, list) else v)
        for k in range(max(0, t - d + 1), t):
            spec.fit_soft(x[k].tolist(), float(soft[t, k]), prm)
        a, b = (np.array(s.weights(3, prm)) @ x[t] for s in (st, spec))
        sig = lambda m: 1 / (1 + np.exp(-m))
        assert got[t].prob == pytest.approx(sig(a)) and got[t].prob_spec == pytest.approx(sig(b))
        assert got[t].prob_blend == pytest.approx(sig((a + b) / 2))


def test_carried_matrix_moves_and_stays_row_stochastic(spark):
    rows = m5.st22_carried_class_matrix(spark, SF.replace("0.001", "0.01")).collect()
    assert len({(r.m0, r.m3) for r in rows}) > 10
    assert all(abs(r.m0 + r.m1 - 1) < 2e-6 and abs(r.m2 + r.m3 - 1) < 2e-6 for r in rows)


def test_class_sums_and_fold_by_hand(spark):
    x = [[-2.0], [-1.0], [1.0], [2.0], [-1.5]]
    y = [0, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, w, t, x[t], y[t] if w else None) for w in (0, 4) for t in range(5)], "stream_id long, win long, t long, x array<double>, y_obs int")
    sums = {r.win: r for r in window_class_sums(df, ("x",)).collect()}
    assert sums[0].n_ok == 0 and sums[0].s == [0.0] * 4
    p = class_probability(np.array(x), np.ones(5, bool), np.array(y, float))
    right = (p > 0.5) == np.array(y)
    want = [[(1 - p)[right & (np.array(y) == k)].sum(), p[right & (np.array(y) == k)].sum()] for k in (0, 1)]
    assert np.allclose(np.reshape(sums[4].s, (2, 2)), want)
    m = {r.win: np.reshape(r.m, (2, 2)) for r in carried_class_matrix(window_class_sums(df, ("x",)), ["stream_id", "view"]).collect()}
    assert np.allclose(m[0], 0.5)
    assert np.allclose(m[4], (0.5 + np.array(want)) / (0.5 + np.array(want)).sum(axis=1, keepdims=True))


@pytest.mark.parametrize("model", ["logistic", "svc", "centroid"])
def test_classifiers_separate(model):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(-2, 0.5, (20, 2)), rng.normal(2, 0.5, (20, 2))])
    y = np.repeat([0.0, 1.0], 20)
    known = np.zeros(40, bool)
    known[[0, 1, 20, 21]] = True
    assert ((class_probability(x, known, y, model) > 0.5) == (y == 1)).all()


def test_logistic_fit_is_stationary():
    from laggard.operators.density import _logistic_fit
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 3)), (rng.random(30) < 0.5).astype(float)
    w = _logistic_fit(x, y, 2.0)
    a = np.hstack([np.ones((30, 1)), x])
    grad = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + np.r_[0, w[1:]] / 2.0
    assert np.abs(grad).max() < 1e-6


def clusters(n=30, seed=7):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(-3, 0.6, (n, 2)), rng.normal(3, 0.6, (n, 2))])
    y = np.full(2 * n, np.nan)
    y[[0, 5, n, n + 7]] = [0, 0, 1, 1]
    return x, y, np.repeat([0.0, 1.0], n)


def test_propagation_labels_clusters():
    x, y, truth = clusters()
    res = peaks(x, 5.0)
    rounds = propagation_rounds(res["parent"], ~np.isnan(y))
    p = propagate_soft(x, res["dist"], res["parent"], rounds, np.nan_to_num(y), np.array([[0.8, 0.2], [0.2, 0.8]]))
    assert ((p > 0.5) == (truth == 1)).all()
    assert np.isnan(propagate_soft(x, res["dist"], res["parent"], rounds, np.zeros(len(x)), np.full((2, 2), 0.5))).all()
    for model in ("svc", "logistic"):
        label, _ = structure_labels([x], [rounds], y, model)
        assert (label == truth).all()
        label, _ = structure_labels([x[:, :1], x[:, 1:]], [rounds, rounds], y, model)
        assert (label == truth).all()


def test_self_training_operator(spark):
    x, y, truth = clusters(10)
    y[:] = np.nan
    y[[0, 3, 10, 13]] = [0, 0, 1, 1]
    df = spark.createDataFrame([(1, 9, t, x[t].tolist(), None if np.isnan(y[t]) else int(y[t])) for t in range(20)]
                               + [(2, 9, t, x[t].tolist(), None) for t in range(20)], "stream_id long, win long, t long, x array<double>, y_obs int")
    got = linear_self_training(df).collect()
    assert [r.label for r in sorted((r for r in got if r.stream_id == 1), key=lambda r: r.t)] == truth.tolist()
    assert all(r.label is None or np.isnan(r.label) for r in got if r.stream_id == 2)


def test_guard_and_fusion():
    assert guard(np.array([0, 1, np.nan])) and not guard(np.array([1, 1, np.nan])) and not guard(np.array([0.0, 1.0]))
    p1, p2 = np.array([0.9, np.nan, 0.2]), np.array([0.4, 0.3, np.nan])
    assert np.allclose(fuse_views(p1, p2), [(0.9 * 0.9 + 0.6 * 0.4) / 1.5, 0.3, 0.2])
    assert np.allclose(fuse_views(p1, p2, "agreement"), [0.9, 0.3, 0.2])
    assert np.allclose(fuse_views(p1, p2, "fixed", weights=(0.6, 0.4)), [0.7, 0.3, 0.2])
    assert np.allclose(fuse_views(p1, p2, "view_quality", (1.0, 0.0)), [0.9, 0.3, 0.2])
    assert 0.4 < fuse_views(p1, p2, "entropy")[0] < 0.9
