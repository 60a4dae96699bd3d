import math

import numpy as np
from pyspark.sql import functions as F

from laggard.operators.learner import FtrlParams, FtrlState, delayed_learner, drift_levels, online_learner


def test_c3_first_ftrl_step():
    """x = [1, 2], y = 1, zero state, LP = 1, L1 = L2 = 0."""
    prm = FtrlParams(decay_choice=4)
    st = FtrlState(2, prm)
    p, loss = st.fit([1.0, 2.0], 1.0, prm)
    assert p == 0.5 and abs(loss - math.log(2)) < 1e-12
    assert st.v == [-0.5, -1.0] and st.h == [0.0, 0.0] and st.z == [-0.5, -1.0]
    assert st.decay == 1.0 and st.r == 2.0
    assert [round(w, 12) for w in st.weights(2, prm)] == [0.25, 0.5]


def _numpy_detector(errs, warm=30):
    times = fails = tw = fw = 0
    pmin, smin, out = 1.0, 10.0, []
    for e in errs:
        times += 1
        fails += e
        lvl = 0
        if times > warm:
            p = fails / times
            s = math.sqrt(p * (1 - p) / times)
            if p + s < pmin + smin:
                pmin, smin = p, s
            if p + s < pmin + 2 * smin:
                tw = fw = 0
            else:
                lvl = 1
                tw += 1
                fw += e
                if p + s > pmin + 3 * smin:
                    lvl = 2
                    times, fails, pmin, smin = tw, fw, 1.0, 10.0
        out.append(lvl)
    return out


def test_c5_detector_matches_independent_loop(spark):
    rng = np.random.default_rng(0)
    errs = [int(rng.random() < (0.1 if i < 200 else 0.6)) for i in range(400)]
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(errs)], "stream_id long, t long, err int")
    got = [r.level for r in drift_levels(df).orderBy("t").collect()]
    assert got == _numpy_detector(errs)
    assert 2 in got[200:]


def test_delayed_learner_matches_python_loop(spark):
    rng = np.random.default_rng(1)
    n, d = 60, 3
    xs = rng.normal(size=(n, 2))
    ys = (xs[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(7, i, [1.0, float(a), float(b)], int(y))
                                  for i, ((a, b), y) in enumerate(zip(xs, ys))],
                                 "stream_id long, t long, x array<double>, y int")
    arr = spark.createDataFrame([(7, i + d, i, int(ys[i])) for i in range(n - d)],
                                "stream_id long, t_arrive long, t_orig long, y int")
    got = {r.t: r.prob for r in delayed_learner(rows, arr, max_delay=d).collect()}
    prm = FtrlParams()
    st = FtrlState(3, prm)
    for t in range(n):
        if t >= d:
            st.fit([1.0, *xs[t - d]], float(ys[t - d]), prm)
        assert abs(st.predict([1.0, *xs[t]], prm) - got[t]) < 1e-12


def test_learner_is_partitioning_invariant(spark):
    from laggard.sources.fixtures import as_array, events_stream
    from tests.conftest import SF
    ev = as_array(events_stream(spark, SF), ["x0", "x1", "x2"], intercept=True)
    a = online_learner(ev.select("stream_id", "t", "x", "y")).select("stream_id", "t", "prob")
    b = online_learner(ev.select("stream_id", "t", "x", "y").repartition(7, "t")).select(
        "stream_id", "t", F.col("prob").alias("p2"))
    j = a.join(b, ["stream_id", "t"])
    assert j.count() == a.count() and j.where("prob != p2").count() == 0


def test_st14_speculation_matches_python_loop(spark):
    from laggard.operators.learner import _copy_state, speculative_learner
    from laggard.functions.logistic import sigmoid_py
    rng = np.random.default_rng(9)
    n, d = 40, 3
    xs = rng.normal(size=(n, 2))
    ys = (xs[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    soft = rng.random(n)
    guesses = [[(k, float(soft[k])) for k in range(max(0, i - d + 1), i) if k % 5] for i in range(n)]
    rows = spark.createDataFrame([(3, i, [1.0, float(a), float(b)], guesses[i]) for i, (a, b) in enumerate(xs)],
                                 "stream_id long, t long, x array<double>, spec array<struct<t:bigint,p:double>>")
    arr = spark.createDataFrame([(3, i + d, i, int(ys[i])) for i in range(n - d)],
                                "stream_id long, t_arrive long, t_orig long, y int")
    got = {r.t: r for r in speculative_learner(rows, arr, max_delay=d).collect()}
    prm = FtrlParams()
    st = FtrlState(3, prm)
    for t in range(n):
        if t >= d:
            st.fit([1.0, *xs[t - d]], float(ys[t - d]), prm)
        x = [1.0, *xs[t]]
        spec = _copy_state(st, prm)
        for k, p in guesses[t]:
            spec.fit_soft([1.0, *xs[k]], p, prm)
        wc, ws = st.weights(3, prm), spec.weights(3, prm)
        assert abs(got[t].prob - sigmoid_py(sum(a * b for a, b in zip(wc, x)))) < 1e-12
        assert abs(got[t].prob_spec - sigmoid_py(sum(a * b for a, b in zip(ws, x)))) < 1e-12


def test_st21_first_minibatch_step(spark):
    """One batch from the zero state: p = 0.5 for every row, g = sum (0.5 - y) x,
    z = g after the update (decay 1, h = 0), next weights = -g / 2."""
    from laggard.streaming.live import STATE_SCHEMA, minibatch_step
    rows = [(1, i, [1.0, float(i % 3)], float(i % 2)) for i in range(10)]
    batch = spark.createDataFrame(rows, "stream_id long, t long, x array<double>, y double")
    preds, state = minibatch_step(batch, spark.createDataFrame([], STATE_SCHEMA), 2)
    assert all(abs(r.prob - 0.5) < 1e-12 for r in preds.collect())
    g = [sum((0.5 - y) * x[j] for _, _, x, y in rows) for j in range(2)]
    s = state.first()
    from laggard.functions.logistic import decay_py
    assert np.allclose(s.z, g) and abs(s.r - 1.0 - decay_py(10, FtrlParams().decay_choice)) < 1e-12
    assert list(s.counts) == [10, 0]  # 0.5 is an error for neither class


def test_st21_with_one_row_a_batch_is_st01():
    """The state update from the aggregated gradient of one row equals the learner's step, through
    warnings and drifts."""
    import pandas as pd

    from laggard.functions.logistic import ftrl_weight_py, sigmoid_py
    from laggard.streaming.live import _update_state
    rng = np.random.default_rng(8)
    prm, p = FtrlParams(), 3
    st, levels = FtrlState(p, prm), []
    state = {"stream_id": 1, "v": None, "h": None, "z": None, "r": None, "counts": None, "warned": None, "best": None}
    for i in range(400):
        x = [1.0, *rng.normal(size=2).tolist()]
        y = float((x[1] > 0) != (i >= 200))
        r = 1.0 if state["r"] is None else state["r"]
        z = state["z"] or [0.0] * p
        prob = sigmoid_py(sum(ftrl_weight_py(z[j], r, prm.l1, prm.l2, prm.lp) * x[j] for j in range(p)))
        want, _ = st.fit(x, y, prm)
        assert abs(prob - want) < 1e-12
        levels.append(st.level)
        row = pd.DataFrame([{**state, "g": [(prob - y) * v for v in x], "n": 1, "errors": int(abs(prob - y) > 0.5)}])
        state = _update_state(row, p, prm).iloc[0].to_dict()
    assert {1, 2} & set(levels)


def _minibatch_rows(spark, n=130, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in (1, 2, 5):
        for t in range(n - 7 * s):
            x = rng.normal(size=2)
            y = None if rng.random() < 0.1 or 20 <= t < 25 else float((x[0] > 0) != (t > 80))
            rows.append((s, t, [1.0, float(x[0]), float(x[1])], y))
    return spark.createDataFrame(rows, "stream_id long, t long, x array<double>, y double")


def test_st21_scan_equals_the_rounds(spark):
    from laggard.streaming.live import minibatch_ftrl, minibatch_rounds
    rows = _minibatch_rows(spark, 40)
    got = {(r.stream_id, r.t): (r.batch, r.prob) for r in minibatch_ftrl(rows.repartition(3), 3, 5).collect()}
    preds, _ = minibatch_rounds(spark, rows, 3, 5)
    want = {(r.stream_id, r.t): (r.batch, r.prob) for r in preds.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_st21_scan_with_one_row_a_batch_is_st01(spark):
    from laggard.streaming.live import minibatch_ftrl
    rows = _minibatch_rows(spark)
    got = {(r.stream_id, r.t): r.prob for r in minibatch_ftrl(rows, 3, 1).collect()}
    want = {(r.stream_id, r.t): r.prob for r in online_learner(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
