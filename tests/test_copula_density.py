import numpy as np
from pyspark.sql import functions as F

from laggard.operators.copula import expect_block, project_to_correlation, subspace_distance, truncnorm_mv
from laggard.operators.density import peaks, propagation_rounds


def test_c2_estep_two_columns():
    rho = 0.6
    sig = np.array([[1.0, rho], [rho, 1.0]])
    C, zi, _, _ = expect_block(np.array([[1.0, np.nan]]), np.full((1, 2), -np.inf), np.full((1, 2), np.inf),
                               np.array([False, False]), sig)
    assert abs(zi[0, 1] - rho) < 1e-12 and abs(C[1, 1] - (1 - rho ** 2)) < 1e-12


def test_sigma_projection_properties():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 4))
    s = project_to_correlation(np.cov(a, rowvar=False) + 0.1 * np.eye(4))
    assert np.allclose(np.diag(s), 1) and np.allclose(s, s.T) and np.all(np.linalg.eigvalsh(s) > 0)


def test_c4_two_clusters_one_root_all_reached():
    x = np.array([[0.0], [0.1], [0.2], [0.15], [0.05], [5.0], [5.1], [5.2], [5.05], [5.15]])
    res = peaks(x, 2.0)
    roots = [i for i, p in enumerate(res["parent"]) if p == i]
    assert len(roots) == 1
    lab = np.zeros(10, dtype=bool)
    lab[[0, 6]] = True
    rnd = propagation_rounds(res["parent"], lab)
    assert (rnd >= 0).all()


def test_window_graph_runs_on_embeddings(spark):
    from laggard.plans import m5
    from tests.conftest import SF
    g = m5.b06_propagation_rounds(spark, SF)
    assert g.count() > 0 and g.where("round < 0").count() <= g.count()


def _one_row(z, lo, hi, is_ord, sig):
    """The E-step of one row by conditioning each cell on explicitly built blocks."""
    p, z = len(z), z.copy()
    seen = [j for j in range(p) if not np.isnan(z[j])]
    gap = [j for j in range(p) if np.isnan(z[j])]
    var, new = np.zeros(p), z.copy()
    for j in seen:
        rest = [k for k in seen if k != j]
        if is_ord[j] and rest:
            a = np.linalg.solve(sig[np.ix_(rest, rest)], sig[rest, j])
            mean, sd = a @ z[rest], np.sqrt(sig[j, j] - a @ sig[rest, j])
            m, v = truncnorm_mv((lo[j] - mean) / sd, (hi[j] - mean) / sd)
            new[j], var[j] = mean + sd * m, sd * sd * v
    full = np.where(np.isnan(new), 0.0, new)
    C = np.diag(var)
    if not seen:
        return sig.copy(), full
    if gap:
        B = np.linalg.solve(sig[np.ix_(seen, seen)], sig[np.ix_(seen, gap)])
        full[gap] = new[seen] @ B
        C[np.ix_(gap, seen)] = B.T * var[seen]
        C[np.ix_(seen, gap)] = C[np.ix_(gap, seen)].T
        C[np.ix_(gap, gap)] = sig[np.ix_(gap, gap)] - sig[np.ix_(gap, seen)] @ B + (B.T * var[seen]) @ B
    return C, full


def test_expectations_equal_row_by_row_conditioning():
    rng = np.random.default_rng(4)
    p = 4
    sig = project_to_correlation(np.cov(rng.normal(size=(200, p)) @ rng.normal(size=(p, p)), rowvar=False))
    z = rng.normal(size=(60, p))
    z[rng.random(z.shape) < 0.35] = np.nan
    z[0], z[1] = np.nan, [np.nan, 0.3, np.nan, np.nan]
    is_ord = np.array([False, True, False, True])
    lo = np.where(is_ord, rng.normal(size=(60, p)) - 0.8, -np.inf)
    hi = np.where(is_ord, lo + 1.2, np.inf)
    C, zi, zn, cd = expect_block(z, lo, hi, is_ord, sig)
    want = [_one_row(z[r], lo[r], hi[r], is_ord, sig) for r in range(len(z))]
    assert np.allclose(C, sum(c for c, _ in want))
    assert np.allclose(zi, [f for _, f in want])
    assert np.allclose(cd, [np.diag(c) for c, _ in want])
    assert (np.isnan(zn) == np.isnan(z)).all()


def test_zero_variance_column_and_far_intervals():
    s = project_to_correlation(np.array([[4.0, 0.0, 2.0], [0.0, 0.0, 0.0], [2.0, 0.0, 4.0]]))
    assert np.allclose(s, [[1, 0, 0.5], [0, 1, 0], [0.5, 0, 1]])
    m, v = truncnorm_mv(8.0, 9.0)
    assert 8.0 < m < 8.2 and 0 < v < 0.02
    m2, v2 = truncnorm_mv(-9.0, -8.0)
    assert abs(m + m2) < 1e-9 and abs(v - v2) < 1e-6


def test_subspace_distance_of_rotated_planes():
    t = 0.3
    a = np.array([[1.0, 0], [0, 1], [0, 0]])
    b = np.array([[1.0, 0], [0, np.cos(t)], [0, np.sin(t)]])
    angle, spectra = subspace_distance(a, 2 * b)
    assert abs(angle - t) < 1e-7 and abs(spectra - np.sqrt(2)) < 1e-12


def test_em_of_a_stream_does_not_depend_on_others(spark):
    from laggard.operators.pattern_em import fit_offline
    rng = np.random.default_rng(5)
    rows = []
    for s, rho in ((1, 0.9), (2, 0.0)):
        x = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], 120)
        x[rng.random(x.shape) < 0.3] = np.nan
        rows += [(s, t, [None if np.isnan(v) else float(v) for v in r], [float("-inf")] * 2, [float("inf")] * 2) for t, r in enumerate(x)]
    df = spark.createDataFrame(rows, "stream_id long, t long, z array<double>, lo array<double>, hi array<double>")
    both, sigma = fit_offline(df, 2, [False, False])
    alone, _ = fit_offline(df.where("stream_id = 1"), 2, [False, False])
    key = lambda r: (r.stream_id, r.t)
    a = {key(r): r.z_imp for r in both.where("stream_id = 1").collect()}
    b = {key(r): r.z_imp for r in alone.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert both.count() == df.count() and all(r.change < 0.01 or r.rounds == 50 for r in sigma.collect())


def test_change_test_replicas_differ_and_find_a_change(spark):
    from laggard.operators.change import change_test
    rng = np.random.default_rng(6)
    rows, ids = [], [10 ** 9 + i for i in range(6)]
    for i, s in enumerate(ids):
        for w in range(8):
            rho = 0.6 if w < 7 else -0.6
            x = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], 40)
            rows += [(s, w, t, [float(v) for v in r]) for t, r in enumerate(x)]
    df = spark.createDataFrame(rows, "stream_id long, win long, t long, z array<double>")
    sig = spark.createDataFrame([(s, [1.0, 0.6, 0.6, 1.0]) for s in ids], "stream_id long, sigma array<double>")
    got = change_test(df, sig, 2, nsample=40).collect()
    still = np.array([r.p_F for r in got if r.win < 7])
    assert len(set(still)) > 15 and 0.25 < still.mean() < 0.75 and still.min() < 0.35 and still.max() > 0.65
    assert max(r.p_F for r in got if r.win == 7) == 0


def test_windows_cover_every_row(spark):
    from laggard.operators.density import sliding_windows
    df = spark.createDataFrame([(s, i) for s, n in ((1, 57), (2, 3), (3, 40), (4, 1)) for i in range(n)], "stream_id long, pos long")
    for size, hop in ((20, 10), (20, 1), (7, 7), (20, 13)):
        w = sliding_windows(df, size, hop)
        assert w.select("stream_id", "pos").distinct().count() == df.count()
        for r in w.groupBy("stream_id", "win").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).collect():
            assert (r.a, r.b, r.n) == (max(0, r.win - size + 1), r.win, r.b - r.a + 1)


def _windows_without_change(spark, n_windows=120, n=40, rho=0.5, gaps=0.2):
    rng = np.random.default_rng(11)
    rows = []
    for w in range(n_windows):
        x = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
        x[rng.random(x.shape) < gaps] = np.nan
        rows += [(1, w, t, [None if np.isnan(v) else float(v) for v in r]) for t, r in enumerate(x)]
    return (spark.createDataFrame(rows, "stream_id long, win long, t long, z array<double>").repartition(6),
            spark.createDataFrame([(1, [1.0, rho, rho, 1.0])], "stream_id long, sigma array<double>"))


def test_p_values_are_uniform_without_a_change(spark):
    from laggard.operators.change import change_test
    df, sig = _windows_without_change(spark)
    p = np.array([r.p_F for r in change_test(df, sig, 2, nsample=39).collect()])
    observed = np.histogram(p, bins=[0, 0.25, 0.5, 0.75, 1.0])[0]
    assert ((observed - 30) ** 2 / 30).sum() < 16.3  # chi-square, 3 degrees of freedom, 0.1 %


def test_stopped_replicas_decide_alike(spark):
    """A decided p-value is near the full one, and takes fewer replicas; a clear change takes them all."""
    from laggard.operators.change import change_test
    df, sig = _windows_without_change(spark, 20)
    full = {r.win: r for r in change_test(df, sig, 2, nsample=200).collect()}
    short = {r.win: r for r in change_test(df.repartition(2), sig, 2, nsample=200, stop_at=10).collect()}
    assert sum(r.replicas for r in short.values()) < 0.6 * sum(r.replicas for r in full.values())
    assert np.mean([abs(full[w].p_F - short[w].p_F) for w in full]) < 0.15 and all(abs(full[w].stat_F - short[w].stat_F) < 1e-9 for w in full)
    other = spark.createDataFrame([(1, [1.0, -0.9, -0.9, 1.0])], "stream_id long, sigma array<double>")
    assert all(r.replicas == 60 and r.p_F == 0 for r in change_test(df, other, 2, nsample=60, stop_at=10).collect())


def test_replica_is_the_estimate_of_its_rows():
    """From the sums of chunks of patterns as from all rows at once, ordinal cells cut as the window's are."""
    from laggard.operators import change
    sigma = np.array([[1.0, 0.4, 0.2], [0.4, 1.0, -0.3], [0.2, -0.3, 1.0]])
    counts, cuts = [("000", 50), ("010", 30), ("100", 20), ("111", 3)], [None, np.array([-0.3, 0.8]), None]
    got = change.replica(np.random.default_rng(3), sigma, counts, cuts)
    rng, blocks = np.random.default_rng(3), []
    for pattern, n in counts:
        z = rng.multivariate_normal(np.zeros(3), sigma, n, method="eigh")
        z[:, [c == "1" for c in pattern]] = np.nan
        blocks.append(z)
    z = np.vstack(blocks)
    k = np.digitize(z[:, 1], cuts[1], right=True)
    ends = np.array([-np.inf, -0.3, 0.8, np.inf])
    lo, hi = np.full_like(z, -np.inf), np.full_like(z, np.inf)
    seen = ~np.isnan(z[:, 1])
    lo[seen, 1], hi[seen, 1] = ends[k[seen]], ends[k[seen] + 1]
    c, full, _, _ = expect_block(z, lo, hi, np.array([False, True, False]), sigma)
    assert np.allclose(got, project_to_correlation(np.cov(full, rowvar=False) + c / len(z)))


def test_replicas_drawn_together_equal_single_ones():
    from laggard.operators import change
    from laggard.operators.copula import matrix_change, project_to_correlation
    a = np.random.default_rng(1).normal(size=(3, 3))
    sigma, counts = project_to_correlation(a @ a.T), [("000", 30), ("001", 10), ("100", 7), ("111", 3)]
    for cuts in ([None] * 3, [None, np.array([-0.5, 0.4]), None], [np.array([0.0]), np.array([-0.5, 0.4]), np.array([])]):
        one = np.array([change.replica(np.random.default_rng(k), sigma, counts, cuts) for k in range(20)])
        many = change.replicas([np.random.default_rng(k) for k in range(20)], sigma, counts, cuts)
        assert np.allclose(one, many, atol=1e-12)
        for r, m in zip(change.matrix_changes(sigma, many), one, strict=True):
            assert np.allclose([r[c] for c in "FSN"], [matrix_change(sigma, m)[c] for c in "FSN"], atol=1e-10)
