import math
import statistics

from laggard.functions.normal import phi_inv_sql, phi_sql


def test_phi_matches_erfc(spark):
    xs = [i / 7.0 for i in range(-70, 71)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.selectExpr(phi_sql("x")).collect()]
    for x, g in zip(xs, got):
        assert abs(g - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-14


def test_phi_inv_matches_stdlib(spark):
    ps = [i / 1000.0 for i in range(1, 1000)] + [1e-12, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.selectExpr(phi_inv_sql("p")).collect()]
    nd = statistics.NormalDist()
    for p, g in zip(ps, got):
        assert abs(g - nd.inv_cdf(p)) < 1e-9
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double").selectExpr(phi_inv_sql("p")).collect()
    assert ends[0][0] == -math.inf and ends[1][0] == math.inf


def test_truncnorm_moments_match_numeric():
    from laggard.operators.copula import truncnorm_mv
    for a, b in [(-1.0, 0.5), (-math.inf, 0.3), (0.2, math.inf), (-2.0, 2.0)]:
        lo, hi = max(a, -12), min(b, 12)
        n = 200000
        xs = [lo + (hi - lo) * (i + 0.5) / n for i in range(n)]
        w = [math.exp(-x * x / 2) for x in xs]
        z = sum(w)
        m = sum(x * wi for x, wi in zip(xs, w)) / z
        v = sum((x - m) ** 2 * wi for x, wi in zip(xs, w)) / z
        mm, vv = truncnorm_mv(a, b)
        assert abs(mm - m) < 1e-5 and abs(vv - v) < 1e-5
