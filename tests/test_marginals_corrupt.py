from pyspark.sql import functions as F

from laggard.operators import corrupt, marginals
from laggard.functions.normal import phi_inv_sql


def test_c7_ordinal_interval(spark):
    cells = spark.createDataFrame([(1, t, 0, float(v)) for t, v in enumerate([1, 1, 2, 3])],
                                  "stream_id long, t long, col int, v double")
    r = {row.t: (row.lo, row.hi) for row in marginals.ord_interval(cells).collect()}
    q = spark.range(1).selectExpr(phi_inv_sql("CAST(0.5 AS DOUBLE)") + " AS a", phi_inv_sql("CAST(0.75 AS DOUBLE)") + " AS b").first()
    assert r[2] == (q.a, q.b) and r[0][0] == float("-inf") and r[3][1] == float("inf")


def test_mask_is_partitioning_invariant(spark):
    from laggard.sources.fixtures import lineitem_mixed
    from tests.conftest import SF
    li = lineitem_mixed(spark, SF)
    cols = ["c0", "c1", "c2", "c3", "c4"]
    a = corrupt.pair_mask(li, cols, 1, 7)
    b = corrupt.pair_mask(li.repartition(5, "t"), cols, 1, 7)
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("x")) for c in cols])
    ja = a.select("stream_id", "t", key.alias("k1"))
    jb = b.select("stream_id", "t", key.alias("k2"))
    assert ja.join(jb, ["stream_id", "t"]).where("k1 != k2").count() == 0


def test_k09_closed_form_matches_loop(spark):
    ys = [1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 0, 0]
    df = spark.createDataFrame([(1, t, y) for t, y in enumerate(ys)], "stream_id long, t long, y int")
    got = [r.t for r in corrupt.interleave_classes(df).orderBy("t_new").collect()]
    ones = [t for t, y in enumerate(ys) if y == 1]
    zeros = [t for t, y in enumerate(ys) if y == 0]
    ref, j = [], 0
    for i, o in enumerate(ones):
        ref.append(o)
        if i % 3 == 0:
            ref.append(zeros[j])
            j += 1
    ref += zeros[j:]
    assert got == ref
