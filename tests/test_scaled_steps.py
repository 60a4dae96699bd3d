"""Steps of round 3 that scale: scores looked up in maps, scans that keep their partitioning, draws without a sort."""

import pytest
from pyspark.sql import functions as F

from laggard.operators import marginals, prep
from laggard.operators.learner import for_scan


def test_scores_by_maps_equal_scores_by_joins(spark, monkeypatch):
    rows = [(s, t, float(t % 3) if t % 5 else None, float(t * s), -0.0 if t % 2 else 0.0) for s in (1, 2, 3) for t in range(40)] + [(None, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "stream_id long, t long, a double, b double, c double")
    got = {}
    for few in (0, 10, 1000):
        monkeypatch.setattr(marginals, "FEW_VALUES", few)
        d = marginals.latent_columns(df, ["stream_id"], ["a", "b", "c"])
        assert d.columns == ["stream_id", "t", "a", "b", "c", "z_a", "z_b", "z_c"]
        got[few] = sorted(map(tuple, d.select("stream_id", "t", "z_a", "z_b", "z_c").collect()), key=str)
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == {0: 3, 10: 2, 1000: 1}[few]
    assert got[0] == got[10] == got[1000] and len(got[0]) == len(rows)


def test_scan_is_partitioned_after_a_join_by_its_keys(spark):
    """The exchange of the scan stays, though its input is partitioned by the same keys already."""
    a = spark.range(100).select((F.col("id") % 7).alias("k"), "id").groupBy("k").agg(F.max("id").alias("t"))
    plan = for_scan(a, ["k"], "t").mapInPandas(lambda it: it, "k long, t long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("k", [2])
def test_draw_needs_no_sort(spark, k):
    rows = [(s, t, 0, float((t * 7) % 31)) for s in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "stream_id long, t long, col int, v double")
    h = prep.hash32("13", "stream_id", "col", "t")
    c = df.withColumn("_h", h)
    by = lambda order: {r.stream_id: r.v for r in c.groupBy("stream_id").agg(F.min_by("v", order).alias("v")).collect()}
    assert by(prep._draw("_h", "t")) == by(F.struct("_h", "t"))
    plan = c.groupBy("stream_id").agg(F.min_by("v", prep._draw("_h", "t")))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert prep.quantile_cutoffs(df, 13, k).where("cutoff IS NULL").count() == 0
