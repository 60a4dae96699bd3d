"""M3 queries: online learners, hedge ensemble, drift detector, label filling, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.functions import logistic as lg
from laggard.operators import corrupt, marginals
from laggard.operators.learner import (FtrlParams, delayed_learner, drift_levels, fill_labels, hedge_ensemble,
                                       online_learner)
from laggard.operators.metrics import running_mse
from laggard.operators.seq import shift
from laggard.operators.whole import WHOLE
from laggard.sources.fixtures import as_array, events_stream

FEATS = ["x0", "x1", "x2"]


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _rows(spark, sf_dir) -> DataFrame:
    return as_array(events_stream(spark, sf_dir), FEATS, intercept=True)


def _learn(df: DataFrame, prm: FtrlParams = FtrlParams(), y: str = "y", soft: bool = False):
    o = online_learner(df, y=y, prm=prm, soft=soft)
    return o.select("stream_id", "t", r6("prob").alias("prob"), "pred", r6("loss").alias("loss"),
                    r6("decay").alias("decay"))


def st01_st13_immediate_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learn(_rows(spark, sf_dir))


def st02_soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir).withColumn("y1", F.when(F.col("y") == 1, 0.9).otherwise(0.1))
    return _learn(d, y="y1", soft=True)


def st03_weighted_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir).withColumn("w", 1.0 + F.col("x0"))
    o = online_learner(d.select("stream_id", "t", "x", "y", "w"), weight="w")
    return o.select("stream_id", "t", r6("prob").alias("prob"), "pred", r6("loss").alias("loss"),
                    r6("decay").alias("decay"))


def st03_delay_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST03 on late labels: their gradients count one and a half times."""
    d = _rows(spark, sf_dir)
    o = delayed_learner(d, corrupt.delayed_labels(d, 5), max_delay=5, delay_compensation=1.5)
    return o.select("stream_id", "t", r6("prob").alias("prob"))


def st04_st09_hidden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.missing_labels(_rows(spark, sf_dir), 0.3, seed=2000)
    return _learn(d, y="y_obs")


def st05_non_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learn(_rows(spark, sf_dir), prm=FtrlParams(adaptive=False))


def st16_drift_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    d = shift(ev.select("stream_id", "t", "y"), ["stream_id"], "t", 1, {"y_prev": "y"})
    d = d.withColumn("err", (F.coalesce("y_prev", F.lit(0)) != F.col("y")).cast("int"))
    lv = drift_levels(d)
    return lv.select("stream_id", "t", "level", r6("p_min").alias("p_min"), r6("s_min").alias("s_min"))


def _two_views(spark, sf_dir):
    ev = events_stream(spark, sf_dir)
    ev = marginals.latent_columns(ev, ["stream_id"], FEATS, whole=WHOLE)
    ev = as_array(ev, FEATS, "x", intercept=True)
    return as_array(ev, [f"z_{c}" for c in FEATS], "z", intercept=True)


def st06_w13_hedge_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hedge_ensemble(_two_views(spark, sf_dir))
    return d.select("stream_id", "t", r6("lam").alias("lam"), r6("prob").alias("prob"), "pred")


def st11_j02_filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.missing_labels(_rows(spark, sf_dir), 0.3, seed=2000)
    d = shift(d, ["stream_id"], "t", 5, {"pseudo": "y"})
    d = fill_labels(d)
    o = online_learner(d.select("stream_id", "t", "x", "y_fill"), y="y_fill")
    o = o.join(d.select("stream_id", "t", "y", "label_source"), ["stream_id", "t"])
    o = running_mse(o, ["stream_id"], k="t")
    return o.select("stream_id", "t", "label_source", r6("prob").alias("prob"), "pred",
                    r6("mse").alias("mse"))


def j03_hidden_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.missing_labels(events_stream(spark, sf_dir), 0.3, seed=2000)
    vis = d.where(F.col("y_obs").isNotNull()).select("stream_id", "t")
    rows = d.select("stream_id", "t")
    a = rows.join(vis, ["stream_id", "t"], "left_semi").groupBy("stream_id").count() \
        .withColumnRenamed("count", "n_visible")
    b = rows.join(vis, ["stream_id", "t"], "left_anti").groupBy("stream_id").count() \
        .withColumnRenamed("count", "n_hidden")
    return a.join(b, "stream_id", "full").fillna(0)


def f03_f21_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    m = (F.col("x0") - 0.5) * 8
    n = F.col("t") + 1
    d = ev.select(
        "stream_id", "t",
        r6(lg.sigmoid(m)).alias("sigmoid"),
        r6(lg.logistic_loss(F.col("y"), m)).alias("logloss"),
        r6(lg.soft_cross_entropy(1 - F.col("x2"), F.col("x2"), m)).alias("soft_ce"),
        r6(lg.log2_loss(lg.sigmoid(m), F.col("y"))).alias("log2loss"),
        *[r6(lg.decay(n, c)).alias(f"decay{c}") for c in range(5)],
        r6(F.element_at(lg.ftrl_weights(F.array(m, -m), F.col("x1") + 1, 0.5, 0.1, 1.0), 1)).alias("w0"),
        r6(lg.std_error(F.col("x2"), n)).alias("stderr"),
        F.element_at(lg.one_hot(F.col("y")), 2).alias("onehot1"),
        lg.threshold(lg.sigmoid(m), 0.3).alias("pred03"))
    return d


def st09_st13_growing_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13 (growing form, P15): the learner on the K04 trapezoidal rows of F2, whose visible
    prefix grows; new features start with zero weight."""
    from laggard.plans.m1 import F2_C
    from laggard.sources.fixtures import lineitem_mixed
    li = lineitem_mixed(spark, sf_dir)
    scaled = li.select("stream_id", "t", "y", (F.col("c0") / 100000.0).alias("c0"), (F.col("c1") / 50.0).alias("c1"),
                       "c2", "c3", (F.col("c4") / 7.0).alias("c4"))
    d = corrupt.trapezoid(scaled, F2_C)
    d = d.withColumn("x", F.concat(F.array(F.lit(1.0)), F.col("x_jag")))
    o = online_learner(d.select("stream_id", "t", "x", "y"))
    return o.select("stream_id", "t", r6("prob").alias("prob"), "pred", r6("loss").alias("loss"))
