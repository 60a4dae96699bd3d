"""M0 slice: per user, cumulative and sliding error of an online classifier whose
labels arrive ``delay`` events late (F1 -> K06 -> ST07 -> W01, W02, A01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.operators.corrupt import delayed_labels
from laggard.operators.learner import FtrlParams, delayed_learner
from laggard.operators.metrics import cumulative_error, prf, sliding_accuracy
from laggard.sources.fixtures import as_array, events_stream


def r6(c):
    return F.round(c, 6) + F.lit(0.0)

M0_DELAY = 5
M0_WINDOW = 30
M0_FEATURES = ["x0", "x1", "x2"]


def delayed_predictions(spark: SparkSession, sf_dir: str, delay: int = M0_DELAY,
                        prm: FtrlParams = FtrlParams()) -> DataFrame:
    """Per (stream_id, t): prob, pred, y, err of the delayed-label learner."""
    ev = events_stream(spark, sf_dir)
    rows = as_array(ev, M0_FEATURES, intercept=True).select("stream_id", "t", "x", "y")
    arrivals = delayed_labels(ev, delay)
    preds = delayed_learner(rows, arrivals, prm=prm, max_delay=delay)
    # the predictions table is read by several metric branches: write it once (reliable
    # checkpoint) so the Python scan runs exactly once
    return (preds.join(ev.select("stream_id", "t", "y"), ["stream_id", "t"])
            .withColumn("err", (F.abs(F.col("y") - F.col("pred")) > 0.5).cast("int"))).checkpoint()


def delayed_errors(spark: SparkSession, sf_dir: str, delay: int = M0_DELAY,
                   window: int = M0_WINDOW) -> DataFrame:
    d = delayed_predictions(spark, sf_dir, delay)
    d = cumulative_error(d, ["stream_id"], k="t")
    d = sliding_accuracy(d, ["stream_id"], window, k="t")
    return d.select("stream_id", "t", r6("prob").alias("prob"), "pred", "y", "err",
                    r6("cer").alias("cer"), r6("acc").alias("acc"))


def delayed_summary(spark: SparkSession, sf_dir: str, delay: int = M0_DELAY) -> DataFrame:
    d = delayed_predictions(spark, sf_dir, delay)
    m = prf(d, ["stream_id"])
    return m.select("stream_id", "n", "tp", "fp", "fn", r6("recall").alias("recall"),
                    r6("precision").alias("precision"), r6("f1").alias("f1"))
