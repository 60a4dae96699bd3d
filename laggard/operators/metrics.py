"""Prequential metrics.

All are window functions or grouped aggregates; the per-stream running and
sliding forms go through ``laggard.operators.seq`` so a hot stream is split
into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laggard.operators.seq import framed, running_sums

EPS = 1e-10


def cumulative_error(df: DataFrame, keys: Sequence[str], k: str = "k", err: str = "err",
                     out: str = "cer") -> DataFrame:
    """cumsum(err) / (k + 1) with ``k`` the dense 0-based position in the scored series."""
    d = running_sums(df, keys, k, {"_ce": F.col(err).cast("double")})
    return d.withColumn(out, F.col("_ce") / (F.col(k) + 1)).drop("_ce")


def sliding_accuracy(df: DataFrame, keys: Sequence[str], w: int, k: str = "k", err: str = "err",
                     out: str = "acc") -> DataFrame:
    """Mean of (1 - err) over the last ``w`` rows, partial at the start (min_periods=1)."""
    return framed(df, keys, k, -(w - 1), 0,
                  {out: lambda win: F.avg(1 - F.col(err).cast("double")).over(win)})


def moving_average(df: DataFrame, keys: Sequence[str], w: int, col: str, k: str = "k",
                   out: str = "ma") -> DataFrame:
    """Full-window moving average, NULL until ``w`` values are present."""
    d = framed(df, keys, k, -(w - 1), 0, {out: lambda win: F.avg(F.col(col)).over(win)})
    return d.withColumn(out, F.when(F.col(k) >= w - 1, F.col(out)))


def moving_average_or_series(df: DataFrame, keys: Sequence[str], w: int, col: str, k: str = "k", out: str = "ma") -> DataFrame:
    """W03 as plots use it: the full-window average, but a series of fewer than ``w`` rows stays as it is."""
    n = df.groupBy(*keys).agg((F.max(k) + 1).alias("_n"))
    d = moving_average(df, keys, w, col, k, out).join(n, list(keys))
    return d.withColumn(out, F.when(F.col("_n") < w, F.col(col).cast("double")).otherwise(F.col(out))).drop("_n")


def running_mse(df: DataFrame, keys: Sequence[str], k: str = "k", prob: str = "prob",
                y: str = "y", out: str = "mse") -> DataFrame:
    """Mean squared error of predictions up to each row."""
    d = running_sums(df, keys, k, {"_se": F.pow(F.col(prob) - F.col(y), 2)})
    return d.withColumn(out, F.col("_se") / (F.col(k) + 1)).drop("_se")


def prf(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """tp/fp/fn -> recall, precision, F1 with 1e-10 in every denominator."""
    yy, pp = F.col(y), F.col(pred)
    agg = df.groupBy(*keys).agg(
        F.sum(((yy == 1) & (pp == 1)).cast("long")).alias("tp"),
        F.sum(((yy == 0) & (pp == 1)).cast("long")).alias("fp"),
        F.sum(((yy == 1) & (pp == 0)).cast("long")).alias("fn"),
        F.count(F.lit(1)).alias("n"))
    rec = F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    pre = F.col("tp") / (F.col("tp") + F.col("fp") + EPS)
    return (agg.withColumn("recall", rec).withColumn("precision", pre)
            .withColumn("f1", 2 * (F.col("precision") * F.col("recall"))
                        / (F.col("precision") + F.col("recall") + EPS)))


def auc(df: DataFrame, keys: Sequence[str], y: str = "y", prob: str = "prob",
        buckets: int = 1 << 16) -> DataFrame:
    """ROC AUC with average ranks for ties; NULL when one class only.

    AUC = sum over positives of (#neg with lower score + 0.5 #neg with equal
    score) / (n_pos n_neg).  Scores are pre-aggregated to (stream, score)
    counts; the count of lower negatives is a prefix sum over the sorted
    scores, computed per (stream, score bucket) so that no stream is one task.
    """
    keys = list(keys)
    s = (df.groupBy(*keys, F.col(prob).alias("_s"))
         .agg(F.sum((F.col(y) == 1).cast("long")).alias("_pos"),
              F.sum((F.col(y) == 0).cast("long")).alias("_neg")))
    s = s.withColumn("_b", F.floor(F.col("_s") * buckets))
    tot = s.groupBy(*keys, "_b").agg(F.sum("_neg").alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_in", F.coalesce(F.sum("_neg").over(wi), F.lit(0)))
         .join(tot, [*keys, "_b"])
         .withColumn("_lower", F.col("_off") + F.col("_in")))
    g = s.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (F.col("_lower") + 0.5 * F.col("_neg"))).alias("_u"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return g.select(*keys, "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                           F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def align(series: DataFrame, spine: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Put a shorter (delayed) series on the full time axis; NULL where absent."""
    return spine.select(*keys, t).join(series, [*keys, t], "left")
