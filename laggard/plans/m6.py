"""M6 queries: file round trips, streaming replay, ensemble variants, mini-batch FTRL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.functions.hashing import uniform
from laggard.operators import corrupt, drift
from laggard.operators.learner import delayed_hedge_ensemble, fill_labels, hedge_ensemble
from laggard.operators.seq import shift
from laggard.plans import m2
from laggard.plans.m1 import F2_C
from laggard.plans.m3 import _two_views
from laggard.sources import text
from laggard.sources.fixtures import as_array, events_stream, lineitem_mixed
from laggard.streaming import live

DELAY = 5
MINIBATCH = 20
#: Labels of st07_live_dropped_labels come 1 to SLOWEST steps late.
SLOWEST, SLOW_SEED = 12, 41


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def s01_s02_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04 sink + S01/S02 readers: F2 as a headerless matrix and its labels as a vector of their
    own, both read back by position and joined."""
    li = lineitem_mixed(spark, sf_dir)
    path, labels = text.scratch_path(spark, "matrix"), text.scratch_path(spark, "labels")
    text.write_matrix(li, path, F2_C)
    text.write_matrix(li.withColumn("y", F.col("y").cast("double")), labels, ["y"])
    back = text.read_matrix(spark, path, len(F2_C)).join(text.read_labels(spark, labels), ["stream_id", "t"])
    return back.select("stream_id", "t", *[r6(f"c{i}").alias(f"c{i}") for i in range(5)], "y")


def s03_s04_jagged_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04 jagged sink + S03 reader on the K04 trapezoidal stream, and its zero-filled matrix; the
    cells of both are compared."""
    d = corrupt.trapezoid(lineitem_mixed(spark, sf_dir), F2_C)
    jagged, zero = text.scratch_path(spark, "jagged"), text.scratch_path(spark, "zero")
    text.write_lines(d.select("stream_id", "t", text.format_jagged("x_jag").alias("value")), jagged)
    full = text.padded("x_jag", len(F2_C), 0.0)
    text.write_matrix(d.select("stream_id", "t", *[full[i].alias(f"c{i}") for i in range(len(F2_C))]), zero, F2_C)
    back = text.read_lines(spark, jagged).withColumn("x", text.parse_jagged("value"))
    both = back.join(text.read_matrix(spark, zero, len(F2_C), prefix="p"), ["stream_id", "t"])
    cell = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(0.0))
    return both.select("stream_id", "t", F.size("x").alias("jag_len"),
                       r6(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("jag_sum"),
                       *[r6(f"p{i}").alias(f"p{i}") for i in range(len(F2_C))],
                       F.forall(F.array(*[cell(i) == F.col(f"p{i}") for i in range(len(F2_C))]), lambda v: v).alias("same"))


def s05_s07_s08_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S05/S08 metric table as CSV with metadata, S07 summary (rankings) as JSON; the CSV
    is read back with its schema."""
    card = m2._scorecard(spark, sf_dir)
    ranks = drift.rank_methods(card, ["stream_id"])
    meta = {"dataset": "events", "drift_start": m2.DRIFT_START, "delay": m2.SC_DELAY,
            "window": m2.SC_WIN}
    out = card.select("stream_id", "method", "n", r6("cer").alias("cer"),
                      r6("baseline").alias("baseline"), r6("dpaa").alias("dpaa"),
                      r6("max_drop").alias("max_drop"), "recovery")
    csv_path = text.scratch_path(spark, "metrics")
    text.write_table(out, csv_path, "csv", meta)
    text.write_table(ranks, text.scratch_path(spark, "summary"), "json", meta)
    schema = ("stream_id bigint, method string, n bigint, cer double, baseline double, dpaa double, "
              "max_drop double, recovery bigint, dataset string, drift_start int, delay int, window int")
    return spark.read.schema(schema).option("header", True).csv(csv_path)


def _f1_rows(spark, sf_dir):
    ev = events_stream(spark, sf_dir)
    return ev, as_array(ev, ["x0", "x1", "x2"], intercept=True).select("stream_id", "t", "x", "y")


def st07_live_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST07 as a Structured Streaming query over a time-ordered replay."""
    ev, rows = _f1_rows(spark, sf_dir)
    arr = corrupt.delayed_labels(ev, DELAY)
    out, _ = live.run_live_replay(spark, live.delayed_events(rows, arr, 50), text.scratch_path(spark, "live"), DELAY)
    return out.select("stream_id", "t", r6("prob").alias("prob"))


def st07_live_dropped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST07 live with labels of uneven delay: those that came too late for their row."""
    _, rows = _f1_rows(spark, sf_dir)
    late = 1 + F.floor(uniform(str(SLOW_SEED), "stream_id", "t") * SLOWEST).cast("long")
    arr = rows.select("stream_id", (F.col("t") + late).alias("t_arrive"), F.col("t").alias("t_orig"), "y")
    arr = arr.join(rows.select("stream_id", F.col("t").alias("t_arrive")), ["stream_id", "t_arrive"], "left_semi")
    _, dropped = live.run_live_replay(spark, live.delayed_events(rows, arr, 50), text.scratch_path(spark, "live"), DELAY)
    return dropped


def st21_minibatch_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST21: mini-batch FTRL (batches of 20 rows per stream); per-row batch probabilities."""
    _, rows = _f1_rows(spark, sf_dir)
    preds = live.minibatch_ftrl(rows, 4, MINIBATCH)
    return preds.select("stream_id", "t", F.col("batch").cast("int").alias("batch"), r6("prob").alias("prob"))


def _ens_out(d: DataFrame) -> DataFrame:
    return d.select("stream_id", "t", r6("lam").alias("lam"), r6("prob").alias("prob"), "pred")


def st08_delayed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _two_views(spark, sf_dir)
    arr = corrupt.delayed_labels(v, DELAY)
    return _ens_out(delayed_hedge_ensemble(v, arr, max_delay=DELAY))


def st10_hidden_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corrupt.missing_labels(_two_views(spark, sf_dir), 0.3, seed=2000)
    return _ens_out(hedge_ensemble(v, y="y_obs"))


def st12_filled_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corrupt.missing_labels(_two_views(spark, sf_dir), 0.3, seed=2000)
    v = fill_labels(shift(v, ["stream_id"], "t", DELAY, {"pseudo": "y"}))
    return _ens_out(hedge_ensemble(v, y="y_fill"))
