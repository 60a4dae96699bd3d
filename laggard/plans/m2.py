"""M2 queries: prequential metrics, drift scorecard, reports, imputation errors.

The predictions table (FIXTURES F6) holds three methods on the F1 event
streams: the delayed-label learner (ST07), the immediate-label learner (ST13)
and the naive "last arrived label" baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.operators import corrupt, drift, metrics
from laggard.operators.learner import FtrlParams, delayed_learner, online_learner
from laggard.operators.seq import shift
from laggard.plans.m1 import F2_C, lineitem_mixed, with_q
from laggard.operators import marginals
from laggard.sources.fixtures import as_array, events_stream

DELAY = 5
SLIDE = 30
MA_W = 10
DRIFT_START, SC_DELAY, SC_WIN = 20, 5, 10
METHODS = ["ftrl_delayed", "ftrl_immediate", "last_label"]


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream_id, method, t, prob, pred, y, err``."""
    ev = events_stream(spark, sf_dir)
    rows = as_array(ev, ["x0", "x1", "x2"], intercept=True).select("stream_id", "t", "x", "y")
    d1 = delayed_learner(rows, corrupt.delayed_labels(ev, DELAY), prm=FtrlParams(), max_delay=DELAY)
    d1 = d1.select("stream_id", F.lit("ftrl_delayed").alias("method"), "t", "prob", "pred")
    d2 = online_learner(rows).select("stream_id", F.lit("ftrl_immediate").alias("method"), "t",
                                     "prob", "pred")
    d3 = shift(ev.select("stream_id", "t", "y"), ["stream_id"], "t", DELAY, {"y_old": "y"})
    d3 = d3.select("stream_id", F.lit("last_label").alias("method"), "t",
                   F.coalesce("y_old", F.lit(0)).cast("double").alias("prob"),
                   F.coalesce("y_old", F.lit(0)).cast("int").alias("pred"))
    p = d1.unionByName(d2).unionByName(d3)
    return (p.join(ev.select("stream_id", "t", "y"), ["stream_id", "t"])
            .withColumn("err", (F.abs(F.col("y") - F.col("pred")) > 0.5).cast("int"))).checkpoint()


G = ["stream_id", "method"]


def w01_w03_a08_prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = predictions(spark, sf_dir)
    d = metrics.cumulative_error(d, G, k="t")
    d = metrics.sliding_accuracy(d, G, SLIDE, k="t")
    d = metrics.moving_average(d, G, MA_W, "err", k="t")
    d = metrics.running_mse(d, G, k="t")
    return d.select(*G, "t", r6("cer").alias("cer"), r6("acc").alias("acc"), r6("ma").alias("ma"),
                    r6("mse").alias("mse"))


def a01_a02_a27_method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = predictions(spark, sf_dir)
    m = metrics.prf(d, G).join(metrics.auc(d, G), G)
    c = d.groupBy(*G).agg(F.avg("err").alias("cer"))
    m = m.join(c, G)
    return m.select(*G, "n", "tp", "fp", "fn", r6("recall").alias("recall"),
                    r6("precision").alias("precision"), r6("f1").alias("f1"),
                    r6("auc").alias("auc"), r6("cer").alias("cer"),
                    F.split("method", "_")[0].alias("family"),
                    F.col("method").contains("missing").alias("is_missing"))


def _scorecard(spark, sf_dir):
    d = predictions(spark, sf_dir)
    return drift.scorecard(d, ["stream_id"], DRIFT_START, SC_DELAY, SC_WIN, k="t")


def a23_a25_w11_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _scorecard(spark, sf_dir)
    return c.select(*G, "n", r6("cer").alias("cer"), r6("baseline").alias("baseline"),
                    r6("dpaa").alias("dpaa"), r6("max_drop").alias("max_drop"), "recovery")


def t01_rank_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = drift.rank_methods(_scorecard(spark, sf_dir), ["stream_id"])
    return r.select(*G, F.col("rank_dpaa").cast("bigint").alias("rank_dpaa"),
                    F.col("rank_recovery").cast("bigint").alias("rank_recovery"))


def w12_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = predictions(spark, sf_dir)
    return d.select(*G, "t", drift.region("t", DRIFT_START, SC_DELAY).alias("region"))


def w14_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = predictions(spark, sf_dir).where((F.col("method") == "ftrl_delayed") & (F.col("t") >= DELAY))
    spine = events_stream(spark, sf_dir)
    a = metrics.align(d.select("stream_id", "t", "prob"), spine, ["stream_id"])
    return a.select("stream_id", "t", r6("prob").alias("prob"))


def s06_step_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (stream, t): <method>_error/_pred/_prob, y_true, region."""
    d = predictions(spark, sf_dir)
    wide = (d.groupBy("stream_id", "t").pivot("method", METHODS)
            .agg(F.first("err").alias("error"), F.first("pred").alias("pred"),
                 F.first("prob").alias("prob"), F.first("y").alias("y")))
    cols = []
    for m in METHODS:
        cols += [F.col(f"{m}_error"), F.col(f"{m}_pred"), r6(f"{m}_prob").alias(f"{m}_prob")]
    return wide.select("stream_id", "t", *cols, F.col(f"{METHODS[0]}_y").alias("y_true"),
                       drift.region("t", DRIFT_START, SC_DELAY).alias("region"))


def s09_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic result-file stem per stream, '/' and '\\' replaced by '_'."""
    ev = events_stream(spark, sf_dir).select("stream_id").distinct()
    name = F.concat_ws("_", F.translate(F.concat(F.lit("events/user\\"), F.col("stream_id").cast("string")),
                                        "/\\", "__"),
                       F.lit(f"Drift{DRIFT_START}"), F.lit(f"Delay{SC_DELAY}"), F.lit(f"Win{SC_WIN}"))
    return ev.select("stream_id", name.alias("file_stem"))


# ---- imputation errors (A03-A07) on the K01-masked F2 cells, imputed by W08 ----------
def with_truth(li: DataFrame) -> DataFrame:
    """The masked stream, beside its true values."""
    return corrupt.pair_mask(li.withColumns({f"true_{c}": F.col(c) for c in F2_C}), F2_C, 1, 7)


def truth_cells(d: DataFrame) -> DataFrame:
    """Every cell of ``with_truth`` with v_true, v (null where masked) and hidden."""
    return d.select("stream_id", "t", F.inline(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).alias("v"), F.col(f"true_{c}").alias("v_true")) for i, c in enumerate(F2_C)]))) \
        .withColumn("hidden", F.col("v").isNull())


def cells_with_truth(li: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every cell with v_true, v and hidden; the masked stream), from one stream."""
    d = with_truth(li)
    return truth_cells(d), d.select("stream_id", "t", *F2_C)


def _imputed_with_medians(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(every cell: v_true, v, hidden, x_imp (W08 at hash-uniform probabilities); the columns' medians of what is seen)."""
    cells, _ = cells_with_truth(lineitem_mixed(spark, sf_dir))
    observed = cells.where(~F.col("hidden")).select("stream_id", "t", "col", "v")
    return marginals.impute_with_medians(with_q(cells), observed, {0: "cont", 1: "cont", 2: "ord", 3: "ord", 4: "ord"}, "q")


def _imputed_vs_truth(spark, sf_dir):
    """Without a checkpoint of its own: what W08 has filled in is one already, all other cells are read from the stream's."""
    return _imputed_with_medians(spark, sf_dir)[0]


def a03_a07_imputation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imputation_errors(*_imputed_with_medians(spark, sf_dir))


def imputation_errors(d: DataFrame, med: DataFrame | None = None) -> DataFrame:
    """A03, A04, A06, A07 per column of cells with x_imp, v_true, hidden; ``med``: the columns' medians of what is seen, if known and not
    beside the cells."""
    if med is None and "med" not in d.columns:
        med = marginals.group_quantile(d.where(~F.col("hidden")), ["stream_id", "col"], 0.5, v="v_true", out="med")
    if "med" not in d.columns:
        d = d.join(med, ["stream_id", "col"])
    diff = F.col("x_imp") - F.col("v_true")
    h = F.col("hidden")
    kind = F.when(F.col("col") < 2, "cont").otherwise("ord")
    g = d.withColumn("kind", kind).groupBy("stream_id", "col", "kind").agg(
        F.avg(F.when(h, F.abs(diff))).alias("mae"),
        (F.sum(F.when(h, F.abs(diff)))
         / F.nullif(F.sum(F.when(h, F.abs(F.col("med") - F.col("v_true")))), F.lit(0.0))).alias("smae"),
        F.sqrt(F.avg(F.pow(diff, 2))).alias("rmse"),
        (F.sqrt(F.avg(F.pow(diff, 2)))
         / F.nullif(F.sqrt(F.avg(F.pow(F.col("v_true"), 2))), F.lit(0.0))).alias("rmse_rel"),
        (F.sqrt(F.sum(F.when(h, F.pow(diff, 2))))
         / F.nullif(F.sqrt(F.sum(F.when(h, F.pow(F.col("v_true"), 2)))), F.lit(0.0)))
        .alias("rel_rmse_hidden"))
    return g.select("stream_id", "col", "kind", *[r6(c).alias(c) for c in
                                                  ["mae", "smae", "rmse", "rmse_rel", "rel_rmse_hidden"]])


def a05_smae_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, med = _imputed_with_medians(spark, sf_dir)
    med = med.withColumn("kind", F.when(F.col("col") < 2, "cont").otherwise("ord"))
    # only hidden cells have an error to add up; a kind without any stays, without a ratio
    g = d.where("hidden").join(med, ["stream_id", "col"]).groupBy("stream_id", "kind").agg(
        (F.sum(F.abs(F.col("x_imp") - F.col("v_true")))
         / F.nullif(F.sum(F.abs(F.col("med") - F.col("v_true"))), F.lit(0.0))).alias("smae"))
    g = med.select("stream_id", "kind").distinct().join(g, ["stream_id", "kind"], "left")
    return g.select("stream_id", "kind", r6("smae").alias("smae"))
