"""Remaining operators: map features, kernels, set operations, speculation, carried class
matrix, reorder/prefix views, SVM baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.functions import fusion as fu
from laggard.operators import corrupt, maps, prep
from laggard.operators.baselines import svm_error
from laggard.operators.density import window_graph
from laggard.functions.logistic import sigmoid
from laggard.operators.learner import speculative_learner
from laggard.plans.m1 import F2_C, lineitem_mixed, wide_cells
from laggard.plans.m5 import PCT, _windows
from laggard.sources.fixtures import as_array, events_stream, table

W_PREFIX = [0.5, -1.0, 2.0, 0.1, 0.3]


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def j08_compare_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08 on per-user event-type count maps: first half of the stream (W) vs second (X)."""
    ev = events_stream(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_type"),
        ["stream_id", "ts"])
    n = ev.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_n"))
    ev = ev.join(n, "stream_id").withColumn("half", (F.col("t") >= F.col("_n") / 2).cast("int"))
    c = ev.groupBy("stream_id", "half", "event_type").agg(F.count(F.lit(1)).cast("double").alias("c"))
    m = c.groupBy("stream_id", "half").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("m"))
    wx = (m.where("half = 0").select("stream_id", F.col("m").alias("w"))
          .join(m.where("half = 1").select("stream_id", F.col("m").alias("x")), "stream_id"))
    r = maps.compare_maps(wx, "w", "x")
    dot = F.aggregate(F.zip_with("shared_w", "shared_x", lambda a, b: a * b), F.lit(0.0),
                      lambda acc, e: acc + e)
    return r.select("stream_id", F.array_join("shared_keys", ",").alias("shared_keys"),
                    r6(dot).alias("shared_dot"), F.array_join("w_only_keys", ",").alias("w_only_keys"),
                    r6(F.aggregate("w_only", F.lit(0.0), lambda a, b: a + b)).alias("w_only_sum"))


def j09_remap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with returnflag R carry a dictionary {col: floor(v)} for columns 0-2."""
    li = lineitem_mixed(spark, sf_dir)
    cells = wide_cells(li)
    dct = (cells.join(li.where("y = 1").select("stream_id", "t"), ["stream_id", "t"])
           .where(F.col("col") < 3).select("stream_id", "t", "col", F.floor("v").cast("double").alias("value")))
    out = maps.remap_cells(cells, dct, ["stream_id", "t"])
    return out.select("stream_id", "t", "col", r6("v").alias("v"))


def j10_kernel_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = maps.kernel_summaries(_windows(spark, sf_dir), ["stream_id"], sigma=1.0)
    return k.select("stream_id", "win", "t", *[r6(c).alias(c) for c in
                                                ["lin_sum", "lin_max", "rbf_sum", "rbf_max"]])


def u01_u04_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01 frontier = parents of labelled rows minus labelled; U02 labelled + frontier;
    U04 unlabelled = window minus labelled (left_anti), per window."""
    w = _windows(spark, sf_dir)
    g = window_graph(w, y=None, pct=PCT).select("stream_id", "win", "t", "parent_t")
    lab = w.where(F.col("y_obs").isNotNull()).select("stream_id", "win", "t")
    par = (g.join(lab, ["stream_id", "win", "t"], "left_semi")
           .select("stream_id", "win", F.col("parent_t").alias("t")).distinct())
    frontier = par.join(lab, ["stream_id", "win", "t"], "left_anti")
    union = lab.unionByName(frontier).distinct()
    unl = w.select("stream_id", "win", "t").join(lab, ["stream_id", "win", "t"], "left_anti")
    cnt = lambda d, n: d.groupBy("stream_id", "win").agg(F.count(F.lit(1)).alias(n))
    base = w.select("stream_id", "win").distinct()
    out = base
    for d, name in [(lab, "n_labelled"), (frontier, "n_frontier"), (union, "n_union"), (unl, "n_unlabelled")]:
        out = out.join(cnt(d, name), ["stream_id", "win"], "left")
    return out.fillna(0)


def p14_p15_reorder_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 ordinal-first permutation and its inverse (identity check), P15 dot product of the
    visible prefix of a trapezoidal row with the first len(x) weights."""
    d = corrupt.trapezoid(lineitem_mixed(spark, sf_dir), F2_C)
    order = [2, 3, 4, 0, 1]
    inv = [order.index(i) for i in range(5)]
    d = d.withColumn("x_ord", prep.reorder("x_zero", order)).withColumn("x_back", prep.reorder("x_ord", inv))
    d = d.withColumn("w", F.array(*[F.lit(v) for v in W_PREFIX]))
    return d.select("stream_id", "t", r6(F.element_at("x_ord", 1)).alias("first_ord"),
                    (F.col("x_back") == F.col("x_zero")).alias("roundtrip_ok"),
                    r6(prep.prefix_dot("w", "x_jag")).alias("prefix_dot"))


def st14_st15_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14/ST15 on F1: the soft label of each of the last four rows is a fixed function of its
    features, sigmoid(4 x0 - 2)."""
    ev = events_stream(spark, sf_dir)
    rows = as_array(ev, ["x0", "x1", "x2"], intercept=True).withColumn("soft", sigmoid(4 * F.col("x0") - 2))
    soft = rows.select("stream_id", F.col("t").alias("of"), "soft")
    later = soft.withColumn("t", F.explode(F.sequence(F.col("of") + 1, F.col("of") + 4)))
    spec = later.groupBy("stream_id", "t").agg(F.collect_list(F.struct(F.col("of").alias("t"), F.col("soft").alias("p"))).alias("spec"))
    s = speculative_learner(rows.join(spec, ["stream_id", "t"], "left"), corrupt.delayed_labels(ev, 5), 5)
    return s.select("stream_id", "t", r6("prob").alias("prob"), r6("prob_spec").alias("prob_spec"),
                    r6("prob_blend").alias("prob_blend"))


def b13_t04_svm_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    return svm_error(spark, ev, ["x0", "x1", "x2"])


def s10_hyper_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream, the profile of each dataset of a profile table (written as a file and loaded
    here) and the batch / window sizes it implies for that stream's length."""
    from laggard.sources.params import load_profiles, profile_table, with_sizes
    from laggard.sources.text import scratch_path
    path = scratch_path(spark, "profiles")
    profile_table(spark).write.option("header", True).csv(path)
    n = events_stream(spark, sf_dir).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return with_sizes(n, load_profiles(spark, path)).select(
        "stream_id", "dataset", "n", "decay_choice", "contribute_error_rate", "batch_size", "window_size")


def a18_neighbour_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node, the parent summary (its parent's soft label) and the child summary
    sum(e^-d soft) / sum(e^-d) over its children; soft label = one-hot of an arrived label,
    else [0.5, 0.5].  NULL when there is no parent (root) or no child."""
    w = _windows(spark, sf_dir)
    g = window_graph(w, y=None, pct=PCT).select("stream_id", "win", "t", "parent_t", "delta", "is_root")
    soft = w.select("stream_id", "win", "t", F.coalesce(F.col("y_obs").cast("double"), F.lit(0.5)).alias("s1"))
    par = (g.where(~F.col("is_root"))
           .join(soft.withColumnRenamed("t", "parent_t").withColumnRenamed("s1", "ps1"),
                 ["stream_id", "win", "parent_t"])
           .select("stream_id", "win", "t", "ps1"))
    ch = (g.where(~F.col("is_root")).join(soft, ["stream_id", "win", "t"])
          .groupBy("stream_id", "win", F.col("parent_t").alias("t"))
          .agg((F.sum(F.exp(-F.col("delta")) * F.col("s1")) / F.sum(F.exp(-F.col("delta")))).alias("cs1")))
    out = g.select("stream_id", "win", "t").join(par, ["stream_id", "win", "t"], "left") \
        .join(ch, ["stream_id", "win", "t"], "left")
    return out.select("stream_id", "win", "t", r6("ps1").alias("parent_p1"), r6("cs1").alias("child_p1"))


def b14_transductive_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B14 on F1 with K05 hidden labels (30 %): transductive linear SVM, Platt probabilities."""
    from laggard.operators.baselines import transductive_svm
    ev = corrupt.missing_labels(events_stream(spark, sf_dir), 0.3, seed=2000)
    r = transductive_svm(ev, ["x0", "x1", "x2"])
    return r.select("stream_id", "t", r6("f").alias("f"), r6("prob").alias("prob"), "converged")
