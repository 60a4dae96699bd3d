"""M5 queries: density-peaks graphs, propagation order, fusion, class soft-label matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.functions import fusion as fu
from laggard.functions.logistic import sigmoid
from laggard.operators import corrupt
from laggard.operators.density import (arrived, linear_self_training, sliding_windows, two_view_propagation,
                                       window_class_sums, window_graph)
from laggard.operators.forest import forest_rounds, round_sets
from laggard.operators.learner import carried_class_matrix
from laggard.operators.long_windows import blocked_peaks
from laggard.operators.online_knn import online_knn
from laggard.operators.seq import number_rows
from laggard.sources.fixtures import embedding_points, events_stream

#: A window that ends at position e knows the labels up to e - DELAY.
SIZE, HOP, PCT, DELAY = 20, 10, 5.0, 3
LONG_BLOCK, LONG_MISSING = 256, 0.95
LABEL_DELAY = 5


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _windows(spark, sf_dir) -> DataFrame:
    pts = embedding_points(spark, sf_dir)
    pts = number_rows(pts, ["stream_id"], ["t"], out="pos", bucket=F.floor(F.col("t") / 65536))
    pts = corrupt.missing_labels(pts, 0.6, seed=77)
    return arrived(sliding_windows(pts, SIZE, HOP), DELAY)


def _graph_out(g: DataFrame) -> DataFrame:
    return g.select("stream_id", "win", "t", r6("rho").alias("rho"), "parent_t",
                    r6("delta").alias("delta"), r6("dc").alias("dc"), "is_root")


def b04_density_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_out(window_graph(_windows(spark, sf_dir), y=None, pct=PCT))


def _whole_table(spark, sf_dir) -> DataFrame:
    """All points of F3 as one window."""
    pts = number_rows(embedding_points(spark, sf_dir, 1), ["stream_id"], ["t"], out="pos", bucket=F.floor(F.col("t") / 65536))
    return pts.withColumn("win", F.lit(0).cast("long"))


def b04_long_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B04 of one window that is as long as the table, by pairs of blocks."""
    return _graph_out(blocked_peaks(_whole_table(spark, sf_dir), pct=PCT, block=LONG_BLOCK))


def b05_long_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_out(blocked_peaks(_whole_table(spark, sf_dir), pct=PCT, time_decay=1.0, block=LONG_BLOCK))


def b05_time_weighted_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_out(window_graph(_windows(spark, sf_dir), y=None, pct=PCT, time_decay=1.0))


def b06_propagation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = window_graph(_windows(spark, sf_dir), y="y_obs", pct=PCT)
    return g.select("stream_id", "win", "t", "parent_t", "round")


def _long_labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(graph of the whole table as one window, its labelled rows)."""
    pts = _whole_table(spark, sf_dir)
    lab = corrupt.missing_labels(pts, LONG_MISSING, seed=77).where("y_obs IS NOT NULL")
    return blocked_peaks(pts, pct=PCT, block=LONG_BLOCK), lab


def b06_long_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B06 of one window that is as long as the table, by pointer doubling."""
    return forest_rounds(*_long_labels(spark, sf_dir))


def u01_u02_all_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01 and U02 for every round of the F3 windows."""
    w = _windows(spark, sf_dir).checkpoint()
    g = window_graph(w, y=None, pct=PCT)
    return round_sets(forest_rounds(g, w.where("y_obs IS NOT NULL")))


def b07_ssc_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = window_graph(_windows(spark, sf_dir), y="y_obs", pct=PCT)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return g.select("stream_id", "win", "t", "round", known("pseudo").alias("pseudo"), r6(known("p1")).alias("p1"), known("final").alias("final"),
                    r6(known("p_final")).alias("p_final"))


def a26_t05_window_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    g = w.groupBy("stream_id", "win").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("y_obs").alias("n_classes"))
    return g.withColumn("ok", (F.col("n_classes") == 2) & (F.col("n") > 2))


def _views(spark, sf_dir) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    return (ev.withColumn("v1", fu.binary(sigmoid((F.col("x0") - 0.5) * 8)))
            .withColumn("v2", fu.binary(sigmoid((F.col("x1") - 0.5) * 6))))


def _quality(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(both views of F1, A19 per stream: how often a view's class is the label, of the labels that have arrived by the stream's
    end; 0.5 where none has)."""
    v = _views(spark, sf_dir)
    arr = corrupt.delayed_labels(v, LABEL_DELAY, missing_ratio=0.3, seed=2000).select("stream_id", F.col("t_orig").alias("t"), F.col("y").alias("y_in"))
    hit = lambda c: F.coalesce(F.avg((fu.argmax(c) == F.col("y_in")).cast("double")), F.lit(0.5))  # noqa: E731 - null without a label
    return v, v.join(arr, ["stream_id", "t"], "left").groupBy("stream_id").agg(hit("v1").alias("q1"), hit("v2").alias("q2"))


def a19_view_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q = _quality(spark, sf_dir)
    return q.select("stream_id", r6("q1").alias("q1"), r6("q2").alias("q2"))


def f10_f19_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _quality(spark, sf_dir)
    v = v.join(q, "stream_id")
    cls = F.array(F.lit(0.3), F.lit(0.7))
    p1 = lambda c: r6(F.element_at(c, 2))
    return v.select(
        "stream_id", "t",
        p1(fu.fixed("v1", "v2", 0.6, 0.4)).alias("fixed"),
        p1(fu.confidence("v1", "v2")).alias("confidence"),
        p1(fu.weighted_confidence("v1", "v2")).alias("weighted"),
        p1(fu.entropy_weighted("v1", "v2")).alias("entropy"),
        p1(fu.agreement("v1", "v2")).alias("agreement"),
        p1(fu.view_quality("v1", "v2", "q1", "q2")).alias("view_quality"),
        p1(fu.three_vector("v1", "v2")).alias("three2"),
        p1(fu.three_vector("v1", "v2", cls)).alias("three3"),
        p1(fu.calibrate("v1", cls)).alias("calibrated"),
        p1(fu.geometric("v1", "v2", F.col("x2"), True)).alias("geo_fwd"),
        p1(fu.geometric("v1", "v2", F.col("x2"), False)).alias("geo_bwd"),
        r6(fu.parent_quality("v1")).alias("parent_quality"),
        fu.argmax("v2").alias("argmax2"),
        r6(fu.time_penalised(F.col("x0"), F.col("t") - 5, 1.0, F.lit(20))).alias("time_dist"))


def a17_class_soft_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream, K x K class soft-label matrix: prior 1/K plus the probability rows of
    correctly classified labelled rows, each row normalised."""
    v = _views(spark, sf_dir)
    ok = v.where(fu.argmax("v1") == F.col("y"))
    s = ok.groupBy("stream_id", "y").agg(F.sum(F.element_at("v1", 1)).alias("s0"),
                                         F.sum(F.element_at("v1", 2)).alias("s1"))
    cls = v.select("stream_id").distinct().withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    m = cls.join(s, ["stream_id", "y"], "left").fillna(0.0, ["s0", "s1"])
    m = m.withColumn("m0", 0.5 + F.col("s0")).withColumn("m1", 0.5 + F.col("s1"))
    tot = F.col("m0") + F.col("m1")
    return m.select("stream_id", F.col("y").alias("class"), r6(F.col("m0") / tot).alias("p0"),
                    r6(F.col("m1") / tot).alias("p1"))


def _two_views(spark, sf_dir) -> DataFrame:
    """F3 windows; the views are the two halves of the embedding."""
    return _windows(spark, sf_dir).withColumns({"x1": F.slice("x", 1, 32), "x2": F.slice("x", 33, 32)})


def u03_nodes_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window, every node that is a parent in the graph of either view."""
    w = _two_views(spark, sf_dir)
    nodes = [window_graph(w, x=x, y=None, pct=PCT).select("stream_id", "win", F.col("parent_t").alias("node")) for x in ("x1", "x2")]
    return nodes[0].unionByName(nodes[1]).distinct()


def b11_b12_two_view_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11 per view and B12 fusion on the F3 windows, class matrices carried over windows (ST22)."""
    r = two_view_propagation(_two_views(spark, sf_dir))
    return r.select("stream_id", "win", "t", r6("p1_view1").alias("p1_view1"),
                    r6("p1_view2").alias("p1_view2"), r6("p1_fused").alias("p1_fused"), "hard")


def b08_ssc_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure-ordered self-training with a linear SVM, one view."""
    r = linear_self_training(_windows(spark, sf_dir), ("x",))
    return r.select("stream_id", "win", "t", "round", "label", r6("p1").alias("p1"))


def b09_ssc_linear_two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two views, either view's class 1 wins."""
    r = linear_self_training(_two_views(spark, sf_dir), ("x1", "x2"))
    return r.select("stream_id", "win", "t", "round", "label", r6("p1").alias("p1"))


def st22_carried_class_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST22 over the sliding windows of F3: S_w from the labelled rows that the window's classifier
    (class centroids of the first four values) gets right, folded over a stream's windows."""
    w = _windows(spark, sf_dir).withColumn("x4", F.slice("x", 1, 4))
    m = carried_class_matrix(window_class_sums(w, ("x4",), model="centroid"))
    return m.select("stream_id", "win", *[r6(F.element_at("m", i + 1)).alias(f"m{i}") for i in range(4)])


def u05_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from laggard.operators.density import list_groups
    g = list_groups(_windows(spark, sf_dir), 4)
    return g.select("stream_id", "win", "chunk", F.size("members").cast("bigint").alias("size"),
                    F.element_at("members", 1).alias("first_t"), F.element_at("members", -1).alias("last_t"))


def b10_ssc_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window, rows in structure order (B06 round, then t); an FTRL learner keyed by
    (stream, window) fits arrived labels and self-trains on its own prediction elsewhere
    (class 0 when p < 0.3, P17)."""
    from laggard.operators.learner import FIT, FtrlParams, scan_events
    w = _windows(spark, sf_dir)
    g = window_graph(w, y="y_obs", pct=PCT).where(F.col("round") >= 0)
    d = g.select("stream_id", "win", "t", "round").join(w.select("stream_id", "win", "t", "x", "y_obs"),
                                                         ["stream_id", "win", "t"])
    order = F.dense_rank().over(__import__("pyspark.sql", fromlist=["Window"]).Window
                                .partitionBy("stream_id", "win").orderBy("round", "t"))
    ev = d.select("stream_id", "win", order.cast("bigint").alias("_time"), F.lit(FIT).alias("_kind"),
                  F.col("t").cast("bigint").alias("_tref"), F.col("x").cast("array<double>").alias("x"),
                  F.col("y_obs").cast("double").alias("y"))
    out = scan_events(ev, ["stream_id", "win"], FtrlParams(threshold=0.3), self_train=0.3)
    return out.select("stream_id", "win", F.col("t_ref").alias("t"), r6("prob").alias("prob"),
                      F.when(F.col("prob") < 0.3, 0).otherwise(1).alias("pred"))


def b10_online_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10, online K-NN over the F3 windows of each stream."""
    w = _windows(spark, sf_dir)
    g = window_graph(w, y="y_obs", pct=PCT).select("stream_id", "win", "t", "round")
    d = online_knn(w.select("stream_id", "win", "t", "x", "y_obs").join(g, ["stream_id", "win", "t"]))
    return d.select("stream_id", "win", "t", "label", r6("p1").alias("p1"), "voted")
