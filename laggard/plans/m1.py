"""M1 queries: sources, typing/binning, corruption, normal functions, marginals.

Each function is a registered query (spark, sf_dir) -> DataFrame over the
whole driver tables; float outputs are rounded to 6 decimals for the value
check against the DuckDB twins in ``laggard.oracle.queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.functions.hashing import uniform
from laggard.functions.normal import phi_inv_sql, phi_sql
from laggard.operators import corrupt, marginals, prep, window_ranks
from laggard.sources.fixtures import col_cells, events_stream, lineitem_mixed

F2_C = ["c0", "c1", "c2", "c3", "c4"]
MASK_SEED = 7
KINDS = {0: "cont", 1: "cont", 2: "ord", 3: "ord", 4: "ord"}
WIN = 60          # marginal window (observations) for the online forms
LONG_WIN = 300    # the same, longer than most tasks would want to hold


def r6(c):
    """Round to 6 decimals; ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def f2_masked(spark, sf_dir) -> DataFrame:
    """F2 with K01 pair masking (one of each column pair hidden, seed 7)."""
    return corrupt.pair_mask(lineitem_mixed(spark, sf_dir), F2_C, 1, MASK_SEED)


def wide_cells(df: DataFrame) -> DataFrame:
    """All cells including missing ones: (stream_id, t, col, v)."""
    r = df.select("stream_id", "t", *[F.col(c).alias(str(i)) for i, c in enumerate(F2_C)])
    long = r.unpivot(["stream_id", "t"], [str(i) for i in range(len(F2_C))], "col", "v")
    return long.select("stream_id", "t", F.col("col").cast("int").alias("col"), "v")


def masked_cells(d: DataFrame) -> DataFrame:
    """Observed cells of a masked F2 stream that the query has built once."""
    return col_cells(d, F2_C)


# ---- P ------------------------------------------------------------------------------
def p01_col_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.col_kinds(col_cells(lineitem_mixed(spark, sf_dir), F2_C))


def p02_mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.mixed_table(wide_cells(lineitem_mixed(spark, sf_dir)))


def p03_discreteness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prep.discreteness(wide_cells(f2_masked(spark, sf_dir)))
    return d.select("stream_id", "col", r6("score").alias("score"))


def p04_auto_bin_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prep.auto_bin_plan(wide_cells(f2_masked(spark, sf_dir)))
    return d.select("stream_id", "col", r6("score").alias("score"), "bins")


def p05_apply_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wc = wide_cells(f2_masked(spark, sf_dir))
    d = prep.apply_bins(wc, prep.auto_bin_plan(wc))
    return d.select("stream_id", "t", "col", "bins", r6("v_bin").alias("v_bin"))


def p06_positional_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    wc = wide_cells(lineitem_mixed(spark, sf_dir))
    d = prep.apply_bins(wc, prep.positional_bin_plan(len(F2_C)))
    return d.select("stream_id", "t", "col", "bins", r6("v_bin").alias("v_bin"))


def p07_ordinalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = col_cells(lineitem_mixed(spark, sf_dir), F2_C)
    mm = c.groupBy("stream_id", "col").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    d = c.join(mm, ["stream_id", "col"])
    return d.select("stream_id", "t", "col",
                    prep.ordinalise(F.col("v"), F.col("mn"), F.col("mx"), 4).alias("v_ord"))


def p08_binarise_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = col_cells(lineitem_mixed(spark, sf_dir), F2_C)
    d = prep.binarise_random(c, seed=11)
    return d.select("stream_id", "t", "col", r6("cutoff").alias("cutoff"), "v_bin")


def p09_quantile_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = col_cells(lineitem_mixed(spark, sf_dir), F2_C).where(F.col("col") < 2)
    d = prep.quantile_cutoffs(c, seed=13, k=2)
    return d.select("stream_id", "t", "col", r6("cutoff").alias("cutoff"), "v_bin")


def p09_quantile_digitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = col_cells(lineitem_mixed(spark, sf_dir), F2_C).where(F.col("col") < 2)
    d = prep.quantile_cutoffs(c, seed=13, k=4)
    return d.select("stream_id", "t", "col", "v_bin")


def p10_p11_design_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = f2_masked(spark, sf_dir)
    x = F.concat(F.array(F.lit(1.0)), F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in F2_C]))
    d = d.withColumn("x", x)
    return d.select("stream_id", "t", F.size("x").alias("width"),
                    *[r6(F.element_at("x", i + 1)).alias(f"x{i}") for i in range(len(F2_C) + 1)])


def p12_p16_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    n = prep.stream_sizes(ev)
    d = prep.chrono_split(prep.drop_tail(ev, 5, n), n, 0.7)
    return d.where(F.col("t") >= 5).select("stream_id", "t", "part")


def p13_p17_observed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = f2_masked(spark, sf_dir)
    obs = sum((F.col(c).isNotNull().cast("int") for c in F2_C), F.lit(0))
    p = F.expr(phi_sql("(c2 * 10 - 0.4)"))
    return d.select("stream_id", "t", obs.alias("n_observed"),
                    F.when(p > 0.5, 1).otherwise(0).alias("pred_05"),
                    F.when(p > 0.3, 1).otherwise(0).alias("pred_03"))


# ---- F01 / F02 ----------------------------------------------------------------------
def f01_f02_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir).withColumn("p1", F.expr(phi_sql("((x1 - 0.5) * 4)")))
    return ev.select("stream_id", "t",
                     r6(F.expr(phi_sql("((x0 - 0.5) * 6)"))).alias("cdf"),
                     r6(F.expr(phi_inv_sql("x2"))).alias("quantile"),
                     r6(F.expr(phi_inv_sql("p1"))).alias("roundtrip"))


# ---- K ------------------------------------------------------------------------------
def k01_pair_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = f2_masked(spark, sf_dir)
    return d.select("stream_id", "t", *[r6(c).alias(c) for c in F2_C])


def k02_mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = col_cells(lineitem_mixed(spark, sf_dir), F2_C)
    d = corrupt.mask_cells(c, 0.2, seed=100)
    return d.select("stream_id", "t", "col", "masked", "seed")


def k03_mask_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.mask_per_row(lineitem_mixed(spark, sf_dir), F2_C, seed=5, size=2)
    return d.select("stream_id", "t", *[r6(c).alias(c) for c in F2_C])


def k04_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.trapezoid(lineitem_mixed(spark, sf_dir), F2_C)
    return d.select("stream_id", "t", "n_visible", F.size("x_jag").alias("jag_len"),
                    *[r6(F.element_at("x_pad", i + 1)).alias(f"pad{i}") for i in range(5)],
                    r6(F.aggregate("x_zero", F.lit(0.0), lambda a, b: a + b)).alias("zero_sum"))


def k05_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.missing_labels(events_stream(spark, sf_dir), 0.3, seed=2000)
    return d.select("stream_id", "t", "y", "y_obs")


def k06_delayed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    a = corrupt.delayed_labels(ev, 7)
    return corrupt.label_slots(ev.select("stream_id", "t"), a)


def k07_delayed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_stream(spark, sf_dir)
    a = corrupt.delayed_labels(ev, 7, missing_ratio=0.3, seed=2000)
    return corrupt.label_slots(ev.select("stream_id", "t"), a)


def k08_shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.shuffle_rows(events_stream(spark, sf_dir), seed=42)
    return d.select("stream_id", "t", "t_new")


def k09_interleave_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corrupt.interleave_classes(events_stream(spark, sf_dir))
    return d.select("stream_id", "t", "y", "t_new")


# ---- marginals --------------------------------------------------------------------------
def a11_col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = marginals.col_stats(masked_cells(f2_masked(spark, sf_dir)))
    return d.select("stream_id", "col", "n_obs", r6("mean").alias("mean"), r6("sd").alias("sd"),
                    r6("min").alias("min"), r6("max").alias("max"))


def a12_ord_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = marginals.ord_gap(masked_cells(f2_masked(spark, sf_dir)).where(F.col("col") >= 2))
    return d.select("stream_id", "col", r6("gap").alias("gap"))


def _n_rows(d: DataFrame) -> DataFrame:
    return d.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_rows"))


def w04_cont_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f2 = f2_masked(spark, sf_dir)
    d = marginals.cont_latent(masked_cells(f2).where(F.col("col") < 2), _n_rows(f2))
    return d.select("stream_id", "t", "col", r6("z").alias("z"))


def w05_ord_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = masked_cells(f2_masked(spark, sf_dir)).where(F.col("col") >= 2)
    d = marginals.ord_interval(c)
    return d.select("stream_id", "t", "col", r6("lo").alias("lo"), r6("hi").alias("hi"))


def w10_window_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = marginals.window_values(masked_cells(f2_masked(spark, sf_dir)), WIN)
    return d.select("stream_id", "t", "col", F.size("win").cast("bigint").alias("win_n"),
                    r6(F.aggregate("win", F.lit(0.0), lambda a, b: a + b)).alias("win_sum"),
                    r6(F.array_min("win")).alias("win_min"), r6(F.array_max("win")).alias("win_max"))


def w06_window_cont_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = masked_cells(f2_masked(spark, sf_dir)).where(F.col("col") < 2)
    d = marginals.window_cont_latent(c, WIN)
    return d.select("stream_id", "t", "col", r6("z").alias("z"))


def w07_window_ord_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = masked_cells(f2_masked(spark, sf_dir)).where(F.col("col") >= 2)
    d = marginals.window_ord_interval(c, WIN)
    return d.select("stream_id", "t", "col", r6("lo").alias("lo"), r6("hi").alias("hi"))


def w06_long_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06 of long windows by rank counts."""
    c = masked_cells(f2_masked(spark, sf_dir)).where(F.col("col") < 2)
    d = window_ranks.long_window_cont_latent(c, LONG_WIN)
    return d.select("stream_id", "t", "col", r6("z").alias("z"))


def w07_long_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07 of long windows by rank counts."""
    c = masked_cells(f2_masked(spark, sf_dir)).where(F.col("col") >= 2)
    d = window_ranks.long_window_ord_interval(c, LONG_WIN)
    return d.select("stream_id", "t", "col", r6("lo").alias("lo"), r6("hi").alias("hi"))


def with_q(cells: DataFrame) -> DataFrame:
    return cells.withColumn("q", uniform("31", "stream_id", "t", "col"))


def a14_quantile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f2 = f2_masked(spark, sf_dir)
    q = with_q(wide_cells(f2)).where(F.col("v").isNull() & (F.col("col") < 2))
    d = marginals.quantile_lookup(q, masked_cells(f2).where(F.col("col") < 2), "q")
    return d.select("stream_id", "t", "col", r6("x_imp").alias("x_imp"))


def a13_inverse_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    f2 = f2_masked(spark, sf_dir)
    q = with_q(wide_cells(f2)).where(F.col("v").isNull() & (F.col("col") >= 2))
    d = marginals.inverse_ecdf(q, masked_cells(f2).where(F.col("col") >= 2), "q")
    return d.select("stream_id", "t", "col", r6("x_imp").alias("x_imp"))


def w08_impute_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f2 = f2_masked(spark, sf_dir)
    d = marginals.impute_missing(with_q(wide_cells(f2)), masked_cells(f2), KINDS, "q")
    return d.select("stream_id", "t", "col", r6("x_imp").alias("x_imp"))
