"""Sparse feature maps (J08, J09) and kernel summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_maps(df: DataFrame, w: str, x: str) -> DataFrame:
    """Shared keys of two MAP<STRING,DOUBLE> columns (sorted) with both values, and the
    keys only in ``w`` with their values."""
    shared = F.array_sort(F.array_intersect(F.map_keys(w), F.map_keys(x)))
    extra = F.array_sort(F.array_except(F.map_keys(w), F.map_keys(x)))
    return (df.withColumn("shared_keys", shared)
            .withColumn("shared_w", F.transform("shared_keys", lambda k: F.element_at(w, k)))
            .withColumn("shared_x", F.transform("shared_keys", lambda k: F.element_at(x, k)))
            .withColumn("w_only_keys", extra)
            .withColumn("w_only", F.transform("w_only_keys", lambda k: F.element_at(w, k))))


def remap_cells(cells: DataFrame, dictionary: DataFrame, row_keys: Sequence[str],
                col: str = "col", v: str = "v") -> DataFrame:
    """Cells of a row that has a dictionary take ``dictionary[col]`` (NULL when the
    column has no entry); rows without a dictionary keep their values.
    ``dictionary``: row_keys, col, value."""
    rk = list(row_keys)
    has = dictionary.select(*rk).distinct().withColumn("_has", F.lit(True))
    d = (cells.join(has, rk, "left")
         .join(dictionary.select(*rk, col, F.col("value").alias("_nv")), [*rk, col], "left"))
    return d.withColumn(v, F.when(F.col("_has"), F.col("_nv")).otherwise(F.col(v))).drop("_has", "_nv")


def kernel_summaries(df: DataFrame, keys: Sequence[str], win: str = "win", t: str = "t",
                     x: str = "x", sigma: float = 1.0) -> DataFrame:
    """J10 within bounded windows: per row the sum and max (j != i) of the linear kernel
    x_i . x_j and of the RBF kernel exp(-||x_i - x_j||^2 / (2 sigma^2)).  The window's
    kernel matrix lives only inside its task."""
    g = [*keys, win]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        a = np.array([np.asarray(v, dtype=float) for v in pdf[x]])
        lin = a @ a.T
        sq = np.sum(a * a, axis=1)
        d2 = np.maximum(sq[:, None] + sq[None, :] - 2 * lin, 0.0)
        rbf = np.exp(-d2 / (2 * sigma * sigma))
        np.fill_diagonal(lin, np.nan)
        np.fill_diagonal(rbf, np.nan)
        out = pdf[[*g, t]].copy()
        out["lin_sum"], out["lin_max"] = np.nansum(lin, axis=1), np.nanmax(lin, axis=1) if len(a) > 1 else np.nan
        out["rbf_sum"], out["rbf_max"] = np.nansum(rbf, axis=1), np.nanmax(rbf, axis=1) if len(a) > 1 else np.nan
        return out

    from laggard.operators.learner import by_key, schema_of
    return by_key(df.select(*g, t, x), g).groupBy(*g).applyInPandas(
        run, f"{schema_of(df, [*g, t])}, lin_sum double, lin_max double, rbf_sum double, rbf_max double")


#: Entries carry their whole row (keys and values) up to so many entries.
CARRIED = 64


def sparse_pairs(entries: DataFrame, sigma: float = 1.0, least: float = 0.0, id_col: str = "id", k: str = "k", v: str = "v") -> DataFrame:
    """J10 for sparse maps given as entries (id, key, value): ``a, b`` (a < b), ``dot`` and ``rbf`` = exp(-|a - b|^2 / (2 sigma^2)) of every pair of
    rows that share a key and whose rbf is at least ``least``.

    Entries meet by key (an inverted index), so that pairs that share nothing are never looked at.  |a - b| is at least the difference of
    the norms: entries whose norms differ too much for ``least`` are not joined.  An entry carries its row, so that a pair is
    settled where its rows meet by the first key they share, and no pair is sent anywhere.  Rows of more than CARRIED entries (or with a
    key twice) are not carried: products of their pairs are summed by pair."""
    e = entries.select(F.col(id_col).alias("id"), F.col(k).alias("k"), F.col(v).cast("double").alias("v")).where("id IS NOT NULL AND v <> 0")
    row = Window.partitionBy("id")
    e = e.withColumns({"sq": F.sum(F.col("v") * F.col("v")).over(row), "_n": F.count(F.lit(1)).over(row)})
    e = e.withColumn("_row", F.collect_list(F.when((F.col("_n") <= CARRIED) & F.col("k").isNotNull(), F.struct("k", "v"))).over(row))
    whole = (F.col("_n") <= CARRIED) & (F.size(F.array_distinct("_row.k")) == F.size("_row"))
    e = e.where("k IS NOT NULL").select("id", "k", "v", "sq", F.when(whole, F.col("_row.k")).alias("ks"), F.when(whole, F.col("_row.v")).alias("vs")).checkpoint()
    a, b = (e.select("k", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "v", "sq", "ks", "vs")]) for n in "ab")
    near = F.col("a_id") < F.col("b_id")
    if least > 0:
        near = near & (F.abs(F.sqrt("a_sq") - F.sqrt("b_sq")) <= sigma * math.sqrt(-2 * math.log(least)) + 1e-9)
    met, sq = a.join(b, "k").where(near), F.col("a_sq") + F.col("b_sq")
    shared = F.array_intersect("a_ks", "b_ks")
    value = lambda n, key: F.get(f"{n}_vs", (F.array_position(f"{n}_ks", key) - 1).cast("int"))
    dot = F.when(F.size(shared) == 1, F.col("a_v") * F.col("b_v")) \
        .otherwise(F.aggregate(shared, F.lit(0.0), lambda s, key: s + value("a", key) * value("b", key)))
    pairs = met.where(F.col("k") == F.get(shared, F.lit(0))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), dot.alias("dot"), sq.alias("sq"))
    if not e.where("ks IS NULL").isEmpty():
        pairs = pairs.unionByName(met.where("a_ks IS NULL OR b_ks IS NULL").groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(
            F.sum(F.col("a_v") * F.col("b_v")).alias("dot"), F.first(sq).alias("sq")))
    rbf = F.exp(-F.greatest(F.col("sq") - 2 * F.col("dot"), F.lit(0.0)) / (2 * sigma * sigma))
    return pairs.withColumn("rbf", rbf).drop("sq").where(F.col("rbf") >= least)


def sparse_kernel_summaries(entries: DataFrame, sigma: float = 1.0, least: float = 0.0, id_col: str = "id", k: str = "k", v: str = "v") -> DataFrame:
    """J10 per row of sparse maps: ``lin_sum`` (of the linear kernel with all other rows: by the sums of each key, no pairs), ``lin_max`` and, of the rows
    that share a key and have an rbf of at least ``least``, ``n_near`` and ``rbf_near`` (sum).  Without such a row: 0 and null."""
    entries = entries.checkpoint()
    e = entries.select(F.col(id_col).alias("id"), F.col(k).alias("k"), F.col(v).cast("double").alias("v"))
    total = e.groupBy("k").agg(F.sum("v").alias("_all"))
    sums = e.join(total, "k").groupBy("id").agg(F.sum(F.col("v") * (F.col("_all") - F.col("v"))).alias("lin_sum"))
    pairs = sparse_pairs(entries, sigma, least, id_col, k, v)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("id"), "dot", "rbf")
    near = sides.groupBy("id").agg(F.max("dot").alias("lin_max"), F.count(F.lit(1)).alias("n_near"), F.sum("rbf").alias("rbf_near"))
    return sums.join(near, "id", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "rbf_near": F.coalesce("rbf_near", F.lit(0.0))})
