"""Column typing, binning and simple projections.

Typing works on the ``cells`` layout (one row per observed cell) with
``groupBy(group, col)`` aggregates, which Spark pre-aggregates map-side; the
resulting column metadata is one row per (stream, column) and is joined back
(AQE turns it into a broadcast once its real size is known).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laggard.functions.hashing import hash32
from laggard.operators.learner import for_scan
from laggard.operators.seq import value_ranks
from laggard.operators.whole import added, by_length, starts_of, whole_keys
from laggard.operators.whole_em import Ranks, scan

REF_MAX_ORD = 14        # fixed value: > 14 distinct values => continuous (helpers); EM default is 5


def col_kinds(cells: DataFrame, group: Sequence[str] = ("stream_id",), max_ord: int = REF_MAX_ORD,
              col: str = "col", v: str = "v") -> DataFrame:
    """``kind`` = 'cont' when the column has more than ``max_ord`` distinct observed values."""
    g = [*group, col]
    d = cells.where(F.col(v).isNotNull()).groupBy(*g).agg(F.count_distinct(v).alias("n_distinct"))
    return d.withColumn("kind", F.when(F.col("n_distinct") > max_ord, "cont").otherwise("ord"))


def mixed_table(wide_cells: DataFrame, group: Sequence[str] = ("stream_id",), col: str = "col",
                v: str = "v", min_unique: int = 14) -> DataFrame:
    """A column is continuous if any value is fractional (a missing cell counts as
    fractional, as NaN % 1 != 0 in pandas) or it has >= 14 distinct values; the table is
    *mixed* when some but not all columns are continuous.  Input includes NULL cells."""
    g = [*group, col]
    frac = F.max((F.col(v).isNull() | (F.col(v) % 1 != 0)).cast("int")) == 1
    c = wide_cells.groupBy(*g).agg(frac.alias("_frac"), F.count_distinct(v).alias("_nu"))
    c = c.withColumn("is_cont", F.col("_frac") | (F.col("_nu") >= min_unique))
    return c.groupBy(*group).agg(
        F.sum(F.col("is_cont").cast("int")).alias("n_cont"), F.count(F.lit(1)).alias("n_cols"),
        (F.bool_or("is_cont") & ~F.bool_and("is_cont")).alias("is_mixed"))


def discreteness(wide_cells: DataFrame, group: Sequence[str] = ("stream_id",), col: str = "col",
                 v: str = "v") -> DataFrame:
    """(distinct values, a missing value counting as one) / rows."""
    g = [*group, col]
    return wide_cells.groupBy(*g).agg(
        ((F.count_distinct(v) + F.max(F.col(v).isNull().cast("int"))) / F.count(F.lit(1)))
        .alias("score"))


def edge_bins(v, mn, mx, k: int):
    """Equal-width label 0..k-1 as pandas ``cut(bins=k)``: right-closed bins over
    ``linspace(min, max, k+1)``; the count of interior edges strictly below v, with edges
    computed as ``min + i * ((max-min)/k)`` like numpy.  Constant column -> ceil(k/2)-1."""
    step = (mx - mn) / k
    lab = sum((F.when(v > mn + F.lit(float(i)) * step, 1).otherwise(0) for i in range(1, k)),
              F.lit(0))
    return F.when(mx == mn, F.lit(-(-k // 2) - 1)).otherwise(lab)


def ordinalise(v, mn, mx, k: int):
    """Number of the k cut-offs linspace(min, max, k+1)[1:] strictly below v."""
    step = (mx - mn) / k
    return sum((F.when(v > mn + F.lit(float(i)) * step, 1).otherwise(0) for i in range(1, k + 1)),
               F.lit(0))


def auto_bin_plan(wide_cells: DataFrame, group: Sequence[str] = ("stream_id",),
                  col: str = "col", v: str = "v") -> DataFrame:
    """Per stream, columns sorted by discreteness (ties by index): the lowest
    int(p/3) get 2 bins, the next up to int(2p/3) get 5 bins, the rest stay (0)."""
    d = discreteness(wide_cells, group, col, v)
    w = Window.partitionBy(*group).orderBy("score", col)
    d = d.withColumn("_r", F.row_number().over(w) - 1)
    d = d.withColumn("_p", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    bins = (F.when(F.col("_r") < F.floor(F.col("_p") / 3), 2)
            .when(F.col("_r") < F.floor(F.col("_p") * 2 / 3), 5).otherwise(0))
    return d.withColumn("bins", bins).drop("_r", "_p")


def positional_bin_plan(p: int) -> dict[int, int]:
    """Middle third -> 2 bins, last third -> 5 bins (index ranges as the reference)."""
    third = p // 3
    return {i: (2 if third <= i < 2 * third else 5 if i >= 2 * third else 0) for i in range(p)}


def apply_bins(wide_cells: DataFrame, plan: DataFrame | dict[int, int],
               group: Sequence[str] = ("stream_id",), col: str = "col", v: str = "v",
               out: str = "v_bin") -> DataFrame:
    """Bin each cell by its column's plan (bins 0 = unchanged), min/max per column.
    ``plan`` is a per-(stream, col) table (P04) or a fixed {col: bins} map (P06)."""
    g = [*group, col]
    mm = wide_cells.groupBy(*g).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    if isinstance(plan, dict):
        bins = F.lit(0)
        for c, b in sorted(plan.items()):
            bins = F.when(F.col(col) == c, F.lit(b)).otherwise(bins)
        d = wide_cells.withColumn("bins", bins).join(mm, g)
    else:
        d = wide_cells.join(plan.select(*g, "bins"), g).join(mm, g)
    vv, mn, mx = F.col(v), F.col("_mn"), F.col("_mx")
    res = (F.when(F.col("bins") == 2, edge_bins(vv, mn, mx, 2))
           .when(F.col("bins") == 5, edge_bins(vv, mn, mx, 5)).otherwise(vv))
    return d.withColumn(out, F.when(vv.isNull(), None).otherwise(res.cast("double"))).drop("_mn", "_mx")


def _draw(h: str, t: str):
    """One number in the order of (h, t), for a 32-bit hash and a position: minima by numbers are kept in a hash table, those by a
    struct need all rows sorted."""
    fits = F.col(t).cast("long").between(0, (1 << 31) - 1)
    return F.when(fits, F.shiftleft(h, 31) + F.col(t)).otherwise(F.raise_error(F.lit("a stream of more than 2^31 rows")).cast("long"))


def binarise_random(cells: DataFrame, seed: int, group: Sequence[str] = ("stream_id", "col"),
                    v: str = "v", t: str = "t") -> DataFrame:
    """Cut-off = an observed value with 10-90 % of the values strictly below it, the
    row picked by smallest hash (the reference draws rows uniformly until one
    qualifies); output ``v > cutoff``.  NULL cut-off if no value qualifies."""
    group = list(group)
    short, long, rest = by_length(cells, group)
    kind = cells.schema[v].dataType
    if not isinstance(kind, (T.DoubleType, T.FloatType, T.IntegralType)):  # the scan ranks numbers
        short, long, rest = None, cells, None
    parts = [] if short is None else [_cutoffs_in_scan(short, seed, group, v, t)]
    if long is not None:
        r = value_ranks(long, group, v)
        d = long.join(r, [*group, v])
        elig = d.where((F.col("n_below") > 0.1 * F.col("n")) & (F.col("n_below") < 0.9 * F.col("n")))
        elig = elig.withColumn("_h", hash32(str(seed), *group, t))
        parts.append(long.join(elig.groupBy(*group).agg(F.min_by(v, _draw("_h", t)).alias("cutoff")), group, "left").select(*cells.columns, "cutoff"))
    if rest is not None:
        parts.append(rest.withColumn("cutoff", F.lit(None).cast(kind)))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("v_bin", (F.col(v) > F.col("cutoff")).cast("int"))


def _cutoffs_in_scan(cells: DataFrame, seed: int, group: Sequence[str], v: str, t: str) -> DataFrame:
    """``cells`` with ``cutoff``: of the values with 10-90 % of their column's strictly below, the one of the row of the smallest hash."""
    head = cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, group):
            first = starts_of(table, group)
            owner, drawn = np.cumsum(first) - 1, table.column("_d").to_numpy()
            values, seen = table.column(v), table.column(v).is_valid().to_numpy()
            r = Ranks(values.fill_null(0).to_numpy(), seen, owner, int(first.sum()))
            below, n = r.below, r.n[r.run_owner]
            at = r.order[np.repeat((below > 0.1 * n) & (below < 0.9 * n), r.length)]
            at = at[np.lexsort((drawn[at], owner[at]))]
            of, least = np.unique(owner[at], return_index=True)
            row = np.full(r.streams, -1)
            row[of] = at[least]
            row = row[owner]
            yield from added(table, head, cutoff=values.take(pa.array(row, mask=row < 0)))

    d = for_scan(cells, group, t).withColumn("_d", _draw(hash32(str(seed), *group, t), t))
    return scan(d, run, f"cutoff {cells.schema[v].dataType.simpleString()}", head)


def quantile_cutoffs(cells: DataFrame, seed: int, k: int = 2,
                     group: Sequence[str] = ("stream_id", "col"), v: str = "v",
                     t: str = "t") -> DataFrame:
    """Candidates strictly between the 5 % and 95 % quantiles (numpy linear);
    k = 2 -> ``v >= c`` with c the smallest-hash candidate; k > 2 -> digitise by the k-1
    smallest-hash distinct candidates plus [min - 0.1 sd, max + 0.1 sd]."""
    from laggard.operators.marginals import quantile_lookup
    group = list(group)
    st = cells.groupBy(*group).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"),
                                   F.stddev_pop(v).alias("_sd"))
    qs = st.select(*group).withColumn("_qq", F.explode(F.array(F.lit(0.05), F.lit(0.95))))
    qv = quantile_lookup(qs, cells, "_qq", group, v, out="_qv", few=True)
    q = (qv.groupBy(*group).agg(F.min(F.when(F.col("_qq") == 0.05, F.col("_qv"))).alias("_q05"),
                                F.min(F.when(F.col("_qq") == 0.95, F.col("_qv"))).alias("_q95"))
         .join(st, group))
    d = cells.join(q, group)
    cand = d.where((F.col(v) > F.col("_q05")) & (F.col(v) < F.col("_q95")))
    cand = cand.withColumn("_h", hash32(str(seed), *group, t))
    if k == 2:
        cut = cand.groupBy(*group).agg(F.min_by(v, _draw("_h", t)).alias("cutoff"))
        return (cells.join(cut, group, "left")
                .withColumn("v_bin", (F.col(v) >= F.col("cutoff")).cast("int")))
    # distinct candidates ranked by their smallest hash; k-1 lowest kept
    dc = cand.groupBy(*group, v).agg(F.min(F.struct("_h", t)).alias("_hk"))
    w = Window.partitionBy(*group).orderBy("_hk")
    dc = dc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k - 1)
    cuts = dc.groupBy(*group).agg(F.array_sort(F.collect_list(v)).alias("cuts"))
    d = d.join(cuts, group, "left")
    edges = F.concat(F.array(F.col("_mn") - 0.1 * F.col("_sd")), F.col("cuts"),
                     F.array(F.col("_mx") + 0.1 * F.col("_sd")))
    # numpy.digitize (right=False): number of edges <= v
    return (d.withColumn("v_bin", F.size(F.filter(edges, lambda e: e <= F.col(v))))
            .select(*cells.columns, "v_bin"))


def drop_tail(df: DataFrame, d: int, n: DataFrame, t: str = "t", keys=("stream_id",)) -> DataFrame:
    """P12 (first half): drop the last ``d`` rows of each stream (``n``: keys -> n_rows)."""
    return df.join(n, list(keys)).where(F.col(t) < F.col("n_rows") - d).drop("n_rows")


def chrono_split(df: DataFrame, n: DataFrame, frac: float = 0.7, t: str = "t",
                 keys=("stream_id",)) -> DataFrame:
    """``part`` = 'train' for t < int(frac * n) else 'test'."""
    return (df.join(n, list(keys))
            .withColumn("part", F.when(F.col(t) < F.floor(F.col("n_rows") * frac), "train")
                        .otherwise("test")).drop("n_rows"))


def stream_sizes(df: DataFrame, keys=("stream_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def reorder(x: str, order: Sequence[int]):
    """Permute an array column (ordinal-first for the solver, and back)."""
    return F.array(*[F.element_at(x, i + 1) for i in order])


def prefix_dot(w: str, x: str):
    """Dot product of a short row with the first len(x) weights."""
    return F.aggregate(F.zip_with(F.slice(w, 1, F.size(x)), x, lambda a, b: a * b),
                       F.lit(0.0), lambda acc, e: acc + e)
