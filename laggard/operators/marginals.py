"""Marginal transforms between observed values and the latent normal scale.

Offline (whole column): A11-A14, W04, W05, W08.  Windowed / online (last W
observed values of a column): W06, W07, W10.  All on the ``cells`` layout
``(stream_id, t, col, v)``.  The ECDF comes from ``value_ranks`` (pre-aggregated
prefix counts); sorted-order lookups are equi-joins on dense positions, so no
column is ever collected into one array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laggard.functions.normal import phi_inv_sql, phi_sql
from laggard.operators.seq import framed, number_rows, value_ranks
from laggard.operators.whole import by_length
from laggard.operators.whole_em import impute_scan, latent_scan

GROUP = ["stream_id", "col"]


def col_stats(cells: DataFrame, group: Sequence[str] = GROUP, v: str = "v") -> DataFrame:
    """N, mean, population sd, min, max of observed cells."""
    return cells.groupBy(*group).agg(F.count(v).alias("n_obs"), F.avg(v).alias("mean"),
                                     F.stddev_pop(v).alias("sd"), F.min(v).alias("min"),
                                     F.max(v).alias("max"))


def ord_gap(cells: DataFrame, group: Sequence[str] = GROUP, v: str = "v") -> DataFrame:
    """Half the smallest gap between distinct values; NULL for a single-valued column.
    The lag runs over *distinct* values, at most ``max_ord`` per ordinal column."""
    d = cells.select(*group, v).distinct()
    w = Window.partitionBy(*group).orderBy(v)
    d = d.withColumn("_gap", F.col(v) - F.lag(v).over(w))
    return d.groupBy(*group).agg((F.min("_gap") / 2.0).alias("gap"))


def ecdf(cells: DataFrame, group: Sequence[str] = GROUP, v: str = "v") -> DataFrame:
    """Attach ``n_below``, ``n_eq``, ``n`` (observed count) of each cell's value."""
    r = value_ranks(cells, group, v)
    return cells.join(r, [*group, v])


def cont_latent(cells: DataFrame, n_rows: DataFrame, group: Sequence[str] = GROUP,
                v: str = "v", latent_sd: float = 1.0) -> DataFrame:
    """z = sd * Phi^-1(n/(n+1) * F(v)), F = ECDF of observed cells, n = rows of the
    stream (``n_rows``: keys -> n_rows)."""
    r = value_ranks(cells, group, v).join(n_rows, [g for g in group if g in n_rows.columns])
    q = "(CAST(n_rows AS DOUBLE) / (n_rows + 1)) * ((n_below + n_eq) / CAST(n AS DOUBLE))"
    r = r.withColumn("_q", F.expr(q)).withColumn("z", F.expr(phi_inv_sql("_q")) * latent_sd)  # once a value, not a cell
    return cells.join(r.select(*group, v, "z"), [*group, v])


def ord_interval(cells: DataFrame, group: Sequence[str] = GROUP, v: str = "v") -> DataFrame:
    """Latent interval [Phi^-1(F(v-)), Phi^-1(F(v))] of an ordinal cell (+-inf at the ends)."""
    r = value_ranks(cells, group, v).withColumns({"_lo": F.expr("n_below / CAST(n AS DOUBLE)"), "_hi": F.expr("(n_below + n_eq) / CAST(n AS DOUBLE)")})
    r = r.withColumns({"lo": F.expr(phi_inv_sql("_lo")), "hi": F.expr(phi_inv_sql("_hi"))})
    return cells.join(r.select(*group, v, "lo", "hi"), [*group, v])


POSITION_BLOCK = 1 << 16


def values_at(wanted: DataFrame, cells: DataFrame, group: Sequence[str] = GROUP, v: str = "v", pos: str = "pos") -> DataFrame:
    """The observed value at each wanted 0-based sorted position: ``group, pos, value``, one row for each
    distinct wanted position.

    Positions come from counts of distinct values, so a value that most rows share is one run,
    not a row each.  Runs and wanted positions are cut into blocks of positions; within a block
    the run that starts last before a position holds it."""
    group = list(group)
    r = value_ranks(cells, group, v)
    at = F.floor(F.col("n_below") / POSITION_BLOCK).cast("long")
    end = F.floor((F.col("n_below") + F.col("n_eq") - 1) / POSITION_BLOCK).cast("long")
    starts = r.select(*group, F.col(v).alias("value"), "n_below", F.explode(F.sequence(at, end)).alias("_blk")) \
        .select(*group, "_blk", F.greatest("n_below", F.col("_blk") * POSITION_BLOCK).cast("long").alias(pos), "value", F.lit(0).alias("_ask"))
    asked = wanted.select(*group, F.col(pos).cast("long").alias(pos)).where(F.col(pos).isNotNull()).distinct() \
        .select(*group, F.floor(F.col(pos) / POSITION_BLOCK).cast("long").alias("_blk"), pos,
                F.lit(None).cast(dict(cells.dtypes)[v]).alias("value"), F.lit(1).alias("_ask"))
    w = Window.partitionBy(*group, "_blk").orderBy(pos, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("value", F.last("value", ignorenulls=True).over(w)) \
        .where("_ask = 1").select(*group, pos, "value")


def values_between(queries: DataFrame, cells: DataFrame, lo: str, group: Sequence[str] = GROUP, v: str = "v") -> DataFrame:
    """``queries`` with ``_a``, the observed value at 0-based sorted position ``lo``, and ``_b``, the one at ``lo`` + 1 (``_a`` at the end).

    The queries themselves pass through the blocks of positions of ``values_at`` and are sent once.  A run that begins a block
    is in the block before it too, as the next value of that block's last position.  ``_at`` is twice the position, and one more for
    a query."""
    group = list(group)
    r = value_ranks(cells, group, v)
    at = F.floor(F.greatest(F.col("n_below") - 1, F.lit(0)) / POSITION_BLOCK).cast("long")
    end = F.floor((F.col("n_below") + F.col("n_eq") - 1) / POSITION_BLOCK).cast("long")
    kind = queries.select(F.struct(*[c for c in queries.columns if c not in group]).alias("_row")).schema["_row"].dataType
    starts = r.select(*group, F.col(v).alias("_v"), "n_below", F.explode(F.sequence(at, end)).alias("_blk"))
    starts = starts.select(*group, "_blk", (2 * F.greatest("n_below", F.col("_blk") * POSITION_BLOCK)).cast("long").alias("_at"), "_v",
                           F.lit(None).cast(kind).alias("_row"))
    asked = queries.select(*group, F.floor(F.col(lo) / POSITION_BLOCK).cast("long").alias("_blk"), (2 * F.col(lo) + 1).cast("long").alias("_at"),
                           F.lit(None).cast(dict(cells.dtypes)[v]).alias("_v"), F.struct(*kind.names).alias("_row"))
    block = Window.partitionBy(*group, "_blk")
    upto = block.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    after = block.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(F.col("_row").isNull(), F.struct("_at", "_v"))
    d = starts.unionByName(asked).withColumns({"_next": F.last(begins, ignorenulls=True).over(after), "_a": F.last("_v", ignorenulls=True).over(upto)})
    b = F.when(F.col("_next._at") == F.col("_at") + 1, F.col("_next._v")).otherwise(F.col("_a"))
    d = d.where("_row IS NOT NULL").select(*group, "_row", "_a", b.alias("_b"))
    return d.select(*[F.col(c) if c in group else F.col(f"_row.{c}").alias(c) for c in queries.columns], "_a", "_b")


def quantile_lookup(queries: DataFrame, cells: DataFrame, q: str, group: Sequence[str] = GROUP,
                    v: str = "v", out: str = "x_imp", few: bool = False) -> DataFrame:
    """Numpy 'linear' quantile of the group's observed values at per-row probability q.

    Index h = q (n-1); value = lerp(x[floor h], x[ceil h], h - floor h) with numpy's
    two-sided lerp.  Both neighbours are looked up by position: ``values_between``, or ``values_at`` and joins where a
    group has a few queries only, which are cheaper to join than all values are to sort twice.
    """
    group = list(group)
    n = cells.groupBy(*group).agg(F.count(v).alias("_n"))
    d = queries.join(n, group).withColumn("_h", F.col(q) * (F.col("_n") - 1))
    d = d.withColumn("_lo", F.floor("_h"))
    if few:
        known = values_at(d.select(*group, F.explode(F.array(F.col("_lo"), F.ceil("_h"))).alias("pos")), cells, group, v)
        lo = known.select(*group, F.col("pos").alias("_lo"), F.col("value").alias("_a"))
        hi = known.select(*group, F.col("pos").alias("_hi"), F.col("value").alias("_b"))
        d = d.withColumn("_hi", F.ceil("_h")).join(lo, [*group, "_lo"], "left").join(hi, [*group, "_hi"], "left").drop("_hi")
    else:
        d = values_between(d, cells, "_lo", group, v)
    tt = F.col("_h") - F.col("_lo")
    diff = F.col("_b") - F.col("_a")
    val = F.when(tt == 0, F.col("_a")).when(tt >= 0.5, F.col("_b") - diff * (1 - tt)).otherwise(F.col("_a") + diff * tt)
    return d.withColumn(out, val).drop("_n", "_h", "_lo", "_a", "_b")


def inverse_ecdf(queries: DataFrame, cells: DataFrame, q: str, group: Sequence[str] = GROUP,
                 v: str = "v", out: str = "x_imp") -> DataFrame:
    """Ordinal inverse ECDF: sorted[clip(ceil(round_half_even((n+1)q - 1, 3)), 0, n-1)]."""
    group = list(group)
    n = cells.groupBy(*group).agg(F.count(v).alias("_n"))
    idx = F.ceil(F.bround((F.col("_n") + 1) * F.col(q) - 1, 3))
    d = queries.join(n, group).withColumn("_i", F.least(F.greatest(idx, F.lit(0)), F.col("_n") - 1))
    known = values_at(d.select(*group, F.col("_i").alias("pos")), cells, group, v) \
        .select(*group, F.col("pos").alias("_i"), F.col("value").alias(out))
    return d.join(known, [*group, "_i"], "left").drop("_n", "_i")


def impute_missing(wide_cells: DataFrame, cells: DataFrame, kinds: dict[int, str], q: str,
                   group: Sequence[str] = GROUP, v: str = "v", out: str = "x_imp") -> DataFrame:
    """Latent -> observed for *missing* cells only (continuous: A14, ordinal: A13);
    observed cells keep their value.  ``wide_cells`` = all cells incl. NULL ``v`` and a
    probability column ``q`` (= Phi(z))."""
    return impute_with_medians(wide_cells, cells, kinds, q, group, v, out)[0]


def impute_rows(rows: DataFrame, cols: Sequence[str], is_ord: Sequence[bool], z: str = "z_imp", keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """``impute_with_medians`` of wide rows whose streams stand whole and in order (``whole_em.latent_scan``): arrays ``x_imp`` and ``med``."""
    return impute_scan(rows, cols, is_ord, z, keys)


def impute_with_medians(wide_cells: DataFrame, cells: DataFrame, kinds: dict[int, str], q: str, group: Sequence[str] = GROUP, v: str = "v",
                        out: str = "x_imp", median: str = "med") -> tuple[DataFrame, DataFrame]:
    """(``impute_missing``, each group's median).  All asked for is a value at a sorted position, or a point between two: the cells
    are ranked once, and every position, of either kind and of the medians, is looked up in that one table."""
    group = list(group)
    n = cells.groupBy(*group).agg(F.count(v).alias("_n")).checkpoint()
    cont = F.col("col").isin([c for c, k in kinds.items() if k == "cont"])
    h = F.col(q) * (F.col("_n") - 1)
    idx = F.least(F.greatest(F.ceil(F.bround((F.col("_n") + 1) * F.col(q) - 1, 3)), F.lit(0)), F.col("_n") - 1)
    miss = wide_cells.where(F.col(v).isNull()).join(n, group)
    at = lambda e, other: F.when(cont, e).otherwise(other).cast("long")
    miss = miss.withColumns({"_lo": at(F.floor(h), idx), "_f": F.when(cont, h - F.floor(h)).otherwise(0.0)})
    mid = (F.col("_n") - 1) * 0.5
    mids = n.where("_n > 0").select(*group, F.floor(mid).cast("long").alias("_lo"), (mid - F.floor(mid)).alias("_f"))
    rest = [c for c in wide_cells.columns if c not in group]
    asked = miss.select(*group, "_lo", "_f", F.struct(*rest).alias("_cell"))
    asked = asked.unionByName(mids.withColumn("_cell", F.lit(None).cast(asked.schema["_cell"].dataType)))
    diff = F.col("_b") - F.col("_a")
    value = F.when(F.col("_f") == 0, F.col("_a")).when(F.col("_f") >= 0.5, F.col("_b") - diff * (1 - F.col("_f"))).otherwise(F.col("_a") + diff * F.col("_f"))
    found = values_between(asked, cells, "_lo", group, v).select(*group, "_cell", value.alias("_value")).checkpoint()
    filled = found.where("_cell IS NOT NULL").select(*[F.col(c) if c in group else F.col(f"_cell.{c}").alias(c) for c in wide_cells.columns],
                                                     F.col("_value").alias(out))
    whole = wide_cells.where(F.col(v).isNotNull()).withColumn(out, F.col(v))
    return whole.unionByName(filled), found.where("_cell IS NULL").select(*group, F.col("_value").alias(median))


# ---------------------------------------------------------------------------
# windowed (online) marginals

def window_values(cells: DataFrame, w: int, group: Sequence[str] = GROUP, v: str = "v",
                  t: str = "t") -> DataFrame:
    """For each observed cell, the last ``w`` observed values of its column up to and
    including it (``win`` array).  Positions are renumbered over observed cells so the
    frame counts observations, not rows."""
    group = list(group)
    d = number_rows(cells, group, [t], out="_k", bucket=F.floor(F.col(t) / 65536))
    return framed(d, group, "_k", -(w - 1), 0,
                  {"win": lambda win: F.collect_list(v).over(win)}).drop("_k")


def window_cont_latent(cells: DataFrame, w: int, group: Sequence[str] = GROUP, v: str = "v",
                       t: str = "t", zero_q: str = "reference") -> DataFrame:
    """q = l/(l+1) * share of window values <= v; q = 0 -> l/(l+1)/2 (reference) or
    1/(2(l+1)) ('tail'); z = Phi^-1(q)."""
    d = window_values(cells, w, group, v, t)
    d = d.withColumn("_l", F.size("win").cast("double"))
    d = d.withColumn("_q", (F.col("_l") / (F.col("_l") + 1))
                     * (F.size(F.filter("win", lambda a: a <= F.col(v))) / F.col("_l")))
    zq = (F.col("_l") / (F.col("_l") + 1) / 2) if zero_q == "reference" else (1 / (2 * (F.col("_l") + 1)))
    d = d.withColumn("_q", F.when(F.col("_q") == 0, zq).otherwise(F.col("_q")))
    return d.withColumn("z", F.expr(phi_inv_sql("_q"))).drop("_l", "_q")


def window_ord_interval(cells: DataFrame, w: int, group: Sequence[str] = GROUP, v: str = "v",
                        t: str = "t") -> DataFrame:
    """Windowed ordinal interval; a single-valued window gives (-inf, +inf)."""
    d = window_values(cells, w, group, v, t)
    # each share is counted once; the quantile's text names it many times
    share = lambda test: F.size(F.filter("win", test)) / F.size("win").cast("double")
    d = d.withColumns({"_nd": F.array_min("win") < F.array_max("win"), "_lo": share(lambda a: a < F.col(v)), "_hi": share(lambda a: a <= F.col(v))})
    inf = F.lit(float("inf"))
    return (d.withColumn("lo", F.when(F.col("_nd"), F.expr(phi_inv_sql("_lo"))).otherwise(-inf))
            .withColumn("hi", F.when(F.col("_nd"), F.expr(phi_inv_sql("_hi"))).otherwise(inf))
            .drop("_nd", "_lo", "_hi"))


def phi_col(c: str):
    return F.expr(phi_sql(c))


def group_quantile(cells: DataFrame, group: Sequence[str], q: float, v: str = "v",
                   out: str = "quantile", t: str = "t") -> DataFrame:
    """numpy-linear quantile per group (median at q = 0.5) through sorted positions;
    unlike an exact percentile aggregate it never holds a group in one buffer."""
    group = list(group)
    qs = cells.select(*group).distinct().withColumn("_q", F.lit(float(q)))
    return quantile_lookup(qs, cells.select(*group, v), "_q", group, v, out, few=True).drop("_q")


#: Values of a column in any one stream up to which its scores are looked up in a map.
FEW_VALUES = 64


def latent_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "z_",
                   latent_sd: float = 1.0, whole: int = 0) -> DataFrame:
    """W04 on a wide table: for every column, z = Phi^-1(n/(n+1) F(v)) with the offline
    ECDF of its stream (n = rows of the stream).  Streams of up to ``whole`` rows are ranked whole in one scan, longer ones by
    their distinct values."""
    if not whole:
        return _latent_by_value(df, keys, cols, prefix, latent_sd)
    keys, cols, zs = list(keys), list(cols), [f"{prefix}{c}" for c in cols]
    short, long, rest = by_length(df, keys, whole)
    z = latent_scan(short, cols, [False] * len(cols), keys, None, [c for c in df.columns if c not in keys])
    parts = [z.select(*df.columns, *[(F.col(f"z{i}") * latent_sd).alias(n) for i, n in enumerate(zs)])]
    if long is not None:
        parts.append(_latent_by_value(long, keys, cols, prefix, latent_sd))
    if rest is not None:
        parts.append(rest.select(*df.columns, *[F.lit(None).cast("double").alias(n) for n in zs]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _latent_by_value(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str, latent_sd: float) -> DataFrame:
    """``latent_columns`` by values.  The columns are unpivoted once: one ECDF, and one score
    for each distinct value, which the rows then look up: columns that have few values in every stream all at once, in maps that are
    a row a stream; each of the others by a join on its values."""
    keys, cols = list(keys), list(cols)
    cells = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    r = value_ranks(cells, [*keys, "_col"], "_v").join(n, keys)
    q = "(CAST(_nr AS DOUBLE) / (_nr + 1)) * ((n_below + n_eq) / CAST(n AS DOUBLE))"
    r = r.select(*keys, "_col", "_v", (F.expr(phi_inv_sql(q)) * latent_sd).alias("_z")).checkpoint()
    most = r.groupBy(*keys, "_col").agg(F.count(F.lit(1)).alias("_n")).groupBy("_col").agg(F.max("_n").alias("_n")).collect()
    few = [m["_col"] for m in most if m["_n"] <= FEW_VALUES]
    out = df
    for i in (i for i in range(len(cols)) if i not in few):
        z = r.where(F.col("_col") == i).select(*keys, F.col("_v").alias(f"_v{i}"), F.col("_z").alias(f"_z{i}"))
        out = out.withColumn(f"_v{i}", F.col(cols[i]).cast("double")).join(z, [*keys, f"_v{i}"], "left").drop(f"_v{i}")
    if few:
        scores = lambda i: F.map_from_entries(F.collect_list(F.when(F.col("_col") == i, F.struct("_v", "_z")))).alias(f"_m{i}")
        maps = r.where(F.col("_col").isin(few)).groupBy(*keys).agg(*[scores(i) for i in few])
        out = out.join(maps, keys, "left").withColumns({f"_z{i}": F.try_element_at(f"_m{i}", F.col(cols[i]).cast("double")) for i in few})
    return out.select(*df.columns, *[F.col(f"_z{i}").alias(f"{prefix}{c}") for i, c in enumerate(cols)])
