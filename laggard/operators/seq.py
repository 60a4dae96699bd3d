"""Order-dependent primitives that stay parallel when one stream is huge.

A stream (``keys``) may hold a third of all rows, so nothing here uses a window
``partitionBy(keys)`` over raw rows.  Instead:

* ``number_rows``  -- dense 0-based position ``t`` per stream.  Rows are cut into
  order buckets (e.g. one day of ``ts``); counts per (stream, bucket) are
  pre-aggregated, offsets come from a window over the *bucket* table (n/bucket
  rows per stream), and the row number is computed per (stream, bucket).
* ``running_sums`` -- prefix sums through fixed blocks of ``t``: block totals,
  an offset window over blocks, and an in-block running window.
* ``shift``         -- ``lag``/``lead`` by ``d`` positions as an equi-join on
  ``(keys, t)``, which hashes on ``t`` as well and so never concentrates a
  stream in one task.
* ``sliding_sums`` -- sum over the last ``w`` rows = P(t) - P(t-w), a
  ``running_sums`` plus one ``shift``.  Exact for integer-valued inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                out: str = "t", bucket: Column | None = None, start: int = 0) -> DataFrame:
    """Add ``out`` = position of the row inside its stream by ``order`` (0-based + start).

    ``bucket`` must be monotone non-decreasing in ``order`` (e.g. day of the
    timestamp that leads ``order``).  Without it a plain per-stream window is
    used, which is fine only when no stream is large.
    """
    keys = _cols(keys)
    order = list(order)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w) - 1 + start)
    d = df.withColumn("_nb", bucket)
    counts = d.groupBy(*keys, "_nb").agg(F.count(F.lit(1)).alias("_nn"))
    wb = Window.partitionBy(*keys).orderBy("_nb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_nb", F.coalesce(F.sum("_nn").over(wb), F.lit(0)).alias("_no"))
    wr = Window.partitionBy(*keys, "_nb").orderBy(*order)
    return (d.withColumn("_nr", F.row_number().over(wr))
            .join(offs, [*keys, "_nb"])
            .withColumn(out, (F.col("_no") + F.col("_nr") - 1 + start).cast("bigint"))
            .drop("_nb", "_nr", "_no"))


def running_sums(df: DataFrame, keys: Sequence[str], t: str, cols: dict[str, Column | str],
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add inclusive prefix sums ``{out: expr}`` over ``t`` within each stream."""
    keys = _cols(keys)
    exprs = {o: (F.col(c) if isinstance(c, str) else c) for o, c in cols.items()}
    d = df.withColumn("_blk", F.floor(F.col(t) / block))
    for o, e in exprs.items():
        d = d.withColumn(f"_v_{o}", e)
    tot = d.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{o}").alias(f"_s_{o}") for o in exprs])
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "_blk", *[F.coalesce(F.sum(f"_s_{o}").over(wb), F.lit(0))
                                       .alias(f"_o_{o}") for o in exprs])
    wi = Window.partitionBy(*keys, "_blk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    for o in exprs:
        d = d.withColumn(f"_i_{o}", F.sum(f"_v_{o}").over(wi))
    d = d.join(offs, [*keys, "_blk"])
    for o in exprs:
        d = d.withColumn(o, F.col(f"_o_{o}") + F.col(f"_i_{o}"))
    drop = ["_blk"] + [f"_{p}_{o}" for o in exprs for p in ("v", "o", "i")]
    return d.drop(*drop)


def shift(df: DataFrame, keys: Sequence[str], t: str, d: int, cols: dict[str, str],
          how: str = "left") -> DataFrame:
    """Attach values of row ``t - d`` (``d`` > 0 = lag, < 0 = lead) as ``{out: src}``."""
    keys = _cols(keys)
    src = df.select(*keys, (F.col(t) + d).alias(t), *[F.col(s).alias(o) for o, s in cols.items()])
    return df.join(src, [*keys, t], how)


def sliding_sums(df: DataFrame, keys: Sequence[str], t: str, w: int, cols: dict[str, Column | str],
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``{out: sum of expr over rows [t-w+1, t]}`` plus ``{out}_n`` = rows in the frame."""
    keys = _cols(keys)
    pref = {f"_p_{o}": c for o, c in cols.items()}
    d = running_sums(df, keys, t, pref, block)
    d = shift(d, keys, t, w, {f"_q_{o}": f"_p_{o}" for o in cols})
    for o in cols:
        d = d.withColumn(o, F.col(f"_p_{o}") - F.coalesce(F.col(f"_q_{o}"), F.lit(0)))
        d = d.withColumn(f"{o}_n", F.least(F.col(t) + 1, F.lit(w)))
    return d.drop(*[f"_p_{o}" for o in cols], *[f"_q_{o}" for o in cols])


def framed(df: DataFrame, keys: Sequence[str], k: str, lo: int, hi: int,
           aggs: dict, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Row-frame window ``rowsBetween(lo, hi)`` over dense ``k`` without a per-stream partition.

    Rows are cut into blocks of ``block`` positions; each block also receives
    the ``-lo`` rows before it and the ``hi`` rows after it (a halo), the
    window runs per (stream, block), and only the block's own rows are kept.
    ``aggs`` maps output name -> function(window_spec) -> Column.
    """
    keys = _cols(keys)
    assert block > max(-lo, hi, 0)
    own = F.floor(F.col(k) / block)
    pos = F.col(k) - own * block
    halo = F.array(own)
    if hi > 0:   # first hi rows of a block are also needed by the previous block
        halo = F.array_union(halo, F.when(pos < hi, F.array(own - 1)).otherwise(F.array(own)))
    if lo < 0:   # last -lo rows of a block are also needed by the next block
        halo = F.array_union(halo, F.when(pos >= block + lo, F.array(own + 1)).otherwise(F.array(own)))
    d = df.withColumn("_own", own).withColumn("_hb", F.explode(halo))
    w = Window.partitionBy(*keys, "_hb").orderBy(k).rowsBetween(lo, hi)
    for name, fn in aggs.items():
        d = d.withColumn(name, fn(w))
    return d.where(F.col("_hb") == F.col("_own")).drop("_own", "_hb")


def value_ranks(df: DataFrame, keys: Sequence[str], v: str, buckets: int = 1 << 16) -> DataFrame:
    """Per distinct (keys, v): ``n_eq`` rows equal to v, ``n_below`` rows strictly below,
    ``n`` rows in the group -- the ECDF of v, without a per-group window over rows.

    Values are pre-aggregated to distinct (key, value) counts, bucketed by their
    position between the group's min and max, and the prefix count is a window
    over the bucket totals plus an in-bucket window.
    """
    keys = _cols(keys)
    s = df.where(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias("n_eq"))
    st = s.groupBy(*keys).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"),
                              F.sum("n_eq").alias("n"))
    span = F.col("_mx") - F.col("_mn")
    b = F.when(span > 0, F.least(F.floor((F.col(v) - F.col("_mn")) / span * buckets),
                                 F.lit(buckets - 1))).otherwise(F.lit(0))
    s = s.join(st, keys).withColumn("_b", b.cast("long"))
    tot = s.groupBy(*keys, "_b").agg(F.sum("n_eq").alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_b", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(*keys, "_b").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_in", F.coalesce(F.sum("n_eq").over(wi), F.lit(0)))
         .join(tot, [*keys, "_b"])
         .withColumn("n_below", F.col("_off") + F.col("_in")))
    return s.select(*keys, v, "n_eq", "n_below", "n")
