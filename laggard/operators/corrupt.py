"""Dataset corruption: hidden cells, hidden and delayed labels, shuffles.

Every random choice is a hash of (seed, stream, t, col) -- see
``laggard.functions.hashing`` -- so masks are identical under any
partitioning, on task retry, and in the DuckDB oracle.  The draws differ from
NumPy's generator (which is order-dependent and cannot be reproduced in a
distributed job); the *distributional* semantics are the reference's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laggard.functions.hashing import hash32, uniform
from laggard.operators.learner import for_scan, schema_of
from laggard.operators.seq import number_rows
from laggard.operators.whole import WHOLE, added, by_length, dense, starts_of, whole_keys


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def pair_mask(df: DataFrame, cols: Sequence[str], mask_num: int, seed: int,
              keys=("stream_id",), t: str = "t") -> DataFrame:
    """Per row and column pair (2j, 2j+1) hide ``mask_num`` (0, 1 or 2) of the two;
    an odd last column is never hidden."""
    keys = _k(keys)
    cols = list(cols)
    out = df
    for i, c in enumerate(cols):
        j = i // 2
        if 2 * j + 1 >= len(cols) or mask_num <= 0:
            continue
        if mask_num >= 2:
            hide = F.lit(True)
        else:
            hide = (hash32(str(seed), *keys, t, str(j)) % 2) == (i % 2)
        out = out.withColumn(c, F.when(hide, F.lit(None).cast("double")).otherwise(F.col(c)))
    return out


def mask_cells(cells: DataFrame, fraction: float, seed: int, keys=("stream_id",), t: str = "t",
               col: str = "col", max_retries: int = 50, seeds_per_pass: int = 4, whole: int = WHOLE) -> DataFrame:
    """Per stream hide exactly ``int(fraction * observed cells)`` cells, chosen by the
    smallest hash; if a row would lose all its cells the stream is redrawn with seed+1
    (at most ``max_retries`` times).  Output: ``cells`` plus ``masked`` BOOLEAN and ``seed``; both are
    NULL for a stream of which no draw leaves every row a cell.

    Streams of up to ``whole`` cells are drawn, and drawn again, where one scan finds them whole; longer ones
    by histograms of their hashes."""
    keys = _k(keys)
    short, long, lost = by_length(cells, keys, whole)
    out = _mask_whole(short, fraction, seed, keys, t, col, max_retries)
    if long is not None:
        out = out.unionByName(_mask_by_histogram(long, fraction, seed, keys, t, col, max_retries, seeds_per_pass))
    if lost is not None:
        out = out.unionByName(lost.select(*cells.columns, F.lit(None).cast("boolean").alias("masked"), F.lit(None).cast("bigint").alias("seed")))
    return out


def _drawn(ids: np.ndarray, h: np.ndarray, place: np.ndarray, row: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells up to the k-th of their stream by hash and place, streams with a row that keeps no cell); ``ids`` ascend."""
    order = np.lexsort((place, h, ids))
    same = (np.diff(h[order]) == 0) & (np.diff(place[order]) == 0) & (np.diff(ids[order]) == 0)
    at = np.arange(len(ids))
    at = np.maximum.accumulate(np.where(np.concatenate([[False], same]), 0, at))  # a cell that is there twice has one place
    hidden = np.zeros(len(ids), dtype=bool)
    hidden[order] = at - np.searchsorted(ids, ids) < k[ids]
    kept = np.zeros(row.max() + 1, dtype=bool)
    kept[row[~hidden]] = True
    return hidden, np.unique(ids[~kept[row]])


def _mask_whole(cells: DataFrame, fraction: float, seed: int, keys: list[str], t: str, col: str, max_retries: int) -> DataFrame:
    """``mask_cells`` of streams that fit a task.  The first draw's hashes come with the cells; those of later ones are
    taken of the streams that need them."""
    keep = cells.columns
    d = cells.withColumn("_h", hash32(str(seed), *keys, t, col)).withColumn("_name", F.concat_ws("#", *[F.col(c).cast("string") for c in (*keys, t, col)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            ids = np.cumsum(starts_of(table, keys)) - 1
            k = np.floor(np.bincount(ids) * fraction).astype(np.int64)
            rows, cols = dense(table.column(t)), dense(table.column(col))
            place = rows * (cols.max() + 1) + cols
            row = np.unique(ids * (rows.max() + 1) + rows, return_inverse=True)[1]
            masked, drawn, todo, h = np.zeros(len(ids), dtype=bool), np.full(len(k), -1, np.int64), np.arange(len(ids)), table.column("_h").to_numpy()
            for s in range(seed, seed + max_retries + 1):
                if s > seed:
                    names = table.column("_name").take(pa.array(todo)).to_pylist()
                    h = np.array([int.from_bytes(md5(f"{s}#{name}".encode()).digest()[:4], "big") for name in names], dtype=np.int64)
                hidden, bad = _drawn(ids[todo], h, place[todo], row[todo], k)
                good = ~np.isin(ids[todo], bad)
                masked[todo[good]] = hidden[good]
                drawn[ids[todo[good]]] = s
                todo = todo[~good]
                if not len(todo):
                    break
            none = np.zeros(len(ids), dtype=bool)
            none[todo] = True
            yield from added(table, keep, masked=pa.array(masked, mask=none), seed=pa.array(drawn[ids], mask=none))

    return for_scan(d, keys).mapInArrow(run, f"{schema_of(cells, keep)}, masked boolean, seed bigint")


def _mask_by_histogram(cells: DataFrame, fraction: float, seed: int, keys: list[str], t: str, col: str, max_retries: int,
                       seeds_per_pass: int) -> DataFrame:
    """``mask_cells`` of streams of any length.

    The per-stream top-k is exact without a per-stream window: hashes are histogrammed on their top 16
    bits per (stream, seed, bucket), and the cells of the one bucket that holds the cut are ranked to find
    the last hidden cell.  That cell decides all others by comparison: a draw is a row for each stream, and no
    pass writes cells.  The first pass draws one seed for all streams; each later pass evaluates
    ``seeds_per_pass`` consecutive seeds at once for the streams still pending.
    """
    n_obs = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nobs"))
    pending = n_obs.select(*keys, F.floor(F.col("_nobs") * fraction).cast("long").alias("_k")).checkpoint()
    g = [*keys, "_s"]
    place = F.struct("_h", F.col(t).alias("t"), F.col(col).alias("col"))
    done = []
    # first pass: one seed for every stream; later passes: several seeds at once, but only for
    # the few streams whose draw left an empty row
    schedule, nxt = [[seed]], seed + 1
    while nxt <= seed + max_retries:
        schedule.append(list(range(nxt, min(nxt + seeds_per_pass, seed + max_retries + 1))))
        nxt += seeds_per_pass
    for seeds in schedule:
        c = cells.select(*keys, t, col).join(pending, keys).withColumn("_s", F.explode(F.array(*[F.lit(s) for s in seeds]))) \
            .withColumn("_h", hash32("_s", *keys, t, col)).withColumn("_hb", F.shiftright("_h", 16))
        hist = c.groupBy(*g, "_hb").agg(F.count(F.lit(1)).alias("_hn"), F.max("_k").alias("_k"))
        wc = Window.partitionBy(*g).orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_cum", F.sum("_hn").over(wc))
        cut = (hist.where(F.col("_cum") >= F.col("_k"))
               .groupBy(*g).agg(F.min_by(F.struct("_hb", "_cum", "_hn", "_k"), "_hb").alias("_c"))
               .select(*g, F.col("_c._hb").alias("_hb"),
                       (F.col("_c._hn") - (F.col("_c._cum") - F.col("_c._k"))).alias("_need")))
        wr = Window.partitionBy(*g).orderBy("_h", t, col)
        last = c.join(cut, [*g, "_hb"]).withColumn("_r", F.row_number().over(wr)).where("_r = _need").select(*g, place.alias("_last"))
        draws = cut.select(*g).join(last, g, "left").checkpoint()
        empty = c.join(draws, g).groupBy(*g, t).agg(F.bool_and(F.coalesce(place <= F.col("_last"), F.lit(False))).alias("_all")) \
            .where("_all").select(*g).distinct()
        chosen = draws.join(empty, g, "left_anti").groupBy(*keys).agg(F.min_by(F.struct("_s", "_last"), "_s").alias("_d")).checkpoint()
        done.append(chosen)
        pending = pending.join(chosen.select(*keys), keys, "left_anti").checkpoint()
        if pending.isEmpty():
            break
    draw = done[0]
    for more in done[1:]:
        draw = draw.unionByName(more)
    d = cells.join(draw, keys, "left").withColumn("_s", F.col("_d._s")).withColumn("_h", hash32("_s", *keys, t, col))
    masked = F.when(F.col("_d").isNotNull(), F.coalesce(place <= F.col("_d._last"), F.lit(False)))
    return d.select(*cells.columns, masked.alias("masked"), F.col("_s").cast("bigint").alias("seed"))


def mask_per_row(df: DataFrame, cols: Sequence[str], seed: int, size: int = 1,
                 keys=("stream_id",), t: str = "t") -> DataFrame:
    """Per row draw ``size`` column indexes with replacement and hide them."""
    keys = _k(keys)
    cols = list(cols)
    p = len(cols)
    drawn = F.array(*[hash32(str(seed), *keys, t, str(i)) % p for i in range(size)])
    out = df.withColumn("_drawn", drawn)
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.when(F.array_contains("_drawn", i), F.lit(None).cast("double"))
                             .otherwise(F.col(c)))
    return out.drop("_drawn")


def trapezoid(df: DataFrame, cols: Sequence[str], keys=("stream_id",), t: str = "t",
              blocks: int = 5) -> DataFrame:
    """Row block b of ceil(n/5) rows sees the first min(p, (b+1)*ceil(p/5)) columns.

    Adds ``n_visible``, the jagged ``x_jag`` (visible prefix), ``x_pad`` (NULL padded)
    and ``x_zero`` (zero padded) arrays.
    """
    keys = _k(keys)
    cols = list(cols)
    p = len(cols)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(n, keys)
    bsz = F.ceil(F.col("_n") / blocks)
    vis = F.least(F.lit(p), (F.floor(F.col(t) / bsz) + 1) * int(-(-p // blocks)))
    d = d.withColumn("n_visible", vis.cast("int"))
    full = F.array(*[F.col(c).cast("double") for c in cols])
    d = d.withColumn("x_pad", F.transform(full, lambda v, i: F.when(i < F.col("n_visible"), v)))
    d = d.withColumn("x_zero", F.transform("x_pad", lambda v: F.coalesce(v, F.lit(0.0))))
    d = d.withColumn("x_jag", F.slice(full, 1, F.col("n_visible")))
    return d.drop("_n")


def missing_labels(df: DataFrame, ratio: float, seed: int, keys=("stream_id",), t: str = "t",
                   y: str = "y", out: str = "y_obs") -> DataFrame:
    """Keep each label with probability 1 - ratio."""
    keys = _k(keys)
    return df.withColumn(out, F.when(uniform(str(seed), *keys, t) > ratio, F.col(y)))


def delayed_labels(df: DataFrame, delay: int, keys=("stream_id",), t: str = "t",
                   y: str = "y", missing_ratio: float = 0.0, seed: int = 0) -> DataFrame:
    """Label of row t arrives at t + D; labels that would arrive past the end are
    lost; with ``missing_ratio`` > 0 each label is also lost with that probability.

    Output ``keys, t_arrive, t_orig, y``.  "Past the end" = no row at t + D,
    tested by a semi-join on (stream, t) rather than by a per-stream count.
    """
    keys = _k(keys)
    lab = df.select(*keys, F.col(t).alias("t_orig"), (F.col(t) + delay).alias("t_arrive"),
                    F.col(y).alias("y"))
    if missing_ratio > 0:
        lab = lab.where(uniform(str(seed), *keys, "t_orig") > missing_ratio)
    spine = df.select(*keys, F.col(t).alias("t_arrive"))
    return lab.join(spine, [*keys, "t_arrive"], "left_semi").select(*keys, "t_arrive", "t_orig", "y")


def label_slots(df: DataFrame, arrivals: DataFrame, keys=("stream_id",), t: str = "t",
                out: str = "y_delayed") -> DataFrame:
    """The reference's delayed label vector: slot t holds the label arriving at t, else NULL."""
    keys = _k(keys)
    a = arrivals.select(*keys, F.col("t_arrive").alias(t), F.col("y").alias(out))
    return df.join(a, [*keys, t], "left")


def shuffle_rows(df: DataFrame, seed: int, keys=("stream_id",), t: str = "t",
                 out: str = "t_new") -> DataFrame:
    """Seeded permutation of positions within each stream."""
    keys = _k(keys)
    d = df.withColumn("_h", hash32(str(seed), *keys, t))
    d = number_rows(d, keys, ["_h", t], out=out, bucket=F.shiftright("_h", 16))
    return d.drop("_h")


def interleave_classes(df: DataFrame, keys=("stream_id",), t: str = "t", y: str = "y",
                       out: str = "t_new") -> DataFrame:
    """Class-1 rows in order, a class-0 row after every third class-1 row (from the
    first), leftover class-0 rows at the end.  Closed form of the reference loop:
    class 1 rank i -> i + floor((i+2)/3); class 0 rank j -> 4j+1 while j < ceil(n1/3),
    else n1 + j.  (The reference fails when n0 < ceil(n1/3); here positions stay
    unique and are renumbered densely.)"""
    keys = _k(keys)
    d = number_rows(df, [*keys, y], [t], out="_rk", bucket=F.floor(F.col(t) / 65536))
    n1 = df.where(F.col(y) == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n1"))
    d = d.join(n1, keys, "left").withColumn("_n1", F.coalesce("_n1", F.lit(0)))
    pos = (F.when(F.col(y) == 1, F.col("_rk") + F.floor((F.col("_rk") + 2) / 3))
           .when(F.col("_rk") < F.ceil(F.col("_n1") / 3), 4 * F.col("_rk") + 1)
           .otherwise(F.col("_n1") + F.col("_rk")))
    d = d.withColumn("_pos", pos)
    d = number_rows(d, keys, ["_pos"], out=out, bucket=F.floor(F.col("_pos") / 65536))
    return d.drop("_rk", "_n1", "_pos")
