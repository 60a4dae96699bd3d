"""Ranks within sliding windows by counting in two dimensions (W06, W07 for windows of any length).

A cell has a place k in its column's time order and a rank among its column's values (ties by
place, so that ranks are a permutation).  The number of values <= v among the last W cells is
C(k, q) - C(k - W, q), where C(k, q) counts the cells of places up to k whose rank is below q, and q is
the number of values <= v.  No window is ever built: the work of a cell does not know W.

The plane of places and ranks is cut into squares of side S.  C(k, q) is the sum of
  * the cells in k's block of places, up to k, with rank below q: asked in that block;
  * the cells in earlier blocks of places, in q's block of ranks, with rank below q: asked in that block;
  * the squares before both: prefix sums of the squares' counts, sent to the block of ranks as one array.
S is at least ``SIDE`` and grows with the root of the column's length, so that a block's cells and the
squares beside it stay in proportion, and a column that holds a third of all cells is as many tasks
as it has blocks.

A column of up to ``WHOLE`` cells needs no squares: it is one sorted scan, and its windows are slices of its ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laggard.functions.normal import phi_inv_sql
from laggard.operators.learner import by_key, for_scan, schema_of
from laggard.operators.seq import number_rows, value_ranks
from laggard.operators.whole import WHOLE, added, by_length, dense, starts_of, whole_keys

SIDE = 4096
PLACE_BUCKET = 1 << 16


def count_below(values: np.ndarray, upto: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query, how many of the first ``upto`` values (non-negative integers) are less than ``below``.

    Bit by bit from the highest: values with the bit unset go in front in their order, so that a prefix stays a
    prefix of its half; a query whose bound has the bit set counts that half and goes on in the other."""
    values, upto, below = values.astype(np.int64), upto.astype(np.int64), below.astype(np.int64)
    bits = max(int(values.max(initial=0)).bit_length(), 1)
    all_of_it = below >= (1 << bits)
    lo, hi, out = np.zeros(len(upto), np.int64), upto.copy(), np.zeros(len(upto), np.int64)
    for b in range(bits - 1, -1, -1):
        one = (values >> b) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        lo0, hi0 = zeros[lo], zeros[hi]
        up = ((below >> b) & 1).astype(bool)
        out += np.where(up, hi0 - lo0, 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
        values = np.concatenate([values[one == 0], values[one == 1]])
    return np.where(all_of_it, upto, out)


def ranked(cells: DataFrame, group: Sequence[str], v: str, t: str) -> DataFrame:
    """Cells with place ``k`` and rank ``r`` (both from 0), ``n_lt`` and ``n_le`` (column values < v, <= v) and column length ``n``."""
    group = list(group)
    d = number_rows(cells, group, [t], out="k", bucket=F.floor(F.col(t) / PLACE_BUCKET))
    d = d.join(value_ranks(cells, group, v), [*group, v])
    d = number_rows(d, [*group, v], ["k"], out="r", bucket=F.floor(F.col("k") / PLACE_BUCKET))
    return d.withColumns({"r": F.col("r") + F.col("n_below"), "n_lt": F.col("n_below"), "n_le": F.col("n_below") + F.col("n_eq")}) \
        .drop("n_below", "n_eq")


def dominance(points: DataFrame, queries: DataFrame, group: Sequence[str], side: int = SIDE) -> DataFrame:
    """``group, id, c``: for each query (id, k, q) the number of points with place <= k and rank < q.

    points: group, k, r (permutations of 0 .. n-1) and n.  Queries with k < 0 count nothing."""
    group = list(group)
    s = F.greatest(F.lit(side), F.ceil(F.sqrt("n"))).cast("long")
    points = points.select(*group, "k", "r", "n", s.alias("s")).checkpoint()
    sizes = points.groupBy(*group).agg(F.max("s").alias("s"), F.max("n").alias("n"))
    ask = queries.where("k >= 0").join(sizes, group)
    block = lambda c: F.floor(F.col(c) / F.col("s"))

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Cells of a block of places: those up to k with rank below q."""
        own, asked = pdf[pdf["id"].isna()].sort_values("k"), pdf[pdf["id"].notna()]
        return answers(asked, count_below(own["r"].to_numpy(), asked["k"].to_numpy() - (asked["blk"] * asked["s"]).to_numpy() + 1, asked["q"].to_numpy()))

    def answers(asked: pd.DataFrame, c: np.ndarray) -> pd.DataFrame:
        got = asked[[*group, "id"]].copy()
        got["c"] = c
        return got

    out = f"{schema_of(points, group)}, id bigint, c bigint"
    null = F.lit(None).cast("long")
    g = [*group, "blk"]
    both = points.select(*group, block("k").alias("blk"), "s", "k", "r", null.alias("id"), null.alias("q")).unionByName(
        ask.select(*group, block("k").alias("blk"), "s", "k", null.alias("r"), "id", "q"))
    first = by_key(both, g).groupBy(*g).applyInPandas(in_block, out)

    # prefix sums of the squares: row per block of ranks, cells of blocks of places and of ranks before
    spine = sizes.withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("s"))))) \
        .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("s"))))).select(*group, "pb", "rb")
    squares = points.groupBy(*group, block("k").alias("pb"), block("r").alias("rb")).agg(F.count(F.lit(1)).alias("c"))
    squares = spine.join(squares, [*group, "pb", "rb"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    upto = Window.unboundedPreceding
    squares = squares.withColumn("c", F.sum("c").over(Window.partitionBy(*group, "rb").orderBy("pb").rowsBetween(upto, -1))) \
        .withColumn("c", F.coalesce(F.sum("c").over(Window.partitionBy(*group, "pb").orderBy("rb").rowsBetween(upto, -1)), F.lit(0)))
    before = squares.groupBy(*group, F.col("rb").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("pb", "c"))).alias("before"))
    before = before.select(*[F.col(c).alias(c) for c in before.columns])  # both sides of the cogroup come from points

    def beside(pdf: pd.DataFrame, squares: pd.DataFrame) -> pd.DataFrame:
        """Cells of earlier blocks of places: those of this block of ranks one by one, those of the ranks before as a sum."""
        own, asked = pdf[pdf["id"].isna()].sort_values("r"), pdf[pdf["id"].notna()]
        blocks = (asked["k"] // asked["s"]).to_numpy(dtype=np.int64)
        c = count_below((own["k"] // own["s"]).to_numpy(), asked["q"].to_numpy() - (asked["blk"] * asked["s"]).to_numpy(), blocks)
        sums = np.array([r["c"] for r in squares["before"].iloc[0]]) if len(squares) else np.zeros(1, np.int64)
        return answers(asked, c + sums[blocks])

    last = F.floor((F.col("n") - 1) / F.col("s"))
    both = points.select(*group, block("r").alias("blk"), "s", "k", "r", null.alias("id"), null.alias("q")).unionByName(
        ask.select(*group, F.least(block("q"), last).alias("blk"), "s", "k", null.alias("r"), "id", "q"))
    second = by_key(both, g).groupBy(*g).cogroup(by_key(before, g).groupBy(*g)).applyInPandas(beside, out)
    return first.unionByName(second).groupBy(*group, "id").agg(F.sum("c").alias("c"))


def counts_in_whole(cells: DataFrame, w: int, group: Sequence[str], v: str, t: str, strict: bool) -> DataFrame:
    """``window_counts`` of columns that fit a task: one scan of the cells in order of time."""
    group, keep = list(group), cells.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, group):
            first = starts_of(table, group)
            at = np.arange(len(first))
            start = np.maximum.accumulate(np.where(first, at, 0))
            known = table.column(v).is_valid().to_numpy()
            before = np.concatenate([[0], np.cumsum(known)])
            at, start = at[known], start[known]
            table = table.filter(pa.array(known))
            r = dense(table.column(v))
            hi, lo = before[at + 1], before[np.maximum(start, at + 1 - w)]
            inside = lambda below: count_below(r, hi, below) - count_below(r, lo, below)  # noqa: E731, B023
            out = {"win_n": np.minimum(at - start + 1, w), "win_le": inside(r + 1), **({"win_lt": inside(r)} if strict else {})}
            yield from added(table, keep, **out)

    kinds = "win_n bigint, win_le bigint" + (", win_lt bigint" if strict else "")
    return for_scan(cells, group, t).mapInArrow(run, f"{schema_of(cells, keep)}, {kinds}")


def window_counts(cells: DataFrame, w: int, group: Sequence[str] = ("stream_id", "col"), v: str = "v", t: str = "t",
                  strict: bool = True, side: int = SIDE, whole: int = WHOLE) -> DataFrame:
    """For each observed cell and the last ``w`` observed values of its column up to and including it: ``win_n``, ``win_le``
    (values <= v) and, if ``strict``, ``win_lt`` (values < v).  Columns of more than ``whole`` cells are counted by squares."""
    short, long, _ = by_length(cells, group, whole)
    got = counts_in_whole(short, w, group, v, t, strict)
    return got if long is None else got.unionByName(counts_by_squares(long, w, group, v, t, strict, side))


def counts_by_squares(cells: DataFrame, w: int, group: Sequence[str], v: str, t: str, strict: bool, side: int) -> DataFrame:
    """``window_counts`` of columns of any length."""
    group = list(group)
    d = ranked(cells, group, v, t).checkpoint()
    asks = [(0, F.col("k"), "n_le"), (1, F.col("k") - w, "n_le")] + ([(2, F.col("k"), "n_lt"), (3, F.col("k") - w, "n_lt")] if strict else [])
    ask = F.array(*[F.struct((F.col("k") * 4 + i).alias("id"), k.alias("k"), F.col(q).alias("q")) for i, k, q in asks])
    c = dominance(d, d.select(*group, F.inline(ask)), group, side)
    part = lambda i: F.coalesce(F.sum(F.when(F.col("id") % 4 == i, F.col("c"))), F.lit(0))
    c = c.groupBy(*group, F.floor(F.col("id") / 4).alias("k")).agg((part(0) - part(1)).alias("win_le"), (part(2) - part(3)).alias("win_lt"))
    got = d.drop("r", "n", "n_lt", "n_le").join(c, [*group, "k"]).withColumn("win_n", F.least(F.col("k") + 1, F.lit(w)).cast("long"))
    got = got.drop("k") if strict else got.drop("k", "win_lt")
    return got.checkpoint()  # what reads the counts is long expressions, which must not share generated code with the sums


def long_window_cont_latent(cells: DataFrame, w: int, group: Sequence[str] = ("stream_id", "col"), v: str = "v", t: str = "t") -> DataFrame:
    """W06 by counts: the z of ``window_cont_latent`` for windows of any length."""
    d = window_counts(cells, w, group, v, t, strict=False)
    q = "(CAST(win_n AS DOUBLE) / (win_n + 1)) * (win_le / CAST(win_n AS DOUBLE))"
    return d.withColumn("z", F.expr(phi_inv_sql(q))).drop("win_n", "win_le")


def long_window_ord_interval(cells: DataFrame, w: int, group: Sequence[str] = ("stream_id", "col"), v: str = "v", t: str = "t") -> DataFrame:
    """W07 by counts; a window that has no other value than v gives (-inf, +inf)."""
    d = window_counts(cells, w, group, v, t)
    one = F.col("win_le") - F.col("win_lt") == F.col("win_n")
    side = lambda c, end: F.when(one, F.lit(end)).otherwise(F.expr(phi_inv_sql(f"({c} / CAST(win_n AS DOUBLE))")))
    return d.withColumns({"lo": side("win_lt", float("-inf")), "hi": side("win_le", float("inf"))}).drop("win_n", "win_le", "win_lt")
