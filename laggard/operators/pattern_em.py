"""The copula's E-step and EM by missing patterns.

All that an E-step takes from Sigma depends on which cells of a row are missing, not on the row: the
regression of each cell on the observed ones, the variance it leaves, the covariance of the missing cells.
So Sigma is inverted once for each (stream, pattern), a small table, and rows are only joined to it:

* ``refresh``: an observed ordinal is known to lie in [lo, hi]; it becomes the mean of its conditional normal
  there, by blocks of rows as matrices.
* ``sums``: per (stream, pattern) the number of rows and the sums of z, z z' and of the variances V that
  ordinals leave open, by partial aggregates.
* ``mstep``: with T = (identity on observed cells, regression for missing ones) a pattern gives
  T S T' to the sum of z z' and T diag(V) T' + n Sigma_{MM|O} to that of C.  It never sees rows either.

Rows without an ordinal to refresh never change.  Their sums are taken once, and a round of the EM reads
only patterns for them: data without ordinals are read once, however many rounds follow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laggard.functions.normal import POS_INF_SQL, pdf_sql, phi_sql
from laggard.operators.copula import initial_sigma, project_to_correlation, truncated_moments
from laggard.operators.learner import for_scan, schema_of, spread_keys
from laggard.operators.whole import WHOLE, by_length, column_of, matrix_of
from laggard.operators.whole_em import expect_scan, fit_scan


def let(body: str, **values: str) -> str:
    """SQL (Spark) of ``body`` with names for values, each evaluated once: ``v.name`` stands for it."""
    return f"transform(array(named_struct({', '.join(f'{k!r}, {e}' for k, e in values.items())})), v -> {body})[0]"


def moments(a: str, b: str) -> str:
    """F20 as Spark SQL: struct(mean, var) of N(0, 1) on [a, b], null where the interval has no mass."""
    step = "v.a > 0"  # the mass by the nearer tail, so that far intervals keep their digits
    mass = f"CASE WHEN {step} THEN {phi_sql('(-v.a)')} - {phi_sql('(-v.b)')} ELSE {phi_sql('v.b')} - {phi_sql('v.a')} END"
    edge = " - ".join(f"(CASE WHEN abs(v.{k}) = {POS_INF_SQL} THEN 0.0D ELSE v.{k} * {pdf_sql(f'v.{k}')} END)" for k in "ab")
    first = let("named_struct('a', v.a, 'b', v.b, 'mass', v.mass, 'mean', CASE WHEN v.mass > 0 THEN v.diff / v.mass END, "
                "'edge', CASE WHEN v.mass > 0 THEN v.edge / v.mass END)", a="v.a", b="v.b", mass=mass, diff=f"{pdf_sql('v.a')} - {pdf_sql('v.b')}", edge=edge)
    return let(f"transform(array({first}), w -> named_struct('mean', w.mean, 'var', 1.0D + w.edge - w.mean * w.mean))[0]", a=a, b=b)


def pattern_of(z: str = "z") -> Column:
    """1 where a cell is missing, 0 where it is observed."""
    return F.concat_ws("", F.transform(z, lambda v: F.when(v.isNull(), "1").otherwise("0")))


def refreshed(pattern: Column | str, is_ord: Sequence[bool]) -> Column:
    """Whether rows of a pattern have an ordinal cell that another observed cell tells about."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    any_ord = F.lit(False)
    for j, o in enumerate(is_ord):
        if o:
            any_ord = any_ord | (F.substring(pattern, j + 1, 1) == "0")
    return any_ord & (F.length(F.translate(pattern, "1", "")) > 1)


def regressions(patterns: DataFrame, sigma: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Per (keys, pattern): ``gain`` (p x p: a row's cell from the observed ones, for missing cells and ordinals to refresh),
    ``spread`` (the variance of such an ordinal given the others, else null) and ``rest`` (p x p: covariance of missing cells
    given the observed ones)."""
    keys, ordinal = list(keys), np.array(is_ord, dtype=bool)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pattern, s in zip(pdf["pattern"], pdf["sigma"], strict=True):
                gap = np.array([c == "1" for c in pattern])
                o, m, s = np.flatnonzero(~gap), np.flatnonzero(gap), np.asarray(s, dtype=float).reshape(p, p)
                gain, rest, spread = np.zeros((p, p)), np.zeros((p, p)), [None] * p
                if len(o):
                    precision = np.linalg.inv(s[np.ix_(o, o)])
                    slope = precision @ s[np.ix_(o, m)]
                    gain[np.ix_(m, o)] = slope.T
                    rest[np.ix_(m, m)] = s[np.ix_(m, m)] - s[np.ix_(m, o)] @ slope
                    for k in np.flatnonzero(ordinal[o]) if len(o) > 1 else ():
                        spread[o[k]] = float(1.0 / precision[k, k])
                        gain[o[k], o] = -precision[k] / precision[k, k]
                        gain[o[k], o[k]] = 0.0
                else:
                    rest = s
                out.append((gain.ravel().tolist(), spread, rest.ravel().tolist()))
            got = pdf[[*keys, "pattern"]].copy()
            got["gain"], got["spread"], got["rest"] = ([r[k] for r in out] for k in range(3))
            yield got

    d = patterns.select(*keys, "pattern").join(sigma.select(*keys, "sigma"), keys)
    return d.mapInPandas(run, f"{schema_of(patterns, keys)}, pattern string, gain array<double>, spread array<double>, rest array<double>")


def by_blocks(rows: DataFrame, fn, columns: Sequence[tuple[str, int]], outputs: Sequence[str]) -> DataFrame:
    """``rows`` with the array columns ``outputs`` that ``fn`` (named matrices -> dict of columns) gives a block of rows; the other columns stay."""
    keep = [c for c in rows.columns if c not in outputs]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(**{c: matrix_of(b.column(c), w) for c, w in columns})
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[got[c] for c in outputs]], [*keep, *outputs])

    return rows.mapInArrow(run, schema)


def refresh(rows: DataFrame, p: int, sweeps: int = 1) -> DataFrame:
    """Rows beside their regression: ``z`` with refreshed ordinals, ``v`` (the variance each cell leaves; 0 but for those).  All
    ordinals of a sweep are conditioned on the values before it."""
    def fn(z: np.ndarray, lo: np.ndarray, hi: np.ndarray, gain: np.ndarray, spread: np.ndarray) -> dict[str, pa.ListArray]:
        gap, v, gain = np.isnan(z), np.zeros_like(z), gain.reshape(-1, p, p)
        for _ in range(sweeps):
            before = np.nan_to_num(z, nan=0.0)
            z, v = z.copy(), np.zeros_like(z)
            for j in range(p):
                on = np.flatnonzero(~np.isnan(spread[:, j]))
                c, scale = (gain[on, j] * before[on]).sum(axis=1), np.sqrt(spread[on, j])
                mean, var = truncated_moments((lo[on, j] - c) / scale, (hi[on, j] - c) / scale)
                z[on, j] = np.where(np.isnan(mean), z[on, j], c + scale * mean)
                v[on, j] = np.where(np.isnan(var), 0.0, scale * scale * var)
        return {"z": column_of(z, gap), "v": column_of(v)}

    d = rows.drop("v") if "v" in rows.columns else rows
    return by_blocks(d, fn, [("z", p), ("lo", p), ("hi", p), ("gain", p * p), ("spread", p)], ["z", "v"])


def completed(rows: DataFrame, p: int) -> DataFrame:
    """Rows with z, v and their regression: ``z_imp`` (missing cells filled) and ``c_diag`` (what each cell leaves open, the diagonal of C)."""
    def fn(z: np.ndarray, v: np.ndarray, gain: np.ndarray, rest: np.ndarray) -> dict[str, pa.ListArray]:
        gap, gain = np.isnan(z), gain.reshape(-1, p, p)
        fill = (gain * np.nan_to_num(z, nan=0.0)[:, None, :]).sum(axis=2)
        left = rest.reshape(-1, p, p)[:, range(p), range(p)] + (gain * gain * v[:, None, :]).sum(axis=2)
        return {"z_imp": column_of(np.where(gap, fill, z)), "c_diag": column_of(np.where(gap, left, v))}

    return by_blocks(rows, fn, [("z", p), ("v", p), ("gain", p * p), ("rest", p * p)], ["z_imp", "c_diag"])


def sums(rows: DataFrame, p: int, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Per (keys, pattern) of rows with z and v: ``n``, ``s`` (sum of z), ``zz`` (upper triangle of the sum of z z'), ``vs`` (sum of v); missing cells
    count as 0."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    d = rows.select(*keys, "pattern", *[F.coalesce(F.get("z", F.lit(j)), F.lit(0.0)).alias(f"_z{j}") for j in range(p)],
                    *[F.get("v", F.lit(j)).alias(f"_v{j}") for j in range(p)])
    return d.groupBy(*keys, "pattern").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"_z{j}") for j in range(p)]).alias("s"),
        F.array(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs]).alias("zz"),
        F.array(*[F.sum(f"_v{j}") for j in range(p)]).alias("vs"))


def totals(parts: Sequence, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sum of z, sum of z z', sum of C) of a stream's completed rows, from the sums of its patterns beside their regressions, by pattern."""
    n, s, szz, c = 0.0, np.zeros(p), np.zeros((p, p)), np.zeros((p, p))
    upper = np.triu_indices(p)
    for r in parts:
        gap = np.array([k == "1" for k in r["pattern"]])
        t = np.diag((~gap).astype(float))
        t[gap] = np.asarray(r["gain"], dtype=float).reshape(p, p)[gap]
        zz = np.zeros((p, p))
        zz[upper] = np.asarray(r["zz"], dtype=float)
        zz = zz + np.triu(zz, 1).T
        n += r["n"]
        s += t @ np.asarray(r["s"], dtype=float)
        szz += t @ zz @ t.T
        c += t @ np.diag(np.asarray(r["vs"], dtype=float)) @ t.T + r["n"] * np.asarray(r["rest"], dtype=float).reshape(p, p)
    return n, s, szz, c


def mstep(stats: DataFrame, table: DataFrame, sigma: DataFrame, p: int, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Sigma = proj(cov(Z) + C / n) of every stream: ``keys, sigma, change`` (relative Frobenius change), ``c`` (C / n)."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for parts, old in zip(pdf["parts"], pdf["old"], strict=True):
                n, s, szz, c = totals(parts, p)
                cov = (szz - np.outer(s, s) / n) / max(n - 1.0, 1.0)
                new, old = project_to_correlation(cov + c / n), np.asarray(old, dtype=float).reshape(p, p)
                got.append((new.ravel().tolist(), float(np.linalg.norm(new - old) / np.linalg.norm(old)), (c / n).ravel().tolist()))
            out = pdf[keys].copy()
            out["sigma"], out["change"], out["c"] = ([g[k] for g in got] for k in range(3))
            yield out

    # a stream's patterns are few (2^p at most): one row a stream
    d = stats.join(table, [*keys, "pattern"]).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pattern", "n", "s", "zz", "vs", "gain", "rest"))).alias("parts"))
    d = d.join(sigma.select(*keys, F.col("sigma").alias("old")), keys)
    return spread_keys(d, keys).mapInPandas(run, f"{schema_of(stats, keys)}, sigma array<double>, change double, c array<double>")


def with_pattern(rows: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return rows.select(*keys, t, F.col("z").cast("array<double>").alias("z"), "lo", "hi", pattern_of().alias("pattern"))


def expect(rows: DataFrame, sigma: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str] = ("stream_id",), t: str = "t", sweeps: int = 1,
           whole: int = WHOLE) -> DataFrame:
    """B01 for every row: ``keys, t, z, z_imp, c_diag, v, pattern``.  Streams of up to ``whole`` rows are sent to one scan beside their Sigma, rows of
    longer ones are joined to their regressions."""
    keys = list(keys)
    short, long, _ = by_length(rows, keys, whole)
    got = expect_scan(short, sigma, p, is_ord, keys, t, sweeps)
    if long is None:
        return got
    d = with_pattern(long, keys, t)
    table = regressions(d.select(*keys, "pattern").distinct(), sigma, p, is_ord, keys).checkpoint()
    return got.unionByName(completed(refresh(d.join(table, [*keys, "pattern"]), p, sweeps), p).select(*keys, t, "z", "z_imp", "c_diag", "v", "pattern"))


def expected_covariance(rows: DataFrame, sigma: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str] = ("stream_id",), t: str = "t",
                        sweeps: int = 1) -> DataFrame:
    """A20 and one round of B03: per stream ``c`` (the mean of C over its rows), ``sigma`` and ``change``."""
    keys = list(keys)
    d = with_pattern(rows, keys, t)
    table = regressions(d.select(*keys, "pattern").distinct(), sigma, p, is_ord, keys).checkpoint()
    if any(is_ord):
        d = refresh(d.join(table, [*keys, "pattern"]), p, sweeps)
    else:  # nothing to refresh: the sums need no regression beside the rows
        d = d.withColumn("v", F.transform("z", lambda _: F.lit(0.0)))
    return mstep(sums(d, p, keys), table, sigma, p, keys)


def fit_offline(rows: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str] = ("stream_id",), t: str = "t", max_iter: int = 50,
                tol: float = 0.01, num_ord_updates: int = 1, whole: int = WHOLE, dealt: bool = False, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """EM, each stream until its own relative Sigma change is below ``tol`` or for ``max_iter`` rounds, so that no
    stream's result depends on the others in the table.  Returns (rows with ``z_imp`` and the columns ``keep``, per stream ``sigma, change,
    rounds``; a change of ``tol`` or more tells that the stream did not converge).  Streams of up to ``whole`` rows are fitted whole where one
    scan finds them, longer ones over tables; rows without a stream have no Sigma.  ``dealt``: all streams fit a task and stand as
    ``whole_em.latent_scan`` leaves them; their rows are not sent again and stay in order.  Else rows without ordinals go over tables at any
    length, as their rounds never see a row."""
    if dealt:
        return fit_scan(rows, p, is_ord, keys, t, max_iter, tol, num_ord_updates, keep)
    rows = rows.select(*keys, t, *keep, "z", "lo", "hi")
    if not any(is_ord):
        return _fit_tables(rows, p, is_ord, keys, t, max_iter, tol, num_ord_updates, keep)
    rows = rows.checkpoint()
    short, long, _ = by_length(rows, keys, whole)
    got = fit_scan(for_scan(short, keys, t), p, is_ord, keys, t, max_iter, tol, num_ord_updates, keep)
    if long is None:
        return got
    return tuple(a.unionByName(b) for a, b in zip(got, _fit_tables(long, p, is_ord, keys, t, max_iter, tol, num_ord_updates, keep), strict=True))


def _fit_tables(rows: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str], t: str, max_iter: int, tol: float, num_ord_updates: int,
                keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    z_imp, sigma = fit_long(rows, p, is_ord, keys, t, max_iter, tol, num_ord_updates)
    return rows.select(*keys, t, *keep).join(z_imp, [*keys, t]) if keep else z_imp, sigma


def fit_long(rows: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str] = ("stream_id",), t: str = "t", max_iter: int = 50,
             tol: float = 0.01, num_ord_updates: int = 1) -> tuple[DataFrame, DataFrame]:
    """``fit_offline`` of streams of any length.  Rows are split once: those with an ordinal to refresh are rewritten every
    round, the others are read for their sums and at the end.  The driver sees whether streams are left."""
    keys, by = list(keys), [*keys, "pattern"]
    d = with_pattern(rows, keys, t).withColumn("_moves", refreshed("pattern", is_ord)).checkpoint()
    zero = F.transform("z", lambda _: F.lit(0.0))
    still = d.where(~F.col("_moves")).withColumn("v", zero).drop("_moves")
    moving = d.where("_moves").drop("_moves")
    some = not moving.isEmpty()
    patterns = d.select(*by).distinct().checkpoint()
    constant = sums(still, p, keys).checkpoint()
    sigma = initial_sigma(d, p, keys).checkpoint()
    done_rows, done_sigma = [], []
    for k in range(1, max_iter + 1):
        active = sigma.select(*keys)
        table = regressions(patterns.join(active, keys, "left_semi"), sigma, p, is_ord, keys).checkpoint()
        stats = constant.join(active, keys, "left_semi")
        if some:
            moving = refresh(moving.select(*by, t, "z", "lo", "hi").join(table, by), p, num_ord_updates).select(*by, t, "z", "lo", "hi", "v").checkpoint()
            stats = stats.unionByName(sums(moving, p, keys))
        new = mstep(stats, table, sigma, p, keys).withColumn("rounds", F.lit(k)) \
            .withColumn("over", (F.col("change") < tol) | F.lit(k == max_iter)).checkpoint()
        over = new.where("over")
        if not over.isEmpty():
            ended = still.unionByName(moving) if some else still
            done_rows.append(completed(ended.join(over.select(*keys), keys, "left_semi").join(table, by), p).select(*keys, t, "z_imp").checkpoint())
            done_sigma.append(over.select(*keys, "sigma", "change", "rounds"))
        sigma = new.where(~F.col("over")).select(*keys, "sigma")
        if sigma.isEmpty():
            break
    if not done_rows:
        return rows.select(*keys, t, F.col("z").alias("z_imp")).limit(0), new.select(*keys, "sigma", "change", "rounds")
    union = lambda ds: reduce(lambda a, b: a.unionByName(b), ds)
    return union(done_rows), union(done_sigma)
