"""Copula imputation of streams that fit a task, whole and many at a time.

W04/W05, B03 and W08 ask a stream's rows for ranks, then for a new Sigma in every round.  Over a table that is several
shuffles of all cells and one of all rows a round (``marginals``, ``pattern_em``); a stream of up to ``WHOLE`` rows is sent once
instead.  ``latent_scan`` deals its rows out; what follows (``fit_scan``, ``impute_scan``) finds them whole and in order and sends
nothing.  Longer streams keep the way over tables.

Rows of a block are sorted by stream; ``owner`` is the number of a row's stream in the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laggard.operators.copula import _phi_inv_np, _phi_np, truncated_moments
from laggard.operators.learner import for_scan
from laggard.operators.whole import added, column_of, matrix_of, starts_of, whole_keys


# --- marginals ---

class Ranks:
    """The observed cells of one column, sorted by stream and value (NaN last), and the runs of equal values among them."""

    def __init__(self, v: np.ndarray, seen: np.ndarray, owner: np.ndarray, streams: int):
        at, self.streams = np.flatnonzero(seen), streams
        order = at[np.lexsort((v[at], owner[at]))]
        self.order, self.owner, self.value = order, owner[order], v[order]
        self.n = np.bincount(self.owner, minlength=streams)
        self.start = np.cumsum(self.n) - self.n
        a, b = self.value[1:], self.value[:-1]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | ~((a == b) | (np.isnan(a) & np.isnan(b)))
        first = np.flatnonzero(new)
        self.length = np.diff(np.append(first, len(order)))
        self.run_owner = self.owner[first] if len(order) else np.zeros(0, np.int64)
        self.below = first - self.start[self.run_owner]

    def spread(self, per_run: np.ndarray, rows: int) -> np.ndarray:
        """A value of each run, at the rows that have it; NaN elsewhere."""
        out = np.full(rows, np.nan)
        out[self.order] = np.repeat(per_run, self.length)
        return out

    def cont(self, n_rows: np.ndarray, rows: int) -> np.ndarray:
        """W04."""
        m, n = n_rows[self.run_owner].astype(float), self.n[self.run_owner].astype(float)
        return self.spread(_phi_inv_np((m / (m + 1)) * ((self.below + self.length) / n)), rows)

    def interval(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """W05."""
        n = self.n[self.run_owner].astype(float)
        return self.spread(_phi_inv_np(self.below / n), rows), self.spread(_phi_inv_np((self.below + self.length) / n), rows)

    def at(self, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The stream's observed value at a sorted place."""
        return self.value[self.start[owner] + place]

    def quantile(self, owner: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A14; NaN for a stream without observed cells."""
        out, on = np.full(len(owner), np.nan), np.flatnonzero(self.n[owner] > 0)
        owner, last = owner[on], self.n[owner[on]] - 1
        h = q[on] * last
        lo = np.floor(h).astype(np.int64)
        f, a, b = h - lo, self.at(owner, lo), self.at(owner, np.minimum(lo + 1, last))
        out[on] = np.where(f == 0, a, np.where(f >= 0.5, b - (b - a) * (1 - f), a + (b - a) * f))
        return out

    def inverse(self, owner: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A13; NaN for a stream without observed cells."""
        out, on = np.full(len(owner), np.nan), np.flatnonzero(self.n[owner] > 0)
        owner, n = owner[on], self.n[owner[on]]
        out[on] = self.at(owner, np.clip(np.ceil(thousandths((n + 1) * q[on] - 1)), 0, n - 1).astype(np.int64))
        return out


def thousandths(x: np.ndarray) -> np.ndarray:
    """x rounded half-even to three decimals of its decimal form, as Spark's bround does."""
    out = np.rint(x * 1000) / 1000
    for i in np.flatnonzero(np.abs(np.abs(x * 1000 - np.floor(x * 1000)) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.001"), rounding=ROUND_HALF_EVEN))
    return out


def owner_of(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    return np.cumsum(starts_of(table, keys)) - 1


def values_of(table: pa.Table, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether there is one), a column each."""
    columns = [table.column(c) for c in cols]
    return np.column_stack([c.to_numpy() for c in columns]), np.column_stack([c.is_valid().to_numpy() for c in columns])


def scan(df: DataFrame, run, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """mapInArrow whose output has ``schema`` and the columns ``keep`` as they are."""
    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(schema).fields))


def latent_scan(df: DataFrame, cols: Sequence[str], is_ord: Sequence[bool], keys: Sequence[str] = ("stream_id",), t: str | None = "t",
                keep: Sequence[str] = ()) -> DataFrame:
    """``keys, t, keep`` and for the i-th column ``z{i}`` (W04) or, if ordinal, ``lo{i}, hi{i}`` (W05); null where the cell is missing.  Every
    stream is whole in one partition, in order of ``t``."""
    keys, cols = list(keys), list(cols)
    order = [] if t is None else [t]
    head = [*keys, *order, *keep]
    names = [n for i, o in enumerate(is_ord) for n in ((f"lo{i}", f"hi{i}") if o else (f"z{i}",))]
    own = [f"_c{i}" for i in range(len(cols))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            owner, (v, seen) = owner_of(table, keys), values_of(table, own)
            n_rows, got = np.bincount(owner), []
            for i, o in enumerate(is_ord):
                r = Ranks(v[:, i], seen[:, i], owner, len(n_rows))
                got += [pa.array(x, mask=~seen[:, i]) for x in (r.interval(len(owner)) if o else (r.cont(n_rows, len(owner)),))]
            yield from pa.table([*[table.column(c) for c in head], *got], [*head, *names]).to_batches()

    d = for_scan(df.select(*head, *[F.col(c).cast("double").alias(n) for c, n in zip(cols, own, strict=True)]), keys, *order)
    return scan(d, run, ", ".join(f"{n} double" for n in names), head)


def impute_scan(rows: DataFrame, cols: Sequence[str], is_ord: Sequence[bool], z: str = "z_imp", keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """W08 of rows that ``latent_scan`` has dealt out: ``x_imp``, the columns with missing cells taken back from the latent ``z`` (continuous: A14,
    ordinal: A13, at Phi(z)), and ``med``, the medians of what is seen; null in a column of which the stream has nothing."""
    keys, cols, head, p = list(keys), list(cols), list(rows.columns), len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            owner, (x, seen) = owner_of(table, keys), values_of(table, cols)
            streams, q = int(owner[-1]) + 1, _phi_np(matrix_of(table.column(z), p))
            med, none = np.zeros(x.shape), np.zeros(x.shape, dtype=bool)
            for j in range(p):
                r, on = Ranks(x[:, j], seen[:, j], owner, streams), np.flatnonzero(~seen[:, j])
                x[on, j] = (r.inverse if is_ord[j] else r.quantile)(owner[on], q[on, j])
                med[:, j] = r.quantile(np.arange(streams), np.full(streams, 0.5))[owner]
                none[:, j] = r.n[owner] == 0
            yield from added(table, head, x_imp=column_of(x, none), med=column_of(med, none))

    return scan(rows, run, "x_imp array<double>, med array<double>", head)


# --- the EM ---

def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def inverses(m: np.ndarray) -> np.ndarray:
    """Of a stack of matrices; a pseudo-inverse where there is none."""
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.array([_inverse(x) for x in m])


def _inverse(x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(x)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(x)


def correlations(cov: np.ndarray) -> np.ndarray:
    """A10 of a stack of matrices."""
    var = np.diagonal(cov, axis1=1, axis2=2)
    scale = np.where(var > 0, 1.0 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)
    out = cov * (scale[:, :, None] * scale[:, None, :])
    out[:, range(cov.shape[1]), range(cov.shape[1])] = 1.0
    return out


def first_sigma(z: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The streams' correlations with missing cells as 0; a column without variance is uncorrelated."""
    p = z.shape[1]
    mean = np.add.reduceat(z, begin) / n[:, None]
    d = z - np.repeat(mean, n, axis=0)
    d[np.repeat(np.minimum.reduceat(z, begin) == np.maximum.reduceat(z, begin), n, axis=0)] = 0.0
    cov = np.zeros((len(n), p, p))
    for i in range(p):
        for j in range(i, p):
            cov[:, i, j] = cov[:, j, i] = np.add.reduceat(d[:, i] * d[:, j], begin)
    return correlations(cov / np.maximum(n - 1, 1)[:, None, None])


class Regressions:
    """What ``pattern_em.regressions`` says of each (stream, pattern): its Sigma beside its gaps."""

    def __init__(self, sigma: np.ndarray, gap: np.ndarray):
        seen = ~gap
        inside = seen[:, :, None] & seen[:, None, :]
        self.gap, self.precision = gap, np.where(inside, inverses(np.where(inside, sigma, np.eye(sigma.shape[1]))), 0.0)
        self.slope = self.precision @ (sigma * gap[:, None, :])      # from observed cells to missing ones
        self.rest = np.where(gap[:, :, None] & gap[:, None, :], sigma - sigma @ self.slope, 0.0)
        self.whole = (self.slope + np.eye(sigma.shape[1]) * seen[:, None, :]).transpose(0, 2, 1)

    def refresh(self, z: np.ndarray, lo: np.ndarray, hi: np.ndarray, member: np.ndarray, ordinal: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
        """``pattern_em.refresh`` of rows (missing cells 0) that belong to the patterns ``member``: (z, v)."""
        moves = ordinal & ~self.gap & ((~self.gap).sum(axis=1) > 1)[:, None]     # the ordinals that other cells tell about
        v = np.zeros_like(z)
        for _ in range(sweeps):
            before, z, v = z, z.copy(), np.zeros_like(z)
            for j in np.flatnonzero(moves.any(axis=0)):
                on = np.flatnonzero(moves[member, j])
                m = member[on]
                spread = 1.0 / self.precision[m, j, j]
                slopes = -self.precision[:, j, :] / np.where(moves[:, j], self.precision[:, j, j], 1.0)[:, None]
                slopes[:, j] = 0.0
                centre, scale = (slopes[m] * before[on]).sum(axis=1), np.sqrt(spread)
                mean, var = truncated_moments((lo[on, j] - centre) / scale, (hi[on, j] - centre) / scale)
                z[on, j] = np.where(np.isnan(mean), z[on, j], centre + scale * mean)
                v[on, j] = np.where(np.isnan(var), 0.0, scale * scale * var)
        return z, v

    def fill(self, z: np.ndarray, gap: np.ndarray, member: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Rows with their missing cells; ``rows``: which of them."""
        out = z if rows is None else z[rows]
        out, gap, member = out.copy(), gap if rows is None else gap[rows], member if rows is None else member[rows]
        seen = out.copy()
        for j in range(z.shape[1]):
            on = np.flatnonzero(gap[:, j])
            out[on, j] = (self.slope[member[on], :, j] * seen[on]).sum(axis=1)
        return out


def pattern_codes(gap: np.ndarray) -> np.ndarray:
    """A number for each pattern of missing cells."""
    return gap @ (1 << np.arange(gap.shape[1], dtype=np.int64)) if gap.shape[1] < 62 else np.unique(gap, axis=0, return_inverse=True)[1].reshape(-1)


def fit_block(z: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, is_ord: Sequence[bool], max_iter: int = 50, tol: float = 0.01,
              sweeps: int = 1, imputed: bool = True) -> dict[str, np.ndarray]:
    """B03 of whole streams: ``z_imp`` a row; ``sigma``, ``change``, ``rounds`` a stream.  A stream that has
    converged leaves with the rows of that round, as in ``pattern_em.fit_offline``."""
    rows, p = z.shape
    streams, ordinal = int(owner[-1]) + 1, np.array(is_ord, dtype=bool)
    gap = np.isnan(z)
    code = pattern_codes(gap)
    order = np.lexsort((code, owner))
    at, z, lo, hi, gap, code, owner = order, np.nan_to_num(z[order], nan=0.0), lo[order], hi[order], gap[order], code[order], owner[order]
    out = {"z_imp": np.zeros((rows, p)) if imputed else None, "sigma": np.zeros((streams, p, p)), "change": np.zeros(streams),
           "rounds": np.zeros(streams, np.int32)}
    sigma, names = first_sigma(z, starts(owner), np.bincount(owner)), np.arange(streams)  # of the streams that are left; owner is a place among them
    for k in range(1, max_iter + 1):
        g = starts(owner, code)
        size, of = np.diff(np.append(g, len(owner))), owner[g]
        member, reg = np.repeat(np.arange(len(g)), size), Regressions(sigma[of], gap[g])
        z, v = reg.refresh(z, lo, hi, member, ordinal, sweeps)
        n, begin = np.bincount(owner, minlength=len(names)), starts(of)
        zz = np.zeros((len(g), p, p))
        for i in range(p):
            for j in range(i, p):
                zz[:, i, j] = zz[:, j, i] = np.add.reduceat(z[:, i] * z[:, j], g)
        whole, back = reg.whole, reg.whole.transpose(0, 2, 1)
        s = np.add.reduceat((whole @ np.add.reduceat(z, g)[:, :, None])[:, :, 0], begin)
        szz = np.add.reduceat(whole @ zz @ back, begin)
        c = np.add.reduceat((whole * np.add.reduceat(v, g)[:, None, :]) @ back + size[:, None, None] * reg.rest, begin) / n[:, None, None]
        cov = (szz - s[:, :, None] * s[:, None, :] / n[:, None, None]) / np.maximum(n - 1.0, 1.0)[:, None, None]
        new = correlations(cov + c)
        change = np.sqrt(((new - sigma) ** 2).sum(axis=(1, 2))) / np.sqrt((sigma ** 2).sum(axis=(1, 2)))
        over = (change < tol) | (k == max_iter)
        sigma = new
        if not over.any():
            continue
        out["sigma"][names[over]], out["change"][names[over]], out["rounds"][names[over]] = new[over], change[over], k
        ended = over[owner]
        if imputed:
            out["z_imp"][at[ended]] = reg.fill(z, gap, member, np.flatnonzero(ended))
        if over.all():
            break
        place = np.cumsum(~over) - 1
        at, z, lo, hi, gap, code, owner = at[~ended], z[~ended], lo[~ended], hi[~ended], gap[~ended], code[~ended], place[owner[~ended]]
        sigma, names = sigma[~over], names[~over]
    return out


def fit_scan(rows: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str], t: str, max_iter: int, tol: float, sweeps: int,
             keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``pattern_em.fit_offline`` of rows that stand as ``latent_scan`` deals them out: (keys, t, keep, z_imp in the same order; keys, sigma,
    change, rounds)."""
    keys = list(keys)
    head = [*keys, t, *keep]
    d = rows.select(*head, F.col("z").cast("array<double>").alias("z"), "lo", "hi")

    def fit(table: pa.Table, imputed: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        owner = owner_of(table, keys)
        return owner, fit_block(*(matrix_of(table.column(c), p) for c in ("z", "lo", "hi")), owner, is_ord, max_iter, tol, sweeps, imputed)

    def imputed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            yield from added(table, head, z_imp=column_of(fit(table, True)[1]["z_imp"]))

    def sigmas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            owner, got = fit(table, False)
            yield from added(table.take(pa.array(starts(owner))), keys, sigma=column_of(got["sigma"].reshape(-1, p * p)), change=got["change"], rounds=got["rounds"])

    return scan(d, imputed, "z_imp array<double>", head), scan(d, sigmas, "sigma array<double>, change double, rounds int", keys)


def expect_scan(rows: DataFrame, sigma: DataFrame, p: int, is_ord: Sequence[bool], keys: Sequence[str], t: str, sweeps: int) -> DataFrame:
    """``pattern_em.expect`` of streams that fit a task: a stream's Sigma is sent as one row more, before its rows."""
    keys, ordinal = list(keys), np.array(is_ord, dtype=bool)
    many = "array<double>"
    d = rows.select(*keys, t, *[F.col(c).cast(many).alias(c) for c in ("z", "lo", "hi")], F.lit(None).cast(many).alias("_sigma"))
    d = d.unionByName(sigma.where("sigma IS NOT NULL").select(*keys, F.lit(None).cast(rows.schema[t].dataType).alias(t),
                                                             *[F.lit(None).cast(many).alias(c) for c in ("z", "lo", "hi")], F.col("sigma").alias("_sigma")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            owner, given = owner_of(table, keys), table.column("_sigma").is_valid().to_numpy()
            of = np.full(int(owner[-1]) + 1, -1)
            of[owner[given]] = np.arange(int(given.sum()))
            on = np.flatnonzero(~given & (of[owner] >= 0))
            if not len(on):
                continue
            matrices = matrix_of(table.column("_sigma").filter(pa.array(given)), p * p).reshape(-1, p, p)
            owner, table = owner[on], table.take(pa.array(on))
            z, lo, hi = (matrix_of(table.column(c), p) for c in ("z", "lo", "hi"))
            gap = np.isnan(z)
            code = pattern_codes(gap)
            order = np.lexsort((code, owner))
            g = starts(owner[order], code[order])
            member = np.empty(len(order), np.int64)
            member[order] = np.repeat(np.arange(len(g)), np.diff(np.append(g, len(order))))
            first = order[g]
            reg = Regressions(matrices[of[owner[first]]], gap[first])
            z, v = reg.refresh(np.nan_to_num(z, nan=0.0), lo, hi, member, ordinal, sweeps)
            left = reg.rest[:, range(p), range(p)][member] + ((reg.slope * reg.slope)[member] * v[:, :, None]).sum(axis=1)
            names = np.array(["".join("1" if c else "0" for c in x) for x in gap[first]])
            yield from added(table, [*keys, t], z=column_of(z, gap), z_imp=column_of(reg.fill(z, gap, member)), c_diag=column_of(np.where(gap, left, v)),
                             v=column_of(v), pattern=pa.array(names[member]))

    return scan(for_scan(d, keys, t), run, f"z {many}, z_imp {many}, c_diag {many}, v {many}, pattern string", [*keys, t])
