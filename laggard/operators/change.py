"""Does a window change the copula correlation?

The statistic is A21 (F, S, N) between the old Sigma and that of one round over the window's rows, which
``pattern_em`` has from sums by missing pattern.  A replica needs nothing of the rows either: it is drawn from N(0, old
Sigma) with as many rows of each pattern as the window has, its ordinal cells cut where the window's are.  So a
window is one small row (patterns, counts, cuts), and its replicas are drawn in its task, ``CHUNK`` rows at a time;
with ``stop_at`` only until the p-values are decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laggard.operators.copula import expect_block, matrix_change, project_to_correlation
from laggard.operators.learner import schema_of, spread_keys
from laggard.operators.pattern_em import expected_covariance, pattern_of
from laggard.operators.whole_em import correlations

CHUNK = 1 << 16
NORMS = "FSN"


def replica(rng: np.random.Generator, sigma: np.ndarray, counts: list[tuple[str, int]], cuts: list[np.ndarray | None]) -> np.ndarray:
    """The Sigma of one round over rows drawn from N(0, sigma) with the given missing patterns."""
    p, n = len(sigma), sum(c for _, c in counts)
    s, szz, total = np.zeros(p), np.zeros((p, p)), np.zeros((p, p))
    ordinal = np.array([c is not None for c in cuts])
    for pattern, count in counts:
        gap = np.array([k == "1" for k in pattern])
        for at in range(0, count, CHUNK):
            z = rng.multivariate_normal(np.zeros(p), sigma, min(CHUNK, count - at), method="eigh")
            lo, hi = np.full_like(z, -np.inf), np.full_like(z, np.inf)
            for j in np.flatnonzero(ordinal & ~gap):
                ends = np.concatenate([[-np.inf], cuts[j], [np.inf]])
                k = np.searchsorted(cuts[j], z[:, j])
                lo[:, j], hi[:, j] = ends[k], ends[k + 1]
            z[:, gap] = np.nan
            c, full, _, _ = expect_block(z, lo, hi, ordinal, sigma)
            s, szz, total = s + full.sum(axis=0), szz + full.T @ full, total + c
    cov = (szz - np.outer(s, s) / n) / max(n - 1, 1)
    return project_to_correlation(cov + total / n)


def replicas(rngs: list[np.random.Generator], sigma: np.ndarray, counts: list[tuple[str, int]], cuts: list[np.ndarray | None]) -> np.ndarray:
    """``replica`` of every generator at once, the same draws: k x p x p."""
    k, p, n = len(rngs), len(sigma), sum(c for _, c in counts)
    w, u = np.linalg.eigh(sigma)
    drawn = np.array([g.standard_normal((n, p)) for g in rngs]) @ (u * np.sqrt(np.abs(w))).T
    ordinal = np.array([c is not None for c in cuts])
    s, szz, total, at = np.zeros((k, p)), np.zeros((k, p, p)), np.zeros((k, p, p)), 0
    for pattern, count in counts:
        gap = np.array([c == "1" for c in pattern])
        o, m = np.flatnonzero(~gap), np.flatnonzero(gap)
        z = drawn[:, at:at + count].reshape(-1, p).copy()
        at += count
        lo, hi = (np.full_like(z, -np.inf), np.full_like(z, np.inf)) if ordinal.any() else (None, None)
        for j in np.flatnonzero(ordinal & ~gap):
            ends = np.concatenate([[-np.inf], cuts[j], [np.inf]])
            i = np.searchsorted(cuts[j], z[:, j])
            lo[:, j], hi[:, j] = ends[i], ends[i + 1]
        t, rest = np.diag((~gap).astype(float)), np.zeros((p, p))
        if len(o) and len(m):
            slope = np.linalg.inv(sigma[np.ix_(o, o)]) @ sigma[np.ix_(o, m)]
            t[np.ix_(m, o)] = slope.T
            rest[np.ix_(m, m)] = sigma[np.ix_(m, m)] - sigma[np.ix_(m, o)] @ slope
        elif len(m):
            rest = sigma
        if (ordinal & ~gap).any():
            z[:, gap] = np.nan
            _, full, _, diagonal = expect_block(z, lo, hi, ordinal, sigma)
            left = np.where(gap, 0.0, diagonal).reshape(k, count, p).sum(axis=1)  # the variances that ordinals leave open
            total += (t * left[:, None, :]) @ t.T
        else:  # nothing to refresh: missing cells follow from the others
            z[:, gap] = 0.0
            full = z
            full[:, m] = z[:, o] @ t[np.ix_(m, o)].T
        full = full.reshape(k, count, p)
        s, szz = s + full.sum(axis=1), szz + full.transpose(0, 2, 1) @ full
        total += count * rest
    cov = (szz - s[:, :, None] * s[:, None, :] / n) / max(n - 1, 1)
    return correlations(cov + total / n)


def matrix_changes(old: np.ndarray, new: np.ndarray) -> list[dict[str, float]]:
    """A21 of every matrix of ``new``."""
    w, v = np.linalg.eigh(old)
    inv_half = v @ np.diag(np.clip(w, 1e-12, None) ** -0.5) @ v.T
    m = inv_half @ new @ inv_half
    off = np.abs(np.linalg.eigvalsh((m + m.transpose(0, 2, 1)) / 2) - 1)
    frob = np.sqrt(((m - np.eye(len(old))) ** 2).sum(axis=(1, 2)))
    return [{"F": f, "S": s, "N": n} for f, s, n in zip(frob.tolist(), off.max(axis=1).tolist(), off.sum(axis=1).tolist(), strict=True)]


def p_values(seed_of, sigma: np.ndarray, observed: dict[str, float], counts, cuts, nsample: int, stop_at: int | None) -> tuple[list[float], int]:
    """p of each norm and the number of replicas: the share of replicas above, exceedances / (nsample + 1); a norm with ``stop_at``
    exceedances after k replicas is decided at stop_at / k.  Replicas are drawn together up to ``CHUNK`` rows."""
    above, decided, k, n = dict.fromkeys(NORMS, 0), {}, 0, sum(c for _, c in counts)
    while k < nsample and len(decided) < len(NORMS):
        some = min(nsample - k, CHUNK // n, nsample if stop_at is None else max(k, 8))
        rngs = [np.random.default_rng(seed_of(i)) for i in range(k, k + max(some, 1))]
        got = replicas(rngs, sigma, counts, cuts) if some else np.array([replica(rngs[0], sigma, counts, cuts)])
        for drawn in matrix_changes(sigma, got):
            k += 1
            for c in NORMS:
                above[c] += drawn[c] > observed[c]
                if stop_at is not None and c not in decided and above[c] >= stop_at:
                    decided[c] = stop_at / k
            if len(decided) == len(NORMS):
                break
    return [decided.get(c, above[c] / (nsample + 1)) for c in NORMS], k


def change_test(rows: DataFrame, sigma_old: DataFrame, p: int, nsample: int = 100, keys: Sequence[str] = ("stream_id",), win: str = "win",
                t: str = "t", seed: int = 0, is_ord: Sequence[bool] | None = None, stop_at: int | None = None) -> DataFrame:
    """B15 for every window: ``stat_F, stat_S, stat_N, p_F, p_S, p_N, replicas``.

    Ordinal columns (``is_ord``, with the rows' ``lo`` and ``hi``) are refreshed within their intervals; a replica's ordinal
    cells get the interval of theirs among those of the window in which the drawn value lies.  A replica's generator is keyed by a
    digest of (seed, keys, window, replica), so that any task draws the same.  A window of one row says nothing: NaN."""
    keys = list(keys)
    g = [*keys, win]
    ordinal = [False] * p if is_ord is None else [bool(o) for o in is_ord]
    none = F.lit(None).cast("array<double>")
    d = rows.select(*g, t, F.col("z").cast("array<double>").alias("z"), *[F.col(c) if any(ordinal) else none.alias(c) for c in ("lo", "hi")])
    old = d.select(*g).distinct().join(sigma_old.select(*keys, "sigma"), keys).checkpoint()
    new = expected_covariance(d, old, p, ordinal, g, t).select(*g, F.col("sigma").alias("new"))
    counts = d.groupBy(*g, pattern_of().alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("counts"))
    ends = [F.array_sort(F.array_union(*[F.collect_set(F.when(F.get("z", F.lit(j)).isNotNull(), F.get(c, F.lit(j)))) for c in ("lo", "hi")])).alias(f"cut{j}")
            for j in range(p) if ordinal[j]]
    one = old.join(new, g).join(counts, g)
    if ends:
        one = one.join(d.groupBy(*g).agg(*ends), g)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                sigma, now = (np.asarray(r[c], dtype=float).reshape(p, p) for c in ("sigma", "new"))
                patterns = [(c["pattern"], int(c["n"])) for c in r["counts"]]
                cuts = [np.array([v for v in r[f"cut{j}"] if np.isfinite(v)]) if ordinal[j] else None for j in range(p)]
                name = "|".join([str(seed), *(str(r[k]) for k in g)])
                seed_of = lambda k, name=name: int.from_bytes(hashlib.blake2b(f"{name}|{k}".encode(), digest_size=16).digest(), "big")
                if sum(n for _, n in patterns) < 2:
                    out.append((*(r[k] for k in g), *[np.nan] * 6, 0))
                    continue
                stat = matrix_change(sigma, now)
                ps, k = p_values(seed_of, sigma, stat, patterns, cuts, nsample, stop_at)
                out.append((*(r[k_] for k_ in g), *(stat[c] for c in NORMS), *ps, k))
            yield pd.DataFrame(out, columns=[*g, *(f"stat_{c}" for c in NORMS), *(f"p_{c}" for c in NORMS), "replicas"])

    schema = ", ".join([schema_of(rows, g), *(f"stat_{c} double" for c in NORMS), *(f"p_{c} double" for c in NORMS), "replicas int"])
    return spread_keys(one, g).mapInPandas(run, schema)
