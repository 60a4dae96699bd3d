"""Density-peaks graphs and structure-ordered self-training per sliding window.

W09 assigns rows to sliding windows (``size`` rows ending every ``hop`` rows);
each window is one bounded group (``size`` rows, a parameter) processed by
``applyInPandas``: the O(size^2) pair distances (J04/J10), the cut-off
distance (A15), densities (A16), nearest denser neighbours (J05, with the
total order (rho desc, t asc) so the result is always a forest, D15), the
propagation rounds (B06) and the K-NN labelling (B07/T03) never leave the
task as rows.  Windows of all streams run in parallel; the duplication factor
is size/hop, so ``hop`` is the scale knob.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laggard.operators.learner import schema_of


def sliding_windows(df: DataFrame, size: int | str, hop: int, keys: Sequence[str] = ("stream_id",),
                    pos: str = "pos", out: str = "win") -> DataFrame:
    """Window ``e`` holds positions [max(0, e - size + 1), e]; windows end at the
    positions e of the stream with (e + 1) % hop == 0 (hop = 1 is the reference's
    batch at every step) and at its last position, so that every row is in a window
    (hop must not exceed size).  Each row is exploded into the at most
    ceil(size / hop) + 1 windows that contain it.  ``size`` may name a column of sizes by stream."""
    if isinstance(size, int) and hop > size or isinstance(size, str) and hop > 1:
        raise ValueError("hop > size leaves rows without a window")
    size = F.col(size) if isinstance(size, str) else F.lit(size)
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.max(pos).alias("_last"))
    p = F.col(pos)
    first = F.ceil((p + 1) / hop) * hop - 1
    upto = F.least(p + size - 1, F.col("_last"))
    ends = F.when(first <= upto, F.sequence(first.cast("long"), upto.cast("long"), F.lit(hop).cast("long"))) \
        .otherwise(F.array().cast("array<bigint>"))
    tail = F.when(F.col("_last") <= p + size - 1, F.array(F.col("_last").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.join(n, keys).withColumn(out, F.explode(F.array_union(ends, tail))).drop("_last")


def _pair_dist(x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed coordinate by coordinate (same order as the SQL oracle)."""
    n, p = x.shape
    acc = np.zeros((n, n))
    for k in range(p):
        diff = x[:, k][:, None] - x[:, k][None, :]
        acc += diff * diff
    return np.sqrt(acc)


def peaks(x: np.ndarray, pct: float, time_decay: float | None = None, dist: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Density peaks of one window; rows in time order.  Returns rho, parent index,
    delta and the cut-off distance.  ``dist``: the rows' distances, if they are known already."""
    n = x.shape[0]
    d = _pair_dist(x) if dist is None else dist
    if time_decay is not None:                       # F19 / B05
        beta = time_decay / n if n > 1 else 0.0
        idx = np.arange(n)
        d = d * np.exp(beta * np.abs(idx[:, None] - idx[None, :]))
    iu = np.triu_indices(n, 1)
    pairs = np.sort(d[iu])
    if len(pairs):
        pos = min(max(int(round(len(pairs) * pct / 100)), 0), len(pairs) - 1)
        dc = pairs[pos]
        if dc == 0:
            pos_vals = pairs[pairs > 0]
            dc = pos_vals[0] if len(pos_vals) else 1.0
    else:
        dc = 1.0
    k = np.exp(-(d / dc) ** 2)
    np.fill_diagonal(k, 0.0)
    rho = np.zeros(n)
    for j in range(n):                               # sequential sum over j (oracle order)
        rho += k[:, j]
    order = sorted(range(n), key=lambda i: (-rho[i], i))
    rank = np.empty(n, dtype=int)
    rank[order] = np.arange(n)
    parent = np.empty(n, dtype=int)
    delta = np.empty(n)
    for i in range(n):
        if rank[i] == 0:
            parent[i], delta[i] = i, d.max() if n > 1 else 0.0
            continue
        cand = np.where(rank < rank[i])[0]
        dj = d[i, cand]
        best = cand[np.lexsort((cand, dj))[0]]
        parent[i], delta[i] = best, d[i, best]
    return {"rho": rho, "parent": parent, "delta": delta, "dc": np.full(n, dc), "dist": d}


def propagation_rounds(parent: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """Round 0 = labelled rows; forward rounds climb to denser neighbours not yet
    visited until exhausted; backward rounds then add rows whose parent is visited.
    Rows never reached (no labelled row in the window) get -1."""
    n = len(parent)
    rnd = np.full(n, -1)
    visited = set(np.where(labelled)[0].tolist())
    if not visited:
        return rnd
    for i in visited:
        rnd[i] = 0
    r, frontier = 0, set(visited)
    while True:
        nxt = {int(parent[i]) for i in frontier} - visited
        if not nxt:
            break
        r += 1
        for i in nxt:
            rnd[i] = r
        visited |= nxt
        frontier = nxt
    while True:
        nxt = {i for i in range(n) if i not in visited and int(parent[i]) in visited}
        if not nxt:
            break
        r += 1
        for i in nxt:
            rnd[i] = r
        visited |= nxt
    return rnd


def knn_vote(dist: np.ndarray, rnd: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Label rows round by round with a distance-weighted K-NN vote among rows
    labelled in earlier rounds (an exact match dominates).  Returns (label, p1)."""
    n = len(rnd)
    lab = np.where(rnd == 0, y, -1).astype(float)
    p1 = np.where(rnd == 0, y, np.nan).astype(float)
    for r in range(1, int(rnd.max()) + 1 if n and rnd.max() > 0 else 1):
        known = np.where((rnd >= 0) & (rnd < r))[0]
        for i in np.where(rnd == r)[0]:
            p1[i] = nearest_share(dist[i], known, lab, k)
            lab[i] = 1.0 if p1[i] > 0.5 else 0.0
    return lab, p1


def nearest_share(dist: np.ndarray, known: np.ndarray, lab: np.ndarray, k: int) -> float:
    """The share of class 1 among the ``k`` nearest of the ``known`` rows, weighted by 1 / distance; rows at distance 0 alone
    count where there are any, the earlier of equally near rows comes first."""
    near = known[np.lexsort((known, dist[known]))[:k]]
    d = dist[near]
    w = (d == 0).astype(float) if np.any(d == 0) else 1.0 / d
    return float(np.sum(w * (lab[near] == 1))) / float(np.sum(w))


def final_vote(dist: np.ndarray, rnd: np.ndarray, lab: np.ndarray, p1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """B07's last step: rows that no round has reached are voted on by all that are labelled by then.  NaN in a window without labels."""
    known, final, p = np.where(rnd >= 0)[0], np.where(rnd >= 0, lab, np.nan), np.where(rnd >= 0, p1, np.nan)
    for i in np.where(rnd < 0)[0] if len(known) else ():
        p[i] = nearest_share(dist[i], known, lab, k)
        final[i] = 1.0 if p[i] > 0.5 else 0.0
    return final, p


def window_graph(df: DataFrame, keys: Sequence[str] = ("stream_id",), win: str = "win",
                 t: str = "t", x: str = "x", y: str | None = "y_obs", pct: float = 5.0,
                 time_decay: float | None = None, knn: int = 3) -> DataFrame:
    """B04/B05 (+ B06, B07 when ``y`` is given) for every (stream, window).

    Output per row and window: ``rho, parent_t, delta, dc, is_root`` and, with labels,
    ``round`` (-1 = unreachable), ``pseudo`` (label) and ``p1`` (vote share of class 1), and of every row, reached or not,
    ``final`` and ``p_final``.
    """
    keys = list(keys)
    g = [*keys, win]
    cols = [*g, t, x] + ([y] if y else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t).reset_index(drop=True)
        xs = np.array([np.asarray(v, dtype=float) for v in pdf[x]])
        res = peaks(xs, pct, time_decay)
        ts = pdf[t].to_numpy()
        out = pdf[[*g, t]].copy()
        out["rho"] = res["rho"]
        out["parent_t"] = ts[res["parent"]]
        out["delta"] = res["delta"]
        out["dc"] = res["dc"]
        out["is_root"] = res["parent"] == np.arange(len(pdf))
        if y:
            yy = pdf[y].to_numpy(dtype=float, na_value=np.nan)
            labelled = ~np.isnan(yy)
            rnd = propagation_rounds(res["parent"], labelled)
            lab, p1 = knn_vote(res["dist"], rnd, np.nan_to_num(yy, nan=-1.0), knn)
            out["round"] = rnd
            out["pseudo"] = np.where(rnd >= 0, lab, np.nan)
            out["p1"] = p1
            out["final"], out["p_final"] = final_vote(res["dist"], rnd, lab, p1, knn)
        return out

    schema = (f"{schema_of(df, [*g, t])}, rho double, parent_t {dict(df.dtypes)[t]}, delta double, "
              f"dc double, is_root boolean")
    if y:
        schema += ", round int, pseudo double, p1 double, final double, p_final double"
    from laggard.operators.learner import by_key
    return by_key(df.select(*cols), g).groupBy(*g).applyInPandas(run, schema)


def _logistic_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, iters: int = 200, tol: float = 1e-8) -> np.ndarray:
    """L2-regularised logistic regression (intercept unpenalised): minimise 0.5 ||w||^2 + C sum
    log-loss by Newton steps, halved while they do not lower the loss, until a step is below ``tol``."""
    a = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.eye(a.shape[1]) / c
    ridge[0, 0] = 0.0
    w = np.zeros(a.shape[1])

    def loss(v):
        m = a @ v
        return np.sum(np.logaddexp(0.0, m) - y * m) + 0.5 * v @ ridge @ v

    now = loss(w)
    for _ in range(iters):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (p - y) + ridge @ w)
        while np.max(np.abs(step)) >= tol and (new := loss(w - step)) > now:
            step = step / 2
        if np.max(np.abs(step)) < tol:
            break
        w, now = w - step, new
    return w


def class_probability(x: np.ndarray, known: np.ndarray, y: np.ndarray, model: str = "logistic", c: float = 1.0) -> np.ndarray:
    """p(class 1) of every row by a classifier fitted on the ``known`` rows (both classes present).
    ``logistic``: L2 logistic regression; ``svc``: linear SVM with squared hinge loss, its margin
    through a sigmoid; ``centroid``: sigmoid of the difference of squared distances to class means."""
    a, labels = x[known], y[known]
    if model == "centroid":
        d0, d1 = (((x - a[labels == k].mean(axis=0)) ** 2).sum(axis=1) for k in (0, 1))
        m = d0 - d1
    elif model == "svc":
        m = np.hstack([np.ones((len(x), 1)), x]) @ _svc_fit(a, labels, c)
    else:
        m = np.hstack([np.ones((len(x), 1)), x]) @ _logistic_fit(a, labels, c)
    return 1.0 / (1.0 + np.exp(-np.clip(m, -35, 35)))


def _svc_fit(x: np.ndarray, y: np.ndarray, c: float = 1.0, iters: int = 200) -> np.ndarray:
    """Linear SVM, squared hinge loss, intercept unpenalised: Newton steps on the rows inside the
    margin until that set stays the same."""
    a, s = np.hstack([np.ones((len(x), 1)), x]), 2 * y - 1
    ridge = np.eye(a.shape[1])
    ridge[0, 0] = 1e-9
    w, active = np.zeros(a.shape[1]), np.ones(len(x), dtype=bool)
    for _ in range(iters):
        b = a[active]
        w = np.linalg.solve(ridge + 2 * c * b.T @ b, 2 * c * b.T @ s[active])
        inside = s * (a @ w) < 1
        if (inside == active).all():
            break
        active = inside
    return w


def _entropy_clip(v: np.ndarray) -> float:
    q = np.clip(v, 1e-10, 1.0)
    return float(-np.sum(q * np.log(q)))


def guard(y: np.ndarray) -> bool:
    """A26 on the labels that have arrived (NaN: not): both classes, in a batch of more than two rows."""
    seen = y[~np.isnan(y)]
    return len(y) > 2 and len(np.unique(seen)) == 2


def propagate_soft(x: np.ndarray, dist: np.ndarray, parent: np.ndarray, rnd: np.ndarray, y: np.ndarray,
                   class_rows: np.ndarray, c: float = 1.0, temperature: float = 2.0, model: str = "logistic") -> np.ndarray:
    """B11 for one window: rows are labelled in round order.  A row of round r fuses the classifier's
    probability (self), the row of the carried class matrix for its arg-max (F16), and the summary
    of the neighbours labelled so far (A18, parent and children weighted by e^-d) by F15 (weights
    proportional to exp(-T H)).  The classifier is refitted on true and pseudo labels after every
    round; the soft label of every row is the last classifier's probability.  Returns p1 per row (NaN
    where the guard A26 rejects the window)."""
    delta = dist[np.arange(len(parent)), parent]
    return soft_labels(x, delta, parent, rnd, y, class_rows, c, temperature, model)


def soft_labels(x: np.ndarray, delta: np.ndarray, parent: np.ndarray, rnd: np.ndarray, y: np.ndarray, class_rows: np.ndarray,
                c: float = 1.0, temperature: float = 2.0, model: str = "logistic") -> np.ndarray:
    """``propagate_soft`` from the distances to the parents alone (``delta``), the only ones it asks for."""
    n = len(rnd)
    if not guard(np.where(rnd == 0, y, np.nan)):
        return np.full(n, np.nan)
    known = rnd == 0
    p1 = class_probability(x, known, y, model, c)
    soft = np.full((n, 2), np.nan)
    soft[known] = np.stack([1 - y[known], y[known]], axis=1)
    near_of: list[list[int]] = [[] for _ in range(n)]
    for i in np.flatnonzero(parent != np.arange(n)):
        near_of[parent[i]].append(int(i))
    for i in np.flatnonzero(parent != np.arange(n)):
        near_of[i].append(int(parent[i]))
    for r in range(1, int(rnd.max()) + 1):
        for i in np.flatnonzero(rnd == r):
            vectors = [np.array([1 - p1[i], p1[i]]), class_rows[int(p1[i] > 0.5)]]
            near = [j for j in near_of[i] if not np.isnan(soft[j, 0])]
            if near:
                weight = np.exp(-np.array([delta[i] if j == parent[i] else delta[j] for j in near]))
                vectors.append(weight @ soft[near] / weight.sum())
            trust = np.exp(-temperature * np.array([_entropy_clip(v) for v in vectors]))
            fused = trust @ np.array(vectors)
            soft[i] = fused / fused.sum()
        done = ~np.isnan(soft[:, 0])
        labels = np.where(done, soft[:, 1] > 0.5, 0).astype(float)
        if len(np.unique(labels[done])) == 2:
            p1 = class_probability(x, done, labels, model, c)
    return p1


def fuse_views(p1: np.ndarray, p2: np.ndarray, method: str = "confidence", quality: tuple[float, float] = (0.5, 0.5),
               weights: tuple[float, float] = (0.5, 0.5)) -> np.ndarray:
    """J07 and F10-F14 on the probabilities of class 1; a row that one view alone has keeps its value."""
    c1, c2 = np.maximum(p1, 1 - p1), np.maximum(p2, 1 - p2)
    if method == "agreement":
        both = np.where((p1 > 0.5) == (p2 > 0.5), (p1 + p2) / 2, np.where(c1 > c2, p1, p2))
    else:
        if method == "entropy":
            h1, h2 = (-(q * np.log(q + 1e-10) + (1 - q) * np.log(1 - q + 1e-10)) for q in (p1, p2))
            total = np.where(h1 + h2 > 0, h1 + h2, 1.0)
            a, b = 1 - h1 / total, 1 - h2 / total
        else:
            a, b = {"confidence": (c1, c2), "fixed": weights, "view_quality": quality}[method]
        a, b = np.broadcast_to(a, p1.shape), np.broadcast_to(b, p1.shape)
        total = a + b
        share = np.where(total > 0, a / np.where(total > 0, total, 1.0), 0.5)
        both = share * p1 + (1 - share) * p2
    return np.where(np.isnan(p1), p2, np.where(np.isnan(p2), p1, both))


def arrived(df: DataFrame, delay: int, y: str = "y_obs", pos: str = "pos", win: str = "win") -> DataFrame:
    """A window that ends at position ``win`` knows the labels of positions up to win - delay only."""
    return df.withColumn(y, F.when(F.col(pos) <= F.col(win) - delay, F.col(y)))


def _window_arrays(pdf: pd.DataFrame, t: str, x: str, y: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(t).reset_index(drop=True)
    return pdf, np.array([np.asarray(v, dtype=float) for v in pdf[x]]), pdf[y].to_numpy(dtype=float, na_value=np.nan)


def window_class_sums(df: DataFrame, view_cols: Sequence[str], keys: Sequence[str] = ("stream_id",), win: str = "win",
                      t: str = "t", y: str = "y_obs", model: str = "logistic") -> DataFrame:
    """A17 per window and view: ``n_ok`` labelled rows that the window's classifier gets right and ``s``,
    the K x K sums of their probability rows by class (flattened); the first stage of ST22.
    Windows that the guard rejects have none."""
    from laggard.operators.learner import by_key
    keys = list(keys)
    g = [*keys, win]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, col in enumerate(view_cols):
            sub, xs, ys = _window_arrays(pdf, t, col, y)
            known, s, n_ok = ~np.isnan(ys), np.zeros((2, 2)), 0
            if guard(ys):
                p1 = class_probability(xs, known, np.nan_to_num(ys), model)[known]
                right = (p1 > 0.5) == (ys[known] == 1)
                n_ok = int(right.sum())
                for cls in (0, 1):
                    q = p1[right & (ys[known] == cls)]
                    s[cls] = [(1 - q).sum(), q.sum()]
            out.append((*sub[g].iloc[0], k, n_ok, s.ravel().tolist()))
        return pd.DataFrame(out, columns=[*g, "view", "n_ok", "s"])

    return by_key(df.select(*g, t, y, *view_cols), g).groupBy(*g).applyInPandas(
        run, f"{schema_of(df, g)}, view int, n_ok bigint, s array<double>")


def two_view_propagation(df: DataFrame, view_cols: Sequence[str] = ("x1", "x2"), keys: Sequence[str] = ("stream_id",),
                         win: str = "win", t: str = "t", y: str = "y_obs", pct: float = 5.0, model: str = "logistic",
                         fusion: str = "confidence") -> DataFrame:
    """B12 in three stages: the windows' class sums (A17), their fold over a stream's windows (ST22,
    one matrix per view), and, with the matrix of its window joined, B11 for every window and view:
    density graph, propagation order, soft labels; both views' labels are fused per row (J07).
    ``df`` holds a row for each (window, member).  Output ``p1_view1, p1_view2, p1_fused, hard``."""
    from laggard.operators.learner import by_key, carried_class_matrix
    keys = list(keys)
    g = [*keys, win]
    sums = window_class_sums(df, view_cols, keys, win, t, y, model)
    carried = carried_class_matrix(sums, [*keys, "view"], win).groupBy(*g).agg(
        *[F.max(F.when(F.col("view") == k, F.struct("m"))).getField("m").alias(f"m{k}") for k in range(2)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ps, qualities = [], []
        for k, col in enumerate(view_cols):
            sub, xs, ys = _window_arrays(pdf, t, col, y)
            res, known = peaks(xs, pct), ~np.isnan(ys)
            p1 = propagate_soft(xs, res["dist"], res["parent"], propagation_rounds(res["parent"], known), np.nan_to_num(ys),
                                np.asarray(sub[f"m{k}"].iloc[0], dtype=float).reshape(2, 2), model=model)
            ps.append(p1)
            qualities.append(float(((p1 > 0.5) == (ys == 1))[known].mean()) if known.any() else 0.5)
        out = sub[[*g, t]].copy()
        fused = fuse_views(*ps, fusion, tuple(qualities))
        out["p1_view1"], out["p1_view2"], out["p1_fused"] = *ps, fused
        out["hard"] = np.where(np.isnan(fused), np.nan, (fused > 0.5).astype(float))
        return out

    schema = f"{schema_of(df, [*g, t])}, p1_view1 double, p1_view2 double, p1_fused double, hard double"
    return by_key(df.select(*g, t, y, *view_cols).join(carried, g), g).groupBy(*g).applyInPandas(run, schema)


def linear_self_training(df: DataFrame, view_cols: Sequence[str] = ("x",), keys: Sequence[str] = ("stream_id",), win: str = "win",
                         t: str = "t", y: str = "y_obs", pct: float = 5.0, model: str = "svc") -> DataFrame:
    """B08 (one view) and B09 (two views): rows are labelled in the order of B06 by a linear
    classifier that is refitted on true and pseudo labels after every round.  With two views a row
    gets class 1 if either view's classifier says so, and each view goes on with that label in the
    order of its own graph; a row that no round reaches is labelled by the last classifiers, as is
    every row in ``p1`` (mean of the views).  Output ``round`` (of the first view), ``label, p1``; NaN where
    the guard rejects the window."""
    from laggard.operators.learner import by_key
    keys = list(keys)
    g = [*keys, win]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        views, rounds = [], []
        for col in view_cols:
            sub, xs, ys = _window_arrays(pdf, t, col, y)
            views.append(xs)
            rounds.append(propagation_rounds(peaks(xs, pct)["parent"], ~np.isnan(ys)))
        out = sub[[*g, t]].copy()
        label, p1 = structure_labels(views, rounds, ys, model)
        out["round"], out["label"], out["p1"] = rounds[0], label, p1
        return out

    schema = f"{schema_of(df, [*g, t])}, round int, label double, p1 double"
    return by_key(df.select(*g, t, y, *view_cols), g).groupBy(*g).applyInPandas(run, schema)


def structure_labels(views: list[np.ndarray], rounds: list[np.ndarray], y: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray]:
    """(labels, p1) of one window by B08 / B09."""
    n = len(y)
    if not guard(y):
        return np.full(n, np.nan), np.full(n, np.nan)
    label = y.copy()
    for r in range(1, max(int(q.max()) for q in rounds) + 1):
        known = ~np.isnan(label)
        fits = [class_probability(x, known, np.nan_to_num(label), model) for x in views]
        due = np.any([q == r for q in rounds], axis=0) & ~known
        label[due] = np.any([p > 0.5 for p in fits], axis=0)[due]
    known = ~np.isnan(label)
    fits = [class_probability(x, known, np.nan_to_num(label), model) for x in views]
    label = np.where(known, label, np.any([p > 0.5 for p in fits], axis=0))
    return label, np.mean(fits, axis=0)


def list_groups(df: DataFrame, k: int, keys: Sequence[str] = ("stream_id",), win: str = "win",
                t: str = "t") -> DataFrame:
    """The window's members in time order grouped into rows of k (last one short);
    the window is a bounded group (W09 size), so the list never grows with the data."""
    g = [*list(keys), win]
    lst = df.groupBy(*g).agg(F.array_sort(F.collect_list(t)).alias("_l"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_l") / k).cast("int") - 1),
                         lambda i: F.slice("_l", i * k + 1, k))
    return lst.select(*g, F.posexplode(chunks).alias("chunk", "members"))
