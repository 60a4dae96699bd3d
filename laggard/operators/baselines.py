"""Batch baselines (B13, T04, B14): linear models fitted by sums over the whole table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C_GRID = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]   # fixed values: the six C of the reference grid


def svm_sums(train: DataFrame, weights: np.ndarray) -> np.ndarray:
    """For every row w of ``weights``: sum of max(0, 1 - s w.a)^2, and over the rows with s w.a < 1 the sums of s a and of a a', in one
    pass.  ``train``: a (array, 1 first), s (+-1).  A task keeps one set of sums; only sums of sums reach the driver."""
    c, q = weights.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((c, 1 + q + q * q))
        for pdf in batches:
            a, s = np.array(pdf["a"].tolist()), pdf["s"].to_numpy()
            short = 1 - s[:, None] * (a @ weights.T)
            for k in range(c):
                on = short[:, k] > 0
                total[k, 0] += (short[on, k] ** 2).sum()
                total[k, 1:1 + q] += s[on] @ a[on]
                total[k, 1 + q:] += (a[on].T @ a[on]).ravel()
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = train.select("a", "s").mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(c * (1 + q + q * q))
    for r in got:
        out[r["at"]] = r["v"]
    return out.reshape(c, -1)


def fit_svms(train: DataFrame, q: int, grid: Sequence[float], max_iter: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, list[int], list[bool]]:
    """(weights by C, steps, converged): linear SVMs of squared hinge loss, 0.5 |w|^2 + C sum max(0, 1 - s w.a)^2 with the intercept
    among w, for all C at once.  A step is Newton's on the rows inside the margin, halved while it does not lower the loss; one
    job serves every C that has not come to rest."""
    grid = np.asarray(grid, dtype=float)
    w, best = np.zeros((len(grid), q)), np.full(len(grid), np.inf)
    move, base = np.zeros_like(w), w.copy()
    steps, rest = np.zeros(len(grid), int), np.zeros(len(grid), bool)
    for _ in range(max_iter):
        on = np.flatnonzero(~rest)
        if not len(on):
            break
        got = svm_sums(train, w[on])
        for k, sums in zip(on, got, strict=True):
            loss = 0.5 * w[k] @ w[k] + grid[k] * sums[0]
            steps[k] += 1
            if loss > best[k] and np.abs(move[k]).max() >= tol:
                move[k] /= 2
            else:
                best[k], base[k] = loss, w[k]
                gram, side = sums[1 + q:].reshape(q, q), sums[1:1 + q]
                move[k] = np.linalg.solve(np.eye(q) + 2 * grid[k] * gram, 2 * grid[k] * side) - w[k]
            rest[k] = np.abs(move[k]).max() < tol * max(1.0, np.abs(base[k]).max())
            w[k] = base[k] if rest[k] else base[k] + move[k]
    return base, steps.tolist(), rest.tolist()


def first_best(scores: DataFrame, keys: Sequence[str], choice: str = "C", score: str = "accuracy") -> DataFrame:
    """Per keys the choice of the highest score, the least one of equals, and its score."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c")))
    return scores.groupBy(*keys).agg(top.alias("_t")).select(*keys, (-F.col("_t.c")).alias(choice), F.col("_t.s").alias(score))


def svm_error(spark: SparkSession, df: DataFrame, features: Sequence[str], y: str = "y",
              t: str = "t", keys: Sequence[str] = ("stream_id",), frac: float = 0.7,
              grid: Sequence[float] = C_GRID, max_iter: int = 50) -> DataFrame:
    """B13 + T04: chronological split per stream (t < int(frac n) trains), a linear SVM (squared hinge) per C,
    accuracy on the held-out rows; the first best C wins.  All C share every pass over the rows.
    Output one row per C: ``C, accuracy, iterations, converged`` (false: the fit stopped at ``max_iter``),
    ``is_best`` and ``error = 1 - accuracy``."""
    keys, grid = list(keys), [float(c) for c in grid]
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    value = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
    d = df.where(F.col(y).isNotNull()).withColumns({c: F.col(c).cast("double") for c in features}).join(n, keys) \
        .select(F.array(F.lit(1.0), *[value(c) for c in features]).alias("a"), (2.0 * F.col(y) - 1).alias("s"),
                (F.col(t) < F.floor(F.col("_n") * frac)).alias("_train")).checkpoint()
    weights, steps, converged = fit_svms(d.where("_train"), len(features) + 1, grid, max_iter)
    margin = lambda w: F.aggregate(F.zip_with("a", F.array(*[F.lit(float(v)) for v in w]), lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    hits = d.where("NOT _train").agg(*[F.coalesce(F.avg(((margin(w) > 0) == (F.col("s") > 0)).cast("double")), F.lit(0.0)).alias(f"c{k}")
                                       for k, w in enumerate(weights)]).first()
    rows = [(c, float(hits[k]), steps[k], bool(converged[k])) for k, c in enumerate(grid)]
    got = spark.createDataFrame(rows, "C double, accuracy double, iterations int, converged boolean")
    best = first_best(got, []).first()["C"]
    return got.withColumns({"is_best": F.col("C") == F.lit(best), "error": 1 - F.col("accuracy")})


LAMBDA_U_SCHEDULE = [0.0, 1e-6, 1e-4, 0.01, 0.1, 0.5, 1.0]   # fixed values: annealing of the unlabelled weight


TRIAL_STEPS = [4.0 ** k for k in range(2, -8, -1)]


def transductive_sums(rows: DataFrame, points: np.ndarray, b: float, bell: float, nl: int) -> np.ndarray:
    """For every row w of ``points``: the sums of the losses and of their gradients by w, in one pass.  ``rows``: _lab, _y (+-1), x (array)."""
    c, q = points.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((c, 1 + q))
        for pdf in batches:
            x, s, lab = np.array(pdf["x"].tolist()).reshape(-1, q), pdf["_y"].to_numpy()[:, None], pdf["_lab"].to_numpy()
            f = x @ points.T + b
            u, hill = 20 * (1 - s[lab] * f[lab]), bell * np.exp(-3 * f[~lab] ** 2)
            total[:, 0] += (np.logaddexp(0.0, u) / (20.0 * nl)).sum(axis=0) + hill.sum(axis=0)
            total[:, 1:] += (-s[lab] * np.exp(-np.logaddexp(0.0, -u)) / nl).T @ x[lab] + (-6 * f[~lab] * hill).T @ x[~lab]
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = rows.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(c * (1 + q))
    for r in got:
        out[r["at"]] = r["v"]
    return out.reshape(c, -1)


def transductive_svm(df: DataFrame, features: Sequence[str], y: str = "y_obs", lam: float = 1e-3,
                     max_steps: int = 200, tol: float = 1e-4, schedule: Sequence[float] = LAMBDA_U_SCHEDULE) -> DataFrame:
    """B14 (re-aimed from the quasi-Newton S3VM solver as a distributed job): linear model
    f = w.(x - mu_u) + b, b = mean label (+-1) of the labelled rows, minimising
    (1/(20 n_l)) sum_L log(1 + e^{20 (1 - y f)}) + (lam_U / n_u) sum_U e^{-3 f^2} + lam ||w||^2
    with lam_U annealed over ``schedule``.  A step of the descent is one pass over the table, whose tasks
    return sums alone: losses and gradients at all ``TRIAL_STEPS`` along the last gradient, of which the least
    loss is taken; the driver holds only w.  A level ends when the loss falls by less than ``tol`` of
    itself; ``converged`` tells whether all levels ended so within ``max_steps``.  Probabilities by Platt
    scaling (Spark ML logistic regression on f over the labelled rows).  Output: input rows + f, prob,
    converged."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    feats = list(features)
    d = df.withColumn("_lab", F.col(y).isNotNull()).withColumn("_y", F.when(F.col(y) == 1, 1.0).otherwise(-1.0))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    st = d.agg(*[F.avg(F.when(~F.col("_lab"), F.col(c))).alias(f"mu{i}") for i, c in enumerate(feats)],
               F.sum(F.col("_lab").cast("int")).alias("nl"), F.sum((~F.col("_lab")).cast("int")).alias("nu"),
               F.avg(F.when(F.col("_lab"), F.col("_y"))).alias("b")).first()
    mu = [st[f"mu{i}"] or 0.0 for i in range(len(feats))]
    nl, nu, b = max(st["nl"], 1), max(st["nu"], 1), st["b"] or 0.0
    xc = [F.col(c) - m for c, m in zip(feats, mu)]
    w = [0.0] * len(feats)
    known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in feats))
    whole = d.where(known).select("_lab", "_y", F.array(*[x.cast("double") for x in xc]).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)

    def losses(points, lam_u):
        """(loss, gradient) at every point, by one job."""
        sums = transductive_sums(whole, np.array(points), b, lam_u / nu, nl)
        return [(float(r[0]) + lam * sum(wi * wi for wi in wv), [float(g) + 2 * lam * wi for g, wi in zip(r[1:], wv)])
                for r, wv in zip(sums, points, strict=True)]

    converged = True
    for lam_u in schedule:
        (loss, g), = losses([w], lam_u)
        for _ in range(max_steps):
            points = [[wi - step * gi for wi, gi in zip(w, g)] for step in TRIAL_STEPS]
            tried = losses(points, lam_u)
            best = min(range(len(points)), key=lambda k: tried[k][0])
            if not tried[best][0] < loss - tol * abs(loss):
                break
            w, (loss, g) = points[best], tried[best]
        else:
            converged = False
    f = sum((wi * x for wi, x in zip(w, xc)), F.lit(b))
    scored = d.withColumn("f", f)
    platt = LogisticRegression(featuresCol="_fv", labelCol="_yl", regParam=0.0, maxIter=50).fit(
        VectorAssembler(inputCols=["f"], outputCol="_fv").transform(
            scored.where("_lab").withColumn("_yl", (F.col("_y") > 0).cast("double"))))
    from pyspark.ml.functions import vector_to_array
    out = platt.transform(VectorAssembler(inputCols=["f"], outputCol="_fv").transform(scored))
    res = out.withColumn("prob", vector_to_array("probability")[1]) \
        .drop("_fv", "rawPrediction", "probability", "prediction", "_lab", "_y").withColumn("converged", F.lit(converged))
    whole.unpersist()
    d.unpersist()
    return res
