"""Adaptive FTRL logistic learner with an embedded drift detector (ST01-ST16).

The learner is order-dependent per stream, so its exact form is a *keyed
ordered scan*: rows are hash-partitioned by stream, sorted by (stream, time,
event kind) inside each partition -- Spark's external sort, so it spills
instead of failing -- and folded by one pure step function in ``mapInPandas``.
State is O(p + D) per stream (weights plus the pending-label buffer); no group
is ever collected into memory, into an array, or onto the driver.  Many
streams run in parallel; one hot stream is one sequential task by definition
of the estimator -- ``minibatch_ftrl`` (ST21, in ``laggard.streaming``) is the
distributed estimator for that case.

Event kinds, processed in (time, kind) order:
  0 LABEL   -- label of an earlier row arrives: fit on the buffered features.
  1 FEATURE -- predict with the current weights; buffer the features.
  2 FIT     -- predict, then fit immediately on the row's own label
               (NULL label = predict only, state unchanged: ST04).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laggard.functions.logistic import (decay_py, ftrl_weight_py, logistic_loss_py,
                                        sigmoid_py, soft_cross_entropy_py)

LABEL, FEATURE, FIT = 0, 1, 2


def keyed_partitions(df: DataFrame) -> int:
    """Partition count for CPU-bound per-key Python stages.  An explicit count keeps AQE
    from coalescing the (byte-small, CPU-heavy) shuffle output into a few tasks."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, spark.sparkContext.defaultParallelism)


def by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by the stream keys with ``keyed_partitions`` tasks."""
    return df.repartition(keyed_partitions(df), *keys)


def for_scan(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Every key whole in one partition, in order, for a scan by ``mapInPandas``.  Rows that a join or an aggregation has left
    partitioned by the keys would not be sent again, and as a scan asks for no partitioning, adaptive execution may then read the
    join's input in other pieces; partitioning by the keys and a constant is never taken for the former."""
    return df.repartition(keyed_partitions(df), *keys, F.lit(0)).sortWithinPartitions(*keys, *order)


def spread_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``by_key`` for ``mapInPandas`` after a join or an aggregation by the same keys: that would leave ``by_key`` without an exchange of its own, and
    adaptive execution would put its few bytes into a few tasks, however long they take."""
    return df.repartition(keyed_partitions(df), *keys, F.lit(0))


def schema_of(df: DataFrame, names: Sequence[str]) -> str:
    """DDL fragment for the named columns of ``df``, in the given order."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {types[n]}" for n in names)


@dataclass(frozen=True)
class FtrlParams:
    l1: float = 0.0
    l2: float = 0.0
    lp: float = 1.0
    decay_choice: int = 4
    contribute_error_rate: float = 0.01
    adaptive: bool = True
    warmup: int = 30          # detector and error-rate blend are active after this many fits
    init_decay: float = 1.0
    threshold: float = 0.5    # P17


NO_BEST = (1.0, 10.0)


def drift_step(rows: int, errors: int, counts: tuple, warned: tuple, best: tuple, warmup: int) -> tuple:
    """ST16 as a transition: (rate or None, level, counts, warned, best) after ``rows`` more rows with
    ``errors`` errors.  The error rate's upper end, rate + spread, is compared with the least one so
    far: two spreads above its rate are a warning, more than three a drift.  Rows are counted anew
    from the start of a warning; a drift makes that count the only one and forgets the least rate."""
    counts = (counts[0] + rows, counts[1] + errors)
    if counts[0] <= warmup:
        return None, 0, counts, warned, best
    rate = counts[1] / counts[0]
    top = rate + math.sqrt(rate * (1 - rate) / counts[0])
    if top < best[0] + best[1]:
        best = (rate, math.sqrt(rate * (1 - rate) / counts[0]))
    level = int(top >= best[0] + 2 * best[1]) + int(top > best[0] + 3 * best[1])
    warned = (warned[0] + rows, warned[1] + errors) if level else (0, 0)
    return (rate, level, warned, warned, NO_BEST) if level == 2 else (rate, level, counts, warned, best)


def observe(rows: int, errors: int, counts: tuple, warned: tuple, best: tuple, prm: FtrlParams) -> tuple:
    """(decay, level, counts, warned, best) after ``rows`` rows: the schedule's decay at the number of rows,
    blended with the error rate by ``contribute_error_rate`` once the detector is active."""
    decay = decay_py(counts[0] + rows, prm.decay_choice)
    rate, level, *state = drift_step(rows, errors, counts, warned, best, prm.warmup)
    if rate is not None:
        share = prm.contribute_error_rate
        decay = decay * (1.0 - share) + share * rate
    return decay, level, *state


class FtrlState:
    """Learner state; ``fit`` is ST01 (hard label) and ``fit_soft`` ST02."""

    __slots__ = ("p", "v", "h", "z", "r", "decay", "counts", "warned", "best", "level")

    def __init__(self, p: int, prm: FtrlParams):
        self.p = p
        self.v = [0.0] * p
        self.h = [0.0] * p
        self.z = [0.0] * p
        self.r = 1.0
        self.decay = prm.init_decay
        self.counts = (0, 0)     # rows seen, errors among them
        self.warned = (0, 0)     # the same since the warning began
        self.best = NO_BEST      # least error rate and its spread
        self.level = 0           # ST16 output: 0 stable, 1 warning, 2 drift

    def grow(self, p: int) -> None:
        """Growing feature space (trapezoidal streams): new weights start at 0."""
        if p > self.p:
            extra = [0.0] * (p - self.p)
            self.v += extra
            self.h += list(extra)
            self.z += list(extra)
            self.p = p

    def weights(self, n: int, prm: FtrlParams) -> list[float]:
        r = self.r
        return [ftrl_weight_py(self.z[i], r, prm.l1, prm.l2, prm.lp) for i in range(n)]

    def margin(self, x: Sequence[float], prm: FtrlParams) -> tuple[float, list[float]]:
        n = len(x)
        self.grow(n)
        w = self.weights(n, prm)
        s = 0.0
        for i in range(n):
            s += w[i] * x[i]
        return s, w

    def predict(self, x: Sequence[float], prm: FtrlParams) -> float:
        return sigmoid_py(self.margin(x, prm)[0])

    def observe(self, err: int, prm: FtrlParams) -> None:
        """F08 decay, blended with the error rate once the detector is active, and ST16."""
        self.decay, self.level, self.counts, self.warned, self.best = observe(
            1, err, self.counts, self.warned, self.best, prm)

    def _update(self, x, w, g_scale: float, prm: FtrlParams) -> None:
        d = self.decay
        for i in range(len(x)):
            self.v[i] += g_scale * x[i]
            self.h[i] = d * self.h[i] + w[i]
            self.z[i] = self.v[i] - prm.lp * self.h[i]
        self.r = 1.0 + d * self.r

    def fit(self, x: Sequence[float], y: float, prm: FtrlParams, weight: float = 1.0,
            grad_factor: float = 1.0) -> tuple[float, float]:
        """One hard-label step; returns (p before the update, loss)."""
        m, w = self.margin(x, prm)
        p = sigmoid_py(m)
        loss = logistic_loss_py(y, m)
        if prm.adaptive:
            self.observe(int(abs(y - p) > 0.5), prm)
        self._update(x, w, weight * (p - y) * grad_factor, prm)
        return p, loss

    def fit_soft(self, x: Sequence[float], y1: float, prm: FtrlParams, weight: float = 1.0,
                 grad_factor: float = 1.0) -> tuple[float, float]:
        """ST02: soft label [1-y1, y1]; failure = class mismatch at 0.5."""
        m, w = self.margin(x, prm)
        p = sigmoid_py(m)
        loss = soft_cross_entropy_py(1.0 - y1, y1, m)
        if prm.adaptive:
            self.observe(int((1 if y1 >= 0.5 else 0) != (1 if p >= 0.5 else 0)), prm)
        self._update(x, w, weight * (p - y1) * grad_factor, prm)
        return p, loss


def evict(buf: dict, before: int) -> None:
    """Drop buffered rows older than ``before``; the buffer is filled in time order."""
    while buf and (old := next(iter(buf))) < before:
        del buf[old]


def _scan_partition(keys: list[str], prm: FtrlParams, max_delay: int | None,
                    soft: bool, emit_updates: bool, self_train: float | None = None):
    """Build the mapInPandas function: a fold over (keys, _time, _kind)-sorted events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None
        st: FtrlState | None = None
        buf: dict[int, list] = {}
        for pdf in batches:
            out = {k: [] for k in keys}
            out.update(kind=[], t=[], t_ref=[], prob=[], margin=[], loss=[], decay=[], level=[])
            kcols = [pdf[k].to_numpy() for k in keys]
            times = pdf["_time"].to_numpy()
            kinds = pdf["_kind"].to_numpy()
            trefs = pdf["_tref"].to_numpy()
            xs = pdf["x"].to_numpy()
            ys = pdf["y"].to_numpy()
            ws = pdf["w"].to_numpy() if "w" in pdf else None
            for i in range(len(pdf)):
                key = tuple(kc[i] for kc in kcols)
                if key != cur:
                    cur = key
                    st = None
                    buf = {}
                kind = int(kinds[i])
                tm = int(times[i])
                y = ys[i]
                has_y = y is not None and not (isinstance(y, float) and math.isnan(y))
                wt = 1.0 if ws is None or pd.isna(ws[i]) else float(ws[i])
                if kind == LABEL:
                    tr = int(trefs[i])
                    xb = buf.pop(tr, None)
                    if xb is None or not has_y:
                        continue
                    if st is None:
                        st = FtrlState(len(xb), prm)
                    marg = st.margin(xb, prm)[0]
                    p, loss = (st.fit_soft(xb, float(y), prm, wt) if soft
                               else st.fit(xb, float(y), prm, wt))
                    if not emit_updates:
                        continue
                    prob = p
                else:
                    x = xs[i]
                    x = [] if x is None else [0.0 if v is None else float(v) for v in x]
                    if st is None:
                        st = FtrlState(len(x), prm)
                    marg = st.margin(x, prm)[0]
                    if kind == FIT and not has_y and self_train is not None:
                        # self-training: fit on the thresholded own prediction
                        y_self = 0.0 if sigmoid_py(marg) < self_train else 1.0
                        prob, loss = st.fit(x, y_self, prm, wt)
                    elif kind == FIT and has_y:
                        prob, loss = (st.fit_soft(x, float(y), prm, wt) if soft
                                      else st.fit(x, float(y), prm, wt))
                    else:
                        prob, loss = sigmoid_py(marg), None
                        if kind == FEATURE:
                            buf[tm] = x
                            if max_delay is not None:
                                evict(buf, tm - max_delay)
                    tr = int(trefs[i])
                for k, kv in zip(keys, key):
                    out[k].append(kv)
                out["kind"].append(kind)
                out["t"].append(tm)
                out["t_ref"].append(tr)
                out["prob"].append(prob)
                out["margin"].append(marg)
                out["loss"].append(loss)
                out["decay"].append(st.decay)
                out["level"].append(st.level if (kind != FEATURE) else None)
            if out["t"]:
                yield pd.DataFrame(out)

    return run


def scan_events(events: DataFrame, keys: Sequence[str], prm: FtrlParams = FtrlParams(),
                max_delay: int | None = None, soft: bool = False,
                emit_updates: bool = False, self_train: float | None = None) -> DataFrame:
    """Fold an event table ``(keys, _time, _kind, _tref, x array<double>, y [, w])`` per stream.

    Returns one row per FEATURE/FIT event (and per applied LABEL event when
    ``emit_updates``): ``keys, kind, t, t_ref, prob, margin, loss, decay, level``
    (``margin`` = w.x with the weights before any update of that event).
    """
    keys = list(keys)
    kschema = schema_of(events, keys)
    schema = (f"{kschema}, kind int, t bigint, t_ref bigint, prob double, margin double, "
              f"loss double, decay double, level int")
    cols = [*keys, "_time", "_kind", "_tref", "x", "y"] + (["w"] if "w" in events.columns else [])
    ev = for_scan(events.select(*cols), keys, "_time", "_kind", "_tref")
    return ev.mapInPandas(_scan_partition(keys, prm, max_delay, soft, emit_updates, self_train), schema)


def _feature_events(rows: DataFrame, keys, t: str, x: str, kind: int, y: str | None,
                    weight: str | None = None) -> DataFrame:
    extra = [F.col(weight).cast("double").alias("w")] if weight else []
    return rows.select(*keys, F.col(t).cast("bigint").alias("_time"), F.lit(kind).alias("_kind"),
                       F.col(t).cast("bigint").alias("_tref"),
                       F.col(x).cast("array<double>").alias("x"),
                       (F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("y"),
                       *extra)


def online_learner(rows: DataFrame, keys: Sequence[str] = ("stream_id",), t: str = "t",
                   x: str = "x", y: str = "y", prm: FtrlParams = FtrlParams(),
                   soft: bool = False, weight: str | None = None) -> DataFrame:
    """ST01/ST02/ST04/ST13: immediate-label learner. Output ``keys, t, prob, pred, loss, decay, level``.

    NULL label rows are predicted without learning (ST04, ST09 hidden labels).
    """
    keys = list(keys)
    ev = _feature_events(rows, keys, t, x, FIT, y, weight)
    out = scan_events(ev, keys, prm, soft=soft)
    return out.select(*keys, "t", "prob", (F.col("prob") > prm.threshold).cast("int").alias("pred"),
                      "margin", "loss", "decay", "level")


def delayed_learner(rows: DataFrame, arrivals: DataFrame, keys: Sequence[str] = ("stream_id",),
                    t: str = "t", x: str = "x", prm: FtrlParams = FtrlParams(),
                    max_delay: int | None = None, soft: bool = False,
                    delay_compensation: float = 1.0) -> DataFrame:
    """ST07: at time t first apply labels arriving at t (J01: matched to the buffered
    features of ``t_orig``; dropped if that row is not buffered), then predict row t.
    ``delay_compensation`` multiplies the gradients of these late labels (ST03).

    ``arrivals``: ``keys, t_arrive, t_orig, y``.  Output ``keys, t, prob, pred``.
    """
    keys = list(keys)
    fe = _feature_events(rows, keys, t, x, FEATURE, None).withColumn("w", F.lit(None).cast("double"))
    le = arrivals.select(*keys, F.col("t_arrive").cast("bigint").alias("_time"),
                         F.lit(LABEL).alias("_kind"), F.col("t_orig").cast("bigint").alias("_tref"),
                         F.lit(None).cast("array<double>").alias("x"),
                         F.col("y").cast("double").alias("y"), F.lit(float(delay_compensation)).alias("w"))
    out = scan_events(fe.unionByName(le), keys, prm, max_delay=max_delay, soft=soft)
    return out.select(*keys, "t", "prob",
                      (F.col("prob") > prm.threshold).cast("int").alias("pred"))


def drift_levels(errs: DataFrame, keys: Sequence[str] = ("stream_id",), t: str = "t",
                 err: str = "err", prm: FtrlParams = FtrlParams()) -> DataFrame:
    """ST16 as its own operator over ``(keys, t, err)``: detector level per row (0/1/2)."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, st = None, None
        for pdf in batches:
            kc = [pdf[k].to_numpy() for k in keys]
            ts = pdf[t].to_numpy()
            es = pdf[err].to_numpy()
            lv, pm, sm = np.zeros(len(pdf), dtype=np.int32), np.zeros(len(pdf)), np.zeros(len(pdf))
            for i in range(len(pdf)):
                key = tuple(c[i] for c in kc)
                if key != cur:
                    cur, st = key, FtrlState(0, prm)
                st.observe(int(es[i]), prm)
                lv[i], (pm[i], sm[i]) = st.level, st.best
            res = pdf[[*keys, t]].copy()
            res["level"], res["p_min"], res["s_min"] = lv, pm, sm
            yield res

    kschema = schema_of(errs, [*keys, t])
    return (for_scan(errs.select(*keys, t, F.col(err).cast("int").alias(err)), keys, t)
            .mapInPandas(run, f"{kschema}, level int, p_min double, s_min double"))


def hedge_ensemble(rows: DataFrame, keys: Sequence[str] = ("stream_id",), t: str = "t",
                   x: str = "x", z: str = "z", y: str = "y", prm: FtrlParams = FtrlParams(),
                   eta: float = 0.001) -> DataFrame:
    """ST06 + W13: one learner per view; p = sigmoid(lam m_x + (1 - lam) m_z) with
    lam = softmax(-eta * cumulative loss) of the rows *before* t, m = w.x with the
    pre-update weights.  Both views are folded in one keyed ordered scan (two states
    per stream), so the upstream plan is read once and no join is needed.
    Output ``keys, t, lam, prob, pred, loss_x, loss_z``.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = None
        sx = sz = None
        lx = lz = 0.0
        for pdf in batches:
            kc = [pdf[k].to_numpy() for k in keys]
            out = {k: [] for k in keys}
            out.update({t: [], "lam": [], "prob": [], "loss_x": [], "loss_z": []})
            for i, (tm, xv, zv, yv) in enumerate(zip(pdf[t], pdf["_x"], pdf["_z"], pdf["_y"])):
                key = tuple(c[i] for c in kc)
                if key != cur:
                    cur, sx, sz, lx, lz = key, None, None, 0.0, 0.0
                xl = [0.0 if v is None else float(v) for v in xv]
                zl = [0.0 if v is None else float(v) for v in zv]
                if sx is None:
                    sx, sz = FtrlState(len(xl), prm), FtrlState(len(zl), prm)
                lam = 1.0 / (1.0 + math.exp(-eta * (lz - lx)))
                mx, mz = sx.margin(xl, prm)[0], sz.margin(zl, prm)[0]
                has_y = yv is not None and not (isinstance(yv, float) and math.isnan(yv))
                if has_y:
                    _, lox = sx.fit(xl, float(yv), prm)
                    _, loz = sz.fit(zl, float(yv), prm)
                    lx, lz = lx + lox, lz + loz
                else:
                    lox = loz = None
                for kk, kv in zip(keys, key):
                    out[kk].append(kv)
                out[t].append(int(tm))
                out["lam"].append(lam)
                out["prob"].append(sigmoid_py(lam * mx + (1 - lam) * mz))
                out["loss_x"].append(lox)
                out["loss_z"].append(loz)
            if out[t]:
                yield pd.DataFrame(out)

    ev = (rows.select(*keys, F.col(t).cast("bigint").alias(t), F.col(x).cast("array<double>").alias("_x"),
                      F.col(z).cast("array<double>").alias("_z"), F.col(y).cast("double").alias("_y"))
          )
    ev = for_scan(ev, keys, t)
    out = ev.mapInPandas(run, f"{schema_of(rows, keys)}, {t} bigint, lam double, prob double, "
                              f"loss_x double, loss_z double")
    return out.select(*keys, t, "lam", "prob", (F.col("prob") > prm.threshold).cast("int").alias("pred"),
                      "loss_x", "loss_z")


def fill_labels(df: DataFrame, y: str = "y_obs", pseudo: str = "pseudo",
                out: str = "y_fill") -> DataFrame:
    """Prefer the real label, else the pseudo-label, else none; ``label_source``."""
    return (df.withColumn(out, F.coalesce(F.col(y).cast("double"), F.col(pseudo).cast("double")))
            .withColumn("label_source", F.when(F.col(y).isNotNull(), "real")
                        .when(F.col(pseudo).isNotNull(), "pseudo").otherwise("none")))


def delayed_hedge_ensemble(rows: DataFrame, arrivals: DataFrame, keys: Sequence[str] = ("stream_id",),
                           t: str = "t", x: str = "x", z: str = "z", prm: FtrlParams = FtrlParams(),
                           eta: float = 0.001, max_delay: int | None = None) -> DataFrame:
    """ST08: two delayed learners (ST07 per view); lam at time t uses the losses of all
    label updates applied up to and including t (labels are applied before the
    prediction of t); p = sigmoid(lam m_x + (1 - lam) m_z) with the current weights.  Both views, their
    waiting rows and the two sums of losses are one ordered scan."""
    keys = list(keys)
    cast = lambda c: F.col(c).cast("array<double>")
    none = F.lit(None).cast("array<double>")
    fe = rows.select(*keys, F.col(t).cast("bigint").alias("_time"), F.lit(FEATURE).alias("_kind"), F.col(t).cast("bigint").alias("_tref"),
                     cast(x).alias("x"), cast(z).alias("z"), F.lit(None).cast("double").alias("y"))
    le = arrivals.select(*keys, F.col("t_arrive").cast("bigint").alias("_time"), F.lit(LABEL).alias("_kind"),
                         F.col("t_orig").cast("bigint").alias("_tref"), none.alias("x"), none.alias("z"), F.col("y").cast("double").alias("y"))
    ev = for_scan(fe.unionByName(le), keys, "_time", "_kind", "_tref")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, sx, sz, lx, lz, buf = None, None, None, 0.0, 0.0, {}
        for pdf in batches:
            out = {k: [] for k in keys}
            out.update({t: [], "lam": [], "prob": []})
            kc = [pdf[k].to_numpy() for k in keys]
            for i, (tm, kind, tref, xv, zv, yv) in enumerate(zip(pdf["_time"], pdf["_kind"], pdf["_tref"], pdf["x"], pdf["z"], pdf["y"])):
                key = tuple(c[i] for c in kc)
                if key != cur:
                    cur, sx, sz, lx, lz, buf = key, None, None, 0.0, 0.0, {}
                if kind == LABEL:
                    kept = buf.pop(int(tref), None)
                    if kept is not None and not pd.isna(yv):
                        lx += sx.fit(kept[0], float(yv), prm)[1]
                        lz += sz.fit(kept[1], float(yv), prm)[1]
                    continue
                xl, zl = ([0.0 if v is None or math.isnan(v) else float(v) for v in vec] for vec in (xv, zv))
                if sx is None:
                    sx, sz = FtrlState(len(xl), prm), FtrlState(len(zl), prm)
                lam = 1.0 / (1.0 + math.exp(-eta * (lz - lx)))
                for k, kv in zip(keys, key):
                    out[k].append(kv)
                out[t].append(int(tm))
                out["lam"].append(lam)
                out["prob"].append(sigmoid_py(lam * sx.margin(xl, prm)[0] + (1 - lam) * sz.margin(zl, prm)[0]))
                buf[int(tm)] = (xl, zl)
                if max_delay is not None:
                    evict(buf, int(tm) - max_delay)
            if out[t]:
                yield pd.DataFrame(out)

    got = ev.mapInPandas(run, f"{schema_of(rows, keys)}, {t} bigint, lam double, prob double")
    return got.withColumn("pred", (F.col("prob") > prm.threshold).cast("int"))


def _copy_state(st: FtrlState, prm: FtrlParams) -> FtrlState:
    c = FtrlState(st.p, prm)
    for k in FtrlState.__slots__:
        v = getattr(st, k)
        setattr(c, k, list(v) if isinstance(v, list) else v)
    return c


def speculative_learner(rows: DataFrame, arrivals: DataFrame, max_delay: int, keys: Sequence[str] = ("stream_id",),
                        t: str = "t", x: str = "x", spec: str = "spec", prm: FtrlParams = FtrlParams()) -> DataFrame:
    """ST14/ST15 for one view: delayed learner (ST07) plus, at every t, a throw-away copy of the
    committed state, trained on the soft pseudo-labels that row t carries for its predecessors
    (``spec``: array of struct(t, p), those of t - max_delay + 1 ... t - 1, nulls left out), which
    predicts t (``prob_spec``); ``prob_blend`` is by the 50/50 average of committed and speculative
    weights.  The copy never writes back; cost O(D p) per row.  Rows whose label is more than
    ``max_delay`` late are forgotten.

    The ordered scan only commits: it gives every row the state at its time and the predecessors that still
    wait for a label.  The copies need nothing of each other, so their rows are dealt out anew, whatever
    stream they are of, and a task trains all copies of a batch of rows at once, step by step."""
    keys = list(keys)
    fe = rows.select(*keys, F.col(t).cast("bigint").alias("_time"), F.lit(FEATURE).alias("_kind"),
                     F.col(t).cast("bigint").alias("_tref"), F.col(x).cast("array<double>").alias("x"),
                     F.lit(None).cast("double").alias("y"),
                     F.transform(spec, lambda s: s["t"].cast("bigint")).alias("st"), F.transform(spec, lambda s: s["p"].cast("double")).alias("sp"))
    le = arrivals.select(*keys, F.col("t_arrive").cast("bigint").alias("_time"), F.lit(LABEL).alias("_kind"),
                         F.col("t_orig").cast("bigint").alias("_tref"), F.lit(None).cast("array<double>").alias("x"),
                         F.col("y").cast("double").alias("y"), F.lit(None).cast("array<bigint>").alias("st"),
                         F.lit(None).cast("array<double>").alias("sp"))
    ev = for_scan(fe.unionByName(le), keys, "_time", "_kind", "_tref")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, st, buf = None, None, {}
        for pdf in batches:
            out = {k: [] for k in keys}
            out.update(t=[], x=[], state=[], counts=[], before=[], soft=[])
            kc = [pdf[k].to_numpy() for k in keys]
            for i, (tm, kind, tref, xv, yv, at, ps) in enumerate(zip(pdf["_time"], pdf["_kind"], pdf["_tref"], pdf["x"], pdf["y"],
                                                                     pdf["st"], pdf["sp"])):
                key = tuple(c[i] for c in kc)
                if key != cur:
                    cur, st, buf = key, None, {}
                if kind == LABEL:
                    b = buf.pop(int(tref), None)
                    if b is not None and not pd.isna(yv):
                        st.fit(b, float(yv), prm)
                    continue
                xl = [float(v) for v in xv]
                if st is None:
                    st = FtrlState(len(xl), prm)
                todo = [(buf[int(k)], float(q)) for k, q in sorted(zip(at if at is not None else [], ps if ps is not None else []))
                        if not pd.isna(q) and int(tm) - max_delay < k < int(tm) and int(k) in buf]
                for kk, kv in zip(keys, key):
                    out[kk].append(kv)
                out["t"].append(int(tm))
                out["x"].append(xl)
                out["state"].append([*st.v, *st.h, *st.z, st.r, st.decay, *st.best])
                out["counts"].append([*st.counts, *st.warned])
                out["before"].append([v for b, _ in todo for v in b])
                out["soft"].append([q for _, q in todo])
                buf[int(tm)] = xl
                evict(buf, int(tm) - max_delay)
            if out["t"]:
                yield pd.DataFrame(out)

    def speculate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, same in pdf.groupby(pdf["x"].map(len)) if len(pdf) else ():
                out = same[[*keys, "t"]].copy()
                out["prob"], out["prob_spec"], out["prob_blend"] = speculated(same, int(p), prm)
                yield out

    kschema = schema_of(rows, keys)
    committed = ev.mapInPandas(commit, f"{kschema}, t bigint, x array<double>, state array<double>, counts array<bigint>, "
                                       "before array<double>, soft array<double>")
    # dealt out by row, not by stream; by a key, so that a task that runs again gets the same rows
    return by_key(committed, [*keys, "t"]).mapInPandas(speculate, f"{kschema}, t bigint, prob double, prob_spec double, prob_blend double")


def speculated(pdf: pd.DataFrame, p: int, prm: FtrlParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prob, prob_spec, prob_blend) of rows with ``p`` features: soft-label steps (ST02) of all copies side by side."""
    state, counts = np.array(pdf["state"].tolist()), np.array(pdf["counts"].tolist(), dtype=np.int64)
    x = np.array(pdf["x"].tolist())
    v, h, z = state[:, :p].copy(), state[:, p:2 * p].copy(), state[:, 2 * p:3 * p].copy()
    r, best = state[:, 3 * p].copy(), state[:, 3 * p + 2:].copy()
    seen, warned = counts[:, :2].copy(), counts[:, 2:].copy()

    def weights(z, r):
        return np.where(np.abs(z) > prm.l1, -(z - prm.l1 * np.sign(z)) / (prm.l2 + prm.lp * r)[:, None], 0.0)

    def sigmoid(m):
        return 1.0 / (1.0 + np.exp(-m))

    committed = weights(z, r)
    steps = pdf["soft"].map(len).to_numpy()
    for k in range(int(steps.max(initial=0))):
        at = np.flatnonzero(steps > k)
        xs = np.array([np.asarray(b[k * p:(k + 1) * p], dtype=float) for b in pdf["before"].iloc[at]])
        q = np.array([s[k] for s in pdf["soft"].iloc[at]])
        w = weights(z[at], r[at])
        prob = sigmoid((w * xs).sum(axis=1))
        decay = state[at, 3 * p + 1]
        if prm.adaptive:
            wrong = ((q >= 0.5) != (prob >= 0.5)).astype(np.int64)
            decay = np.array([decay_py(int(c) + 1, prm.decay_choice) for c in seen[at, 0]])
            now = seen[at] + np.stack([np.ones_like(wrong), wrong], axis=1)
            active = now[:, 0] > prm.warmup
            rate = now[:, 1] / now[:, 0]
            spread = np.sqrt(rate * (1 - rate) / now[:, 0])
            share = prm.contribute_error_rate
            decay = np.where(active, decay * (1.0 - share) + share * rate, decay)
            lower = active & (rate + spread < best[at].sum(axis=1))
            least = np.where(lower[:, None], np.stack([rate, spread], axis=1), best[at])
            level = (rate + spread >= least[:, 0] + 2 * least[:, 1]).astype(int) + (rate + spread > least[:, 0] + 3 * least[:, 1])
            warn = np.where((level > 0)[:, None], warned[at] + np.stack([np.ones_like(wrong), wrong], axis=1), 0)
            drift = active & (level == 2)
            seen[at] = np.where(drift[:, None], warn, now)
            warned[at] = np.where(active[:, None], warn, warned[at])
            best[at] = np.where(drift[:, None], NO_BEST, least)
            state[at, 3 * p + 1] = decay
        v[at] += (prob - q)[:, None] * xs
        h[at] = decay[:, None] * h[at] + w
        z[at] = v[at] - prm.lp * h[at]
        r[at] = 1.0 + decay * r[at]
    copy = weights(z, r)
    return tuple(sigmoid((w * x).sum(axis=1)) for w in (committed, copy, 0.5 * committed + 0.5 * copy))


def carried_class_matrix(s_table: DataFrame, keys: Sequence[str] = ("stream_id",), win: str = "win",
                         k: int = 2) -> DataFrame:
    """ST22: M_w = row-normalise(M_{w-1} + S_w) when window w had a correctly classified
    labelled row (``n_ok`` > 0), else M_{w-1}; M starts at 1/K.  ``s_table``: keys, win,
    n_ok, s (flattened K x K sums of probability rows per true class)."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, m = None, None
        for pdf in batches:
            res = []
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, kk) for kk in keys)
                if key != cur:
                    cur, m = key, np.full((k, k), 1.0 / k)
                if r.n_ok and r.n_ok > 0:
                    m = m + np.asarray(r.s, dtype=float).reshape(k, k)
                    m = m / m.sum(axis=1, keepdims=True)
                res.append((*key, getattr(r, win), m.ravel().tolist()))
            yield pd.DataFrame(res, columns=[*keys, win, "m"])

    return (for_scan(s_table, keys, win)
            .mapInPandas(run, f"{schema_of(s_table, [*keys, win])}, m array<double>"))
