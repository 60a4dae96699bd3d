"""Soft-label fusion and calibration (F10-F19, T02) as array column expressions.

Soft labels are ``array<double>`` of length K (``num_classes``, fixed when the
plan is built).  Every function is unrolled over the K elements into plain
scalar arithmetic (``element_at``), so it compiles into whole-stage codegen;
higher-order array functions would run interpreted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _el(v: Column, k: int) -> list[Column]:
    return [F.element_at(v, i + 1) for i in range(k)]


def _sum(xs: list[Column]) -> Column:
    out = F.lit(0.0)
    for x in xs:
        out = out + x
    return out


def _max(xs: list[Column]) -> Column:
    return xs[0] if len(xs) == 1 else F.greatest(*xs)


def _mix(v1: Column, v2: Column, w1: Column, w2: Column, k: int) -> list[Column]:
    return [w1 * a + w2 * b for a, b in zip(_el(v1, k), _el(v2, k))]


def _normalise(xs: list[Column]) -> Column:
    s = _sum(xs)
    return F.array(*[x / s for x in xs])


def entropy(v, k: int = 2) -> Column:
    """-sum p log(p + 1e-10)."""
    return -_sum([x * F.log(x + EPS) for x in _el(_c(v), k)])


def clipped_entropy(v, k: int = 2) -> Column:
    """-sum q log q with q = clip(p, 1e-10, 1)."""
    qs = [F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0)) for x in _el(_c(v), k)]
    return -_sum([q * F.log(q) for q in qs])


def argmax(v, k: int = 2) -> Column:
    """Index of the first maximum."""
    xs = _el(_c(v), k)
    m = _max(xs)
    out = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        out = F.when(xs[i] == m, F.lit(i)).otherwise(out)
    return out


def fixed(v1, v2, w1: float = 0.5, w2: float = 0.5, k: int = 2) -> Column:
    """normalised fixed view weights."""
    s = w1 + w2
    a, b = (w1 / s, w2 / s) if s > 0 else (0.5, 0.5)
    return F.array(*_mix(_c(v1), _c(v2), F.lit(a), F.lit(b), k))


def confidence(v1, v2, k: int = 2) -> Column:
    """weights proportional to each view's max probability."""
    v1, v2 = _c(v1), _c(v2)
    c1, c2 = _max(_el(v1, k)), _max(_el(v2, k))
    tot = c1 + c2
    w1 = F.when(tot > 0, c1 / tot).otherwise(F.lit(0.5))
    w2 = F.when(tot > 0, c2 / tot).otherwise(F.lit(0.5))
    return F.array(*_mix(v1, v2, w1, w2, k))


def weighted_confidence(v1, v2, k: int = 2, parts=(0.6, 0.3, 0.1), bonus=(0.2, -0.1), clip=(0.1, 0.9)) -> Column:
    """F11 (weighted form): each view's weight is ``parts`` of its share of confidence (F11), of its share by entropy (F12) and of
    0.5 plus or minus a bonus (view 1's when the views agree, view 2's when they do not), clipped and renormalised."""
    v1, v2 = _c(v1), _c(v2)
    c1, c2 = _max(_el(v1, k)), _max(_el(v2, k))
    h1, h2 = entropy(v1, k), entropy(v2, k)

    def share(a, b):
        return F.when(a + b > 0, a / (a + b)).otherwise(F.lit(0.5))

    def by_entropy(own, other):
        return F.when(h1 + h2 > 0, share(1 - own / (h1 + h2), 1 - other / (h1 + h2))).otherwise(F.lit(0.5))

    extra = F.when(argmax(v1, k) == argmax(v2, k), F.lit(bonus[0])).otherwise(F.lit(bonus[1]))
    w1 = parts[0] * share(c1, c2) + parts[1] * by_entropy(h1, h2) + parts[2] * (0.5 + extra)
    w2 = parts[0] * share(c2, c1) + parts[1] * by_entropy(h2, h1) + parts[2] * (0.5 - extra)
    w1, w2 = (F.least(F.greatest(w, F.lit(clip[0])), F.lit(clip[1])) for w in (w1, w2))
    return F.array(*_mix(v1, v2, w1 / (w1 + w2), w2 / (w1 + w2), k))


def fuse_rows(view1: DataFrame, view2: DataFrame, keys, method=None, v: str = "v", out: str = "v") -> DataFrame:
    """Rows of two views by their keys; those of both are fused by ``method`` (F11 if none is given), those of one stay."""
    both = view1.select(*keys, F.col(v).alias("_v1")).join(view2.select(*keys, F.col(v).alias("_v2")), list(keys), "full")
    fused = (method or confidence)("_v1", "_v2")
    return both.select(*keys, F.when(F.col("_v1").isNull(), F.col("_v2")).when(F.col("_v2").isNull(), F.col("_v1")).otherwise(fused).alias(out))


def entropy_weighted(v1, v2, k: int = 2) -> Column:
    """weights proportional to 1 - H_i / (H_1 + H_2), renormalised."""
    v1, v2 = _c(v1), _c(v2)
    h1, h2 = entropy(v1, k), entropy(v2, k)
    tot = h1 + h2
    a, b = 1 - h1 / tot, 1 - h2 / tot
    ws = a + b
    ok = (tot > 0) & (ws > 0)
    return F.array(*_mix(v1, v2, F.when(ok, a / ws).otherwise(F.lit(0.5)),
                         F.when(ok, b / ws).otherwise(F.lit(0.5)), k))


def agreement(v1, v2, k: int = 2) -> Column:
    """same arg-max -> mean; otherwise the more confident view (view 2 on ties)."""
    v1, v2 = _c(v1), _c(v2)
    mean = F.array(*_mix(v1, v2, F.lit(0.5), F.lit(0.5), k))
    pick = F.when(_max(_el(v1, k)) > _max(_el(v2, k)), v1).otherwise(v2)
    return F.when(argmax(v1, k) == argmax(v2, k), mean).otherwise(pick)


def view_quality(v1, v2, q1, q2, k: int = 2) -> Column:
    """weights proportional to each view's quality."""
    v1, v2, q1, q2 = _c(v1), _c(v2), _c(q1), _c(q2)
    tot = q1 + q2
    return F.array(*_mix(v1, v2, F.when(tot > 0, q1 / tot).otherwise(F.lit(0.5)),
                         F.when(tot > 0, q2 / tot).otherwise(F.lit(0.5)), k))


def three_vector(self_v, class_v, parent_v=None, temperature: float = 2.0, k: int = 2) -> Column:
    """weights proportional to exp(-temperature * H) over 2 or 3 vectors, renormalised;
    a NULL ``parent_v`` falls back to the two-vector form."""
    s, c = _c(self_v), _c(class_v)
    r1 = F.exp(-clipped_entropy(s, k) * temperature)
    r2 = F.exp(-clipped_entropy(c, k) * temperature)
    two = _normalise(_mix(s, c, r1 / (r1 + r2), r2 / (r1 + r2), k))
    if parent_v is None:
        return two
    p = _c(parent_v)
    r3 = F.exp(-clipped_entropy(p, k) * temperature)
    tot = r1 + r2 + r3
    three = [a + (r3 / tot) * b for a, b in zip(_mix(s, c, r1 / tot, r2 / tot, k), _el(p, k))]
    return F.when(p.isNull(), two).otherwise(_normalise(three))


def calibrate(current, class_row, k: int = 2) -> Column:
    """F16 (calibrated form): alpha = 0.7 when max(current) < 0.7 else 0.3;
    normalise(alpha * class_row + (1 - alpha) * current)."""
    cur, cls = _c(current), _c(class_row)
    alpha = F.when(_max(_el(cur, k)) < 0.7, F.lit(0.7)).otherwise(F.lit(0.3))
    return _normalise(_mix(cls, cur, alpha, 1 - alpha, k))


def geometric(source, target, distance, forward: bool = True, k: int = 2) -> Column:
    """alpha = clip(a e^{-d/2} + b min(conf, 0.8), 0.2, 0.8), (a, b) = (0.7, 0.3)
    forward or (0.5, 0.5) backward; normalise(alpha src + (1 - alpha) target)."""
    src, tgt, d = _c(source), _c(target), _c(distance)
    a, b = (0.7, 0.3) if forward else (0.5, 0.5)
    alpha = a * F.exp(-d / 2.0) + b * F.least(_max(_el(tgt, k)), F.lit(0.8))
    alpha = F.least(F.greatest(alpha, F.lit(0.2)), F.lit(0.8))
    return _normalise(_mix(src, tgt, alpha, 1 - alpha, k))


def parent_quality(v, k: int = 2) -> Column:
    """min(1, 0.7 max + 0.3 (1 - H / ln K))."""
    v = _c(v)
    return F.least(F.lit(1.0), 0.7 * _max(_el(v, k)) + 0.3 * (1.0 - entropy(v, k) / math.log(k)))


def time_penalised(d, dt, decay_strength: float, n) -> Column:
    """d * exp(beta |dt|), beta = decay_strength / N (0 for N <= 1)."""
    n = _c(n)
    beta = F.when(n > 1, F.lit(decay_strength) / n).otherwise(F.lit(0.0))
    return _c(d) * F.exp(beta * F.abs(_c(dt)))


def binary(p1) -> Column:
    """[1 - p, p] soft label of a probability."""
    p1 = _c(p1)
    return F.array(1 - p1, p1)
