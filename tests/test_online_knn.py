"""Online K-NN against a plain loop over windows and rounds."""

import numpy as np
import pytest

from laggard.operators.density import peaks, propagation_rounds
from laggard.operators.online_knn import online_knn


def windows(seed, n=60, size=12, hop=3, delay=4):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, 2)).round(1), rng.integers(0, 2, n)
    hidden = rng.random(n) < 0.5
    out = []
    for e in range(hop - 1, n, hop):
        ts = np.arange(max(0, e - size + 1), e + 1)
        known = (ts <= e - delay) & ~hidden[ts]
        rounds = propagation_rounds(peaks(x[ts], 5.0)["parent"], known)
        out += [(1, e, int(t), x[t].tolist(), int(y[t]) if k else None, int(r)) for t, k, r in zip(ts, known, rounds, strict=True)]
    return out


def plain(rows, k, capacity):
    memory, done, out = [], {}, []
    for _, w, t, x, y, r in sorted(rows, key=lambda q: (q[1], q[5], q[2])):
        if r < 0 or (t in done and (done[t] == "label" or y is None)):
            continue
        if y is not None:
            label = p = float(y)
        elif memory:
            near = sorted(range(len(memory)), key=lambda i: (((np.array(memory[i][1]) - x) ** 2).sum() ** 0.5, i))[:k]
            d = [((np.array(memory[i][1]) - x) ** 2).sum() ** 0.5 for i in near]
            weights = [float(v == 0) for v in d] if 0 in d else [1 / v for v in d]
            p = sum(a for a, i in zip(weights, near, strict=True) if memory[i][2] == 1) / sum(weights)
            label = float(p > 0.5)
        else:
            p, label = 0.5, 0.0
        at = [i for i, m in enumerate(memory) if m[0] == t]
        if at:
            memory[at[0]] = (t, x, label)
        else:
            memory = (memory + [(t, x, label)])[-capacity:]
        done[t] = "label" if y is not None else "vote"
        out.append((w, t, label, p, y is None))
    return out


@pytest.mark.parametrize(("k", "capacity"), [(3, 256), (1, 5), (4, 12)])
def test_online_knn(spark, k, capacity):
    rows = windows(2)
    other = [(2, *r[1:]) for r in windows(3)]
    df = spark.createDataFrame(rows + other, "stream_id long, win long, t long, x array<double>, y_obs int, round int").repartition(4)
    got = online_knn(df, k, capacity).collect()
    for s, want in ((1, plain(rows, k, capacity)), (2, plain(other, k, capacity))):
        mine = {(r.win, r.t): (r.label, pytest.approx(r.p1), r.voted) for r in got if r.stream_id == s}
        assert len(mine) == len(want) and all(mine[w, t] == (label, p, v) for w, t, label, p, v in want)
    assert online_knn(df.where("false")).count() == 0
