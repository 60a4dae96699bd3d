"""Rounds by pointer doubling against the rounds themselves."""

import numpy as np
import pytest

from laggard.operators.density import propagation_rounds
from laggard.operators.forest import forest_rounds, round_sets


def forest(n, kind, seed):
    rng = np.random.default_rng(seed)
    if kind == "chain":
        return np.maximum(np.arange(n) - 1, 0)
    if kind == "star":
        return np.zeros(n, dtype=int)
    parent = np.array([int(rng.integers(max(0, i - 6), i)) if i else 0 for i in range(n)])
    roots = rng.random(n) < 0.03
    return np.where(roots, np.arange(n), parent)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5])
def test_rounds(spark, share):
    cases = {(s, w): forest(n, kind, s) for s, (n, kind) in enumerate([(1, "chain"), (2, "chain"), (70, "chain"), (50, "star"), (200, "deep"), (33, "deep")]) for w in (0, 7)}
    rng = np.random.default_rng(8)
    known = {k: rng.random(len(p)) < share for k, p in cases.items()}
    known[2, 0][:] = False
    known[2, 0][[40, 69]] = share > 0
    rows = [(s, w, 10 + t, 10 + int(q)) for (s, w), p in cases.items() for t, q in enumerate(p)]
    labels = [(s, w, 10 + int(t)) for (s, w), k in known.items() for t in np.flatnonzero(k) for _ in range(2)]
    df = spark.createDataFrame(rows, "stream_id long, win long, t long, parent_t long").repartition(3)
    lab = spark.createDataFrame(labels, "stream_id long, win long, t long")
    rounds = forest_rounds(df, lab).checkpoint()
    got = {(r.stream_id, r.win, r.t): r.round for r in rounds.collect()}
    assert len(got) == len(rows)
    for (s, w), p in cases.items():
        want = propagation_rounds(p, known[s, w])
        assert [got[s, w, 10 + t] for t in range(len(p))] == want.tolist(), (s, w)
        sets = {r["round"]: (r.n_frontier, r.n_union) for r in round_sets(rounds).where(f"stream_id = {s} AND win = {w}").collect()} if w == 7 else None
        if sets is not None:
            assert sets == {int(k): (int((want == k).sum()), int(((want >= 0) & (want <= k)).sum())) for k in set(want.tolist()) - {-1}}
