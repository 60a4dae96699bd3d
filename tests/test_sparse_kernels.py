"""J10 on sparse maps against plain sums over pairs."""

import math

import numpy as np
import pytest

from laggard.operators import maps


def rows_of(seed=1):
    rng = np.random.default_rng(seed)
    rows = {i: {int(k): float(rng.integers(1, 9)) for k in rng.choice(12, rng.integers(1, 7), replace=False)} for i in range(40)}
    rows[40] = {k: 1.0 for k in range(12)}
    rows[41] = {99: 3.0, 3: 0.0}
    return rows


@pytest.mark.parametrize("carried", [64, 4, 0])
def test_pairs_equal_plain_sums(spark, monkeypatch, carried):
    monkeypatch.setattr(maps, "CARRIED", carried)
    rows, sigma, least = rows_of(), 5.0, 0.3
    entries = [(i, k, v) for i, m in rows.items() for k, v in m.items()] + [(None, 1, 2.0), (None, 2, 2.0), (7, None, 2.0), (8, 5, None)]
    df = spark.createDataFrame([e for e in entries if e[:2] != (8, 5) or e[2] is None], "id long, k long, v double")
    rows[8].pop(5, None)
    sq = {i: sum(v * v for v in m.values()) + (4.0 if i == 7 else 0.0) for i, m in rows.items()}
    want = {}
    for i in rows:
        for j in rows:
            both = [k for k in rows[i] if k in rows[j] and rows[i][k] and rows[j][k]]
            dot = sum(rows[i][k] * rows[j][k] for k in both)
            rbf = math.exp(-max(sq[i] + sq[j] - 2 * dot, 0) / (2 * sigma * sigma))
            if i < j and both and rbf >= least:
                want[i, j] = (dot, pytest.approx(rbf))
    assert {(r.a, r.b): (r.dot, r.rbf) for r in maps.sparse_pairs(df, sigma, least).collect()} == want
    assert maps.sparse_pairs(df, sigma, least).count() == len(want)
    got = {r.id: r for r in maps.sparse_kernel_summaries(df, sigma, least).collect()}
    for i in rows:
        mine = [w for p, w in want.items() if i in p]
        assert got[i].n_near == len(mine) and got[i].lin_max == max((d for d, _ in mine), default=None)


def test_repeated_keys_multiply_out(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 5, 3.0), (2, 5, 4.0), (2, 6, 1.0)], "id long, k long, v double")
    assert [(r.a, r.b, r.dot) for r in maps.sparse_pairs(df, 9.0).collect()] == [(1, 2, 20.0)]


def test_no_pair_is_shuffled(spark):
    """One exchange for each side of the join by key; nothing is grouped by pair."""
    df = spark.createDataFrame([(i, k, 1.0) for i in range(9) for k in range(i % 3 + 1)], "id long, k long, v double")
    plan = maps.sparse_pairs(df, 9.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan
