"""Positions looked up in blocks, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laggard.operators import marginals
from laggard.plans import m2
from tests.conftest import SF


def cells_of(spark, groups):
    return spark.createDataFrame([(s, i, 0, float(v)) for s, vs in groups.items() for i, v in enumerate(vs)], "stream_id long, t long, col int, v double")


@pytest.mark.parametrize("block,few", [(1, False), (2, False), (7, False), (7, True), (1 << 16, False)])
def test_quantiles_over_blocks_equal_numpy(spark, monkeypatch, block, few):
    monkeypatch.setattr(marginals, "POSITION_BLOCK", block)
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=41), 1: np.repeat([1.0, 5.0, 6.0], [14, 1, 7]), 2: [3.0], 3: np.arange(22.0)}
    qs = [*np.linspace(0, 1, 43), 0.5, 0.5, None]
    asked = spark.createDataFrame([(s, i, 0, None if q is None else float(q), f"{s}-{i}") for s in [*groups, 9] for i, q in enumerate(qs)],
                                  "stream_id long, t long, col int, q double, name string")
    got = {r.name: r for r in marginals.quantile_lookup(asked, cells_of(spark, groups), "q", few=few).collect()}
    assert len(got) == len(groups) * len(qs)                       # a group without cells has no quantiles
    for s, vs in groups.items():
        for i, q in enumerate(qs):
            want = None if q is None else np.quantile(vs, q)
            assert got[f"{s}-{i}"].x_imp == (want if want is None else pytest.approx(want, abs=1e-12)) and got[f"{s}-{i}"].t == i


def test_w08_and_medians_over_blocks_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(marginals, "POSITION_BLOCK", 5)
    rng = np.random.default_rng(4)
    rows = [(s, t, c, None if rng.random() < 0.4 else float(np.round(rng.normal() * 3)), float(rng.random())) for s in range(3) for t in range(50) for c in range(2)]
    wide = spark.createDataFrame(rows, "stream_id long, t long, col int, v double, q double")
    filled, medians = marginals.impute_with_medians(wide, wide.where("v IS NOT NULL"), {0: "cont", 1: "ord"}, "q")
    got, med = {(r.stream_id, r.t, r.col): r for r in filled.collect()}, {(r.stream_id, r.col): r.med for r in medians.collect()}
    assert len(got) == len(rows)
    for s, t, c, v, q in rows:
        seen = np.sort([r[3] for r in rows if (r[0], r[2]) == (s, c) and r[3] is not None])
        n = len(seen)
        want = v if v is not None else np.quantile(seen, q) if c == 0 else seen[int(np.clip(np.ceil(np.round((n + 1) * q - 1, 3)), 0, n - 1))]
        assert got[s, t, c].x_imp == pytest.approx(want, abs=1e-12) and got[s, t, c].q == q and med[s, c] == pytest.approx(np.median(seen))


def test_queries_are_sent_once(spark):
    """The ranks and the count of a group are joined, the two neighbours are not."""
    cells = cells_of(spark, {0: range(9)})
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    ranks = joins(marginals.value_ranks(cells, marginals.GROUP, "v"))
    assert joins(marginals.quantile_lookup(cells.withColumn("q", F.lit(0.3)), cells, "q")) <= ranks + 1


def test_errors_by_kind_rank_the_cells_once(spark, monkeypatch):
    calls, ranks = [], marginals.value_ranks
    monkeypatch.setattr(marginals, "value_ranks", lambda *a, **k: (calls.append(a), ranks(*a, **k))[1])
    assert m2.a05_smae_by_kind(spark, SF).count() and len(calls) == 1
