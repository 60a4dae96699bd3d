"""Small-scale stand-in for the driver's gate: a selection of queries vs DuckDB at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF

TABLES = "events lineitem embeddings documents labels".split()
PICK = ["m0_delayed_errors", "k01_pair_mask", "w04_cont_latent", "a23_a25_w11_scorecard",
        "st06_w13_hedge_ensemble", "b04_density_peaks", "f10_f19_fusion", "b01_estep_p2"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


@pytest.mark.parametrize("name", PICK)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cols = df.columns
    mine = sorted("|".join(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    oc = [d[0] for d in res.description]
    theirs = sorted("|".join(_norm(r[oc.index(c)]) for c in sorted(oc)) for r in res.fetchall())
    assert sorted(cols) == sorted(oc)
    assert mine == theirs


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "prob" in df.columns
