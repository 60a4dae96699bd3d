"""Scans of whole keys against the forms for keys of any length, and against what they avoid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laggard.operators import corrupt
from laggard.operators import window_ranks as wr
from laggard.operators.whole import by_length, whole_keys


def cells(spark):
    """Streams of 1 to 300 rows, some cells missing, one stream of single cells that no draw can leave a cell each."""
    rng = np.random.default_rng(8)
    rows = [(s, t, c, float(rng.integers(0, 9)) if c else float(rng.normal()))
            for s, n in ((1, 300), (2, 40), (3, 1), (4, 90)) for t in range(n) for c in range(4) if rng.random() < 0.8]
    return spark.createDataFrame(rows + [(5, t, 0, 1.0) for t in range(20)], "stream_id long, t long, col int, v double").repartition(3)


def rows_of(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_by_length(spark):
    c = cells(spark).unionByName(spark.createDataFrame([(None, 1, 0, 1.0)], "stream_id long, t long, col int, v double"))
    short, long, lost = by_length(c, ["stream_id"], 100)
    assert {r.stream_id for r in long.select("stream_id").distinct().collect()} == {1, 2, 4}
    assert {r.stream_id for r in short.select("stream_id").distinct().collect()} == {3, 5}
    assert [r.stream_id for r in lost.collect()] == [None]
    assert by_length(c, ["stream_id"])[1] is None


def test_whole_keys_cuts_between_keys(spark):
    table = spark.createDataFrame([(i // 7, i) for i in range(100)], "k long, i long").toArrow()
    for least in (1, 5, 8, 1000):
        got = list(whole_keys(iter(table.to_batches(max_chunksize=3)), ["k"], least))
        keys = [set(t.column("k").to_pylist()) for t in got]
        assert sum(len(k) for k in keys) == len(set.union(*keys)) == 15
        assert [i for t in got for i in t.column("i").to_pylist()] == list(range(100))


@pytest.mark.parametrize("fraction", [0.2, 1.0])
def test_masks_equal_those_by_histogram(spark, fraction):
    """With several draws, cells that are there twice, and a stream without a key."""
    c = cells(spark)
    c = c.unionByName(c.where("stream_id = 2 AND t < 9")).unionByName(spark.createDataFrame([(None, 1, 0, 1.0)], "stream_id long, t long, col int, v double"))
    got, want = (rows_of(corrupt.mask_cells(c, fraction, 100, max_retries=9, whole=n)) for n in (1 << 18, 0))
    assert got == want
    assert len(got) == c.count()


@pytest.mark.parametrize(("w", "side"), [(10, 8), (1000, 16)])
def test_window_counts_equal_those_by_squares(spark, w, side):
    c = cells(spark)
    assert rows_of(wr.window_counts(c, w, side=side)) == rows_of(wr.window_counts(c, w, side=side, whole=50))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_keys_are_sent_once(spark):
    """No join back and no window over rows: one exchange from the cells to the result."""
    c = cells(spark).coalesce(2).checkpoint()
    for d in (wr.window_counts(c, 30), corrupt.mask_cells(c, 0.2, 100)):
        assert plan(d.select("stream_id", F.lit(1))).count("Exchange") == 1
