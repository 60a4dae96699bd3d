"""P08 in one scan against brute force."""

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from laggard.operators.prep import binarise_random


def test_cutoffs_in_one_scan(spark):
    """Cells were joined to their ranks and again to their cut-off."""
    rng, rows = np.random.default_rng(4), []
    for s, n in ((1, 1), (2, 30), (3, 400), (None, 6)):
        rows += [(s, t, c, None if rng.random() < 0.1 else float(rng.integers(12))) for t in range(n) for c in (0, 1)]
    rows += [(4, t, 0, 1.0) for t in range(20)]                       # no value qualifies
    df = spark.createDataFrame(rows, "stream_id long, t long, col int, v double").repartition(6)
    d = binarise_random(df, seed=11)
    short = binarise_random(df.where("stream_id IS NOT NULL"), seed=11)._jdf.queryExecution().optimizedPlan().toString()
    assert short.count("RepartitionByExpression") == 1 and "Join" not in short
    got = {(r.stream_id, r.t, r.col): (r.cutoff, r.v_bin) for r in d.collect()}
    assert len(got) == len(rows)
    for key in {(r[0], r[2]) for r in rows}:
        own = [(r[1], r[3]) for r in rows if (r[0], r[2]) == key]
        known = [v for _, v in own if v is not None]
        share = lambda v: sum(x < v for x in known)
        fit = [(int(md5(f"11#{key[0]}#{key[1]}#{t}".encode()).hexdigest()[:8], 16), t, v) for t, v in own
               if v is not None and 0.1 * len(known) < share(v) < 0.9 * len(known)] if key[0] is not None else []
        cut = min(fit)[2] if fit else None
        for t, v in own:
            assert got[key[0], t, key[1]] == (cut, None if cut is None or v is None else int(v > cut))
