"""B10, online K-NN: self-training in structure order with a bounded memory of neighbours.

A stream's windows come one after another.  In a window the rows that its graph has reached come in the order of
their rounds (B06) and of time.  A row whose label has arrived goes into the memory with that label; any other is voted
on by its nearest rows there (T03) and goes in with the vote.  A row is voted on once, in the first window that
reaches it; a label that arrives later replaces its vote.  The memory holds the ``capacity`` rows that went in
last.  One ordered scan by stream; state per stream is the memory and which of a
window's rows have been voted on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laggard.operators.density import nearest_share
from laggard.operators.learner import by_key, schema_of


class Neighbours:
    """The last rows that went in, by their time, in order of entry."""

    def __init__(self, capacity: int):
        self.capacity, self.rows = capacity, {}

    def put(self, t: int, x: np.ndarray, label: float) -> None:
        """A new row, or another label for one that is there."""
        if t in self.rows:
            self.rows[t] = (x, label)
            return
        self.rows[t] = (x, label)
        if len(self.rows) > self.capacity:
            del self.rows[next(iter(self.rows))]

    def share(self, x: np.ndarray, k: int) -> float:
        """Share of class 1 among the nearest; 0.5 while there are none.  Of equally near rows the one that went in first counts."""
        if not self.rows:
            return 0.5
        xs, labels = np.array([r[0] for r in self.rows.values()]), np.array([r[1] for r in self.rows.values()])
        return nearest_share(np.sqrt(((xs - x) ** 2).sum(axis=1)), np.arange(len(xs)), labels, k)


def online_knn(rows: DataFrame, k: int = 3, capacity: int = 256, keys: Sequence[str] = ("stream_id",), win: str = "win", t: str = "t", x: str = "x",
               y: str = "y_obs", round_: str = "round") -> DataFrame:
    """``keys, win, t, label, p1, voted`` for every row, once when it is first reached and again if its label arrives after a vote.  ``rows`` holds a row for
    each (window, member) with its round (-1: not reached) and the label as far as the window knows it."""
    keys = list(keys)
    first = rows.groupBy(*keys, win).agg(F.min(t).alias("_from"))
    ev = rows.where(f"{round_} >= 0").select(*keys, win, round_, t, x, y).join(first, [*keys, win])
    ev = by_key(ev, keys).sortWithinPartitions(*keys, win, round_, t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, start, memory, voted = None, None, Neighbours(capacity), {}
        for pdf in batches:
            out = []
            for key, w, tm, xv, yv, lo in zip(pdf[keys].itertuples(index=False, name=None), pdf[win], pdf[t], pdf[x], pdf[y], pdf["_from"]):
                if key != cur:
                    cur, start, memory, voted = key, None, Neighbours(capacity), {}
                if lo != start:  # rows before a window's start never come again
                    start, voted = lo, {s: v for s, v in voted.items() if s >= lo}
                known = not pd.isna(yv)
                if tm in voted and not (voted[tm] and known):
                    continue
                point = np.asarray(xv, dtype=float)
                p = float(yv) if known else memory.share(point, k)
                label = float(p > 0.5)
                memory.put(int(tm), point, label)
                voted[tm] = not known
                out.append((*key, w, tm, label, p, not known))
            if out:
                yield pd.DataFrame(out, columns=[*keys, win, t, "label", "p1", "voted"])

    return ev.mapInPandas(run, f"{schema_of(rows, [*keys, win, t])}, label double, p1 double, voted boolean")
