"""The live learner's calls to its state, which go through a socket each."""

import numpy as np
import pandas as pd

from laggard.operators.learner import FEATURE, LABEL, FtrlParams
from laggard.streaming.live import DelayedLearner


class Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class Handle:
    def __init__(self):
        self.calls, self.timers, self.values = [], [], {}

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value(self.calls))

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def events(times, late):
    rows = [(t, FEATURE, t, np.array([1.0, t % 3]), None) for t in times] + [(t + late, LABEL, t, None, float(t % 2)) for t in times if t + late in times]
    return pd.DataFrame(rows, columns=["time", "kind", "ref", "x", "y"])


def test_calls_do_not_follow_the_rows():
    """A micro-batch of 200 rows and labels makes as many calls as one of 10, and leaves max_delay + 1 rows at most."""
    made = []
    for n in (10, 200):
        handle, learner = Handle(), DelayedLearner(FtrlParams(), 5)
        learner.init(handle)
        list(learner.handleInputRows((1,), iter([events(range(n), 3)]), None))
        made.append(len(handle.calls))
        assert list(handle.values["pending"].value[0]) == list(range(n - 3, n))
    assert made[0] == made[1] <= 5


def test_expired_rows_go():
    handle, learner = Handle(), DelayedLearner(FtrlParams(), 5)
    learner.init(handle)
    list(learner.handleInputRows((1,), iter([events(range(10), 3)]), None))
    list(learner.handleExpiredTimer((1,), Now(learner.expires(8)), None))
    assert list(handle.values["pending"].value[0]) == [9]
    assert handle.timers[-1] == learner.expires(9)
    list(learner.handleExpiredTimer((1,), Now(learner.expires(9)), None))
    assert handle.values["pending"].value is None
