"""Structured Streaming forms (S11, ST07 live, ST21).

* ``write_replay_files`` / ``replay_stream`` (S11): a table is written as
  time-bucketed parquet files and read back with ``readStream`` one file per
  trigger, so micro-batches arrive in time order.
* ``live_delayed_learner`` (ST07 live): feature and label events of a stream share one keyed state of
  ``transformWithState``: the learner as a typed value, the rows whose label is still to come as another.  A label finds its row for ``max_delay`` steps; later ones are a second kind of output,
  not a silence.  Rows that no label may claim any more go by event-time timers, at the watermark, so
  that a stream which falls silent leaves no state behind.  The step function is the batch fold's
  ``FtrlState`` (R6): a replay gives the batch result, in one run or over restarts.
* ``minibatch_ftrl`` (ST21): one FTRL step a batch from the batch's summed gradient.  The fold keeps the
  weights and the open batch's sums (O(p) a stream), so all batches of all streams are one plan and one
  job; ``live_minibatch_ftrl`` keeps the same in operator state.  ``minibatch_rounds`` is the form for
  batches that are too large for a task: the gradient is one aggregation and one job a batch.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from laggard.functions.logistic import ftrl_weight_py
from laggard.operators.learner import FEATURE, LABEL, NO_BEST, FtrlParams, FtrlState, for_scan, keyed_partitions, observe, schema_of
from laggard.session import ensure_checkpoint_dir

EVENT_SCHEMA = ("stream_id bigint, _time bigint, _kind int, _tref bigint, x array<double>, "
                "y double, _bucket bigint")


def delayed_events(rows: DataFrame, arrivals: DataFrame, bucket_rows: int) -> DataFrame:
    """Feature events at t and label events at t_arrive, with a replay bucket of the time."""
    fe = rows.select("stream_id", F.col("t").alias("_time"), F.lit(FEATURE).alias("_kind"),
                     F.col("t").alias("_tref"), F.col("x").cast("array<double>").alias("x"),
                     F.lit(None).cast("double").alias("y"))
    le = arrivals.select("stream_id", F.col("t_arrive").alias("_time"), F.lit(LABEL).alias("_kind"),
                         F.col("t_orig").alias("_tref"), F.lit(None).cast("array<double>").alias("x"),
                         F.col("y").cast("double").alias("y"))
    return fe.unionByName(le).withColumn("_bucket", F.floor(F.col("_time") / bucket_rows))


def write_replay_files(events: DataFrame, path: str, files_per_bucket: int = 4) -> None:
    """S11 (sink half): one job writes a folder for each time bucket.  A stream's events of a bucket are
    in one file, in order.  The file source reads the oldest files first, so the files then get
    modification times in the order of their buckets (a metadata call for each file)."""
    slot = F.pmod(F.hash("stream_id"), F.lit(files_per_bucket))
    (events.withColumn("_slot", slot).repartition("_bucket", "_slot").sortWithinPartitions("_bucket", "stream_id", "_time", "_kind", "_tref")
     .drop("_slot").write.mode("overwrite").partitionBy("_bucket").parquet(path))
    spark = events.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [(int(f.getPath().getName().split("=")[1]), f.getPath()) for f in fs.listStatus(root) if "=" in f.getPath().getName()]
    start = int(time.time() * 1000) - 1000 * (len(folders) + 1)
    for k, (_, folder) in enumerate(sorted(folders, key=lambda x: x[0])):
        for f in fs.listStatus(folder):
            fs.setTimes(f.getPath(), start + 1000 * k, -1)


def replay_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA,
                  max_files_per_trigger: int = 4) -> DataFrame:
    """Replay the bucket folders in time order; a micro-batch takes the next
    ``max_files_per_trigger`` files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(path))


# ---- ST07 live ---------------------------------------------------------------------------

LEARNER_SCHEMA = ("v array<double>, h array<double>, z array<double>, r double, decay double, counts array<bigint>, "
                  "warned array<bigint>, best array<double>, level int")
LIVE_SCHEMA = "stream_id bigint, kind string, t bigint, prob double, t_arrive bigint"
PREDICTION, DROPPED = "prediction", "dropped"


def as_tuple(st: FtrlState) -> tuple:
    return st.v, st.h, st.z, float(st.r), float(st.decay), list(st.counts), list(st.warned), [float(b) for b in st.best], int(st.level)


def as_learner(values: tuple, prm: FtrlParams) -> FtrlState:
    st = FtrlState(len(values[0]), prm)
    st.v, st.h, st.z = (list(a) for a in values[:3])
    st.r, st.decay = values[3:5]
    st.counts, st.warned, st.best = (tuple(a) for a in values[5:8])
    st.level = values[8]
    return st


class DelayedLearner(StatefulProcessor):
    """State of one stream: the learner and the time of its last row; the rows that wait for a label, at most max_delay + 1, and the row
    its timer is for.  Both are read once and written once a micro-batch, whatever it holds: each call goes through a socket."""

    def __init__(self, prm: FtrlParams, max_delay: int):
        self.prm, self.max_delay = prm, max_delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learner = handle.getValueState("learner", f"{LEARNER_SCHEMA}, last bigint")
        self.pending = handle.getValueState("pending", "t array<bigint>, x array<array<double>>, timer bigint")

    def expires(self, t: int) -> int:
        """Event time, in ms, from which on no label of row t counts."""
        return 1000 * (t + 1 + self.max_delay + 1)

    def watch(self, t: int) -> int:
        """One timer a stream, for its oldest waiting row."""
        self.handle.registerTimer(self.expires(t))
        return t

    def keep(self, waiting: dict[int, list[float]], timer: int | None, there: bool) -> None:
        if waiting or timer is not None:
            self.pending.update((list(waiting), list(waiting.values()), timer))
        elif there:
            self.pending.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["time", "kind", "ref"])  # a stream's rows of one micro-batch
        values, held = self.learner.get(), self.pending.get()
        st, last = (as_learner(values[:-1], self.prm), values[-1]) if values else (None, None)
        waiting, timer = ({t: list(x) for t, x in zip(held[0], held[1], strict=True)}, held[2]) if held else ({}, None)
        fresh: dict[int, list[float]] = {}
        out: list[tuple] = []
        for tm, kind, tref, x, y in zip(*(pdf[c].tolist() for c in ("time", "kind", "ref", "x", "y")), strict=True):
            if kind == FEATURE:
                xv = [float(v) for v in x]
                st = st or FtrlState(len(xv), self.prm)
                out.append((key[0], PREDICTION, tm, st.predict(xv, self.prm), None))
                fresh[tm], last = xv, tm
                continue
            xb = fresh.pop(tref, None)
            if xb is None:
                xb = waiting.pop(tref, None)
            if y is None or math.isnan(y):
                continue
            if xb is None or last - tref > self.max_delay:
                out.append((key[0], DROPPED, tref, None, tm))
            else:
                st.fit(xb, float(y), self.prm)
        if fresh and timer is None:
            timer = self.watch(min(fresh))
        waiting = {t: xv for t, xv in {**waiting, **fresh}.items() if last - t <= self.max_delay}
        self.keep(waiting, timer, held is not None)
        if st is not None:
            self.learner.update((*as_tuple(st), last))
        yield live_rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self.pending.get()
        waiting = {t: list(x) for t, x in sorted(zip(held[0], held[1], strict=True)) if self.expires(t) > now} if held else {}
        self.keep(waiting, self.watch(min(waiting)) if waiting else None, held is not None)
        yield live_rows([])

    def close(self) -> None:
        pass


def live_rows(rows: list[tuple]) -> pd.DataFrame:
    got = pd.DataFrame(rows, columns=["stream_id", "kind", "t", "prob", "t_arrive"])
    return got.astype({"stream_id": "Int64", "t": "Int64", "prob": "float64", "t_arrive": "Int64"})


def live_delayed_learner(events: DataFrame, max_delay: int, prm: FtrlParams = FtrlParams(), lateness: int = 0) -> DataFrame:
    """ST07 on a streaming DataFrame of ``delayed_events``: rows ``stream_id, kind, t, prob, t_arrive``; kind ``prediction``
    has prob, kind ``dropped`` is a label (of row t, arrived at t_arrive) that came more than ``max_delay`` steps late or for
    a row that is not waiting.  Event time is the step plus one, in seconds, as a
    stream's first watermark is 0 and what is not above it is late; events of one stream come in order, and streams
    may be ``lateness`` steps apart.  State per stream: the learner and at most max_delay + 1 rows."""
    timed = events.select("stream_id", F.col("_time").alias("time"), F.col("_kind").alias("kind"), F.col("_tref").alias("ref"), "x", "y",
                          F.timestamp_seconds(F.col("_time") + 1).alias("event_time")).withWatermark("event_time", f"{lateness} seconds")
    return timed.groupBy("stream_id").transformWithStateInPandas(
        DelayedLearner(prm, max_delay), LIVE_SCHEMA, "Append", "eventTime")


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """transformWithState needs this state store; the setting of other queries stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(result: DataFrame, scratch: str, by: str | None = None) -> None:
    """Run a streaming query over all input there is into a parquet sink under ``scratch``; run again, it goes on where it ended."""
    w = result.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ckpt").outputMode("append")
    with state_in_rocksdb(result.sparkSession):
        (w.partitionBy(by) if by else w).trigger(availableNow=True).start().awaitTermination()


def run_live_replay(spark: SparkSession, events: DataFrame, scratch: str, max_delay: int, prm: FtrlParams = FtrlParams(),
                    bucket_rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """Write the events as replay files and run the live learner over them: (predictions, dropped labels)."""
    files = keyed_partitions(events)  # a bucket is as many files, and a micro-batch as many tasks, as the cluster runs at once
    write_replay_files(events, f"{scratch}/events", files)
    stream = replay_stream(spark, f"{scratch}/events", max_files_per_trigger=files)
    run_to_end(live_delayed_learner(stream, max_delay, prm, 2 * bucket_rows), scratch, "kind")
    return live_output(spark, scratch)


def live_output(spark: SparkSession, scratch: str) -> tuple[DataFrame, DataFrame]:
    got = spark.read.schema(LIVE_SCHEMA).parquet(f"{scratch}/out")
    return (got.where(F.col("kind") == PREDICTION).select("stream_id", "t", "prob"),
            got.where(F.col("kind") == DROPPED).select("stream_id", "t", "t_arrive"))


# ---- ST21 mini-batch FTRL ------------------------------------------------------------------

STATE_SCHEMA = ("stream_id bigint, v array<double>, h array<double>, z array<double>, r double, "
                "counts array<bigint>, warned array<bigint>, best array<double>")


def _update_state(pdf: pd.DataFrame, p: int, prm: FtrlParams) -> pd.DataFrame:
    """One FTRL update per (stream, batch) from the aggregated gradient and error count; with one
    row a batch it is ST01's step."""
    rows = []
    for r in pdf.itertuples(index=False):
        new = r.z is None
        v, h, z = ([0.0] * p if new else list(a) for a in (r.v, r.h, r.z))
        rr = 1.0 if new else r.r
        counts, warned, best = ((0, 0), (0, 0), NO_BEST) if new else (tuple(map(int, r.counts)), tuple(map(int, r.warned)), tuple(r.best))
        w = [ftrl_weight_py(z[i], rr, prm.l1, prm.l2, prm.lp) for i in range(p)]
        d = prm.init_decay
        if prm.adaptive:
            d, _, counts, warned, best = observe(int(r.n), int(r.errors), counts, warned, best, prm)
        for i in range(p):
            v[i] += r.g[i]
            h[i] = d * h[i] + w[i]
            z[i] = v[i] - prm.lp * h[i]
        rows.append((r.stream_id, v, h, z, 1.0 + d * rr, list(counts), list(warned), list(best)))
    return pd.DataFrame(rows, columns=["stream_id", "v", "h", "z", "r", "counts", "warned", "best"])


def minibatch_step(batch: DataFrame, state: DataFrame, p: int,
                   prm: FtrlParams = FtrlParams()) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: predictions of ``batch`` (stream_id, t, x, y) with the current state,
    and the new state.  The gradient and the error count are distributed aggregations per stream."""
    st = state.select("stream_id", "z", "r")
    j = batch.join(st, "stream_id", "left")
    w = F.transform(F.coalesce("z", F.array_repeat(F.lit(0.0), p)),
                    lambda zi: F.when(F.abs(zi) > prm.l1,
                                      -(zi - prm.l1 * F.signum(zi))
                                      / (prm.l2 + prm.lp * F.coalesce("r", F.lit(1.0))))
                    .otherwise(F.lit(0.0)))
    j = j.withColumn("_w", w)
    m = F.aggregate(F.zip_with("_w", "x", lambda a, b: a * b), F.lit(0.0), lambda acc, e: acc + e)
    j = j.withColumn("prob", 1.0 / (1.0 + F.exp(-m)))
    preds = j.select("stream_id", "t", "prob")
    miss = F.col("prob") - F.col("y")
    g = j.where(F.col("y").isNotNull()).groupBy("stream_id").agg(
        F.array(*[F.sum(miss * F.element_at("x", i + 1)) for i in range(p)]).alias("g"),
        F.count(F.lit(1)).alias("n"), F.sum((F.abs(miss) > 0.5).cast("long")).alias("errors"))
    cur = g.join(state, "stream_id", "left")
    new = cur.groupBy("stream_id").applyInPandas(lambda pdf: _update_state(pdf, p, prm), STATE_SCHEMA)
    untouched = state.join(g.select("stream_id"), "stream_id", "left_anti")
    return preds, untouched.unionByName(new)


class MiniBatch:
    """ST21 of one stream: the learner before the open batch, and the sums of the batch so far."""

    def __init__(self, p: int, prm: FtrlParams):
        self.prm, self.learner = prm, FtrlState(p, prm)
        self.batch, self.g, self.n, self.errors = -1, np.zeros(p), 0, 0

    def close(self) -> None:
        """One step from the sums; a batch without labels changes nothing."""
        st, prm = self.learner, self.prm
        if self.n:
            w, decay = st.weights(st.p, prm), prm.init_decay
            if prm.adaptive:
                decay, st.level, st.counts, st.warned, st.best = observe(self.n, self.errors, st.counts, st.warned, st.best, prm)
            st.decay = decay
            for i in range(st.p):
                st.v[i] += float(self.g[i])
                st.h[i] = decay * st.h[i] + w[i]
                st.z[i] = st.v[i] - prm.lp * st.h[i]
            st.r = 1.0 + decay * st.r
        self.g, self.n, self.errors = np.zeros(st.p), 0, 0

    def add(self, batch: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Probabilities of further rows of the open batch, or the first of a later one (y: NaN without a label)."""
        if batch != self.batch:
            self.close()
            self.batch = batch
        prob = 1.0 / (1.0 + np.exp(-(x @ np.array(self.learner.weights(self.learner.p, self.prm)))))
        known = ~np.isnan(y)
        miss = prob[known] - y[known]
        self.g = self.g + miss @ x[known]
        self.n += int(known.sum())
        self.errors += int((np.abs(miss) > 0.5).sum())
        return prob


def runs_of(*cols: np.ndarray) -> Iterator[slice]:
    """Slices of equal values in sorted columns."""
    n = len(cols[0])
    if n:
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        yield from (slice(a, b) for a, b in zip([0, *new], [*new, n], strict=True))


def minibatch_ftrl(rows: DataFrame, p: int, batch_rows: int, prm: FtrlParams = FtrlParams()) -> DataFrame:
    """ST21 over a table, batches t // batch_rows of each stream: ``stream_id, t, batch, prob``.  One ordered scan by stream: all
    steps are one job, a task keeps O(p) numbers, and rows of a batch are handled together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, None
        for pdf in batches:
            keys, ids = pdf["stream_id"].to_numpy(), pdf["batch"].to_numpy()
            y, prob = pdf["y"].to_numpy(dtype=float, na_value=np.nan), np.zeros(len(pdf))
            for at in runs_of(keys, ids):
                if state is None or keys[at.start] != stream:
                    stream, state = keys[at.start], MiniBatch(p, prm)
                prob[at] = state.add(int(ids[at.start]), np.array([np.asarray(v, dtype=float) for v in pdf["x"].iloc[at]]), y[at])
            yield pd.DataFrame({"stream_id": keys, "t": pdf["t"], "batch": ids, "prob": prob})

    d = rows.select("stream_id", "t", F.floor(F.col("t") / batch_rows).cast("long").alias("batch"), F.col("x").cast("array<double>").alias("x"),
                    F.col("y").cast("double").alias("y"))
    return for_scan(d, ["stream_id"], "batch", "t").mapInPandas(
        run, f"{schema_of(rows, ['stream_id', 't'])}, batch bigint, prob double")


class LiveMiniBatch(StatefulProcessor):
    """``MiniBatch`` as operator state: an epoch's rows give predictions at once, the step is taken when the next batch begins."""

    def __init__(self, p: int, batch_rows: int, prm: FtrlParams):
        self.p, self.batch_rows, self.prm = p, batch_rows, prm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("minibatch", f"{LEARNER_SCHEMA}, batch bigint, g array<double>, n bigint, errors bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mb = MiniBatch(self.p, self.prm)
        if self.state.exists():
            *learner, mb.batch, g, mb.n, mb.errors = self.state.get()
            mb.learner, mb.g = as_learner(tuple(learner), self.prm), np.array(g)
        pdf = pd.concat(list(rows)).sort_values("t")
        t, y, prob = pdf["t"].to_numpy(), pdf["y"].to_numpy(dtype=float, na_value=np.nan), np.zeros(len(pdf))
        x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]])
        for at in runs_of(t // self.batch_rows):
            prob[at] = mb.add(int(t[at.start] // self.batch_rows), x[at], y[at])
        self.state.update((*as_tuple(mb.learner), mb.batch, mb.g.tolist(), mb.n, mb.errors))
        yield pd.DataFrame({"stream_id": key[0], "t": t, "batch": t // self.batch_rows, "prob": prob})

    def close(self) -> None:
        pass


def live_minibatch_ftrl(rows: DataFrame, p: int, batch_rows: int, prm: FtrlParams = FtrlParams()) -> DataFrame:
    """ST21 on a streaming DataFrame (stream_id, t, x, y), a stream's rows in order: one streaming query, weights in its state."""
    return rows.groupBy("stream_id").transformWithStateInPandas(
        LiveMiniBatch(p, batch_rows, prm), "stream_id bigint, t bigint, batch bigint, prob double", "Append", "None")


def minibatch_rounds(spark: SparkSession, rows: DataFrame, p: int, batch_rows: int,
                     prm: FtrlParams = FtrlParams()) -> tuple[DataFrame, DataFrame]:
    """ST21 for batches that are too large for one task: batches are t // batch_rows; a driver loop over batch index runs
    all streams in parallel per step.  Rows are written by batch once, so that a step reads its own
    only; predictions are appended to one folder, the state is written every step, all in the
    shared checkpoint folder.  Returns (predictions, final state)."""
    folder = f"{ensure_checkpoint_dir(spark)}/minibatch-{uuid.uuid4().hex}"
    by_batch = F.floor(F.col("t") / batch_rows).cast("long")
    rows.withColumn("batch", by_batch).write.partitionBy("batch").parquet(f"{folder}/rows")
    d = spark.read.schema(rows.withColumn("batch", by_batch).schema).parquet(f"{folder}/rows")
    last = d.agg(F.max("batch")).first()[0]
    state = spark.createDataFrame([], STATE_SCHEMA)
    none = state.select("stream_id", F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("prob"), F.lit(0).cast("long").alias("batch"))
    none.write.parquet(f"{folder}/predictions")
    for b in range(0 if last is None else int(last) + 1):
        pr, state = minibatch_step(d.where(F.col("batch") == b).drop("batch"), state, p, prm)
        pr.withColumn("batch", F.lit(b).cast("long")).write.mode("append").parquet(f"{folder}/predictions")
        state = state.checkpoint()
    return spark.read.parquet(f"{folder}/predictions"), state


def minibatch_foreach(prm: FtrlParams, p: int, state_path: str):
    """``foreachBatch`` handler for a live stream.  Epoch e reads the state that epoch e - 1 has written
    under ``state_path`` (in the shared checkpoint folder) and writes its own, so an epoch that is run
    again gives the same state; a state that cannot be read is an error."""
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(STATE_SCHEMA).parquet(f"{state_path}/epoch={epoch - 1}") if epoch \
            else spark.createDataFrame([], STATE_SCHEMA)
        _, new = minibatch_step(batch, state, p, prm)
        new.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
    return handle
