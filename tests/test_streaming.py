import numpy as np
from pyspark.sql import functions as F

from laggard.operators.corrupt import delayed_labels
from laggard.operators.learner import delayed_learner
from laggard.sources.fixtures import as_array, events_stream
from laggard.sources.text import scratch_path
from laggard.streaming.live import (delayed_events, live_delayed_learner, live_minibatch_ftrl, live_output, minibatch_ftrl, replay_stream,
                                    run_live_replay, run_to_end, write_replay_files)
from tests.conftest import SF


def same(batch, live):
    j = batch.select("stream_id", "t", F.col("prob").alias("pb")).join(live.select("stream_id", "t", F.col("prob").alias("pl")), ["stream_id", "t"], "full")
    assert batch.count() == live.count() == j.count()
    assert j.where("pb IS NULL OR pl IS NULL OR abs(pb - pl) > 1e-12").count() == 0


def test_live_replay_equals_batch(spark):
    """ST07: the Structured Streaming replay (keyed state) reproduces the batch fold."""
    ev = events_stream(spark, SF)
    rows = as_array(ev, ["x0", "x1", "x2"], intercept=True).select("stream_id", "t", "x", "y")
    arr = delayed_labels(ev, 5)
    live, dropped = run_live_replay(spark, delayed_events(rows, arr, 10), scratch_path(spark, "test-live"), 5, bucket_rows=10)
    same(delayed_learner(rows, arr, max_delay=5), live)
    assert dropped.count() == 0


def uneven(spark, n=60, streams=(1, 2, 9), most=9):
    """Labels 1 to ``most`` steps late, some twice, some for rows that never were; stream 9 ends early."""
    rng = np.random.default_rng(12)
    rows, arr = [], []
    for s in streams:
        for t in range(n if s < 9 else 17):
            x = rng.normal(size=2)
            rows.append((s, t, [1.0, float(x[0]), float(x[1])], int(x[0] > 0)))
            late = int(rng.integers(1, most + 1))
            arr.append((s, t + late, t, int(x[0] > 0)))
            if t % 20 == 3:
                arr.append((s, t + late + 1, t, 1))
    arr.append((1, 30, 999, 1))
    return (spark.createDataFrame(rows, "stream_id long, t long, x array<double>, y int"),
            spark.createDataFrame(arr, "stream_id long, t_arrive long, t_orig long, y int"))


def expected_drops(rows, arr, max_delay):
    """By a plain loop: a label is dropped if its row is no longer, or never was, among the last ones of its stream."""
    out, last, waiting = [], {}, set()
    events = sorted([(r.stream_id, r.t, 1, r.t) for r in rows.collect()] + [(a.stream_id, a.t_arrive, 0, a.t_orig) for a in arr.collect()])
    for s, t, kind, ref in events:
        if kind:
            waiting.add((s, t))
            last[s] = t
        elif (s, ref) in waiting:
            waiting.remove((s, ref))
            if last[s] - ref > max_delay:
                out.append((s, ref, t))
        else:
            out.append((s, ref, t))
    return sorted(out)


def test_late_labels_are_counted(spark):
    rows, arr = uneven(spark)
    live, dropped = run_live_replay(spark, delayed_events(rows, arr, 7), scratch_path(spark, "test-late"), 5, bucket_rows=7)
    same(delayed_learner(rows, arr, max_delay=5), live)
    got = sorted((r.stream_id, r.t, r.t_arrive) for r in dropped.collect())
    assert got == expected_drops(rows, arr, 5) and len(got) > 20


def test_restart_in_mid_stream(spark):
    """Two runs over one checkpoint, rows waiting between them, give what one run gives; the second sees no file twice."""
    rows, arr = uneven(spark)
    events = delayed_events(rows, arr, 7)
    scratch = scratch_path(spark, "test-restart")
    for half in (F.col("_time") < 28, F.col("_time") >= 28):
        write_replay_files(events.where(half), f"{scratch}/part")
        copy = spark.read.parquet(f"{scratch}/part")
        copy.repartitionByRange(3, "_bucket").sortWithinPartitions("_bucket", "stream_id", "_time").write.mode("append").parquet(f"{scratch}/events")
        run_to_end(live_delayed_learner(replay_stream(spark, f"{scratch}/events", max_files_per_trigger=100), 5, lateness=70), scratch, "kind")
    live, dropped = live_output(spark, scratch)
    same(delayed_learner(rows, arr, max_delay=5), live)
    assert sorted((r.stream_id, r.t, r.t_arrive) for r in dropped.collect()) == expected_drops(rows, arr, 5)


def test_silent_streams_leave_no_rows(spark):
    """Stream 9 ends at 17; the watermark of the others removes what waits there."""
    from laggard.streaming.live import state_in_rocksdb
    rows, arr = uneven(spark, n=90)
    scratch = scratch_path(spark, "test-silent")
    run_live_replay(spark, delayed_events(rows, arr.where("stream_id <> 9 AND t_arrive < 88"), 10), scratch, 5, bucket_rows=10)
    with state_in_rocksdb(spark):
        left = spark.read.format("statestore").option("path", f"{scratch}/ckpt").option("stateVarName", "pending").load()
        assert left.where("key.stream_id = 9").count() == 0
        assert left.count() > 0


def test_live_minibatch_equals_the_scan(spark):
    """ST21 in operator state, micro-batches that cut through batches."""
    rows = uneven(spark)[0].withColumn("y", F.col("y").cast("double"))
    scratch = scratch_path(spark, "test-minibatch")
    events = rows.select("stream_id", F.col("t").alias("_time"), F.lit(1).alias("_kind"), F.col("t").alias("_tref"), "x", "y", F.floor(F.col("t") / 9).alias("_bucket"))
    write_replay_files(events, f"{scratch}/events")
    stream = replay_stream(spark, f"{scratch}/events").select("stream_id", F.col("_time").alias("t"), "x", "y")
    run_to_end(live_minibatch_ftrl(stream, 3, 5), scratch)
    same(minibatch_ftrl(rows, 3, 5), spark.read.parquet(f"{scratch}/out"))
