"""Derived streams (FIXTURES.md part B) built from the driver tables.

Each builder returns the canonical stream schema; ``t`` is the 0-based
position inside the stream, computed by ``number_rows`` with a time bucket so
that a hot stream is numbered by many tasks.  The DuckDB twins of these
builders live in ``laggard.oracle.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.operators.seq import number_rows

F2_COLS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber"]
# Order buckets for the stream position: a stream is numbered by (stream, bucket) tasks, so a
# hot stream is split by time; coarser buckets keep the offset table small.
EVENT_BUCKET_DAYS = 7


def _materialise(df: DataFrame) -> DataFrame:
    """Write the numbered stream once (reliable checkpoint in the shared
    ``spark.checkpoint.dir``): every operator downstream reads it instead of
    re-running the numbering, and lineage stays short for executor-loss recovery."""
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events per user. ``stream_id, t, ts, x0, x1, x2, y``."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), "ts", "event_id",
        (F.col("value") / 100.0).alias("x0"),
        (F.hour("ts") / 24.0).alias("x1"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("x2"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("y"))
    ev = number_rows(ev, ["stream_id"], ["ts", "event_id"],
                     bucket=F.floor(F.unix_date(F.to_date("ts")) / EVENT_BUCKET_DAYS))
    return _materialise(ev.select("stream_id", "t", "ts", "x0", "x1", "x2", "y"))


def cohort_stream(spark: SparkSession, sf_dir: str, cohorts: int = 5) -> DataFrame:
    """F1 by cohort: the users' events merged in order of time, so that a stream is thousands of rows long."""
    ev = events_stream(spark, sf_dir).withColumn("user_id", F.col("stream_id")).withColumn("stream_id", F.col("user_id") % cohorts)
    ev = number_rows(ev.drop("t"), ["stream_id"], ["ts", "user_id", "x0", "x1", "x2", "y"],
                     bucket=F.floor(F.unix_date(F.to_date("ts")) / EVENT_BUCKET_DAYS))
    return _materialise(ev.select("stream_id", "t", "x0", "x1", "x2", "y"))


def lineitem_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem per supplier. ``stream_id, t, c0..c4, y`` (c0, c1 continuous; c2-c4 ordinal)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stream_id"), "l_shipdate", "l_orderkey", "l_linenumber",
        "l_partkey", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(F2_COLS)],
        (F.col("l_returnflag") == "R").cast("int").alias("y"))
    li = number_rows(li, ["stream_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
                     bucket=F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    return _materialise(li.select("stream_id", "t", *[f"c{i}" for i in range(len(F2_COLS))], "y"))


def embedding_points(spark: SparkSession, sf_dir: str, blocks: int = 10) -> DataFrame:
    """embeddings as points; block = vec_id % blocks, t = vec_id. ``stream_id, t, x, y, label``."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % blocks).alias("stream_id"), F.col("vec_id").alias("t"),
        F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") < 5).cast("int").alias("y"), "label")


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with naturally missing labels; stream = lang, t = rank of doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = docs.join(lab, "doc_id", "left").select(
        F.col("lang").alias("stream_id"), "doc_id",
        F.col("n_chars").cast("double").alias("x0"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("x1"),
        (F.length(F.regexp_replace("text", "[^0-9]", ""))
         / F.nullif(F.length("text"), F.lit(0))).alias("x2"),
        F.col("quality").alias("y"))
    return number_rows(d, ["stream_id"], ["doc_id"],
                       bucket=F.floor(F.col("doc_id") / 4096)).select(
        "stream_id", "t", "doc_id", "x0", "x1", "x2", "y")


def col_cells(wide: DataFrame, cols: list[str], keys=("stream_id", "t")) -> DataFrame:
    """unpivot to ``(keys, col INT, v)`` with missing cells removed."""
    keys = list(keys)
    renamed = wide.select(*keys, *[F.col(c).alias(str(i)) for i, c in enumerate(cols)])
    long = renamed.unpivot(keys, [str(i) for i in range(len(cols))], "col", "v")
    return long.select(*keys, F.col("col").cast("int").alias("col"), "v").where(F.col("v").isNotNull())


def as_array(df: DataFrame, cols: list[str], out: str = "x", intercept: bool = False,
             zero_fill: bool = True) -> DataFrame:
    """Pack columns into ``array<double>``, NULL -> 0, optional leading 1.0."""
    vals = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if zero_fill else F.col(c).cast("double")
            for c in cols]
    if intercept:
        vals = [F.lit(1.0)] + vals
    return df.withColumn(out, F.array(*vals))
