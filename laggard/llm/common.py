"""Column expressions and table helpers that the operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laggard.session import ensure_checkpoint_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words, as long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory to the machine.  Workers are reused, and arrays of one stage would else stay beside those of the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library; it keeps what it likes
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_key(seed: str, *cols: Column) -> Column:
    """A 60-bit hash-random key of the given columns, the same in every run and engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("~")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def number(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df``, written, with ``_row``: the global number of each row by ``order`` (nulls first), from 0.

    Rows are range-sorted; a row's number is its place in its range plus the sizes of the ranges
    before, one row a range.  Rows that tie follow the order of the scan, so that many equal rows
    fill as many ranges as they need.
    """
    ranged = df.withColumn("_pos", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, "_pos").sortWithinPartitions(*order, "_pos").drop("_pos")
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # as many rows as placed has partitions
    return placed.withColumns({"_part": part, "_place": place}).join(F.broadcast(starts), "_part") \
        .withColumn("_row", F.col("_start") + F.col("_place")).drop("_mid", "_part", "_place", "_start")


def crc32_sql(text: str) -> str:
    """DuckDB SQL of a string's crc32, byte by byte and bit by bit."""
    half = ", ".join(["0::BIGINT"] * 8)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {octets}, "
            f"lambda a, b: list_reduce([xor(a, b), {half}], lambda c, e: xor(c >> 1, 3988292384::BIGINT * (c & 1)))))")
