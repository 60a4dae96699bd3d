"""B06, U01, U02 over forests of any size by pointer doubling.

The nearest denser rows of a window make a forest.  The round of a row follows from distances along it:

* forward: a row's round is the least distance to a labelled row below it (0: labelled itself);
* backward: of the rows that no labelled one lies below, the round is the distance to the nearest row above that the
  forward rounds have reached, after the last forward round; a tree without labelled rows is not reached (-1).

A path of length L is covered by log2(L) doublings: in step k every row knows its ancestor 2^k above and the answer
for the 2^k rows around it.  Upwards that is a grouped minimum by ancestor, downwards a join with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forest_rounds(graph: DataFrame, labelled: DataFrame, group: Sequence[str] = ("stream_id", "win"), t: str = "t", parent: str = "parent_t") -> DataFrame:
    """``group, t, parent, round`` for every row of ``graph`` (a root is its own parent); ``labelled`` has group, t."""
    group = list(group)
    on = [*group, t]
    known = labelled.select(*on).distinct().withColumn("_known", F.lit(0).cast("long"))
    rows = graph.select(*on, parent).join(known, on, "left") \
        .withColumn("jump", F.when(F.col(parent) != F.col(t), F.col(parent))).withColumnRenamed("_known", "up").checkpoint()
    jumps, step = [], 1
    while True:  # up: least distance to a labelled row at most 2^k - 1 below
        jumps.append((rows.select(*on, "jump"), step))
        if rows.where("jump IS NOT NULL").isEmpty():
            break
        given = rows.where("jump IS NOT NULL AND up IS NOT NULL").groupBy(*group, F.col("jump").alias(t)).agg((F.min("up") + step).alias("_up"))
        far = rows.where("jump IS NOT NULL").select(*group, F.col(t).alias("jump"), F.col("jump").alias("_next"))
        rows = rows.join(given, on, "left").join(far, [*group, "jump"], "left") \
            .select(*on, parent, F.least("up", "_up").alias("up"), F.col("_next").alias("jump")).checkpoint()
        step *= 2
    last = rows.groupBy(*group).agg(F.max("up").alias("_last"))
    down = rows.select(*on, parent, "up", F.when(F.col("up").isNotNull(), F.lit(0).cast("long")).alias("down")).checkpoint()
    for jump, step in jumps[:-1]:  # down: distance to a reached row at most 2^k - 1 above
        above = down.where("down IS NOT NULL").select(*group, F.col(t).alias("jump"), F.col("down").alias("_down"))
        wanting = down.where("down IS NULL").select(*on).join(jump, on)
        found = wanting.join(above, [*group, "jump"]).select(*on, (F.col("_down") + step).alias("_down"))
        down = down.join(found, on, "left").select(*on, parent, "up", F.coalesce("down", "_down").alias("down")).checkpoint()
    return down.join(last, group).select(*on, parent, F.coalesce("up", F.col("_last") + F.col("down"), F.lit(-1)).cast("int").alias("round"))


def round_sets(rounds: DataFrame, group: Sequence[str] = ("stream_id", "win")) -> DataFrame:
    """U01 and U02 over all rounds: ``group, round, n_frontier`` (rows that the round adds) and ``n_union`` (rows known after it)."""
    group = list(group)
    n = rounds.where("round >= 0").groupBy(*group, "round").agg(F.count(F.lit(1)).alias("n_frontier"))
    so_far = Window.partitionBy(*group).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("n_union", F.sum("n_frontier").over(so_far))
