"""Mixing sources to target weights.

Every document gets a hash-random key; within a source documents lie in key order, split
into equal key ranges.  Word counts are summed by range, prefix sums over the range sums find
the range in which a source's budget ends, and prefix sums inside that one range find the
cut.  What is left is one small row for each source, so documents are read again and never
shuffled, whatever share of them one source holds.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; equal keys (repeated rows) share what is left at the cut in proportion to their sizes;
no documents give no rows; a source of size 0 gets a target of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laggard.llm.common import cut, hash_key, n_words, table

WEIGHTS = (5, 2, 1)
SHARE_PCT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
KEY_BITS = 60
RANGE_ROWS = 20_000
#: At most some 5 MB of cuts.
BROADCAST_SOURCES = 50_000
#: The places right after a word and before white space.
AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_pct: int = SHARE_PCT,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target.  ``sizes``: source, size (rows of any grain).

    The k sources with the least cap / weight stop at their cap; the others share what is left
    by weight.  k is the least for which no other source is above its cap.  One row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.select("source", "source_size", w.cast("long").alias("w"),
                   (F.col("source_size") * max_epochs).alias("cap"))
    least = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = least.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.select("*", F.row_number().over(least).alias("k"),
                   (F.sum("source_size").over(every) * F.lit(share_pct / 100)).alias("total"),
                   F.sum("w").over(every).alias("all_w"),
                   F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("cap_before"),
                   F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w_before"))
    rate = (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    by = by.select("*", rate.alias("rate"), (rate * F.col("w") <= F.col("cap")).alias("ok"))
    first = F.min(F.when(F.col("ok"), F.struct("k", "rate"))).over(every)
    by = by.withColumn("first", first)
    open_ = F.col("first").isNotNull() & (F.col("k") >= F.col("first.k"))
    return by.select("source", "source_size",
                     F.when(open_, F.col("first.rate") * F.col("w")).otherwise(F.col("cap").cast("double"))
                     .alias("target"))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: source_size, target, full (whole epochs), rest (words of the last epoch),
    cut_key, cut_before, cut_sum.  ``sized``: source, key, size (a written table)."""
    n = sized.count()
    bits = max(0, min(30, (max(n, 1) // RANGE_ROWS).bit_length()))
    keyed = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    plan = targets.withColumn("budget", F.round("target").cast("long")) \
        .withColumn("full", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))) \
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("source_size"))
    by_range = keyed.groupBy("source", "range").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.withColumn("range_before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    a, b = by_range.alias("a"), plan.alias("b")
    last = a.join(b, F.expr("a.source <=> b.source AND a.range_before <= b.rest "
                            "AND b.rest < a.range_before + a.s")) \
        .select("b.*", "a.range", "a.range_before")
    c, d = keyed.alias("c"), last.alias("d")
    groups = c.join(d, F.expr("c.source <=> d.source AND c.range = d.range")) \
        .groupBy("d.source", "c.key").agg(F.sum("c.size").alias("g"), F.first("d.range_before").alias("range_before"),
                                          F.first("d.rest").alias("rest"))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("cut_before", F.col("range_before") + F.coalesce(F.sum("g").over(inside), F.lit(0))) \
        .where("cut_before <= rest AND rest < cut_before + g")
    e, f = plan.alias("e"), groups.alias("f")
    return e.join(f, F.expr("e.source <=> f.source"), "left") \
        .select("e.source", "e.source_size", "e.target", "e.full", "e.rest", F.col("f.key").alias("cut_key"),
                "f.cut_before", F.col("f.g").alias("cut_sum"))


def beside(plan: DataFrame) -> DataFrame:
    """The cuts as the small side of a join: one row a source, broadcast up to ``BROADCAST_SOURCES`` of
    them, so that documents stay where they are; beyond that an ordinary join."""
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def with_size(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED) -> DataFrame:
    return docs.withColumns({"_size": n_words(F.col(text_col)), "_key": hash_key(seed, F.col(id_col)),
                             "_source": F.col(source_col).cast("string")})


def plan_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
             share_pct: int = SHARE_PCT, max_epochs: int = MAX_EPOCHS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(sized, cuts): the written table id, source, key, size, and the written cut of each source."""
    sized = cut(with_size(docs, id_col, text_col, source_col, seed)
                .select(F.col(id_col), F.col("_source").alias("source"), F.col("_key").alias("key"),
                        F.col("_size").alias("size")))
    return sized, cut(cuts(sized, source_targets(sized, weights, share_pct, max_epochs)))


def taken(size: str, key: str) -> Column:
    """Words that the mix takes of a document, beside the columns of cuts()."""
    return F.expr(f"CAST(full * {size} + CASE WHEN cut_key IS NULL OR {key} > cut_key THEN 0 WHEN {key} < cut_key "
                  f"THEN {size} ELSE ({size} * (rest - cut_before)) div cut_sum END AS BIGINT)")


def mix(docs: DataFrame, id_col="doc_id", **kw) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    sized, plan = plan_mix(docs, id_col=id_col, **kw)
    a, b = sized.alias("a"), beside(plan).alias("b")
    return a.join(b, F.expr("a.source <=> b.source")) \
        .select(f"a.{id_col}", "size", "source_size", "target", taken("size", "key").alias("taken"))


def mixed_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **kw) -> DataFrame:
    """The mix itself: each document as often as the epochs take it, with its own columns; the
    copy at a source's cut ends after the words that the budget leaves."""
    _, plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    got = with_size(own, f"_doc.{id_col}", f"_doc.{text_col}", f"_doc.{source_col}", kw.get("seed", SEED)).alias("a") \
        .join(beside(plan).alias("b"), F.expr("a._source <=> b.source")) \
        .withColumn("_taken", taken("_size", "_key")).where("_taken > 0")
    copies = F.sequence(F.lit(0), F.expr("CAST((_taken - 1) div _size AS INT)"))
    got = got.withColumn("_copy", F.explode(copies)).withColumn("_left", F.expr("_taken - _copy * _size"))
    pieces = F.split(F.col(f"_doc.{text_col}"), AFTER_WORD)  # each ends with a word; joined they are the text
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("_left").cast("int")), "")
    text = F.when(F.expr("_left >= _size"), F.col(f"_doc.{text_col}")).otherwise(head)
    return got.select(*[(text if c == text_col else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: Every document's prefix sum in its source, by one window, and the caps by the same closed form.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
-- for each source, the level if those of a lesser cap / weight stop at their caps; the first that holds
v AS (SELECT b.source, any_value(b.source_size / b.w) AS ratio,
        (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(2 * c.source_size) FILTER (c.source_size / c.w < b.source_size / b.w), 0))
        / sum(c.w) FILTER (c.source_size / c.w >= b.source_size / b.w) AS rate FROM s b, s c GROUP BY b.source),
r AS (SELECT s.*, (SELECT arg_min(rate, ratio) FROM v WHERE rate <= 2 * ratio + 1e-9) AS rate FROM s),
t AS (SELECT source, source_size, least(rate * w, 2.0 * source_size)::DOUBLE AS target FROM r),
u AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size)
  + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken FROM u"""
