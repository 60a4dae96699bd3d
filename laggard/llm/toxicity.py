"""Toxicity: non-negative positive-unlabelled learning.

The learner sees confirmed toxic examples and unlabelled texts, no negatives.  Its risk is
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with the sigmoid loss: the
negatives' risk is that of the unlabelled texts less the toxic ones among them, by the class
prior, and a step that would make it negative goes the other way.  The classifier is linear
over the presence of hashed words; a screen by the difference of two shares keeps the words
worth a weight.

It is trained in numpy from at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` texts, taken in the
order of a hash of their ids; every text is scored, whole, on the executors.

Defined results: null and empty texts have no words and get the score of the intercept; with
no confirmed example, no unlabelled text or no word that tells them apart there is nothing to
learn and every score is 0;
a null id counts as its text '' in the fold; repeated label rows of an id count once (toxic if
any says so); repeated documents are scored alike.  Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from laggard.llm.common import hash_key, table

MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
FOLDS = 5
LEAST_Z = 4.0
STEPS, RATE, DECAY = 2000, 0.1, 1e-6
MEMORY = 60_000
WORDS = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == 0


def feature(word: str) -> int:
    """A word's 32-bit hash."""
    return zlib.crc32(word.encode())


class Memory(dict):
    """Feature of each word met; starts anew beyond a bound (for speed, not a limit)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        at = self[word] = feature(word)
        return at


def features(text: str | None, memory: Memory) -> set[int]:
    return set(map(memory.__getitem__, set(WORDS.findall(text.lower())))) if text else set()


def screen(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """Features whose share of the toxic texts differs from that of the unlabelled ones by more
    than LEAST_Z standard errors, sorted."""
    n, m = len(pos), len(unl)
    kinds, both = np.unique(np.concatenate([*pos, *unl]), return_counts=True)
    a = np.zeros(len(kinds))
    mine, times = np.unique(np.concatenate(pos), return_counts=True)
    a[np.searchsorted(kinds, mine)] = times
    share = (both + 0.5) / (n + m + 1)
    error = np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return kinds[np.abs(a / n - (both - a) / m) > LEAST_Z * error]


def rows_of(texts: list[np.ndarray], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of the kept features that are present, and the number of rows."""
    cols, rows = [], []
    for i, x in enumerate(texts):
        at = np.searchsorted(kept, x)
        at = at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == x)] if len(kept) else at[:0]
        cols.append(at)
        rows.append(np.full(len(at), i))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(rows + empty).astype(np.int64), np.concatenate(cols + empty).astype(np.int64), len(texts)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_nnpu(pos, unl, prior: float, k: int, steps: int = STEPS, rate: float = RATE,
             decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and intercept; ``pos`` and ``unl`` as of rows_of.  Full-batch Adam."""
    w, m1, m2 = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)

    def value(x):
        row, col, n = x
        return w[k] + np.bincount(row, w[col], n)

    def back(x, per_row):
        row, col, n = x
        return np.append(np.bincount(col, per_row[row], k), per_row.sum()) / n

    for t in range(1, steps + 1):
        sp, su = sigmoid(value(pos)), sigmoid(value(unl))
        negative = su.mean() - prior * sp.mean()          # sigmoid loss: l(-g) = s(g), l(g) = 1 - s(g)
        g_negative = back(unl, su * (1 - su)) - prior * back(pos, sp * (1 - sp))
        grad = -g_negative if negative < 0 else g_negative - prior * back(pos, sp * (1 - sp))
        grad = grad + decay * np.append(w[:k], 0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w = w - rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-9)
    return w[:k], float(w[k])


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the sorted features of each text, as the bytes of 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for b in batches:
            got = [np.array(sorted(features(t, memory)), np.uint32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "f"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, f binary")


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """{features, weights, intercept, prior}; no label of a held-out row is read."""
    mine = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")) \
        .where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    prior = mine.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    order = hash_key("nnpu", F.col("id"))
    pos = mine.where("y = 1").select("id").orderBy(order, "id").limit(max_positive)
    unl = docs.select(F.col(id_col).alias("id")).where(~held_out(F.col("id"))).orderBy(order, "id").limit(max_unlabelled)
    # the two samples' ids are bounded by the parameters
    chosen = pos.withColumn("p", F.lit(1)).unionByName(unl.withColumn("p", F.lit(0))).groupBy("id") \
        .agg(F.max("p").alias("p"), F.min("p").alias("u")).collect()
    kinds = {r["id"]: (r["p"] == 1, r["u"] == 0) for r in chosen}
    if not kinds:
        return {"features": [], "weights": [], "intercept": None, "prior": prior}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in kinds if i is not None], f"id {docs.schema[id_col].dataType.simpleString()}")
    texts = docs.alias("d").join(F.broadcast(ids.alias("i")), F.expr(f"d.`{id_col}` = i.id")) \
        .select(F.col("i.id").alias(id_col), F.col(f"d.`{text_col}`").alias(text_col)).dropDuplicates([id_col])
    got = [(r["id"], np.frombuffer(r["f"], np.uint32)) for r in feature_rows(texts, id_col, text_col).collect()]
    got.sort(key=lambda x: x[0])
    p, u = [f for i, f in got if kinds[i][0]], [f for i, f in got if kinds[i][1]]
    if not p or not u or not 0 < prior < 1:
        return {"features": [], "weights": [], "intercept": None, "prior": prior}
    kept = screen(p, u)
    if not len(kept):
        return {"features": [], "weights": [], "intercept": None, "prior": prior}
    w, b = fit_nnpu(rows_of(p, kept), rows_of(u, kept), prior, len(kept))
    return {"features": kept.tolist(), "weights": w.tolist(), "intercept": b, "prior": prior}


def score(docs: DataFrame, model: dict, id_col="doc_id", text_col="text", keep: list[str] | None = None,
          score_col="score", predicted_col="predicted") -> DataFrame:
    """The columns ``keep`` (the id alone, if none are named), score (0 to 1) and predicted (0, 1) of
    every text."""
    weights, intercept = dict(zip(model["features"], model["weights"], strict=True)), model["intercept"]
    cols = keep or [id_col]
    sent = cols if text_col in cols else [*cols, text_col]
    at = sent.index(text_col)
    own = docs.select(*[F.col(f"`{c}`") for c in sent])
    schema = StructType([*own.schema.fields[:len(cols)], StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        known = weights.keys()
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = part.column(at).to_pylist()
                if intercept is None:
                    s = np.zeros(len(texts))
                else:
                    s = sigmoid(np.array([intercept + sum(weights[f] for f in sorted(known & features(t, memory)))
                                          for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(cols)], pa.array(s, pa.float64()),
                                                  pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=schema.names)

    return own.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
