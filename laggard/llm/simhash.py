"""Document fingerprints: SimHash of 128 bits, and a search by block tables.

Terms are pairs of neighbouring words (a text of one word has that word).  Each distinct term
has a 128-bit hash and the weight 1 + ln(count); it votes with its weight for or against every
bit.  The votes are summed by byte: a histogram of the terms' weights over the 256 values of
each of the 16 hash bytes, times the signs of the values' bits.

Two fingerprints within Hamming radius r differ by at most r // m bits in one of m blocks.
``near`` keeps one table for each block, keyed by its bits, looks a query up under every key that
is so close to its own, and compares what it meets, so that no pair within the radius is missed; a
pair counts in the first table that has it.  Equal fingerprints are grouped before.

The radius is from measured distances (sf0.01, texts of 50 to 1,500 words): changing one word
moves 3.5 to 7.6 bits on average, changing 2 % of the words 11 (98 to 99.7 % of such copies stay
within 19), 5 % of them 17 to 18 (64 to 75 % stay); 99.9 % of all pairs of texts are 46 bits or more
apart.

Defined results: null and empty texts have no terms and the fingerprint 0; equal texts have
equal fingerprints; ids that repeat are ordered by a hash of their texts, null ids come last;
a single document is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laggard.llm.common import cut, table

BITS = 128
RADIUS, BLOCKS = 19, 10
ROWS_A_RANGE = 4000
QUERY_EVERY = 100
MEMORY = 60_000
#: Sign of bit j (highest first) in each byte value.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
OFFSETS = (256 * np.arange(16))[None, :]


class Memory(dict):
    """64-bit hash of each word met; starts anew beyond a bound (for speed, not a limit)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "big")
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(raw: bytes, memory: Memory) -> np.ndarray:
    """64-bit hashes of the terms, repeats included."""
    words = raw.split()
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    return h if len(h) < 2 else mix(h[:-1] * np.uint64(3) + mix(h[1:]))


def simhash(raw: bytes, memory: Memory) -> bytes:
    """The fingerprint, 16 bytes."""
    terms, counts = np.unique(term_hashes(raw, memory), return_counts=True)
    if not len(terms):
        return bytes(16)
    wide = np.stack([terms, mix(terms + np.uint64(0x9E3779B97F4A7C15))], axis=1)
    cells = wide.view(np.uint8).reshape(len(terms), 16) + OFFSETS
    weights = np.repeat(1 + np.log(counts), 16)
    votes = np.bincount(cells.ravel(), weights, 4096).reshape(16, 256) @ SIGNS
    return np.packbits(votes.ravel() > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, after: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + after[:k]


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def compare(text: str, mark: bytes, after: str, after_mark: bytes, memory: Memory) -> tuple:
    new = edited(text, after).encode()
    other = simhash(new, memory)
    return len(text), sha256(new).hexdigest(), mark.hex(), other.hex(), likeness(mark, other), likeness(mark, after_mark)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id, fingerprint (hex): one row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for b in batches:
            marks = [simhash(x or b"", memory).hex() for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_successor(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id and RESULT for each document and the next one in descending order of ids (after the
    last: the first).

    Documents are range-partitioned by id and read in order; what is left open is the last row
    of each partition, whose successor is the first row of the next one.  Those two rows of each
    partition come with their texts and are joined in a second, small step.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select(id_col).count() // ROWS_A_RANGE)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = own.repartitionByRange(parts, F.col("id").desc_nulls_last()) \
        .sortWithinPartitions(F.col("id").desc_nulls_last(), F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    names = ["id", *(x.split()[0] for x in RESULT.split(", ")), "role", "part", "text"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]

    def batch(ids, rows, id_type):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, last, id_type, open_row = Memory(), None, None, (None,) * 6
        for b in batches:
            ids, rows = [], []
            id_type, part = b.column(0).type, b.column(2)[0].as_py() if b.num_rows else None
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mark = simhash(text.encode(), memory)
                if last is None:
                    ids.append(i)
                    rows.append((*open_row, "first", part, text))
                else:
                    ids.append(last[0])
                    rows.append((*compare(last[1], last[2], text, mark, memory), "done", part, None))
                last = (i, text, mark)
                if len(rows) >= 512:
                    yield batch(ids, rows, id_type)
                    ids, rows = [], []
            if rows:
                yield batch(ids, rows, id_type)
        if last is not None:
            yield batch([last[0]], [(*open_row, "last", part, last[1])], id_type)

    seen = cut(ordered.mapInArrow(run, f"id {kind}, {RESULT}, role string, part int, text string"))
    # one row for each partition that has any
    ends = seen.where("role = 'last'").select("id", "part", "text").alias("a")
    firsts = seen.where("role = 'first'").select("part", F.col("text").alias("after"))
    ring = firsts.select("part").withColumn("before", F.coalesce(
        F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))).alias("r")
    pairs = ends.join(ring, F.expr("a.part = r.before")).join(firsts.alias("f"), F.expr("f.part = r.part")) \
        .select("a.id", "a.text", "f.after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for b in batches:
            rows = [compare(t, simhash(t.encode(), memory), a, simhash(a.encode(), memory), memory)
                    for t, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows, strict=True), kinds[:6])],
                                                 names=names[:7])

    rest = pairs.mapInArrow(finish, f"id {kind}, {RESULT}")
    return seen.where("role = 'done'").select(names[:7]).unionByName(rest).withColumnRenamed("id", id_col)


def halves(mark: Column) -> tuple[Column, Column]:
    """The upper and the lower 64 bits of a hex fingerprint."""
    return tuple(F.conv(F.substring(mark, at, 16), 16, -10).cast("long") for at in (1, 17))


def edges(blocks: int) -> list[tuple[int, int]]:
    """First and end bit (from the highest) of every block."""
    if not 3 <= blocks <= BITS:  # a key has a block's bits and 7 of the table's number
        raise ValueError(f"3 to {BITS} blocks")
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def piece(high: Column, low: Column, a: int, b: int) -> Column:
    """Bits a to b of a fingerprint in halves."""
    if b <= 64:
        bits = F.shiftrightunsigned(high, 64 - b)
    elif a >= 64:
        bits = F.shiftrightunsigned(low, BITS - b)
    else:
        bits = F.shiftleft(high, b - 64).bitwiseOR(F.shiftrightunsigned(low, BITS - b))
    return bits.bitwiseAND(F.lit((1 << (b - a)) - 1))


def _key(own: Column, t: int):
    return lambda mask: F.shiftleft(own.bitwiseXOR(mask), 7).bitwiseOR(F.lit(t))


def block_keys(high: Column, low: Column, blocks: int, flips: int = 0) -> Column:
    """array of long: in every table, the keys that differ from the block's bits in up to ``flips`` bits."""
    keys = []
    for t, (a, b) in enumerate(edges(blocks)):
        masks = [sum(1 << k for k in chosen) for n in range(flips + 1) for chosen in combinations(range(b - a), n)]
        signed = F.lit(np.array(masks, np.uint64).view(np.int64).tolist())
        keys.append(F.transform(signed, _key(piece(high, low, a, b), t)))
    return F.concat(*keys)


def near(marks: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint, n_near: for each distinct fingerprint of ``queries``, the documents of ``marks``
    within the radius (equal ones included).  Both have a column fingerprint."""
    flips = radius // blocks
    halved = lambda df, x, y: df.select("*", *[c.alias(n) for c, n in zip(halves(F.col("fingerprint")), (x, y), strict=True)])
    groups = halved(marks.groupBy("fingerprint").agg(F.count("*").alias("n")), "c", "d")
    a = groups.select(F.explode(block_keys(F.col("c"), F.col("d"), blocks)).alias("other_key"), "c", "d", "n")
    q = halved(queries.select("fingerprint").distinct(), "a", "b")
    q = q.select(F.explode(block_keys(F.col("a"), F.col("b"), blocks, flips)).alias("key"), "a", "b")
    x, y = F.col("a").bitwiseXOR(F.col("c")), F.col("b").bitwiseXOR(F.col("d"))
    first = F.coalesce(*[F.when(F.bit_count(piece(x, y, i, j)) <= flips, F.lit(t)) for t, (i, j) in enumerate(edges(blocks))])
    cond = (F.col("key") == F.col("other_key")) & (F.bit_count(x) + F.bit_count(y) <= radius) \
        & (first == F.col("key").bitwiseAND(F.lit(127)))
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return q.join(a, cond).groupBy("a", "b").agg(F.sum("n").alias("n_near")) \
        .select(F.concat(digits("a"), digits("b")).alias("fingerprint"), "n_near")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_count: of the documents whose id is divisible by 100, how many others lie within the
    radius (null for all other documents, which are no queries)."""
    rows = cut(with_successor(table(spark, sf_dir, "documents")))
    asked = rows.where(F.col("doc_id") % QUERY_EVERY == 0).select("doc_id", "fingerprint")
    found = near(rows, asked).withColumnRenamed("fingerprint", "mark")
    counts = asked.join(found, F.col("fingerprint") == F.col("mark")) \
        .select(F.col("doc_id").alias("asked_id"), (F.col("n_near") - 1).alias("near_count")).dropDuplicates(["asked_id"])
    return rows.join(counts, F.col("doc_id") == F.col("asked_id"), "left").drop("asked_id")
