"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by a total order (id, then crc32 and MD5 of the text), whatever the files or
partitions they come in.  A keyed Feistel network permutes the numbers of the next power of two;
numbers that land beyond the last row walk on along their cycle until they land inside.  The
permuted number alone gives the shard (its remainder) and the slot (its quotient), so a row's place
is computed without any shuffle, and the inverse permutation names the row of any shard and slot.

Law ``rows``: shards differ by one row at most, slots have no gaps.  Groups of equal texts are
spread like other rows.

Defined results: a null or empty text has 16 bytes and crc32 0; a null id comes first; repeated rows
each get a place of their own, which of them gets which is the same to any reader; more shards than
rows leave shards empty; no rows give no rows; columns of any name are kept by ``shuffled``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from laggard.llm.common import crc32_sql, cut, number, table

SHARDS = 40
SEED = "shards-1"
OVERHEAD = 16
ROUNDS = 6
#: The round function works modulo this prime, so that 62 bits hold every product.
PRIME = (1 << 31) - 1


def round_keys(seed: str = SEED) -> list[tuple[int, int, int]]:
    """Per round: two multipliers and an offset below the prime."""
    out = []
    for k in range(ROUNDS):
        d = hashlib.sha256(f"{seed}|{k}".encode()).digest()
        a, b, c = (int.from_bytes(d[i:i + 8], "big") for i in (0, 8, 16))
        out.append((1 + a % (PRIME - 1), 1 + b % (PRIME - 1), c % PRIME))
    return out


def half_bits(n: int) -> tuple[int, int]:
    """Bits of the two halves; together they number n rows, and at most twice as many."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def mixed(x: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
    y = (x * key[0] + key[2]) % PRIME
    y = (y ^ (y >> 15)) * key[1] % PRIME
    return y ^ (y >> 13)


def network(x: np.ndarray, n: int, seed: str = SEED, inverse: bool = False) -> np.ndarray:
    """The halves change by turns, each by a function of the other."""
    a, b = half_bits(n)
    left, right = x >> b, x & ((1 << b) - 1)
    steps = list(enumerate(round_keys(seed)))
    for k, key in reversed(steps) if inverse else steps:
        if k % 2:
            right = right ^ (mixed(left, key) & ((1 << b) - 1))
        else:
            left = left ^ (mixed(right, key) & ((1 << a) - 1))
    return left << b | right


def permute(x: np.ndarray, n: int, seed: str = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 .. n-1 (int64)."""
    y = network(x.astype(np.int64), n, seed, inverse)
    while (out := y >= n).any():
        y[out] = network(y[out], n, seed, inverse)
    return y


def place(row: np.ndarray, n: int, shards: int = SHARDS, seed: str = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    y = permute(row, n, seed)
    return y % shards, y // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: str = SEED) -> np.ndarray:
    """Row number at a shard and slot."""
    return permute(slot.astype(np.int64) * shards + shard, n, seed, inverse=True)


def assign(numbered: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``numbered`` (with _row) and its columns shard, slot."""
    n = numbered.count()

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, slot = place(b.column("_row").to_numpy(zero_copy_only=False), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int32)), pa.array(slot)],
                                             names=[*b.schema.names, "shard", "slot"])

    schema = StructType([*numbered.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    return numbered.mapInArrow(places, schema).drop("_row")


def shuffled(docs: DataFrame, shards: int = SHARDS, id_col="doc_id", text_col="text", seed: str = SEED) -> DataFrame:
    """The documents with their own columns, and _shard, _slot: the shuffle itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"),
                      F.crc32(text).alias("_crc"), F.md5(text).alias("_md5"))
    got = assign(number(own, "_id", "_crc", "_md5"), shards, seed)
    return got.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns],
                      F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **kw) -> None:
    """One folder of Parquet a shard, its files in slot order."""
    got = shuffled(docs, shards, **kw)
    got.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot") \
        .write.partitionBy("_shard").parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, id_col="doc_id", text_col="text", seed: str = SEED) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot, grown_shard.  Texts are read once and never shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = cut(docs.select(F.col(id_col), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                            F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("_md5")))
    got = assign(number(light, id_col, "text_crc32", "_md5").drop("_md5"), shards, seed)
    return got.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def network_sql(value: str) -> str:
    """DuckDB SQL of one walk step from the table s (row, y) with the widths a, b of p; columns row, y."""
    q = f"SELECT row, n, a, b, {value} >> b AS l, {value} & ((1::BIGINT << b) - 1) AS r FROM s, p"
    for k, (m, m2, c) in enumerate(round_keys()):
        src, dst, width = ("l", "r", "b") if k % 2 else ("r", "l", "a")
        keep = "l" if k % 2 else "r"
        q = f"SELECT *, ({src} * {m} + {c}) % {PRIME} AS f FROM ({q})"
        q = f"SELECT * EXCLUDE (f), (xor(f, f >> 15) * {m2}) % {PRIME} AS f FROM ({q})"
        q = f"SELECT row, n, a, b, {keep}, xor({dst}, xor(f, f >> 13) & ((1::BIGINT << {width}) - 1)) AS {dst} FROM ({q})"
    return f"SELECT row, (l << b) | r AS y FROM ({q})"


#: The same network, walked by a recursive query.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, coalesce(text, '') AS t,
    {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
i AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, md5(t)) - 1 AS row FROM d),
c AS (SELECT count(*)::BIGINT AS n, greatest(2, CASE WHEN count(*) < 2 THEN 0 ELSE length(bin(count(*) - 1)) END)::BIGINT AS bits FROM d),
p AS (SELECT n, bits // 2 AS a, bits - bits // 2 AS b FROM c),
w AS (SELECT row, y FROM (WITH s AS (SELECT row, row AS y FROM i) {network_sql('y')})
  UNION ALL SELECT row, y FROM (WITH s AS (SELECT w.row, w.y FROM w, p WHERE w.y >= p.n) {network_sql('y')}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % {SHARDS})::INT AS shard, y // {SHARDS} AS slot, NULL::INT AS grown_shard
FROM i JOIN w USING (row), p WHERE y < n"""
