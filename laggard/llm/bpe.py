"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokeniser's pattern.  Over the byte positions of a piece lies
a segment tree: the leaf of a live position holds the rank of the pair that starts there, and
an inner node the least (rank, position) below it, so that the root is the leftmost pair of
minimum rank.  A merge kills one position and changes the pairs of two live neighbours: three
point updates, each logarithmic in the length of the piece.

Defined results: a null or empty text has no ids and decodes to no bytes; texts of any length
are encoded whole; every row is encoded by itself, so repeated rows repeat.  An id that the
vocabulary lacks raises ValueError on decoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker remembers; beyond them it forgets those that it met only once (for speed, not a limit).
MEMORY = 200_000
SLICE = 256
#: Longer pieces are merged one by one, each in a tree of its own size.
WIDE_BITS = 6
NEVER = 1 << 60


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    bits = (n - 1).bit_length()
    size, mask = 1 << bits, (1 << bits) - 1
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for v in range(size - 1, 0, -1):
        a, b = tree[2 * v], tree[2 * v + 1]
        tree[v] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the live neighbours of a position

    def put(i: int, key: int) -> None:
        v = size + i
        tree[v] = key
        v >>= 1
        while v:
            a, b = tree[2 * v], tree[2 * v + 1]
            low = a if a < b else b
            if tree[v] == low:
                break
            tree[v] = low
            v >>= 1

    def pair(i: int) -> int:
        """Key of the pair that starts at i."""
        j = after[i]
        r = ranks.get(piece[i:after[j]]) if j < n else None
        return NEVER if r is None else r << bits | i

    while tree[1] != NEVER:
        i = tree[1] & mask
        j = after[i]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        put(j, NEVER)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Codec:
    """Ranks and pattern, and a bounded memory of pieces and their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)])
        pairs = {}  # (left id, right id) -> id of both together
        for whole, r in ranks.items():
            for i in range(1, len(whole)):
                left, right = ranks.get(whole[:i]), ranks.get(whole[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        n = max(ranks.values()) + 1
        names = [b""] * n
        for name, r in ranks.items():
            names[r] = name
        self.known = np.array([bool(x) for x in names])
        self.name_start = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.forget()

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)  # ids of piece i: ids[start[i]:start[i + 1]]
        self.uses = np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Keep the pieces met more than once, those met most if there are more than ``most``."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:most]])
        names, counts = list(self.place), self.start[keep + 1] - self.start[keep]
        ids, uses = self.ids[ragged(self.start[keep], counts)], self.uses[keep] // 2
        self.place = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.start, self.ids, self.uses = np.concatenate([[0], np.cumsum(counts)]), ids, uses

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1: no such token."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def merge_many(self, pieces: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each piece); merge_pairs over many pieces of at
        most 2**bits bytes, a segment tree in each row, one merge of every row at a time."""
        m, width = len(pieces), 1 << bits
        length = np.fromiter(map(len, pieces), np.int64, m)
        at = np.arange(width)
        ids = np.zeros((m, width), np.int64)
        live = at[None, :] < length[:, None]
        ids[live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.tile(at + 1, (m, 1)), np.tile(at - 1, (m, 1))
        tree = np.full((m, 2 * width), NEVER, np.int64)
        rows, cols = np.nonzero(at[None, :] < length[:, None] - 1)
        r = self.join(ids[rows, cols], ids[rows, cols + 1])
        tree[rows, width + cols] = np.where(r < 0, NEVER, r << bits | cols)
        w = width // 2
        while w:
            tree[:, w:2 * w] = np.minimum(tree[:, 2 * w:4 * w:2], tree[:, 2 * w + 1:4 * w:2])
            w //= 2

        def put(a, i, key):
            v = width + i
            tree[a, v] = key
            for _ in range(bits):
                v = v >> 1
                tree[a, v] = np.minimum(tree[a, 2 * v], tree[a, 2 * v + 1])

        def put_pair(a, i, j):
            r = self.join(ids[a, i], ids[a, j])
            put(a, i, np.where(r < 0, NEVER, r << bits | i))

        a = np.flatnonzero(tree[:, 1] != NEVER)
        while len(a):
            root = tree[a, 1]
            i = root & (width - 1)
            j = after[a, i]
            k = after[a, j]
            ids[a, i] = root >> bits
            after[a, i] = k
            live[a, j] = False
            put(a, j, NEVER)
            inner = k < length[a]
            before[a[inner], k[inner]] = i[inner]
            put_pair(a[inner], i[inner], k[inner])
            put(a[~inner], i[~inner], NEVER)
            p = before[a, i]
            outer = p >= 0
            put_pair(a[outer], p[outer], i[outer])
            a = a[tree[a, 1] != NEVER]
        return ids[live], live.sum(axis=1)

    def learn(self, pieces: set[str]) -> None:
        """Find the ids of the pieces not met so far."""
        if len(self.place) > MEMORY:
            self.shrink(MEMORY // 2)
        new = [p for p in pieces if p not in self.place]
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode()
            bits = -1 if raw in self.ranks else max(1, (len(raw) - 1).bit_length())
            classes.setdefault(bits if bits <= WIDE_BITS else 99, []).append((p, raw))
        for bits, members in sorted(classes.items()):
            if bits == -1:
                ids, counts = np.array([self.ranks[raw] for _, raw in members]), np.ones(len(members), np.int64)
            elif bits == 99:
                lists = [merge_pairs(raw, self.ranks) for _, raw in members]
                ids, counts = np.array(list(chain.from_iterable(lists))), np.array(list(map(len, lists)))
            else:
                ids, counts = self.merge_many([raw for _, raw in members], bits)
            self.place.update(zip((p for p, _ in members), range(len(self.place), len(self.place) + len(members)), strict=True))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        pieces = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        n = sum(map(len, pieces))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(pieces)), np.int64, n)
        uses = np.bincount(at, minlength=len(self.place))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        counts = self.start[at + 1] - self.start[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        texts_end = np.cumsum([len(p) for p in pieces])
        return self.ids[ragged(self.start[at], counts)], np.concatenate([[0], upto[texts_end]]) if texts else upto

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after another, offsets of the texts)."""
        odd = (ids < 0) | (ids >= len(self.known))
        odd[~odd] = ~self.known[ids[~odd]]
        if odd.any():
            raise ValueError(f"no token has the id {ids[odd][0]}")
        counts = self.name_start[ids + 1] - self.name_start[ids]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return self.name_bytes[ragged(self.name_start[ids], counts)], upto[offsets]

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.asarray(list(ids), np.int64)
        return self.decode_many(ids, np.array([0, len(ids)]))[0].tobytes()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def ids_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def bytes_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def encode(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None,
           pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """id, ids (array<int>): one row for each row of ``docs``; with ``decoded`` also what the ids decode
    to (binary), by the same workers."""
    path, pattern = path or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, offsets = codec.encode_many(part.column(1).to_pylist())
                cols = {"id": part.column(0), "ids": ids_array(ids, offsets)}
                if decoded:
                    cols["decoded"] = bytes_array(*codec.decode_many(ids, offsets))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        codec.shrink(MEMORY // 4)     # a worker that waits for other work holds little

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col="doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, ids, decoded (binary) of stored ids: null ids decode to no bytes."""
    path, pattern = path or vocabulary_path(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column(1).fill_null([])
                decoded = bytes_array(*codec.decode_many(ids.flatten().to_numpy(zero_copy_only=False),
                                                         np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids") \
        .mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep`` (ids, decoded), n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, id_col, text_col, decoded=True).select(
        id_col, *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
