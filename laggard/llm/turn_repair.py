"""Conversation structure repair by Four-Russians block tables.

A conversation becomes a string of symbols, one a row: the role's initial and whether the row is
truncated, or that it must go.  The cheapest edits to a legal order of roles are a shortest path
through four states (nothing yet, after system, after user, after a whole pair).  Read from the
end, a state's cost to the end is a vector of four numbers; less its minimum only a few such
vectors exist, and one table holds for each vector and each block of ``BLOCK`` symbols the vector
before the block and what the minimum grew by.  Costs are looked up block by block; a trace then
expands each block backward from the vector at its right end, and takes in every state the
ASCII-least edit that keeps the cost, so that ties are safe.

On Spark: rows are range-sorted once, and a conversation's rows are cut into segments of at most
``SEGMENT`` rows.  A segment looks up its blocks for every vector at its right end; the few numbers
that come out are chained over the segments of a conversation, each segment is traced from every
state, and the traces are chained again.  No task holds more than a segment's symbols or a
conversation's traces; texts are only streamed.  A digest of a whole text has to be taken in one
pass over that conversation's rows, with one row in memory.

Defined results: null roles and texts are one space; rows are in order of turn (nulls first), and
rows of one turn by the MD5 of role and text, repeats beside each other; a null conv_id is a
conversation of its own; a conversation without rows needs no edits; extra columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import crc32_sql, cut, number, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols: 2 * (initial in INITIALS, else 3) + truncated; a row that must go; no row.
INITIALS = "sua"
GONE, NONE, SYMBOLS = 8, 9, 10
BLOCK, SEGMENT = 4, 4096
#: States: nothing yet, after system, after user, after a pair.  What a user or assistant turn leads to, and its role.
PAIR = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
FAR = 1 << 20
BLANK_TEXT, LAST = r"\A[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"


def kept(state: int, symbol: int) -> int | None:
    """The state after a kept row, None if its role does not fit."""
    initial = symbol >> 1
    if symbol >= GONE or initial == 3:
        return None
    if initial == 0:
        return 1 if state == 0 else None
    return PAIR[state] if (initial == 2) == (state == 2) else None


def closed(costs) -> tuple[int, ...]:
    """Costs of the states once rows may be inserted."""
    return tuple(min(costs[s], INSERT + costs[PAIR[s]], 2 * INSERT + costs[PAIR[PAIR[s]]]) for s in range(4))


#: At the end: nothing or whole pairs.
END = closed((0, FAR, FAR, 0))


def before(costs, symbol: int) -> tuple[int, ...]:
    """Costs before a row, from those after it."""
    if symbol == NONE:
        return tuple(costs)
    out = []
    for s in range(4):
        best = DELETE + costs[s]
        if symbol < GONE:
            cut_off = TRUNCATED * (symbol & 1)
            best = min(best, REROLE + cut_off + costs[PAIR[s]])
            to = kept(s, symbol)
            if to is not None:
                best = min(best, cut_off + costs[to])
        out.append(best)
    return closed(out)


class Blocks:
    """The normalised vectors and the tables of blocks.  A block's code has its first symbol highest."""

    def __init__(self):
        self.vectors = [tuple(c - min(END) for c in END)]
        ids, rows, grows = {self.vectors[0]: 0}, [], []
        for v in self.vectors:  # grows while it is read
            nexts, grow = [], []
            for symbol in range(SYMBOLS):
                w = before(v, symbol)
                low = min(w)
                w = tuple(c - low for c in w)
                if w not in ids:
                    ids[w] = len(self.vectors)
                    self.vectors.append(w)
                nexts.append(ids[w])
                grow.append(low)
            rows.append(nexts)
            grows.append(grow)
        one, one_grow = np.array(rows, np.int32), np.array(grows, np.int64)
        to, grow = one, one_grow
        for _ in range(BLOCK - 1):  # a symbol more in front
            grow = (grow[:, None, :] + one_grow[to].transpose(0, 2, 1)).reshape(len(one), -1)
            to = one[to].transpose(0, 2, 1).reshape(len(one), -1)
        self.to, self.grow = to, grow
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def codes(self, symbols: bytes) -> np.ndarray:
        """The blocks of a segment; what is missing of the first one is filled in front."""
        s = np.frombuffer(symbols, np.uint8).astype(np.int64)
        s = np.concatenate([np.full(-len(s) % BLOCK, NONE), s]).reshape(-1, BLOCK)
        return s @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def through(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector right of the blocks: the vector left of them, and the growth."""
        v, grow = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for c in codes[::-1]:
            grow += self.grow[v, c]
            v = self.to[v, c]
        return v, grow

    def expand(self, right: int, code: int, state: int) -> tuple[str, int]:
        """The edits of one block entered in a state, ASCII-least of the cheapest, and the state after it.

        K, D as in an audit; r and i, R and I: rerole and insert, as user and as assistant."""
        key = (right, code, state)
        if key not in self.traces:
            symbols = [code // SYMBOLS ** k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
            costs = [self.vectors[right]]
            for s in reversed(symbols):
                costs.append(before(costs[-1], s))
            costs.reverse()
            out = []
            for k, s in enumerate(symbols):
                while s != NONE:
                    now, then = costs[k], costs[k + 1]
                    cut_off = TRUNCATED * (s & 1) if s < GONE else FAR
                    to, need = kept(state, s), now[state]
                    if need == DELETE + then[state]:
                        out.append("D")
                        break
                    if need == INSERT + now[PAIR[state]]:
                        out.append("I" if state == 2 else "i")
                        state = PAIR[state]
                        continue
                    if to is not None and need == cut_off + then[to]:
                        out.append("K")
                        state = to
                        break
                    out.append("R" if state == 2 else "r")
                    state = PAIR[state]
                    break
            self.traces[key] = "".join(out), state
        return self.traces[key]

    def trace(self, codes: np.ndarray, right: int, state: int) -> tuple[str, int]:
        rights = [right]
        for c in codes[:0:-1]:
            rights.append(int(self.to[rights[-1], c]))
        out = []
        for c, v in zip(codes, reversed(rights), strict=True):
            piece, state = self.expand(v, int(c), state)
            out.append(piece)
        return "".join(out), state


@lru_cache(maxsize=1)
def blocks() -> Blocks:
    return Blocks()


def ending(state: int) -> str:
    """Inserts after the last row."""
    out = ""
    while state in (1, 2):
        out += "I" if state == 2 else "i"
        state = PAIR[state]
    return out


AUDIT = str.maketrans("rRi", "RRI")


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query: conv_id, turn, role, text, copy."""
    words = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    fault = F.crc32(F.concat_ws(":", *words)) % 20
    got = rows.select("conv_id", "turn", fault.alias("_fault"), role.alias("_role"), text.alias("_text")).where("_fault <> 0")
    return got.select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("_role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("_text", "[.!?]", ""))
        .otherwise(F.col("_text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def symbols(rows: DataFrame) -> DataFrame:
    """Numbered rows with fault and symbol, without their texts: _row, conv_id, turn, initial, fault, symbol.

    ``rows`` have _row and _md5 of role and text.  The first row of each (conversation, MD5) is joined by
    its own number, so that no key is hot."""
    first = rows.groupBy("conv_id", "_md5").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(~F.col("_whole"), "truncated")
    got = rows.drop("text", "_md5").join(first, "_row", "left").withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    code = F.lit(3)
    for i, c in enumerate(INITIALS):
        code = F.when(initial == c, i).otherwise(code)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(2 * code + F.col("fault").eqNullSafe("truncated").cast("int"))
    return got.select("_row", "conv_id", "turn", code.alias("initial"), "fault", symbol.alias("symbol"))


SEGMENT_SCHEMA = ("conv_id {conv}, at long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low {turn}, "
                  "high {turn}, first_initial int, last_initial int, codes binary, to array<int>, grow array<long>")
LEGAL = {(0, 1), (1, 2), (2, 1)}


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment: counts inside it, its ends, and what its blocks do to every vector."""
    table_ = blocks()
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("at", "illegal", "turns", "low", "high", "first_initial", "last_initial", "codes", "to", "grow")}
        for rows in b.column("rows").to_pylist():
            initials, turns = [r["initial"] for r in rows], [r["turn"] for r in rows]
            known = [t for t in turns if t is not None]
            code = table_.codes(bytes(r["symbol"] for r in rows))
            to, grow = table_.through(code)
            values = (rows[0]["_row"], sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False)),
                      sum(i == 0 or t != known[i - 1] for i, t in enumerate(known)), known[0] if known else None,
                      known[-1] if known else None, initials[0], initials[-1], code.astype(np.int32).tobytes(), to, grow)
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        turn = b.column("rows").type.value_type.field("turn").type
        types = [pa.int64(), pa.int64(), pa.int64(), turn, turn, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        made = {k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)}
        names = ["conv_id", "at", "n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_initial", "last_initial",
                 "codes", "to", "grow"]
        yield pa.RecordBatch.from_arrays([made[k] if k in made else b.column(k) for k in names], names=names)


def segments(coded: DataFrame) -> DataFrame:
    """One row per conversation and ``SEGMENT`` global row numbers."""
    got = coded.groupBy("conv_id", F.floor(F.col("_row") / SEGMENT).alias("_seg")).agg(
        F.sort_array(F.collect_list(F.struct("_row", "turn", "symbol", "initial"))).alias("rows"), F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("fault").eqNullSafe(f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")])
    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}
    return got.drop("_seg").mapInArrow(summed, SEGMENT_SCHEMA.format(conv=kinds["conv_id"], turn=kinds["turn"]))


def rights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector right of each segment of a conversation, from its last segment to its first; the cost at the first."""
    for b in batches:
        at, right, cost = [], [], []
        for parts in b.column("parts").to_pylist():
            v, total = 0, 0
            for k in range(len(parts) - 1, -1, -1):
                at.append(parts[k]["at"])
                right.append(v)
                total += parts[k]["grow"][v]
                v = parts[k]["to"][v]
                cost.append(total + blocks().vectors[v][0] if k == 0 else None)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(right, pa.int32()), pa.array(cost, pa.int64())],
                                         names=["at", "right", "cost"])


def traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's edits from every state it may be entered in."""
    for b in batches:
        out = []
        for codes, right in zip(b.column("codes").to_pylist(), b.column("right").to_pylist(), strict=True):
            code = np.frombuffer(codes, np.int32)
            out.append([dict(zip(("edits", "state"), blocks().trace(code, right, s), strict=True)) for s in range(4)])
        kind = pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "ways"])


def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's segments in order: what is counted across their ends, and the one trace through them."""
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            state, illegal, turns, low, high, edits = 0, 0, 0, None, None, []
            for k, p in enumerate(parts):
                illegal += p["illegal"] + (k > 0 and (parts[k - 1]["last_initial"], p["first_initial"]) not in LEGAL)
                turns += p["turns"] - (high is not None and p["low"] == high)
                low = p["low"] if low is None else low
                high = high if p["high"] is None else p["high"]
                way = p["ways"][state]
                state = way["state"]
                edits.append(way["edits"])
            edits[-1] += ending(state)
            out.append({"gaps": 0 if low is None else high - low + 1 - turns, "illegal": illegal, "audit": "".join(edits).translate(AUDIT),
                        "edits": [{"at": p["at"], "edits": e} for p, e in zip(parts, edits, strict=True)]})
        kind = pa.struct([("gaps", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()),
                          ("edits", pa.list_(pa.struct([("at", pa.int64()), ("edits", pa.string())])))])
        made = pa.array(out, kind)
        keep = [c for c in b.schema.names if c != "parts"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made.flatten()], names=[*keep, *kind.names])


def row_edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's edits by row: the inserted lines before it (after the last row: behind it), and its own edit."""
    lines = {"i": "user:", "I": "assistant:"}
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "_row", "lines", "edit", "behind")}
        for conv, at, edits in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "edits")), strict=True):
            inserted: list[str] = []
            for e in edits:
                if e in lines:
                    inserted.append(lines[e])
                    continue
                for k, v in zip(out, (conv, at, "\n".join(inserted) or None, e, None), strict=True):
                    out[k].append(v)
                inserted, at = [], at + 1
            if inserted:
                out["behind"][-1] = "\n".join(inserted)
        types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by conversation and row, each edit just before its row; a digest per conversation."""
    conv, digest, lines, edit, behind = None, None, None, None, None

    def put(line: str | None) -> None:
        nonlocal digest
        if line is not None:
            digest.update(b"\n" + line.encode() if digest.begun else line.encode())
            digest.begun = True

    for b in batches:
        done: list[tuple] = []
        for c, kind, l_, e, h, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "kind", "lines", "edit", "behind", "role", "text")), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, Digest()
            if kind == 0:
                lines, edit, behind = l_, e, h
                continue
            put(lines)
            if edit != "D":
                put(f"{ {'r': 'user', 'R': 'assistant'}.get(edit, role)}:{text}")
            put(behind)
        yield digest_batch(done, b)
    if digest is not None:
        yield digest_batch([(conv, digest.hexdigest())], b)


class Digest:
    """A SHA-256 that knows whether a line has gone into it."""

    def __init__(self):
        self.begun, self._hash = False, hashlib.sha256()
        self.update, self.hexdigest = self._hash.update, self._hash.hexdigest


def digest_batch(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], like.schema.field("conv_id").type), pa.array([d for _, d in done], pa.string())],
                                      names=["conv_id", "repaired_sha256"])


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered rows, edits by row, one row per conversation) of conv_id, turn, role, text and an optional copy.

    Edits: conv_id, _row, lines, edit, behind.  Conversations: counts, cost, audit."""
    own = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in ("conv_id", "turn", "role", "text", "copy")]
    md5 = F.md5(F.concat_ws("\u0000", "role", "text"))
    flags = rows.select(*own, F.unhex(md5).alias("_md5"), F.regexp_like("text", F.lit(BLANK_TEXT)).alias("_blank"),
                        F.regexp_like("text", F.lit(LAST)).alias("_whole"))
    numbered = number(flags, "conv_id", "turn", "_md5", "copy")
    parts = cut(segments(symbols(numbered)))
    order = F.sort_array(F.collect_list(F.struct("at", "to", "grow"))).alias("parts")
    right = parts.groupBy("conv_id").agg(order).mapInArrow(rights, "at long, right int, cost long")
    kind = {f.name: f.dataType.simpleString() for f in parts.schema}
    names = ["conv_id", "at", "n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_initial", "last_initial", "right", "cost"]
    both = parts.drop("to", "grow").join(right, "at").select(*names, "codes")
    way = both.mapInArrow(traced, ", ".join(f"{c} {kind.get(c) or dict(right='int', cost='long')[c]}" for c in [*names, "codes"])
                          + ", ways array<struct<edits: string, state: int>>").drop("codes")
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    convs = way.groupBy("conv_id").agg(*counts, F.max("cost").alias("cost"), F.sort_array(F.collect_list(F.struct(
        "at", "low", "high", "first_initial", "last_initial", "illegal", "turns", "ways"))).alias("parts"))
    convs = cut(convs.mapInArrow(chained, f"conv_id {kind['conv_id']}, blank long, duplicate long, truncated long, cost long, gaps long, "
                                          "illegal long, audit string, edits array<struct<at: long, edits: string>>"))
    edits = convs.select("conv_id", F.inline("edits")).mapInArrow(
        row_edits, f"conv_id {kind['conv_id']}, _row long, lines string, edit string, behind string")
    return numbered, edits, convs.drop("edits")


def repaired_rows(numbered: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, position, role, text."""
    got = numbered.drop("conv_id").join(edits, "_row")
    role = F.when(F.col("edit") == "r", "user").when(F.col("edit") == "R", "assistant").otherwise(F.col("role"))
    empty = [F.transform(F.split(c, "\n"), lambda x: F.struct(F.rtrim(x, F.lit(":")).alias("role"), F.lit("").alias("text")))
             for c in ("lines", "behind")]
    none = F.array().cast("array<struct<role:string,text:string>>")
    own = F.when(F.col("edit") != "D", F.array(F.struct(role.alias("role"), F.col("text").alias("text")))).otherwise(none)
    turns = F.concat(F.coalesce(empty[0], none), own, F.coalesce(empty[1], none))
    return got.select("conv_id", "_row", F.posexplode(turns).alias("at", "turn")).select("conv_id", F.struct("_row", "at").alias("position"), "turn.*")


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation with rows: counts of faults, cost, audit, repaired_sha256."""
    numbered, edits, convs = plan(rows)
    blank = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    told = edits.select("conv_id", "_row", F.lit(0).alias("kind"), "lines", "edit", "behind", *blank) \
        .unionByName(numbered.select("conv_id", "_row", F.lit(1).alias("kind"), "role", "text"), allowMissingColumns=True)
    kind = convs.schema["conv_id"].dataType.simpleString()
    sha = told.repartition("conv_id").sortWithinPartitions("conv_id", "_row", "kind").mapInArrow(digests, f"conv_id {kind}, repaired_sha256 string")
    return together(convs, sha)


def together(*tables: DataFrame) -> DataFrame:
    """Rows of one conv_id (null is one too) from tables with different other columns."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in both.columns if c != "conv_id"])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return all_conversations(rows, repair(damaged(rows)))


def all_conversations(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """Also the conversations that the damage left without rows."""
    got = together(rows.select("conv_id"), repaired)
    empty: Column = F.sha2(F.lit(""), 256)
    return got.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


#: Rows after damage, then the costs from the end by a recursive query and the edits from the start by another.
#: States are counted from 1: nothing yet, after system, after user, after a pair.
ORACLE = f"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy) AS i FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
    regexp_matches(text, '{BLANK_TEXT}') AS empty, regexp_matches(text, '{LAST}') AS whole FROM o),
r AS (SELECT conv_id, turn, role, text, i, pair, CASE WHEN empty THEN 'b' WHEN again > 1 THEN 'd' WHEN NOT whole THEN 't' ELSE '' END AS fault,
    CASE role[1] WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE '' END AS initial FROM e),
-- per row and state: what a kept row costs and leads to (null if it cannot be kept), what a rerole costs
m AS (SELECT conv_id, i, role, text, CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 3 ELSE 0 END AS c,
    CASE initial WHEN 's' THEN [2, NULL, NULL, NULL] WHEN 'u' THEN [3, 3, NULL, 3] WHEN 'a' THEN [NULL, NULL, 4, NULL]
      ELSE [NULL, NULL, NULL, NULL]::INT[] END AS k FROM r),
b AS (SELECT conv_id, max(i) AS i, [0, 6, 3, 0]::INT[] AS v FROM m GROUP BY conv_id
  UNION ALL SELECT conv_id, i - 1, [least(w[j], 3 + w[p[j]], 6 + w[p[p[j]]]) FOR j IN [1, 2, 3, 4]]
  FROM (SELECT b.conv_id, b.i, [3, 3, 4, 3] AS p,
      [least(4 + v[j], 3 + c + v[([3, 3, 4, 3])[j]], c + coalesce(v[k[j]], 1000000)) FOR j IN [1, 2, 3, 4]]::INT[] AS w
    FROM b JOIN m ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.i = m.i)),
-- z: the costs after row i and before it
z AS (SELECT y.conv_id, y.i, y.v AS v, x.v AS now, c, k, role, text FROM b y JOIN b x ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i - 1
  JOIN m ON m.conv_id IS NOT DISTINCT FROM y.conv_id AND m.i = y.i),
t AS (SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS made FROM m WHERE i = 1
  UNION ALL SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END,
    CASE edit WHEN 'D' THEN s WHEN 'K' THEN k[s] ELSE ([3, 3, 4, 3])[s] END, audit || edit,
    CASE edit WHEN 'D' THEN made WHEN 'K' THEN made || [role || ':' || text]
      ELSE made || [CASE s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END] END
  FROM (SELECT t.*, role, text, k, CASE WHEN z.i IS NULL THEN 'I' WHEN now[s] = 4 + v[s] THEN 'D' WHEN now[s] = 3 + now[([3, 3, 4, 3])[s]] THEN 'I'
      WHEN now[s] = c + v[k[s]] THEN 'K' ELSE 'R' END AS edit
    FROM t LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM t.conv_id AND z.i = t.i WHERE z.i IS NOT NULL OR s IN (2, 3))),
g AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(made, length(audit)) AS made FROM t GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au') AND i > 1) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 0"""
