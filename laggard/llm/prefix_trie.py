"""A z-fast trie of conversations.

A conversation's turns are the symbols; a prefix of d turns is named by a chained digest, so that
equal names are equal prefixes.  The compacted trie is a table with one row an edge: the depth it
starts at, the names of the prefixes along it (the last one names its node), and the bytes of the
last texts.  A node is found by its handle, the prefix whose length is the number in the edge's
range that the highest power of two divides.  A conversation finds the edge on which it leaves the
trie by fat binary search: it probes the handle of the fattest length left, goes on below the node
found or above the length probed, and needs logarithmically many probes in its own length.

All conversations still missing are searched at once, a join by handle for each probe.  Then, in a
batch, edges are cut where conversations end or leave, and below each cut one conversation for each
next turn becomes a new edge.  Those that share it search again in the next round, where they find
it.  An edge belongs to the conversation that brought it; these chains hang on chains of earlier
rounds, so that sums over subtrees run along the chains, from the last round to the first.  Edges
are expanded to one row a node at the end.

Many conversations through one node: names are spread over a conversation's depths, the new edge is
the least by name of its end (a partial aggregate), cuts of an edge are a set bounded by its
length, and nodes count members by partial sums.  Digests of members are taken over blocks of ids,
streamed in order.

Defined results: turns are in order of turn (nulls first), ties by the digest of role and text;
null roles and texts are empty; rows without conv_id belong to no conversation; extra columns are
ignored; no conversations give no rows; the depth of a conversation is bounded by what one row may
hold (16 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laggard.llm.common import crc32_sql, cut, table

FAMILY, HEADS = 5, 9
ID_BLOCK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def root_name() -> Column:
    return F.lit("").cast("binary")


# --- conversations as strings of named prefixes ---

def turns(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns: array of (digest, bytes) in order.  Texts go no further than this."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    light = rows.where("conv_id IS NOT NULL").select("conv_id", F.struct(
        "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    ordered = light.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select(F.col("conv_id").cast("long").alias("conv_id"), F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c, its first turns replaced by those of c - c % 5."""
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    got = convs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % FAMILY, "_h": h}).join(heads, "_base", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    return got.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chained digests of all prefixes of each conversation."""
    for b in batches:
        digests, names = iter(b.column("digests").flatten().to_pylist()), []
        for n in b.column("digests").value_lengths().to_pylist():
            name, out = b"", []
            for _ in range(n):
                name = hashlib.md5(name + next(digests)).digest()
                out.append(name)
            names.append(out)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(names, pa.list_(pa.binary())), b.column("bytes")],
                                         names=["conv_id", "names", "bytes"])


def strings(convs: DataFrame) -> DataFrame:
    """Per conversation: conv_id, node (the name of its end), names of its prefixes, bytes of its texts."""
    got = convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("bytes")) \
        .mapInArrow(named, "conv_id long, names array<binary>, bytes array<long>")
    return got.select("conv_id", F.coalesce(F.try_element_at("names", F.lit(-1)), root_name()).alias("node"), "names", "bytes")


# --- the trie: one row an edge, from its parent to its node ---

TRIE = "owner binary, round int, parent binary, start int, names array<binary>, bytes array<long>"


def fattest(low: str, high: str) -> str:
    """SQL of the number in (low, high] that the highest power of two divides, for low < high."""
    bits = f"length(bin(({low}) ^ ({high}))) - 1"
    return f"shiftleft(shiftright({high}, {bits}), {bits})"


def node(c: str = "names") -> Column:
    return F.element_at(c, -1)


def step(pending: DataFrame, edges: DataFrame, probe: Column, active: str) -> DataFrame:
    """Join the active rows' probe to edges by name; edge and fit (its names that the conversation shares) are null without a match."""
    keyed = pending.withColumn("_key", F.when(F.expr(active), probe).otherwise(F.col("node")))  # a name of its own if there is no probe
    got = keyed.join(edges, F.col("_key") == F.col("_name"), "left").drop("_key", "_name")
    hit = F.expr(f"({active}) AND _edge IS NOT NULL")
    return got.withColumns({"_hit": hit, "_fit": F.when(hit, F.expr("size(array_intersect(_edge, slice(names, _start + 1, size(_edge))))"))})


def search(pending: DataFrame, trie: DataFrame, probes: int) -> DataFrame:
    """Per pending conversation: at (how far the trie holds it) and edge (the node of the edge on which it leaves, null at a node).

    pending: node, names, bytes, low (a depth known to be a node's)."""
    edges = trie.select(F.expr(f"element_at(names, {fattest('start', 'start + size(names)')} - start)").alias("_name"),
                        F.col("start").alias("_start"), F.col("names").alias("_edge"))
    got = pending.withColumns({"high": F.size("names"), "edge": F.lit(None).cast("binary"), "at": F.lit(None).cast("int")})
    for _ in range(probes):
        f = fattest("low", "high")
        got = step(got, edges, F.expr(f"element_at(names, {f})"), "low < high")
        whole = F.expr("_hit AND _fit = size(_edge)")
        got = got.withColumns({
            "edge": F.when(F.expr("_hit AND _fit < size(_edge)"), node("_edge")).otherwise(F.col("edge")),
            "at": F.when(F.expr("_hit AND _fit < size(_edge)"), F.expr("_start + _fit")).otherwise(F.col("at")),
            "low": F.when(whole, F.expr("_start + _fit")).otherwise(F.col("low")),
            "high": F.when(whole, F.col("high")).when(F.expr("_hit"), F.col("low")).when(F.expr("low < high"), F.expr(f"{f} - 1"))
            .otherwise(F.col("high")),
        }).drop("_start", "_edge", "_hit", "_fit")
    # the edge whose handle lies beyond the point where the conversation leaves it
    first = trie.select(F.element_at("names", 1).alias("_name"), F.col("start").alias("_start"), F.col("names").alias("_edge"))
    got = step(got, first, F.expr("element_at(names, low + 1)"), "edge IS NULL AND low < size(names)")
    return got.select("node", "names", "bytes", F.coalesce("at", F.expr("low + coalesce(_fit, 0)")).alias("at"),
                      F.coalesce("edge", F.when(F.col("_hit"), node("_edge"))).alias("edge"))


def cut_edges(trie: DataFrame, cuts: DataFrame) -> DataFrame:
    """Edges split at depths inside them; the parts stay in their chain.  cuts: edge, at."""
    at = cuts.groupBy("edge").agg(F.sort_array(F.collect_set("at")).alias("_cuts"))
    got = trie.withColumn("edge", node()).join(at, "edge", "left")
    ends = F.expr("concat(transform(coalesce(_cuts, array()), x -> x - start), array(size(names)))")
    got = got.withColumn("_ends", ends).withColumn("_part", F.explode(F.expr(
        "transform(_ends, (x, i) -> struct(if(i = 0, 0, _ends[i - 1]) AS lo, x AS hi))")))
    part = [F.expr(f"slice({c}, _part.lo + 1, _part.hi - _part.lo)").alias(c) for c in ("names", "bytes")]
    return got.select("owner", "round", F.expr("if(_part.lo = 0, parent, element_at(names, greatest(_part.lo, 1)))").alias("parent"),
                      F.expr("start + _part.lo").alias("start"), *part)


def new_edges(missing: DataFrame, round_: int) -> DataFrame:
    """For each place and next turn, the conversation of the least name becomes an edge."""
    one = missing.groupBy(F.expr("element_at(names, at + 1)").alias("_next")).agg(
        F.min_by(F.struct("node", "at", "names", "bytes"), "node").alias("s"))
    rest = [F.expr(f"slice(s.{c}, s.at + 1, size(s.names))").alias(c) for c in ("names", "bytes")]
    return one.select(F.col("s.node").alias("owner"), F.lit(round_).alias("round"),
                      F.when(F.expr("s.at = 0"), root_name()).otherwise(F.expr("element_at(s.names, greatest(s.at, 1))")).alias("parent"),
                      F.col("s.at").alias("start"), *rest)


def build(distinct: DataFrame) -> tuple[DataFrame, int]:
    """(trie, rounds) of distinct conversations: node, names, bytes."""
    trie = distinct.sparkSession.createDataFrame([], TRIE)
    pending, round_ = distinct.where("size(names) > 0").withColumn("low", F.lit(0)), 0
    deepest = pending.agg(F.max(F.expr("size(names) - low"))).first()[0]
    while deepest:
        round_ += 1
        if round_ > 1:
            found = cut(search(pending, trie, deepest.bit_length()))
        else:
            found = pending.select("node", "names", "bytes", F.lit(0).alias("at"), F.lit(None).cast("binary").alias("edge"))
        missing = found.where("at < size(names)")
        trie = cut(cut_edges(trie, found.where("edge IS NOT NULL").select("edge", "at")).unionByName(new_edges(missing, round_)))
        brought = trie.where(F.col("round") == round_).select(F.col("owner").alias("node")).distinct()
        pending = missing.join(brought, "node", "left_anti").select("node", "names", "bytes", F.col("at").alias("low"))
        pending = cut(pending)
        deepest = pending.agg(F.max(F.expr("size(names) - low"))).first()[0]
    return trie, round_


# --- what the trie is asked ---

def members(convs: DataFrame) -> DataFrame:
    """Per node at which conversations end: ends_sha256 of their ids in order, by blocks of ids."""
    by = convs.groupBy("node", F.shiftright("conv_id", ID_BLOCK.bit_length() - 1).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    return by.repartition("node").sortWithinPartitions("node", "block").mapInArrow(member_digests, "node binary, ends_sha256 string")


def member_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams blocks in order of node and block."""
    at, digest = None, None
    out: tuple[list, list] = [], []

    def close():
        if digest is not None:
            out[0].append(at)
            out[1].append(digest.hexdigest())

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["node", "ends_sha256"])
        out[0].clear()
        out[1].clear()
        return made

    for b in batches:
        for name, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if name == at:
                digest.update(b"," + ids.encode())
            else:
                close()
                at, digest = name, hashlib.sha256(ids.encode())
        yield batch()
    close()
    yield batch()


def sums(trie: DataFrame, rounds: int, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with sums, the root's): n_convs, conv_id, n_leaves, n_children at an edge's node, below: the
    tokens saved below it.  ends: node, n_convs, conv_id.  Chains of the last round first."""
    given = [ends.select("node", "n_convs", "conv_id", *[F.lit(0).cast("long").alias(c) for c in ("n_leaves", "saved", "n_children")])]
    done = []
    for round_ in range(rounds, -1, -1):
        got = given[0]
        for g in given[1:]:
            got = got.unionByName(g)
        got = got.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved", "n_children")])
        if round_ == 0:
            return union(done), got.where(F.col("node") == root_name())
        edges = trie.where(F.col("round") == round_).withColumns({"node": node(), "size": F.expr("aggregate(bytes, 0L, (s, x) -> s + x)")})
        down = Window.partitionBy("owner").orderBy(F.desc("start"))
        so_far = down.rowsBetween(Window.unboundedPreceding, 0)
        own = edges.join(got, "node", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_convs", "n_leaves", "saved", "n_children")})
        last = F.row_number().over(down) == 1
        own = own.withColumns({"last": last, "first": F.row_number().over(Window.partitionBy("owner").orderBy("start")) == 1})
        own = own.withColumns({"n_children": F.col("n_children") + (~F.col("last")).cast("long"),
                               "n_leaves": F.when(F.expr("last AND n_children = 0"), 1).otherwise(F.col("n_leaves"))})
        own = own.withColumns({"n_convs": F.sum("n_convs").over(so_far), "conv_id": F.min("conv_id").over(so_far),
                               "n_leaves": F.sum("n_leaves").over(so_far)})
        own = own.withColumn("all", F.sum(F.expr("saved + (n_convs - 1) * size")).over(so_far))
        own = cut(own.withColumn("below", F.expr("all - (n_convs - 1) * size")).drop("saved", "last"))
        done.append(own)
        given.append(own.where("first").select(F.col("parent").alias("node"), "n_convs", "conv_id", "n_leaves", F.col("all").alias("saved"),
                                               F.lit(1).cast("long").alias("n_children")))


def union(tables: list[DataFrame]) -> DataFrame | None:
    out = None
    for t in tables:
        out = t if out is None else out.unionByName(t)
    return out


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def expanded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge as one row a node."""
    for b in batches:
        out: list[list] = [[] for _ in NODE.split(", ")]
        cols = ("conv_id", "parent_conv_id", "start", "bytes", "n_convs", "n_children", "n_leaves", "below", "ends_sha256")
        for conv, up, start, sizes, n, children, leaves, below, sha in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
            saved, rows = below, []
            for i in range(len(sizes), 0, -1):
                saved += (n - 1) * sizes[i - 1]
                last = i == len(sizes)
                rows.append((conv, start + i, up if i == 1 else conv, n, children if last else 1, leaves, saved,
                             sha if last and sha is not None else EMPTY_SHA))
            for column, values in zip(out, zip(*rows, strict=True), strict=True):
                column.extend(values)
        kinds = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                                         names=[c.split()[0] for c in NODE.split(", ")])


def nodes(convs: DataFrame) -> DataFrame:
    """Every node of the trie.  convs (a written table): conv_id, node, names, bytes."""
    ends = convs.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    trie, rounds = build(cut(convs.groupBy("node").agg(F.first("names").alias("names"), F.first("bytes").alias("bytes"))))
    edges, root = sums(trie, rounds, ends)
    shas = members(convs)
    top = root.join(shas, "node", "left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    if edges is None:
        return top
    least = root.agg(F.min("conv_id")).first()[0]
    at_root = F.col("start") == 0
    # edges at the root know their parent; they take part under names of their own, as the root may have most edges
    up = edges.select(F.col("node").alias("_up"), F.col("conv_id").alias("_up_conv"))
    got = edges.withColumn("_up", F.when(at_root, F.col("node")).otherwise(F.col("parent"))).join(up, "_up").join(shas, "node", "left")
    return got.withColumn("parent_conv_id", F.when(at_root, least).otherwise(F.col("_up_conv"))) \
        .select("conv_id", "parent_conv_id", "start", "bytes", "n_convs", "n_children", "n_leaves", "below", "ends_sha256") \
        .mapInArrow(expanded, NODE).unionByName(top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(cut(strings(rebuilt(cut(turns(table(spark, sf_dir, "conversations")))))))


#: Nodes by the digest of the whole prefix; leaves and savings over the ancestors of each node's least member.
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, {crc32_sql("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT k.c, i, role, text, 0 AS own FROM k JOIN t ON t.c = k.c - k.c % 5 AND i <= h
  UNION ALL SELECT k.c, i, role, text, 1 FROM k JOIN t ON t.c = k.c AND i > h),
r AS (SELECT c, row_number() OVER w AS d, strlen(text) AS bytes,
    md5(string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '') OVER w) AS node
  FROM u WINDOW w AS (PARTITION BY c ORDER BY own, i)),
m AS (SELECT c, d, bytes, node FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
n AS (SELECT node, any_value(m.d) AS depth, min(m.c) AS conv_id, count(*) AS n_convs, any_value(bytes) * (count(*) - 1) AS saved,
    sha256(coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (l.d = m.d), '')) AS ends_sha256 FROM m JOIN l USING (c) GROUP BY node),
p AS (SELECT n.*, m.node AS up FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.depth - 1),
x AS (SELECT up AS node, count(*) AS n_children FROM p WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT m.node, sum(p.saved) AS saved_tokens, count(*) FILTER (x.node IS NULL) AS n_leaves
  FROM p JOIN m ON m.c = p.conv_id AND m.d <= p.depth LEFT JOIN x ON x.node = p.node GROUP BY m.node)
SELECT p.conv_id, p.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, p.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, p.ends_sha256
FROM p JOIN s USING (node) LEFT JOIN x USING (node) LEFT JOIN n q ON q.node = p.up"""
