"""The prefix trie, the repair of conversations, and sharding."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from laggard.llm import prefix_trie, queries, sharding, turn_repair
from laggard.llm.common import number
from tests.conftest import SF

CONV = "conv_id long, turn long, role string, text string"


def told(df, names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_turn_repair", "op13_feistel_shards"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert told(got, names) == Counter(res.fetchall())


def conversations(spark, rows):
    return spark.createDataFrame(rows, CONV)


@pytest.fixture
def odd_turns(spark):
    """Nulls in every column, ties, repeated rows, empty and long texts, foreign roles."""
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, None, "A."), (1, None, "system", None), (2, None, None, None),
            (None, 0, "user", "No id."), (None, 1, "assistant", "None."), (3, 0, "tool", "x" * 300000), (3, 0, "", ""), (3, 7, "assistant", "Out. "),
            (4, 5, "system", "S."), (4, 6, "system", " \n\t"), (0, 1, "user", "é.!?"), (0, 2, "assistant", "Hm")]
    return conversations(spark, rows)


# --- op11 ---

def brute_trie(rows):
    """Nodes by the prefix itself."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [t for _, _, t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
        ends[whole[c]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"") + sum(saved[q] for q in children[p])
    return Counter((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p in members)


NODE = [c.split()[0] for c in prefix_trie.NODE.split(", ")]


def trie_of(df):
    return told(prefix_trie.nodes(prefix_trie.cut(prefix_trie.strings(prefix_trie.rebuilt(prefix_trie.turns(df))))), NODE)


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_prefixes(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), 150):
        shared = rnd.randint(0, 3) == 0
        for t in range(rnd.choice([1, 2, 3, 5, 8, 9, 40])):
            rows.append((c, t, "user", "the same turn" if shared else rnd.choice("ab") * rnd.randint(1, 2)))
    rows += [(1000, t, "user", "a" if t < 200 else "é") for t in range(260)] + [(1001, t, "user", "a") for t in range(230)]
    assert trie_of(conversations(spark, rows)) == brute_trie(rows)


def test_trie_of_copies(spark):
    """One conversation in most rows: ids in several blocks, one edge."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 12000, 5) for t in range(2)] + [(-5, 0, "user", "t0"), (7, 0, "user", "t0")]
    assert trie_of(conversations(spark, rows)) == brute_trie(rows)


def test_trie_takes_odd_rows(spark, odd_turns):
    rows = [tuple(r) for r in odd_turns.collect()]
    clashing = odd_turns.withColumns({n: F.lit(1) for n in ("node", "names", "bytes", "low", "at", "edge", "start", "owner", "t", "h")})
    assert trie_of(clashing) == brute_trie(rows)
    assert not trie_of(odd_turns.where("false"))
    assert trie_of(odd_turns.where("conv_id = 2")) == brute_trie([r for r in rows if r[0] == 2])


def test_handles_are_the_fattest(spark):
    pairs = [(a, b) for a in range(70) for b in range(a + 1, 70)]
    got = spark.createDataFrame(pairs, "low int, high int").selectExpr("low", "high", f"{prefix_trie.fattest('low', 'high')} AS f").collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


# --- op12 ---

def suffix_repair(rows):
    """(cost, audit, lines) by least (cost, audit) of every suffix: a plain recursion over rows and roles."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last):
        out = []
        if i == len(rows):
            if last in ("", "a"):
                out.append((0, "", ()))
        else:
            role, text, gone, cut = rows[i]
            cost, audit, lines = best(i + 1, last)
            out.append((cost + 4, "D" + audit, lines))
            if not gone:
                extra = 3 if cut else 0
                if role[:1] and role[:1] in legal[last]:
                    cost, audit, lines = best(i + 1, role[:1])
                    out.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                for new in ("user", "assistant"):
                    if new[0] in legal[last]:
                        cost, audit, lines = best(i + 1, new[0])
                        out.append((cost + extra + 3, "R" + audit, (f"{new}:{text}", *lines)))
        return min(out + [x for x in inserted(i, last, 2)], default=(10 ** 9, "", ()), key=lambda x: x[:2])

    def inserted(i, last, left):
        for new in ("user", "assistant"):
            if left and new[0] in legal[last]:
                cost, audit, lines = best_without(i, new[0]) if left == 1 else best_two(i, new[0])
                yield cost + 3, "I" + audit, (f"{new}:", *lines)

    @cache
    def best_without(i, last):
        out = []
        if i == len(rows):
            return (0, "", ()) if last in ("", "a") else (10 ** 9, "", ())
        role, text, gone, cut = rows[i]
        cost, audit, lines = best(i + 1, last)
        out.append((cost + 4, "D" + audit, lines))
        if not gone:
            extra = 3 if cut else 0
            if role[:1] and role[:1] in legal[last]:
                cost, audit, lines = best(i + 1, role[:1])
                out.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
            for new in ("user", "assistant"):
                if new[0] in legal[last]:
                    cost, audit, lines = best(i + 1, new[0])
                    out.append((cost + extra + 3, "R" + audit, (f"{new}:{text}", *lines)))
        return min(out, key=lambda x: x[:2])

    @cache
    def best_two(i, last):
        return min([best_without(i, last), *inserted(i, last, 1)], key=lambda x: x[:2])

    return best(0, "")


def brute_repair(rows):
    """Per conversation the expected row of repair(); rows: conv_id, turn, role, text in any order."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), hashlib.md5(f"{role}\0{text}".encode()).digest(), turn, role, text))
    out = {}
    for c, ts in convs.items():
        ts.sort(key=lambda x: x[:2])
        seen, faults, plain = set(), Counter(), []
        for _, _, _, role, text in ts:
            words = text.strip(" \t\n\v\f\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for _, _, t, _, _ in ts if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(plain)]
        cost, audit, lines = suffix_repair(plain)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    return {r.conv_id: tuple(r[c] for c in (*turn_repair.COUNTS, "audit", "repaired_sha256")) for r in turn_repair.repair(df).collect()}


def some_turns(seed, n=120, most=9):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t", "Yes. ", "a\nb."]
    return [(c, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "tool", "", "u", " "]), rnd.choice(texts) + rnd.choice(["", str(i), f"{i}."]))
            for c in range(n) for i in range(rnd.randint(1, most))]


@pytest.mark.parametrize(("segment", "seed"), [(4096, 1), (3, 2), (8, 3)])
def test_repair_is_the_cheapest(spark, monkeypatch, segment, seed):
    """Segments shorter than conversations must not change anything."""
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    rows = some_turns(seed) + some_turns(seed + 10, 2, 60)[:90]
    assert repaired(conversations(spark, rows)) == brute_repair(rows)


def test_suffix_minimum_is_the_least_audit():
    """The brute force itself against all edit sequences of short conversations."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def every(rows, i, last, inserts):
        if i == len(rows) and last in ("", "a"):
            yield 0, ""
        if inserts:
            for new in "ua":
                if new in legal[last]:
                    yield from ((c + 3, "I" + a) for c, a in every(rows, i, new, inserts - 1))
        if i < len(rows):
            role, _, gone, cut = rows[i]
            yield from ((c + 4, "D" + a) for c, a in every(rows, i + 1, last, inserts))
            if not gone:
                for new, letter, cost in ((role[:1], "K", 0), ("u", "R", 3), ("a", "R", 3)):
                    if new and new in legal[last]:
                        yield from ((c + cost + 3 * cut, letter + a) for c, a in every(rows, i + 1, new, inserts))

    rnd = random.Random(5)
    for _ in range(300):
        rows = [(rnd.choice(["user", "assistant", "system", "x"]), "t", rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randint(0, 4))]
        assert min(every(rows, 0, "", 4)) == suffix_repair(rows)[:2]


def test_block_tables_equal_single_steps():
    t = turn_repair.blocks()
    rnd = random.Random(0)
    for _ in range(200):
        symbols = bytes(rnd.randrange(9) for _ in range(rnd.randint(1, 30)))
        codes = t.codes(symbols)
        to, grow = t.through(codes)
        for v, costs in enumerate(t.vectors):
            for s in reversed(symbols):
                costs = turn_repair.before(costs, s)
            assert tuple(c + grow[v] for c in t.vectors[to[v]]) == costs


def test_repaired_rows_are_legal(spark):
    rows = some_turns(7)
    numbered, edits, _ = turn_repair.plan(conversations(spark, rows))
    got = defaultdict(list)
    for r in turn_repair.repaired_rows(numbered, edits).orderBy("conv_id", "position").collect():
        got[r.conv_id].append((r.role, r.text))
    want = {c: v[-1] for c, v in brute_repair(rows).items()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got[c]).encode()).hexdigest() for c in want if got[c]} == {c: h for c, h in want.items() if h != empty}


def test_repair_takes_odd_rows(spark, odd_turns):
    rows = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in map(tuple, odd_turns.collect())]
    clean = odd_turns.fillna(" ", ["role", "text"])
    assert repaired(clean) == brute_repair(rows)
    clashing = odd_turns.withColumns({n: F.lit(1) for n in ("copy", "fault", "symbol", "_row", "edit", "kind", "at", "n", "audit")})
    got = turn_repair.all_conversations(clashing, turn_repair.repair(turn_repair.damaged(clashing))).collect()
    assert {r.conv_id for r in got} == {r[0] for r in rows} and len(got) == 6
    none = odd_turns.where("false")
    assert turn_repair.all_conversations(none, turn_repair.repair(turn_repair.damaged(none))).count() == 0


# --- op13 ---

@pytest.mark.parametrize("n", [*range(1, 70), 1000, 4095, 4096, 4097])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = sharding.permute(x, n)
    assert sorted(y) == list(x) and (sharding.permute(y, n, inverse=True) == x).all()
    shard, slot = sharding.place(x, n, 7)
    assert (sharding.row_at(shard, slot, n, 7) == x).all()


def test_feistel_mixes():
    """Neighbouring rows fall into all shards, and other seeds give other orders."""
    n = 40_000
    shard, slot = sharding.place(np.arange(n), n)
    after = np.histogram2d(shard[:-1], shard[1:], bins=40)[0]
    assert abs(after - (n - 1) / 1600).max() < 6 * (n / 1600) ** 0.5
    assert abs(np.corrcoef(np.arange(n), slot)[0, 1]) < 0.03
    assert (sharding.permute(np.arange(n), n) != sharding.permute(np.arange(n), n, "another")).mean() > 0.99


def shards_of(df, **kw):
    return Counter(tuple(r) for r in sharding.shard(df, **kw).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect())


def brute_shards(rows, shards):
    """rows: doc_id, text.  The network by plain integers."""
    def one(x, n):
        a, b = sharding.half_bits(n)
        left, right = x >> b, x & ((1 << b) - 1)
        for k, (m, m2, c) in enumerate(sharding.round_keys()):
            v = ((left if k % 2 else right) * m + c) % sharding.PRIME
            v = (v ^ (v >> 15)) * m2 % sharding.PRIME
            v ^= v >> 13
            if k % 2:
                right ^= v & ((1 << b) - 1)
            else:
                left ^= v & ((1 << a) - 1)
        return left << b | right

    def key(r):
        text = (r[1] or "").encode()
        return (r[0] is not None, r[0] or 0, zlib.crc32(text), hashlib.md5(text).digest())

    out, n = Counter(), len(rows)
    for x, r in enumerate(sorted(rows, key=key)):
        y = one(x, n)
        while y >= n:
            y = one(y, n)
        text = (r[1] or "").encode()
        out[r[0], len(text) + 16, zlib.crc32(text), "rows", y % shards, y // shards, None] += 1
    return out


def test_shards_equal_a_plain_loop(spark, odd, clashing, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert shards_of(odd, shards=4) == shards_of(clashing.repartition(7), shards=4) == brute_shards(rows, 4)
    assert shards_of(odd, shards=50) == brute_shards(rows, 50)
    assert not shards_of(none)
    same = spark.range(3000).selectExpr("1L AS doc_id", "'one text' AS text").unionByName(spark.range(500).selectExpr("id AS doc_id", "'t' AS text"))
    got = shards_of(same)
    assert got == brute_shards([tuple(r) for r in same.collect()], 40)
    counts = Counter()
    for k, v in got.items():
        counts[k[4]] += v
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 40


def test_written_shards(spark, clashing, tmp_path):
    got = sharding.shuffled(clashing, 3)
    assert got.columns == [*clashing.columns, "_shard", "_slot"]
    sharding.write_shards(clashing, f"{tmp_path}/s", 3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert told(back, ["doc_id", "text", "_shard", "_slot"]) == told(got, ["doc_id", "text", "_shard", "_slot"])


def test_numbers_follow_the_order(spark):
    rows = [(i * 7919 % 1000 or None, i % 3) for i in range(2500)]
    got = sorted((r._row, r.a, r.b) for r in number(spark.createDataFrame(rows, "a long, b long").repartition(9), "a", "b").collect())
    assert [r[0] for r in got] == list(range(2500))
    assert [(a, b) for _, a, b in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
