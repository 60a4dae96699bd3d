"""Operators over the whole corpus, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from laggard.llm import bpe, jaccard_join, license_scan, mixing, pii, queries, toxicity
from tests.conftest import SF
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def oracle(sql, sf=SF):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(names, row, strict=True))) for row in res.fetchall())


@pytest.mark.parametrize(("name", "sql"), [("op7_source_mixing", mixing.ORACLE), ("op8_license_scan", license_scan.ORACLE),
                                           ("op10_ngram_jaccard", jaccard_join.ORACLE)])
def test_sql(spark, name, sql):
    rows = queries.QUERIES[name](spark, SF).collect()
    got = Counter(tuple(round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.asDict().items())) for r in rows)
    assert got == oracle(sql)


# --- op7 ---

def water_level(sizes, weights, total):
    """Targets by repeated resharing; sizes: (source, size) in order."""
    target, left, open_ = {}, total, dict(sizes)
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    while open_:
        rate = left / sum(w[s] for s in open_)
        full = [s for s in open_ if rate * w[s] > 2 * open_[s]]
        if not full:
            return target | {s: rate * w[s] for s in open_}
        for s in full:
            target[s] = 2 * open_.pop(s)
            left -= target[s]
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), "en", rnd.choice(["a", "b", "c", "é", None, "B"] if i % 3 else ["a"])) for i in range(400)]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    size = Counter()
    for i, t, _, s in rows:
        assert got[i].size == len(t.split())
        size[s] += got[i].size
    order = sorted(size, key=lambda s: (s is None, s))
    want = water_level([(s, size[s]) for s in order], mixing.WEIGHTS, 1.5 * sum(size.values()))
    taken = Counter()
    for i, _, _, s in rows:
        assert got[i].source_size == size[s] and got[i].target == pytest.approx(want[s])
        assert 0 <= got[i].taken <= 2 * got[i].size
        taken[s] += got[i].taken
    for s in order:
        assert taken[s] == round(want[s])
    assert got == {r.doc_id: r for r in mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()}


def test_copies_are_what_the_mix_takes(spark):
    rows = [(i, "  lead " + " ".join(f"x{j}" for j in range(i % 37)) + "\n", "en", "ab"[i % 2]) for i in range(80)]
    docs = frame(spark, rows).withColumns({"size": F.lit("s"), "key": F.lit("k"), "full": F.lit(1), "rest": F.lit(2)})
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    text, seen = dict((r[0], r[1]) for r in rows), Counter()
    for r in copies.collect():
        seen[r.doc_id] += len(WORD.findall(r.text))
        assert text[r.doc_id].startswith(r.text)
    assert seen == Counter({i: n for i, n in taken.items() if n})


def test_mix_odd_rows(spark, clashing, none):
    rows = mixing.mix(clashing).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in clashing.collect())
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_copies(none).count() == 0
    blank = frame(spark, [(1, None, "en", "a"), (2, " ", "en", "b")])
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


def test_rows_of_one_key_share_the_cut(spark):
    rows = [(7, "one two three four", "en", "a")] * 10 + [(8, "x " * 200, "en", "b")]
    got = mixing.mix(frame(spark, rows)).where("doc_id = 7").collect()
    assert len({r.taken for r in got}) == 1 and abs(sum(r.taken for r in got) - got[0].target) < 10


# --- op10 ---

def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """rows: (key, id, text); key -> (set size, component, links)."""
    sets = {k: shingle_set(t) for k, _, t in rows}
    ids = {k: i for k, i, _ in rows}
    inverse = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            inverse[x].append(k)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = Counter()
    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in inverse[x] if j != k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links[k] += 1
                a, b = find(k), find(j)
                if a != b:
                    root[a] = b
    least = {}
    for k in sets:
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return {k: (len(s), least.get(find(k)) if s else ids[k], links[k]) for k, s in sets.items()}


def variants(rnd, words, n, edits):
    for _ in range(n):
        w = list(words)
        for _ in range(rnd.randint(0, edits)):
            at = rnd.randrange(len(w))
            w[at:at + 1] = rnd.choice([[], [f"e{rnd.randrange(999)}"], [w[at], "extra"]])
        yield " ".join(w)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for n in (1, 4, 5, 6, 12, 40, 90, 200):
        base = rnd.choices(vocabulary, k=n)
        texts += variants(rnd, base, 12, max(1, n // 25))
        texts += [" ".join(base).upper()] * 3
    texts += [" ".join(rnd.choices(vocabulary, k=30) + passage + rnd.choices(vocabulary, k=rnd.choice([5, 30]))) for _ in range(30)]
    return texts


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("block", "batch"), [(768, 1_000_000), (5, 800)])
def test_join_is_exact(spark, monkeypatch, seed, block, batch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BATCH_TOKENS", batch)
    texts = corpus(seed)
    want = brute_components([(i, i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.classes(frame(spark, list(enumerate(texts)))).collect()}
    assert got == want


def test_join_of_a_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.query(spark, SF).collect()}
    assert got == brute_components(rows)


def test_trie_prunes_but_loses_nothing():
    rnd = np.random.default_rng(2)
    tokens = [np.unique(rnd.integers(0, 40, rnd.integers(3, 30))).astype(np.uint64) for _ in range(80)]
    sizes = np.array([len(t) + int(rnd.integers(0, 3)) for t in tokens])
    every = np.arange(80)
    for left, right in ((every, every), (every[:30], every[30:])):
        i, j = jaccard_join.join_sets(every.astype(np.int64), sizes, tokens, left, right, step=7)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        sets = [set(t.tolist()) for t in tokens]
        want = {(a, b) for a in range(80) for b in range(a + 1, 80) if (len(left) == 80 or (a < 30 <= b))
                and 175 * len(sets[a] & sets[b]) >= 75 * (sizes[a] + sizes[b])}
        assert got == want and len(got) == len(i)


def test_join_odd_rows(clashing, none, spark):
    rows = [(k, r.doc_id, r.text) for k, r in enumerate(clashing.collect())]
    want = Counter((i, *brute_components(rows)[k]) for k, i, _ in rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.classes(clashing).collect()) == want
    assert jaccard_join.classes(none).count() == 0 and jaccard_join.deduplicate(none).count() == 0
    left = jaccard_join.deduplicate(clashing)
    assert left.columns == clashing.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 1, 2, 3, None, None, 4, 5, 6, 7])


def test_labels_shrink_to_the_least(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)] + [(-5, 200), (-5, -9)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


# --- the pipeline ---

def test_stages_name_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "private_data", "source_mix", "encoding"]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, tables = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, SF).write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(left)
        assert k == 4 or left.columns == docs.columns
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:3]]
    start = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    assert set(rows[0]) == set(start) - toxic and all(rows[0][i] == start[i] for i in rows[0])
    parts = brute_components([(i, i, r.text) for i, r in rows[0].items()])
    assert set(rows[1]) == {i for i, (_, c, _) in parts.items() if c == i} and all(rows[1][i] == start[i] for i in rows[1])
    assert set(rows[2]) == set(rows[1])
    for i, r in rows[2].items():
        assert (r.text == start[i].text) == (not pii.found(start[i].text)) and r.n_chars == len(r.text)
    size = Counter()
    for r in rows[2].values():
        size[r.source] += len(WORD.findall(r.text))
    want = water_level(sorted(size.items()), mixing.WEIGHTS, 1.5 * sum(size.values()))
    taken, mixed = Counter(), Counter()
    for r in tables[3].collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert rows[2][r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
        mixed[r.doc_id, r.text] += 1
    assert {s: round(t) for s, t in want.items()} == taken
    codec = bpe.Codec.load(bpe.vocabulary_path(), bpe._pattern())
    assert Counter((r.doc_id, codec.decode(r.ids).decode()) for r in tables[4].collect()) == mixed


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (3, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        extra = odd.withColumn("score", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("__own", F.lit(2))
        out = stage(spark, extra, str(tmp_path))
        assert out.count() > 0 and (name == "encoding" or out.columns == extra.columns)
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "ids"} <= set(rows.columns)
    assert corpus_pipeline.ORACLE_SQL is None
