"""Operators that look at one text at a time."""

import hashlib
import html
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from laggard.llm import bpe, fertility, html_extract, license_scan, pii, simhash, toxicity, url_filter
from tests.conftest import SF
from tests.llm.conftest import frame


def texts_of(name="documents", cols="doc_id, text"):
    return duckdb.sql(f"SELECT {cols} FROM '{SF}/{name}.parquet'").fetchall()


# --- op1 ---

def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, max(fits, key=len) if fits else None


URLS = [None, "", "no scheme", "http://", "http://A.ORG", "http://A.ORG/", "http://a.org?x=/y", "x://example.org/es/1", "https://m.EXAMPLE.org/en/123#t",
        "http://notexample.org/es/", "http://b.com/de/1?q", "http://b.com/fr/", "http://com/fr/x", "http://b.com/DE/1", "a://b://c.org/x", "http://É.org/ü",
        "http://casino-win.example.net/en/5", "http://www.free-bets.example.com/es/1", "http://cheap-casino.example.net/x",
        "http://ththen.example.com/es/99", "http://" + "a" * 5000 + ".net/" + "b" * 5000]


def test_urls(spark):
    model = url_filter.train(spark)
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)] + [(None, "http://a.org/", 1, "y")], "page_id long, url string, rule int, host string")
    rows = url_filter.filter_urls(pages, model).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        url = "http://a.org/" if r.page_id is None else URLS[r.page_id]
        host, path, rule = brute_rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (dict(url_filter.RULES)[rule] if rule else "block" if r.score >= 0.5 else "allow")
    by = {URLS[r.page_id]: r.verdict for r in rows if r.page_id is not None}
    assert by["http://casino-win.example.net/en/5"] == by["http://cheap-casino.example.net/x"] == "block"
    assert by["http://ththen.example.com/es/99"] == by[""] == "allow"
    assert url_filter.filter_urls(pages.limit(0), model).count() == 0


def test_url_model_on_names_it_has_not_seen(spark):
    model = url_filter.train(spark)
    bad = ["casino-slots", "poker-bets", "spam-links", "cheap-viagra", "ads-banner", "xxx-adult"]
    good = ["river-news", "school-library", "ththon", "erhatan", "orchestra-club", "weather-archive"]
    pages = spark.createDataFrame([(i, f"http://{n}.example.net/en/7") for i, n in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, model).collect()}
    assert [got[i] for i in range(12)] == ["block"] * 6 + ["allow"] * 6


def test_url_model_on_held_out_names(spark):
    assert not {"ththing", "tiontion", "ereating", "onether", "thandor", "ention"} & set(url_filter.ALLOWED_WORDS)
    good = ["mountain-guide", "kitchen-garden", "parliament", "bicycle-repair", "violin-lessons", "harbour-pilot", "chemistry", "tiontion", "ththing"]
    bad = ["poker-room", "free-casino", "cheap-meds", "spam-farm", "payday-cash"]
    pages = spark.createDataFrame([(i, f"http://{n}.example.net/en/7") for i, n in enumerate(good + bad)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.train(spark)).collect()}
    assert [got[i] for i in range(len(got))] == ["allow"] * len(good) + ["block"] * len(bad)


# --- op2 ---

@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.load(bpe.vocabulary_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encoding_is_tiktokens(codec, tik):
    rnd = random.Random(3)
    chars = [*map(chr, range(0x250)), "\u0301", "\u200b", "\u2028", "\u3000", "語", "😀", " ", " ", "\n"]
    texts = ["".join(rnd.choices(chars, k=rnd.randint(1, 80))) for _ in range(400)] + ["a" * 9999, " " * 700, "<|endoftext|>", "ab" * 3000 + "\n\n x"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == tik.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_one_tree_and_many_trees_agree(codec):
    rnd = random.Random(4)
    for n in (1, 2, 3, 7, 8, 9, 33, 64):
        raws = [bytes(rnd.choices(b"abcdeth on\xc3\xa9", k=n)) for _ in range(50)]
        if n > 1:
            ids, counts = codec.merge_many(raws, (n - 1).bit_length())
            assert np.split(ids, np.cumsum(counts)[:-1])[7].tolist() == bpe.merge_pairs(raws[7], codec.ranks)
            assert ids.tolist() == [i for r in raws for i in bpe.merge_pairs(r, codec.ranks)]


def test_bpe_query_and_odd_rows(spark, tik, clashing, none):
    want = {}
    for r in clashing.collect():
        ids = tik.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[r.doc_id, r.text] = (len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest())
    got = bpe.digests(clashing).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == \
        Counter((r.doc_id, *want[r.doc_id, r.text]) for r in clashing.collect())
    assert bpe.digests(none).count() == 0
    again = bpe.decode(bpe.encode(clashing).withColumn("ids", F.when(F.size("ids") > 0, F.col("ids")))).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in again) == Counter((r.doc_id, r.text or "") for r in clashing.collect())
    full = {r.doc_id: r.ids_sha256 for r in bpe.query(spark, SF).collect()}
    assert full == {i: hashlib.sha256(",".join(map(str, tik.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in texts_of()}


def test_unknown_id(codec):
    with pytest.raises(ValueError):
        codec.decode([50256])


# --- op3 ---

def test_nnpu_finds_the_signal():
    rnd = np.random.default_rng(1)
    pos = [np.unique(np.r_[rnd.integers(0, 2), rnd.integers(10, 200, 20)]) for _ in range(300)]
    unl = [np.unique(np.r_[rnd.integers(10, 200, 20), rnd.integers(0, 2) if i % 10 == 0 else 20]) for i in range(2000)]
    kept = toxicity.screen(pos, unl)
    assert {0, 1} <= set(kept.tolist())
    w, b = toxicity.fit_nnpu(toxicity.rows_of(pos, kept), toxicity.rows_of(unl, kept), 0.1, len(kept))
    weight = dict(zip(kept.tolist(), w, strict=True))
    assert min(weight[0], weight[1]) + b > 0 > b


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    hit = [r.predicted for r in rows if labels[r.doc_id] == 1]
    false = [r.predicted for r in rows if labels[r.doc_id] == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.01


def test_toxicity_odd_rows(spark, clashing, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (9, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(clashing, labels)
    rows = toxicity.score(clashing, model).collect()
    assert len(rows) == clashing.count()
    assert len({r.score for r in rows if r.doc_id in (2, 3, 5)}) == 1
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0
    empty = toxicity.score(clashing, toxicity.train(clashing, labels.limit(0))).collect()
    assert {r.score for r in empty} == {0.0}


# --- op4 ---

CARD = "4111 1111 1111 1111"
PRIVATE = [
    (1, f"Mrs. Anna Schmidt <anna.s@mail.example.com> paid with {CARD}. Call +49 30 123 4567.", "en", "a"),
    (2, f"Frau Schmidt, ANNA.S@MAIL.EXAMPLE.COM, card {CARD.replace(' ', '')}, host 10.2.33.4 and 10.2.33.5", "de", "a"),
    (3, "Иван Петров; IBAN DE89 3704 0044 0532 0130 00; ssn 123-45-6789; password=hunter22x", "ru", "b"),
    (4, "Version 2.0 of 12.5 percent, 1234567890123456 is no card, 300.1.2.3 no address.", "en", "b"),
    (5, None, None, None), (6, "", "en", "a"), (2, "clean text of the same id", "en", "a"),
]


def test_surrogates(spark):
    docs = frame(spark, PRIVATE)
    rows = {(r.doc_id, r.lang): r for r in pii.replace(docs, count_col="found").collect()}
    one, two, three = rows[1, "en"].text, rows[2, "de"].text, rows[3, "ru"].text
    assert rows[4, "en"].text == PRIVATE[3][1] and rows[5, None].text is None and rows[6, "en"].text == "" and rows[4, "en"].found == 0
    for gone in ("Anna", "Schmidt", "anna.s@", CARD, "+49 30 123 4567"):
        assert gone not in one
    for gone in ("Schmidt", "ANNA.S", "10.2.33.4", "10.2.33.5"):
        assert gone not in two
    for gone in ("Иван", "Петров", "DE89", "123-45-6789", "hunter22x"):
        assert gone not in three
    # coreference in any format, distinctness, type and format
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", one)[0]
    assert card.replace(" ", "") in two and pii.luhn(card.replace(" ", "")) % 10 == 0 and card[0] == "4"
    mail = re.search(r"\S+@\S+(?=>)", one)[0].lstrip("<")
    assert mail.upper() in two
    family = re.match(r"Mrs\. (\w+) (\w+) ", one)
    assert two.startswith(f"Frau {family[2]},") and family[1] in pii.GIVEN_LISTS["f", "latin"]
    assert three.split()[0] in pii.GIVEN_LISTS["m", "cyrillic"]
    iban = re.search(r"IBAN (DE[\d ]+);", three)[1].replace(" ", "")
    assert pii.iban_rest(iban) == 1
    a, b = re.findall(r"\d+\.\d+\.\d+\.\d+", two)
    assert a != b
    assert re.search(r"Call \+\d\d \d\d \d{3} \d{4}\.$", one)


def test_surrogates_stay_distinct(spark):
    # more given names than the lists hold, and surrogates that are entities themselves
    names = [n for n in pii.GIVEN_LISTS["f", "latin"]]
    entities = spark.createDataFrame([("given-f-latin", n) for n in names] + [("given-f-latin", f"Name{i}") for i in range(60)]
                                     + [("ipv4", f"{i}.{j}.1.1") for i in range(1, 10) for j in range(1, 10)], "kind string, entity string")
    got = pii.assign(entities).collect()
    assert len(got) == len({(r.kind, r.entity) for r in got}) == entities.count()
    assert len({(r.kind, r.value) for r in got}) == len(got)
    real = {(r.kind, r.entity) for r in got}
    assert not any((r.kind, r.value) in real for r in got)


def test_masked_secrets_and_exhausted_formats(spark):
    masked = ["password: ********", "Password: ______ x", "token = ()=>{};", "key ghp_" + "_" * 36]
    new = {r.doc_id: r.text for r in pii.replace(frame(spark, [*enumerate(masked), (9, "password: ****a**")])).collect()}
    assert [new[i] for i in range(4)] == masked and re.fullmatch(r"password: [*]{4}[a-z][*]{2}", new[9]) and new[9] != "password: ****a**"
    # every surrogate of these formats is an entity itself
    entities = [("phone", f"10{i:03d}") for i in range(1000)] + [("secret", f"*****{c}") for c in "abcdefghijklmnopqrstuvwxyz"] + [("secret", "******")]
    got = pii.assign(spark.createDataFrame(entities, "kind string, entity string")).collect()
    assert {(r.kind, r.entity) for r in got} == set(entities) and len(got) == len(entities)
    values = {(r.kind, r.value) for r in got}
    assert len(values) == len(entities) and not values & set(entities)
    value = next(r.value for r in got if r.entity == "10500")
    assert pii.written("phone", "+1 05 00", value).translate(pii.ONLY_DIGITS) == value


def test_gates_and_forms():
    def kinds(t):
        return [(k, t[a:b]) for a, b, k, _ in pii.found(t)]
    mac = "DE-AD-BE-EF-CA-FE"
    assert kinds(mac) == kinds(mac + " and 2024")[:1] == [("mac", mac)] and kinds("de:ad:be:ef:ca:fe") == [("mac", "de:ad:be:ef:ca:fe")]
    for ip in ("2001:db8::1", "fe80::1", "2001:db8:0:0:0:0:0:1", "2001:0DB8:0000:0000:0000:0000:0000:0001", "2001:db8::"):
        assert kinds(f"at {ip}, up") == [("ipv6", ip)]
    for phone in ("06 12 34 56 78", "020 7946 0958", "555 123 4567", "+33 6 12 34 56 78", "(020) 7946 0958", "٥٥٥-١٢٣-٤٥٦٧", "+49 30 123 4567"):
        assert kinds(f"call {phone}.") == [("phone", phone)]
    iban = next(x for i in range(98) if pii.iban_rest(x := f"MT{i:02d}MALTABANKOFVALLETTA") == 1)
    assert kinds(iban) == [("iban", iban)]
    for none in ("std::vector a::b ::1 12::30", "1 2 3 4 5", "06 12 34 56 78 90 12", "in 2001, 300 100 20", "a-b-c-d-e-f-g"):
        assert kinds(none) == []
    # one entity in all its forms, each written in its own
    entities = {pii.found(x)[0][3] for x in ("2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:0db8:0000:0000:0000:0000:0000:0001")}
    assert len(entities) == 1
    value = pii.surrogate("ipv6", *entities, 0)
    assert re.fullmatch(r"[1-9a-f][0-9a-f]{3}:[1-9a-f][0-9a-f]{2}::[1-9a-f]", pii.written("ipv6", "2001:db8::1", value))
    assert {pii.canonical("ipv6", pii.written("ipv6", x, value)) for x in ("2001:db8::1", "2001:DB8:0:0:0:0:0:1")} == {value}
    assert pii.canonical("phone", "٥٥٥-١٢٣-٤٥٦٧") == "5551234567"


def test_private_data_odd_rows(spark, clashing, none):
    out = pii.replace(clashing)
    assert out.columns == clashing.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in clashing.collect())
    assert pii.replace(none).count() == 0


def test_private_data_of_a_table(spark):
    texts = dict(texts_of())
    new = {r.doc_id: r for r in pii.query(spark, SF).collect()}
    for i, t in texts.items():
        hits = pii.found(t)
        assert new[i].n_entities == len(hits)
        assert (new[i].text == t) == (not hits)
        for a, b, kind, _ in hits:
            assert t[a:b] not in new[i].text or kind.startswith("family")


# --- op5 ---

def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_rules(spark, clashing, none):
    rows = [(100 + i, t, "en", "s") for i, t in enumerate(["a b c d e a b c d e f", "x\nx\n \n \nx y\x1cz\u00a0q", "w " * 40, "#*$%&|<> #", "a b c d e f a b c d e"])]
    docs = clashing.unionByName(frame(spark, rows), allowMissingColumns=True)
    want = Counter((r.doc_id, *brute_base(r.text or "")) for r in docs.collect())
    got = fertility.score(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert fertility.score(none).count() == 0


def test_fertility_measures():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.vocabulary_path())
    text = "the cat sat on the 語𝄞 mat mat"
    meter = fertility.Meter(fertility.vocabulary_path())
    words = text.encode().split()
    meter.learn([words])
    _, chars, share, entropy = meter.measure(words, sum(len(w.decode()) for w in words))
    ids = [i for w in text.split() for i in model.encode(w)]
    p = np.array(list(Counter(ids).values())) / len(ids)
    assert chars == pytest.approx(len(text.replace(" ", "")) / len(ids))
    assert share == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
    assert entropy == pytest.approx(-(p * np.log2(p)).sum())


def test_fertility_verdicts(spark):
    sf = SF.replace("0.001", "0.1")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in fertility.query(spark, sf).collect() if r.doc_id in quality and r.n_words >= 10]
    good = [r.kept for r in rows if quality[r.doc_id] == 1]
    bad = [r.kept for r in rows if quality[r.doc_id] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_verdicts_do_not_depend_on_copies(spark):
    texts = duckdb.sql(f"""SELECT DISTINCT text FROM '{SF.replace("0.001", "0.1")}/documents.parquet' d JOIN
        '{SF.replace("0.001", "0.1")}/labels.parquet' l USING (doc_id) WHERE quality = 1 AND lang = 'en'
        AND len(string_split(text, ' ')) BETWEEN 140 AND 240 ORDER BY text LIMIT 60""").fetchall()
    rows = [(i, t, "en") for i, (t,) in enumerate(texts)]
    copies = [(1000 + i, rows[7][1], "en") for i in range(90)]
    alone, crowd = ({r.doc_id: r.kept for r in fertility.score(frame(spark, x)).collect() if r.doc_id < 1000} for x in (rows, rows + copies))
    assert len(rows) == 60 and crowd == alone and np.mean(list(crowd.values())) > 0.9


# --- op6 ---

def test_successors_and_near_fingerprints(spark):
    rows = {r.doc_id: r for r in simhash.query(spark, SF).collect()}
    texts = {i: t or "" for i, t in texts_of()}
    ids = sorted(texts, reverse=True)
    assert set(rows) == set(ids)
    marks = {i: int(rows[i].fingerprint, 16) for i in ids}
    for k, i in enumerate(ids):
        after, r = ids[(k + 1) % len(ids)], rows[i]
        assert r.edited_sha256 == hashlib.sha256(simhash.edited(texts[i], texts[after]).encode()).hexdigest()
        assert r.near_next == 1 - (marks[i] ^ marks[after]).bit_count() / 128
        assert r.near_edited == 1 - (marks[i] ^ int(r.edited_fingerprint, 16)).bit_count() / 128
        near = sum((marks[i] ^ m).bit_count() <= simhash.RADIUS for m in marks.values()) - 1
        assert r.near_count == (near if i % 100 == 0 else None)
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.97


@pytest.mark.parametrize(("radius", "blocks"), [(2, 3), (3, 4), (3, 6)])
def test_block_tables_lose_no_pair(spark, radius, blocks):
    rnd = random.Random(5)
    base = [rnd.getrandbits(128) for _ in range(8)]
    marks = [b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(0, 5))) for b in base for _ in range(12)] + base[:2]
    df = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    got = {r.fingerprint: r.n_near for r in simhash.near(df, df, radius, blocks).collect()}
    assert got == {f"{m:032x}": sum((m ^ x).bit_count() <= radius for x in marks) for m in marks}


def test_edited_copies_are_near(spark):
    rnd, texts = random.Random(8), [t.split() for _, t in texts_of() if t and 50 <= len(t.split()) <= 1500]
    rows, words = [], [w for t in texts for w in t]
    for i, own in enumerate(texts):
        new = list(own)
        for k in rnd.sample(range(len(own)), max(1, len(own) // 50)):
            new[k] = rnd.choice(words)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(new))]
    marks = simhash.fingerprints(frame(spark, rows)).cache()
    by = {r.doc_id: r.fingerprint for r in marks.collect()}
    plain = {i: int(m, 16) for i, m in by.items()}
    found = {r.fingerprint: r.n_near for r in simhash.near(marks, marks.where("doc_id % 2 = 0")).collect()}
    assert found == {by[i]: sum((plain[i] ^ m).bit_count() <= simhash.RADIUS for m in plain.values()) for i in by if i % 2 == 0}
    assert np.mean([found[by[i]] > 1 for i in by if i % 2 == 0]) > 0.95
    assert np.median(list(found.values())) == 2  # the text and its copy, no other


@pytest.mark.parametrize(("radius", "blocks"), [(7, 3), (9, 4), (19, 10), (4, 128)])
def test_keys_with_flipped_bits_lose_no_pair(spark, radius, blocks):
    rnd = random.Random(5)
    base = [rnd.getrandbits(128) for _ in range(4)]
    marks = [b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(0, 20))) for b in base for _ in range(12)] + base[:2] + [0, 1]
    df = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    got = {r.fingerprint: r.n_near for r in simhash.near(df, df, radius, blocks).collect()}
    assert got == {f"{m:032x}": sum((m ^ x).bit_count() <= radius for x in marks) for m in marks}


def test_simhash_odd_rows(spark, clashing, none):
    rows = simhash.with_successor(clashing).collect()
    assert len(rows) == clashing.count()
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"0" * 32}
    assert simhash.with_successor(none).count() == 0
    alone = simhash.with_successor(frame(spark, [(5, "only one text here")])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(5, 1.0)]
    assert Counter(r.doc_id for r in simhash.fingerprints(clashing).collect()) == Counter(r.doc_id for r in clashing.collect())


# --- op8 ---

def test_license_scan(spark, clashing, none):
    rows = [(50, "Released under the MIT License, under the mit-license; CC BY\nNC"), (51, "Content licensed CC BY-NC 4.0."),
            (52, "released under the BSD 3-clause license"), (53, "released under the gnu\nlesser general public license"), (54, "mit license")]
    docs = clashing.unionByName(frame(spark, rows), allowMissingColumns=True)
    got = {r.doc_id: r for r in license_scan.scan(docs).collect() if (r.doc_id or 0) >= 50}
    assert (got[50].n_base, got[50].first_word, got[50].last_word, got[50].base_labels) == (3, 1, 9, "cc-by-nc,mit")
    assert got[51].labels == "cc-by-nc" and got[51].score == 1.0
    assert got[52].labels == "bsd-3-clause" and got[52].base_labels == ""
    assert got[53].labels == "" and got[54].labels == "" and got[54].score == 0
    assert license_scan.scan(docs).count() == docs.count()
    assert license_scan.scan(none).count() == 0


def brute_license(text, threshold):
    out = set()
    for line in license_scan.re.findall(r"[^\n]+", text):
        words = set(re.findall(license_scan.TOKEN, line.translate(license_scan.ASCII_LOWER)))
        out |= {label for label, t in license_scan.template_sets() if len(words & set(t)) / len(t) >= threshold - 1e-12}
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_containment_join_is_exact(spark, threshold):
    rnd = random.Random(6)
    words = sorted({w for _, t in license_scan.template_sets() for w in t}) + ["zebra", "quilt"]
    texts = ["\n".join(" ".join(rnd.choices(words, k=rnd.randint(1, 25))) for _ in range(4)) for _ in range(120)]
    texts += [t[0] for t in license_scan.TEMPLATES]
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, list(enumerate(texts))), threshold=threshold, phrases=()).collect()}
    for i, t in enumerate(texts):
        assert got[i].labels == ",".join(sorted(brute_license(t, threshold)))


# --- op9 ---

def test_labelled_pages_and_tree():
    tree = html_extract.default_tree()
    for page, kept in html_extract.labelled_pages():
        blocks = html_extract.blocks_of(page)
        assert html_extract.main_text(page, tree) == "\n".join(b[0] for b, k in zip(blocks, kept, strict=True) if k)


def test_article_of_a_page():
    prose = "It was a long walk from the station to the sea, and nobody in the group had brought any water along."
    page = (f"<html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'><form id=f><header>Site</header><nav><a href=/>Home</a></nav>"
            f"<main><article><h1>Sea &amp; sand</h1><p title='a>b'>{prose}<script>if (a<b) '</p>'</script><p>Second\n  <b>bold</b>&nbsp;text, un<i>bro</i>ken.<br>"
            f"<div class='ad-box'>{prose}</div><!-- <p>no</p> --><ul><li>First thing<li>Second thing</ul></article>"
            f"<section id='comments'><p>{prose}</p></section></main><aside><p>{prose}</p></aside><div class='cookie-banner'>{prose}</div></form><footer>{prose}")
    assert html_extract.main_text(page, html_extract.default_tree()).split("\n") == \
        ["Sea & sand", prose, "Second bold text, unbroken.", "First thing", "Second thing"]


def test_extraction_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (None, "v", "<p", 3), (4, "w", "<article><p>" + "long " * 50000, 4), (4, "w", "<script>", 5)],
                                  "page_id long, url string, html string, text int")
    rows = html_extract.extract(pages).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in rows) == Counter([(1, "u", 0), (2, None, 0), (None, "v", 0), (4, "w", 249999), (4, "w", 0)])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pages_of_a_table(spark):
    for r in html_extract.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", inner)
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", blocks)]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)

