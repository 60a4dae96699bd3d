"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, as the set of its words.  Only words of some template can count for a
containment, so blocks keep just those; they are ordered by how many blocks of the whole
table have them, rarest first.  A block and a template T whose containment |B n T| / |T| is
at least the threshold share a word among the first |B| - a + 1 and |T| - a + 1 in that
order (a = ceil(threshold * |T|)); candidates come from an equi-join on those prefix words,
behind the length filter |B| >= a and the positional filter, and their exact containment is
then computed.  DataFrame functions only.

Defined results: a null or empty text has no words, no places, no labels (empty strings) and
a score of 0; rows that repeat an id with the same text get the same result each; a template
of no words is left out.  Only the id and the text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import ASCII_LOWER, ascii_lower, cut, table

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of the template's words; short notices must stand there whole, or one license's would pass for another's.
THRESHOLD = 0.9
#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices in our own words and their labels; a label may have several.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this file is distributed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("this project is available under the terms of the mit license", "mit"),
    ("content licensed cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("dedicated to the public domain under creative commons zero", "cc0"),
    ("released under the gnu general public license version 3", "gpl-3"),
    ("released under the gnu general public license version 2", "gpl-2"),
    ("released under the gnu lesser general public license", "lgpl"),
    ("released under the gnu affero general public license", "agpl"),
    ("released under the bsd 3 clause license", "bsd-3-clause"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("copyright all rights reserved no part may be reproduced without permission", "all-rights-reserved"),
)


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    sets = [(label, list(dict.fromkeys(re.findall(TOKEN, text.translate(ASCII_LOWER))))) for text, label in templates]
    return [(label, words) for label, words in sets if words]


def needed(n: int, threshold: float) -> int:
    """Least overlap of a template of n words."""
    return max(1, math.ceil(round(threshold * n, 9)))


def line_words(text: Column) -> Column:
    """Words of each line of the lower-cased text."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n")
    return F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells a row's result apart: its id and a hash of its text."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h")]


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def stands(tokens: list[str]):
    """Whether the tokens stand in _words from place i on."""
    def at(i):
        hit = F.lit(True)
        for k, t in enumerate(tokens):
            hit = hit & (F.get("_words", i + F.lit(k)) == t)
        return hit
    return at


def digest(docs: DataFrame, vocabulary: list[str], least: int, phrases=PHRASES, id_col="doc_id",
           text_col="text") -> DataFrame:
    """The one pass over the texts: _id, _h, n_words, places and labels of the base phrases, the
    template words of every block as numbers of the vocabulary, blocks after one another (seen),
    and those of at least ``least`` words each by itself (blocks)."""
    vocab = words_array(vocabulary)
    lines = docs.select(*row_key(id_col, text_col), line_words(F.col(text_col)).alias("_lines"))
    kept = F.transform("_lines", lambda x: F.array_intersect(x, vocab))
    df = lines.select("_id", "_h", F.flatten("_lines").alias("_words"), kept.alias("_kept"))
    df = df.withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    all_places, labels = [F.array().cast("array<int>")], [F.lit(None).cast("string")]
    for phrase, label in phrases:
        tokens = phrase.split()
        starts = F.when(F.size("_words") >= len(tokens), F.sequence(F.lit(0), F.size("_words") - F.lit(len(tokens))))
        has = F.contains("_line", F.lit(f" {phrase} "))
        all_places.append(F.when(has, F.filter(starts, stands(tokens))).otherwise(F.array().cast("array<int>")))
        labels.append(F.when(has, F.lit(label)))
    numbers = F.transform(F.flatten("_kept"), lambda w: F.array_position(vocab, w).cast("short"))
    return df.select("_id", "_h", F.size("_words").cast("long").alias("n_words"), F.concat(*all_places).alias("_places"),
                     F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("_base"),
                     numbers.alias("seen"), F.filter("_kept", lambda x: F.size(x) >= least).alias("blocks"))


def frequency_order(digested: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, those of the fewest blocks first.  The table that comes to the
    driver has one row per word of a template, whatever the size of the corpus."""
    seen = {vocabulary[r["i"] - 1]: r["n"] for r in digested.select(F.explode("seen").alias("i"))
            .groupBy("i").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def template_prefixes(spark: SparkSession, sets, order: list[str], threshold: float) -> DataFrame:
    """word, i (its place in the template's order), n, need, label, tokens: one row per prefix word."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words in sets:
        words = sorted(words, key=rank.__getitem__)
        need = needed(len(words), threshold)
        for i, w in enumerate(words[:len(words) - need + 1]):
            rows.append("('{}', {}, {}, {}, '{}', split('{}', ' '))".format(w, i, len(words), need, label, " ".join(words)))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(word, i, n, need, label, tokens)")


def similar_blocks(digested: DataFrame, sets, order: list[str], threshold: float) -> DataFrame:
    """_id, _h, label, containment: every (block, template) at the threshold, found once for each
    prefix word that they share."""
    least = min(needed(len(words), threshold) for _, words in sets)
    found = digested.select("_id", "_h", F.explode("blocks").alias("block")) \
        .select("_id", "_h", F.array_intersect(words_array(order), "block").alias("words"))
    found = found.select("*", F.size("words").alias("m"), F.posexplode(F.expr(f"slice(words, 1, size(words) - {least} + 1)"))
                         .alias("j", "word"))
    pairs = found.join(template_prefixes(digested.sparkSession, sets, order, threshold), "word") \
        .where("m >= need AND j <= m - need AND least(n - i, m - j) >= need")  # length, prefix and positional filters
    overlap = F.size(F.array_intersect("words", "tokens"))
    return pairs.where(overlap >= F.col("need")).select("_id", "_h", "label", (overlap / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, id_col="doc_id",
         text_col="text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    sets = template_sets(templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    base = cut(digest(docs, vocabulary, min(needed(len(w), threshold) for _, w in sets), phrases, id_col, text_col))
    found = similar_blocks(base, sets, frequency_order(base, vocabulary), threshold) \
        .groupBy("_id", "_h").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("score"))
    a, b = base.drop("seen", "blocks").alias("a"), found.alias("b")
    more = F.coalesce(F.col("_more"), F.array().cast("array<string>"))
    return a.join(b, F.expr("a._id <=> b._id AND a._h = b._h"), "left") \
        .select(F.col("a._id").alias(id_col), "n_words", F.size("_places").cast("long").alias("n_base"),
                F.array_min("_places").cast("long").alias("first_word"),
                F.array_max("_places").cast("long").alias("last_word"),
                F.array_join("_base", ",").alias("base_labels"),
                F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
                F.coalesce("score", F.lit(0.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every line against every template, by set sizes."""
    rows = ", ".join("({}, {}, '{}')".format("['" + "','".join(words) + "']", needed(len(words), THRESHOLD), label)
                     for label, words in template_sets())
    token = TOKEN
    phrase_rows = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{token}') AS ws FROM d),
t(tokens, need, label) AS (VALUES {rows}),
p(phrase, label, k) AS (VALUES {phrase_rows}),
places AS (SELECT r, label, unnest(list_filter(range(len(ws)::BIGINT), lambda i: array_to_string(ws[i + 1:i + k], ' ') = phrase)) AS place
           FROM w, p WHERE contains(t, split_part(phrase, ' ', 1)) AND contains(array_to_string(ws, ' '), phrase)),
b AS (SELECT r, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS ls FROM places GROUP BY r),
lines AS (SELECT r, list_distinct(regexp_extract_all(x, '{token}')) AS b FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)),
m AS (SELECT r, label, len(list_intersect(b, tokens)) / len(tokens) AS c FROM lines, t
      WHERE len(list_intersect(b, tokens)) >= need),
ms AS (SELECT r, list(DISTINCT label) AS ls, max(c) AS score FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(ms.ls, [])))), ','), '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN ms USING (r)"""


ORACLE = _oracle()
