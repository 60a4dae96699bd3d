"""Quality rules: tokeniser fertility in rejection bands by language or script.

A public vocabulary with byte fallback measures each text over its words: characters per
token, the share of byte-fallback tokens, and the entropy of the tokens.  Texts that pass the
base rules set the bands: for each language (or, where none is given, the script that most
letters belong to) and each length class (a power of two of words) the quartiles over the
distinct texts of the whole table give a centre and a spread, so that it is no matter how often
any text is repeated.  A text is rejected if its characters per token and
entropy together lie too far below what is usual (few letters a token *and* few kinds of
tokens is what tables, markup and repeats look like), or if any of the three lies far outside.

Defined results: a null or empty text has no words, fails the base rules and has null
measures; rows that repeat are judged alike; a length class of fewer than ``MIN_SUPPORT``
distinct texts takes the bands of its whole language.  Only id, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import cut, table

VOCABULARY = "piece_bpe_32k.model"
#: Words that a worker remembers; it starts anew beyond them (a speed bound, not a limit).
MEMORY = 200_000
SLICE = 256
MIN_WORDS, REPEAT_PCT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Spreads below the centre that characters per token and entropy may have together; spreads
#: that any measure may lie from its centre.
JOINT, WIDE = 4.0, 8.0
MIN_SUPPORT = 30
#: Least spreads, so that a measure without any does not reject all that differs: about what a
#: language's texts of 128 to 511 words have at sf0.1.
LEAST_SPREAD = {"chars_per_token": 0.035, "byte_share": 0.02, "entropy": 0.1}
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF),
           ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class Meter:
    """Tokens of words under one vocabulary, with a bounded memory."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.forget()

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Meter:
        return cls(path)

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start = np.zeros(1, np.int64)   # tokens of word i: tokens[start[i]:start[i + 1]]
        self.tokens = np.zeros(0, np.int32)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Tokenise the words not met so far."""
        if len(self.place) > MEMORY:
            self.forget()
        new = list({w for words in texts for w in words if w not in self.place})
        if not new:
            return
        ids = self.model.encode([w.decode() for w in new], num_threads=1)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.tokens = np.concatenate([self.tokens, *(np.asarray(x, np.int32) for x in ids)])

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float | None, float | None, float | None]:
        """Words in repeated windows, characters per token, byte share, entropy (bits a token)."""
        if not words:
            return 0, None, None, None
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        kinds, local, counts = np.unique(at, return_inverse=True, return_counts=True)
        n = self.start[kinds + 1] - self.start[kinds]
        ends = np.cumsum(n)
        tokens = self.tokens[np.arange(ends[-1]) + np.repeat(self.start[kinds] - ends + n, n)]
        hist = np.bincount(tokens, np.repeat(counts, n), len(self.is_byte))
        total = hist.sum()
        if not total:
            return repeated(local), None, None, None
        p = hist[hist > 0] / total
        return repeated(local), chars / total, float(hist[self.is_byte].sum() / total), float(-(p * np.log2(p)).sum())


def repeated(ids: np.ndarray, k: int = WINDOW) -> int:
    """Words that lie in a window of k words that occurs twice or more."""
    if len(ids) <= k:
        return 0
    base, code = int(ids.max()) + 1, ids.astype(np.int64)
    for j in range(1, k):
        if (int(code.max()) + 1) * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code[:-1] * base + ids[j:]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, np.flatnonzero(hit), 1)
    np.add.at(steps, np.flatnonzero(hit) + k, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def script_of(text: str) -> str:
    """The script of most letters; none: other."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = [int(((points >= lo) & (points <= hi)).sum()) for _, lo, hi in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))][0] if max(counts) else "other"


MEASURED = ("h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "chars_per_token double, byte_share double, entropy double, script string")


def text_row(raw: bytes, words: list[bytes], meter: Meter, with_script: bool) -> tuple:
    text = raw.decode()
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats, *measures = meter.measure(words, chars)
    return (len(words), chars, sum(raw.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)),
            repeats, *measures, script_of(text) if with_script else None)


def measures(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", path: str | None = None) -> DataFrame:
    """id, lang and MEASURED (h: a hash of the text): one row for each row of ``docs``."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                raws = [x or b"" for x in part.column(2).cast(pa.binary()).to_pylist()]
                words = [x.split() for x in raws]  # bytes split at ASCII white space
                meter.learn(words)
                rows = [text_row(r, w, meter, k is None)
                        for r, w, k in zip(raws, words, part.column(1).to_pylist(), strict=True)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), *map(pa.array, cols, kinds)],
                    names=["id", "lang", *(x.split()[0] for x in MEASURED.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"),
                       F.xxhash64(text).alias("h")) \
        .mapInArrow(run, f"id {kind}, lang string, {MEASURED}")


def judge(measured: DataFrame, joint: float = JOINT, wide: float = WIDE) -> DataFrame:
    """Adds base_failed and kept to a (written) table of measures."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * n)
    df = measured.select("*", base.alias("base_failed"), F.coalesce("lang", "script").alias("band"),
                         F.when(n > 0, F.floor(F.log2(n.cast("double")))).otherwise(F.lit(0)).cast("int").alias("length"))
    names = list(LEAST_SPREAD)
    ok = df.where("NOT base_failed AND entropy IS NOT NULL").select("band", "length", "h", *names).distinct()
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in names]
    fine = ok.groupBy("band", "length").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= MIN_SUPPORT)
    # quartiles of a language over all lengths
    rough = ok.groupBy("band").agg(*quartiles)
    fine = fine.select("band", "length", F.struct(*names).alias("fine"))
    rough = rough.select("band", F.struct(*names).alias("rough"))
    df = df.join(fine, ["band", "length"], "left").join(rough, ["band"], "left") \
        .withColumn("q", F.coalesce("fine", "rough"))

    def z(c: str):
        q = F.col(f"q.{c}")
        spread = F.greatest((F.get(q, 2) - F.get(q, 0)) / 1.349, F.lit(LEAST_SPREAD[c]))
        return (F.col(c) - F.get(q, 1)) / spread

    chars, share, entropy = (z(c) for c in ("chars_per_token", "byte_share", "entropy"))
    odd = (chars + entropy < -joint) | (F.abs(chars) > wide) | (F.abs(entropy) > wide) | (share > wide)
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def score(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **kw) -> DataFrame:
    """One row per document: id, base measures, base_failed, kept, and the three measures."""
    return judge(cut(measures(docs, id_col, text_col, lang_col)), **kw).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "chars_per_token", "byte_share", "entropy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
