"""PII: surrogate generation.

Personal data (mail addresses, phone, card and account numbers, IP and MAC addresses, secrets,
names of persons) is replaced by keyed surrogates of the same type, script, gender and
format (longer, where a format has none left).  An entity is the canonical form of what was found (digits of a number, lower-case
address, part of a name), so that one entity gets one surrogate however it is written and
wherever in the corpus it occurs; a family name alone and the same name after a given name
agree.  Surrogates are drawn by HMAC from key, type, entity and attempt.  Those that equal a
real entity, or that another entity has, are drawn again, until each entity has its own: the
checks are joins and aggregates over the distinct entities of the whole table.

Texts without an entity pass through; the others alone are shuffled, to meet their
replacements.  Defined results: null texts stay null, empty texts empty; texts without an
entity stay as they are, byte for byte; of entities that overlap the first, then the longest
is replaced; repeated rows get equal texts.  All other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import cut, table

#: For tests and queries; a job passes its own secret.
KEY = b"laggard-surrogates-1"

UP, LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω", "a-zß-öø-ÿа-яёά-ώ"
NAME = rf"[{UP}][{LOW}]+(?:[-'][{UP}][{LOW}]+)*"
TITLES = {"m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Signor г-н Господин",
          "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mlle Señora Sra Signora г-жа Госпожа",
          "": "Dr Prof Professor"}
GIVEN = {("m", "latin"): """James John Robert Michael William David Thomas Peter Paul Mark Hans Karl Jürgen Stefan Pierre
Jacques Michel Philippe José Carlos Miguel Antonio""",
         ("f", "latin"): """Mary Anna Maria Emma Laura Julia Sarah Alice Helen Ursula Monika Sabine Claire Sophie Camille
Nathalie Carmen Lucía Elena Isabel Katharina Susan""",
         ("m", "cyrillic"): "Иван Пётр Николай Сергей Дмитрий Андрей Михаил Виктор",
         ("f", "cyrillic"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана",
         ("m", "greek"): "Νίκος Γιώργος Κώστας Δημήτρης", ("f", "greek"): "Μαρία Ελένη Σοφία Άννα"}
SYLLABLES = {"latin": "bar ben dor fel gan hol kar lin mar nor pel ros sen tal vor win",
             "cyrillic": "бар бел дор гал кар лин мар нов пет рос сав тор вол зим",
             "greek": "βασ γαλ δημ καρ λαμ μαν νικ παπ ροδ σταμ"}
GENDER_OF = {n: g for (g, _), names in GIVEN.items() for n in names.split()}
TITLE_GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
GIVEN_LISTS = {k: v.split() for k, v in GIVEN.items()}

_hex = "[0-9A-Fa-f]{1,4}"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("key", re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_\w{30,}|(?<!\w)xox[abprs]-[\w-]{10,}"
                          r"|(?<!\w)sk-[A-Za-z0-9_-]{20,}")),
    ("secret", re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([^\s\"']{6,})")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])")),
    ("ipv6", re.compile(rf"(?<![\w:])(?:(?:{_hex}:){{7}}{_hex}|{_hex}(?::{_hex}){{0,5}}::(?:{_hex}(?::{_hex}){{0,5}})?)(?![\w:])")),
    ("ipv4", re.compile(rf"(?<![\w.]){_octet}(?:\.{_octet}){{3}}(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\w)"
                         r"|(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\)|[ .-]\d(?=[ .-]))?(?:[ .-]?\d{2,4}){2,4}(?!\w)"
                         # national forms: 555 123 4567, 06 12 34 56 78, 020 7946 0958
                         r"|(?<![\w+])(?<!\d[ .-])(?:[2-9]\d\d \d{3} \d{4}|0[1-9](?P<gap>[ .-])\d\d(?:(?P=gap)\d\d){3}"
                         r"|(?:0\d{1,4}|\(0\d{1,4}\)) \d{3,4} \d{3,4})(?!\w|[ .-]\d)")),
)
_titles = "|".join(sorted(map(re.escape, TITLE_GENDER), key=len, reverse=True))
_given = "|".join(sorted(GENDER_OF, key=len, reverse=True))
TITLED = re.compile(rf"(?<!\w)({_titles})\.?[ \t]+({NAME})(?:[ \t]+({NAME}))?")
NAMED = re.compile(rf"(?<![\w-])({_given})[ \t]+({NAME})(?!\w)")
#: What a text must have for the patterns to be worth a try: every match of a pattern has what its gate looks for.
FOUR_DIGITS = re.compile(r"\d(?:\D{0,3}\d){3}")
IBAN_START = re.compile(r"[A-Z]{2}\d\d")
KEY_SIGNS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-")
NAME_SIGNS = re.compile("|".join(map(re.escape, (*TITLE_GENDER, *GENDER_OF))))
NUMBERS = ("card", "ipv4", "ssn", "phone")
ONLY_DIGITS = str.maketrans("", "", " .-()+")
LEADS = ("AKIA", "ASIA", "xox", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
#: From this attempt on, surrogates grow by a character each time, so that no format runs out.
WIDER = 8


def luhn(digits: str) -> int:
    """Luhn sum; a valid number's is divisible by ten."""
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "ё" else "greek" if "ά" <= c <= "ώ" else "latin"


def canonical(kind: str, surface: str) -> str:
    if kind in ("phone", "card", "ssn"):
        digits = surface.translate(ONLY_DIGITS)
        return digits if digits.isascii() else "".join(str(int(c)) for c in digits)
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(surface).exploded
    if kind in ("email", "mac"):
        return surface.lower().replace("-", ":") if kind == "mac" else surface.lower()
    return surface


def lead_of(key: str) -> str:
    return next((p for p in LEADS if key.startswith(p)), "")


def is_ipv6(surface: str) -> bool:
    """Whether it is an address, and with '::' no bit of code or time: three groups, or a first one of four, and a digit."""
    try:
        ipaddress.IPv6Address(surface)
    except ValueError:
        return False
    groups = [x for x in surface.split(":") if x]
    return "::" not in surface or (len(groups) > 2 or len(groups[0]) == 4) and any(c.isdigit() for c in surface)


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of every entity of a text, in order, none overlapping."""
    hits = []
    has = text.__contains__
    numbers = FOUR_DIGITS.search(text) is not None
    for kind, pattern in PATTERNS:
        if kind == "email" and not has("@") or kind == "key" and not any(map(has, KEY_SIGNS)) \
                or kind == "secret" and not (has("=") or has(":")):
            continue
        if kind in NUMBERS and not numbers or kind == "iban" and not IBAN_START.search(text) \
                or kind == "mac" and max(text.count(":"), text.count("-")) < 5 or kind == "ipv6" and text.count(":") < 2:
            continue
        for m in pattern.finditer(text):
            group = 1 if kind == "secret" else 0
            surface = m[group]
            if kind in ("secret", "key") and not any(c.isalpha() or c.isdigit() for c in surface[len(lead_of(surface)):]):
                continue  # a mask or code, nothing to replace
            if kind == "ipv6" and not is_ipv6(surface):
                continue
            if kind == "card" and luhn(canonical("card", surface)) % 10 or kind == "iban" and iban_rest(canonical("iban", surface)) != 1:
                continue
            hits.append((*m.span(group), kind, canonical(kind, surface)))
    named = NAME_SIGNS.search(text) is not None
    for m in TITLED.finditer(text) if named else ():
        gender = TITLE_GENDER[m[1]]
        if m[3]:
            hits += [(*m.span(2), given_kind(m[2], gender), m[2]), (*m.span(3), "family-" + script(m[3]), m[3])]
        else:
            hits.append((*m.span(2), "family-" + script(m[2]), m[2]))
    for m in NAMED.finditer(text) if named else ():
        hits += [(*m.span(1), given_kind(m[1], ""), m[1]), (*m.span(2), "family-" + script(m[2]), m[2])]
    out, end = [], 0
    for hit in sorted(set(hits), key=lambda h: (h[0], -h[1])):
        if hit[0] >= end:
            out.append(hit)
            end = hit[1]
    return out


def given_kind(name: str, gender: str) -> str:
    return f"given-{GENDER_OF.get(name, '') or gender or 'm'}-{script(name)}"


class Draw:
    """Keyed random numbers of one entity and attempt."""

    def __init__(self, key: bytes, *parts):
        self.key, self.parts, self.n, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            raw = hmac.digest(self.key, b"%d\x1f" % self.n + self.parts, hashlib.sha256)
            self.n, self.pool = self.n + 1, int.from_bytes(b"\1" + raw, "big")
        self.pool, r = divmod(self.pool, n)
        return r

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Letters and digits drawn by class; all else stays."""
        out = []
        for c in text:
            if hexadecimal and c in "0123456789abcdefABCDEF":
                d = "0123456789abcdef"[self.below(16)]
                out.append(d.upper() if c.isupper() else d)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                alphabet = {"cyrillic": "абвгдежзиклмнопрстуфхя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(
                    script(c), "abcdefghijklmnopqrstuvwxyz")
                d = alphabet[self.below(len(alphabet))]
                out.append(d.upper() if c.isupper() else d)
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, entity: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of an entity at an attempt, in canonical form."""
    draw = Draw(key, kind, entity, attempt)
    more = max(0, attempt - WIDER + 1)
    if kind == "email":
        local, _, domain = entity.partition("@")
        names, dot, top = domain.rpartition(".")
        if names == "example" or names.endswith(".example"):   # a reserved domain stays one
            names, dot, top = names.removesuffix("example").removesuffix("."), ".", f"example.{top}"
        # addresses of one domain keep one domain
        host = Draw(key, "domain", domain).like(names)
        return f"{draw.like(local)}{'x' * (attempt // 4)}{draw.like('x' * more)}@{host}{dot if host else ''}{top}"
    if kind == "phone":
        lead = 1 if entity.startswith("1") and len(entity) == 11 else min(2, len(entity) - 4)
        rest = draw.like(entity[lead:])
        return entity[:lead] + ("0" if entity[lead] == "0" else str(1 + draw.below(9))) + rest[1:] + draw.like("0" * more)
    if kind == "card":
        body = entity[0] + draw.like(entity[1:-1] + "0" * more)
        return body + str(-luhn(body + "0") % 10)
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + draw.like("0" * more)
    if kind == "iban":
        body = draw.like(entity[4:] + "0" * more)
        return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + body):02d}{body}"
    if kind == "ipv4":
        spans = {1: (1, 9), 2: (10, 90), 3: (100, 155)}
        return ".".join(str(lo + draw.below(n)) for lo, n in (spans[len(x)] if attempt < 6 else (1, 254)
                                                            for x in [*entity.split("."), *["1"] * more]))
    if kind == "mac":
        return draw.like(entity + "0" * more, hexadecimal=True)
    if kind == "ipv6":   # groups keep their lengths, those of 0 stay as long as there is room
        groups = [x.lstrip("0") for x in entity.split(":")] if not more else ["ffff"] * 8
        return ":".join((f"{1 + draw.below(15):x}" + draw.like(x[1:], hexadecimal=True) if x else "").zfill(4) for x in groups)
    if kind in ("key", "secret"):
        lead = lead_of(entity)
        return lead + draw.like(entity[len(lead):] + "0" * more, all(c in "0123456789abcdef" for c in entity.lower()))
    part, *rest = kind.split("-")
    if part == "given":
        names = GIVEN_LISTS.get(tuple(rest)) or GIVEN_LISTS["m", "latin"]
        return "-".join(names[draw.below(len(names))] for _ in range(attempt + 1))
    names = SYLLABLES[rest[0]].split()
    return "".join(names[draw.below(len(names))] for _ in range(3 + attempt // 2)).capitalize()


def written(kind: str, surface: str, value: str) -> str:
    """A canonical surrogate in the format of what it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        digits = iter(value)
        return "".join(next(digits) if c.isalnum() else c for c in surface) + "".join(digits)
    if kind == "ipv6":
        address = ipaddress.IPv6Address(value)
        if "::" in surface:
            value = address.compressed
        elif any(len(x) < 4 for x in surface.split(":")):
            value = ":".join(f"{int(x, 16):x}" for x in value.split(":"))
    if kind in ("email", "ipv6", "mac"):
        value = value.replace(":", "-") if kind == "mac" and "-" in surface else value
        return value.upper() if surface.isupper() else value
    return value


def row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")).alias("k"), F.xxhash64(F.col(f"`{text_col}`")).alias("h")]


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """k, h (what names a row and its text), s, e, kind, entity: one row for each entity found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, h, *hit) for k, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for hit in found(t)]
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), kinds)),
                                                 names=["k", "h", "s", "e", "kind", "entity"])

    return docs.where(F.col(f"`{text_col}`").isNotNull()).select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("t")) \
        .mapInArrow(run, "k string, h long, s int, e int, kind string, entity string")


def part_of(docs: DataFrame, text_col: str, with_entity: bool) -> DataFrame:
    """The rows whose texts have an entity, or those that have none."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(t and found(t)) == with_entity for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def propose(entities: DataFrame, attempt: int, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, e, attempt, key) for k, e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "entity", "value"])

    return entities.select("kind", "entity").mapInArrow(run, "kind string, entity string, value string")


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity, value: a surrogate for each distinct entity, none given twice, none an entity.
    It comes to an end: from the attempt WIDER on, every round has ten times as many to draw from."""
    real = entities.select("kind", F.col("entity").alias("value"))
    pending, done = entities, None
    for attempt in count():
        new = propose(pending, attempt, key).join(real, ["kind", "value"], "left_anti")
        if done is not None:
            new = new.join(done.select("kind", "value"), ["kind", "value"], "left_anti")
        new = cut(new.groupBy("kind", "value").agg(F.min("entity").alias("entity")).select("kind", "entity", "value"))
        done = new if done is None else cut(done.unionByName(new))
        pending = cut(pending.join(new.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if pending.isEmpty():
            return done


def replacements(docs: DataFrame, id_col="doc_id", text_col="text", key: bytes = KEY) -> DataFrame:
    """k, h, swaps (array of s, e, kind, value): one row for each text with an entity."""
    hits = cut(detect(docs, id_col, text_col).dropDuplicates(["k", "h", "s", "e"]))
    entities = cut(hits.select("kind", "entity").distinct())
    swaps = hits.join(assign(entities, key), ["kind", "entity"]).select("k", "h", F.struct("s", "e", "kind", "value").alias("x"))
    return swaps.groupBy("k", "h").agg(F.sort_array(F.collect_list("x")).alias("swaps"))


def replace(docs: DataFrame, id_col="doc_id", text_col="text", key: bytes = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts, and the number of entities replaced in ``count_col``."""
    names = docs.columns
    swaps = replacements(docs, id_col, text_col, key).withColumnsRenamed({"k": "__pii_k", "h": "__pii_h", "swaps": "__pii_swaps"})
    own = part_of(docs, text_col, True).withColumns(dict(zip(("__pii_k1", "__pii_h1"), row_key(id_col, text_col), strict=True)))
    joined = own.join(swaps, F.expr("__pii_k1 = __pii_k AND __pii_h1 = __pii_h"), "left") \
        .select(*[F.col(f"`{c}`") for c in names], F.col("__pii_swaps"))
    schema = joined.drop("__pii_swaps").withColumn("__pii_n", F.lit(0).cast("long")).schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for text, hits in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                pieces, end = [], 0
                for x in hits or ():
                    pieces += [text[end:x["s"]], written(x["kind"], text[x["s"]:x["e"]], x["value"])]
                    end = x["e"]
                texts.append("".join(pieces) + text[end:])
                counts.append(len(hits or ()))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*names, "__pii_n"])

    changed = joined.mapInArrow(run, schema)
    rest = part_of(docs, text_col, False).withColumn("__pii_n", F.lit(0).cast("long"))
    out = changed.unionByName(rest)
    return out.withColumnRenamed("__pii_n", count_col) if count_col else out.drop("__pii_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, count_col="n_entities")
