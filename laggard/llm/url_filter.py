"""URL filters: allow/block rules first, a logistic regression on hashed character
n-grams of host and path for the rest.  DataFrame functions and Spark ML only, no shuffle.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule
and is judged by the model (its score is that of no n-gram at all).  Repeated rows stay
repeated.  Only the id and url columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laggard.llm.common import ascii_lower, table

#: (rule, verdict); a rule is host + path prefix and fits the host and its subdomains.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
MAX_RULES = 5000
N_FEATURES = 1 << 14
GRAMS = (3, 4, 5)
REGULARISATION = 0.02

# The small labelled table is spelled out by a rule: pairs of words as names, under a few host
# prefixes, domains and paths, so that only the names tell the classes apart.
BLOCKED_WORDS = """casino poker bets slots jackpot lotto spam farm ads track clicks popup banner adult cams xxx porn tube escort
dates cheap pills meds viagra payday loans free crypto giveaway win prizes warez crack keygen malware phish replica miracle
diet casinos""".split()
ALLOWED_WORDS = """city news daily herald open library town museum state university science garden notes school board journal
archive weather recipes history health office docs python wiki forum theatre orchestra northern southern then other thing nation
station motion therein reading edition handler mother tongue river trust lake district stone works sailing club astronomy geology
botany printing parish council""".split()
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.org", "example.net")
PATHS = ("/en/12", "/de/345.html", "/fr/7/", "/es/89", "/")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled URL table (1: block), about 320 rows written out by the rule above."""
    def pairs(words, steps):
        return [f"{a}-{words[(i + k) % len(words)]}" for k in steps for i, a in enumerate(words)]

    spread = list(product(PREFIXES, DOMAINS, PATHS))
    out = [("", 0)] * 4
    for label, names in ((1, pairs(BLOCKED_WORDS, (1, 5, 11))), (0, ALLOWED_WORDS + pairs(ALLOWED_WORDS, (1, 17)))):
        for i, name in enumerate(names):
            pre, dom, path = spread[(7 * i + 23 * label) % len(spread)]
            out.append((f"https://{pre}{name}.{dom}{path}", label))
    return out


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))),
                      F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _of(t: Column, tag: str, n: int):
    return lambda i: F.concat(F.lit(tag), F.substr(t, i, F.lit(n)))


def grams(text: Column, tag: str) -> Column:
    """All character n-grams of ``text`` between two end marks, digits as one class; an empty
    text has none."""
    t = F.concat(F.lit("^"), F.translate(ascii_lower(text), "123456789", "000000000"), F.lit("$"))
    sets = []
    for n in GRAMS:
        last = F.length(t) - F.lit(n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        sets.append(F.transform(starts, _of(t, tag, n)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*sets))


def with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("_grams", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p")))


def train(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> PipelineModel:
    """Fit the classifier on the labelled table (a parameter of bounded size)."""
    rows = labelled_urls() if rows is None else rows
    small = spark.sql("SELECT * FROM VALUES "
                      + ", ".join("('{}', {}D)".format(u.replace("'", "\\'"), y) for u, y in rows)
                      + " AS t(url, label)")
    small = with_grams(small.select("label", host_of(F.col("url")).alias("host"),
                                    path_of(F.col("url")).alias("path")))
    tf = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=N_FEATURES, binary=True)
    lr = LogisticRegression(featuresCol="_tf", labelCol="label", probabilityCol="_prob", rawPredictionCol="_raw",
                            predictionCol="_pred", regParam=REGULARISATION, maxIter=100)
    return Pipeline(stages=[tf, lr]).fit(small.coalesce(1))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule (ties: the greater text), else null.

    The rules are a bounded parameter and go into the plan as a literal: no join, no shuffle.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; keep long lists in a table and join them")
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fits = []
    for rule, verdict in rules:
        at, _, rest = rule.partition("/")
        hit = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        fits.append(F.when(hit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"),
                                         F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def filter_urls(pages: DataFrame, model: PipelineModel, id_col="page_id", url_col="url", rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (of the model: 1 blocks)."""
    df = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = model.transform(with_grams(df.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))))
    score = F.element_at(vector_to_array("_prob"), 2)
    return scored.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), F.when(score >= 0.5, "block").otherwise("allow"))
                         .alias("verdict"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train(spark))
