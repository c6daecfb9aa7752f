"""URL filter: longest domain rule first, else a logistic regression on character n-grams.

Scoring is a narrow projection of built-in functions: n-grams of the host and of the
path are hashed into ``BUCKETS`` weights, which are one constant array.  The model is
fitted on the driver on ``training_urls()``, a small labelled table made of two lists of words, from the same
built-in expressions.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule and gets the model's verdict on the empty strings; repeated urls get one row each;
other columns are not read; an empty table gives no rows; a very long url is read whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS = 8192
GRAMS = (3, 4)
STEPS = 300
RATE = 8.0
PENALTY = 1e-4
THRESHOLD = 0.5
#: Words of hosts to block and of hosts to allow, from which the labelled table is made.
BLOCK_WORDS = (
    "casino", "poker", "slots", "jackpot", "betting", "roulette", "spam", "phishing", "malware", "scam", "pills", "viagra", "pharmacy", "cheapmeds", "porn", "xxx", "adult", "sexcam", "escort",
    "payday", "loans", "fastcash", "prize", "giveaway", "replica", "rolex", "warez", "crack", "keygen", "torrent", "adserver", "ads", "tracker", "track", "popup", "banner", "clickbait", "backlinks", "linkfarm", "hotdeals",
)
ALLOW_WORDS = (
    "news", "weather", "library", "museum", "school", "history", "science", "garden", "recipes", "travel", "forum", "wiki", "docs", "code", "theatre", "health", "research", "letters", "music", "railway",
    "station", "kitchen", "nation", "thread", "thesis", "other", "teacher", "author", "northern", "mountain", "river", "street", "market", "paper", "translation", "question", "reader", "athens", "bridge", "winter",
)
#: Words and paths that stand with both, so that they tell nothing.
WITH_BOTH = ("farm", "online", "best", "world", "my", "city", "shop", "club", "live", "daily", "top", "go", "hub")
#: Syllables of made-up names: a name that tells nothing is allowed.
ONSETS, NUCLEI, CODAS = ("b", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "th", "w", "st"), ("a", "e", "i", "o", "u"), ("", "n", "r", "s", "nd", "ng", "t", "le")
NAMES = 140
PATHS = ("/", "/en/12", "/de/450?page=2", "/es/978", "/fr/414.html", "/index.html", "/en/728/", "/es/31?utm_source=feed", "/about")


def training_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block or 0 to allow)."""
    out = [("", 0)]
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, word in enumerate(words):
            other = WITH_BOTH[i % len(WITH_BOTH)]
            for k, host in enumerate((f"{word}-{other}.example.org", f"www.{other}-{word}.example.net", f"{word}.example.{('net', 'org')[i % 2]}", f"blog.{word}.example.{('org', 'net')[i % 2]}")):
                out.append((f"http{'s' * (i % 2)}://{host}{PATHS[(i + k) % len(PATHS)]}", label))
    for i in range(NAMES):
        name = "".join(ONSETS[(i * a + b) % len(ONSETS)] + NUCLEI[(i * c + b) % len(NUCLEI)] + CODAS[(i // a + b) % len(CODAS)] for a, b, c in ((3, 1, 1), (5, 2, 2)))
        out.append((f"https://{('', 'www.', 'm.')[i % 3]}{name}.example.{('org', 'net')[i % 2]}{PATHS[i % len(PATHS)]}", 0))
    return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _hashed(text: Column, kind: str, n: int, begins: Column) -> Column:
    return F.transform(begins, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def buckets_of(host: Column, path: Column) -> Column:
    """Places of the distinct n-grams of host and path, marked at both ends."""
    grams = []
    for kind, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))):
        for n in GRAMS:
            last = F.length(text) - (n - 1)
            grams.append(F.when(last >= 1, _hashed(text, kind, n, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.concat(*grams))


def train(spark: SparkSession, table=None) -> tuple[list[float], float]:
    """Weights and base by gradient descent on the small table; features are scaled by 1/sqrt(n)."""
    rows = spark.createDataFrame(list(table or training_urls()), "url string, label int")
    rows = rows.select("label", buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("at")).collect()
    examples = [(r["label"], r["at"], 1 / math.sqrt(max(1, len(r["at"])))) for r in rows]
    weights, base = [0.0] * BUCKETS, 0.0
    share = {label: len(examples) / (2 * n) for label in (0, 1) if (n := sum(x[0] == label for x in examples))}  # both labels weigh alike
    for _ in range(STEPS):
        step, slope = {}, 0.0
        for label, at, scale in examples:
            p = 1 / (1 + math.exp(-(base + scale * sum(weights[k] for k in at))))
            error = (p - label) * share[label] / len(examples)
            slope += error
            for k in at:
                step[k] = step.get(k, 0.0) + error * scale
        base -= RATE * slope
        for k, g in step.items():
            weights[k] -= RATE * (g + PENALTY * weights[k])
    return weights, base


def probability(host: Column, path: Column, weights: list[float], base: float) -> Column:
    at = buckets_of(host, path)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one constant, folded before execution
    total = F.aggregate(at, F.lit(0.0), lambda s, k: s + F.element_at(table, k + 1))
    return 1 / (1 + F.exp(-(F.lit(base) + total / F.sqrt(F.greatest(F.size(at), F.lit(1))))))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block."""
    weights, base = train(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), probability(F.col("host"), F.col("path"), weights, base).alias("p_block"))
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), F.round("p_block", 6).alias("p_block"))
