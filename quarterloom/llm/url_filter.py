"""URL filter: prefix rules first, then logistic regression on hashed n-grams.

Method: character n-grams of host and path are hashed into buckets; a logistic
regression over the buckets is trained from a small labelled URL table. The
hash is a polynomial of code points, the trained weights are rounded to integers, so
that scores are exact sums and independent of summation order. Scoring is one
projection of SQL higher-order functions: no join, shuffle, UDF or Arrow.

Rules up to MAX_RULES are part of the plan. Larger sets are a table: each distinct host is
spread to its suffixes, which meet the rules by equality.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

BUCKETS = 4096
NGRAM = 4
#: Weights are stored as integers: this many units are 1.0.
UNITS = 1_000_000
#: Rules that are written into the plan; more are joined.
MAX_RULES = 1000

#: Names of the small labelled table, invented for it: no host of the supplied pages is among them.
BAD_NAMES = (
    "cheapest-meds cheap-rx pills-shop order-pills online-casino casino-royal casinos win-jackpot winners spam-links spammers link-farm farm-links "
    "casino-bonus adult-films sports-bets bets-today free-spins free-money adult-chat adults-only x-adult ads-server ads-click ad-tracker track-clicks"
).split()
GOOD_NAMES = (
    "weather library gardening news university museum theatre station thinking heather nation recipes maps docs science history ontario there handles shores "
    "tenth eighth seventh math myths length strength thirst others inner island lantern estate reading indian edition ardent oration tired stored sharing "
    "rather whither mother hinted resting entry andes latin soothing north rhythm thousand youth within health rehearse"
).split()
_PLACES = ("", "www.", "m.", "blog.")
_ENDS = ("com", "net", "org")
_PATHS = ("/en/7", "/de/31", "/fr/825", "/es/533/", "/en/148.html", "/de/671", "/fr/12.html", "/es/9", "/en/play", "/en/today", "")


def _labelled() -> tuple[tuple[str, int], ...]:
    """Every name as two URLs; both classes get the same places, ends and paths in turn."""
    out = []
    for y, names in ((1, BAD_NAMES), (0, GOOD_NAMES)):
        for i, name in enumerate(n for n in names for _ in range(2)):
            out.append((f"http://{_PLACES[i % 4]}{name}.example.{_ENDS[i % 3]}{_PATHS[i % 11]}", y))
    return tuple(out)


#: The small labelled URL table: (url, 1 to block).
LABELLED_URLS: tuple[tuple[str, int], ...] = _labelled()

#: The rules of the contract: (rule, verdict); a rule is host + path.
RULES: tuple[tuple[str, str], ...] = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: str) -> list[int]:
    cp = [ord(c) for c in text]
    return [sum(c * 31 ** (NGRAM - 1 - d) for d, c in enumerate(cp[i : i + NGRAM])) % BUCKETS for i in range(len(cp) - NGRAM + 1)]


def _split(url: str) -> tuple[str, str]:
    _, sep, rest = url.partition("://")
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    cut = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return (rest[:end], tail[:cut]) if sep else ("", "")


def train(labelled: Sequence[tuple[str, int]] = LABELLED_URLS, epochs: int = 200, rate: float = 0.3, l2: float = 3e-3) -> tuple[list[int], int]:
    """(bucket weights, bias) in UNITS; plain gradient descent over the small table.

    Each distinct bucket of a URL counts once. Deterministic: fixed order, zero start.
    """
    rows = []
    for url, y in labelled:
        host, path = _split(url)
        rows.append((sorted(set(_grams(f"^{host.lower()} {path}$"))), y))
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        grad: dict[int, float] = {}
        g0 = 0.0
        for grams, y in rows:
            z = bias + sum(w[g] for g in grams)
            e = (1 / (1 + math.exp(-max(min(z, 30.0), -30.0))) - y) / len(rows)
            g0 += e
            for g in grams:
                grad[g] = grad.get(g, 0.0) + e
        bias -= rate * g0
        for g, v in grad.items():
            w[g] -= rate * (v + l2 * w[g])
    return [round(x * UNITS) for x in w], round(bias * UNITS)


def score_of(host: Column, path: Column, weights: Sequence[int], bias: int) -> Column:
    """Bias plus the integer weights of the distinct n-gram buckets of host and path."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))
    cp = F.transform(F.split(text, ""), F.ascii)
    # neighbours side by side: the code points are made once for each place in a gram, not once a gram
    n = F.greatest(F.size(cp) - (NGRAM - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice(cp, d + 1, n) for d in range(NGRAM)])
    gram = lambda x: sum((x[str(d)] * F.lit(31 ** (NGRAM - 1 - d)) for d in range(NGRAM)), F.lit(0).cast("long"))
    grams = F.transform(beside, lambda x: F.pmod(gram(x), F.lit(BUCKETS)).cast("int"))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    return F.aggregate(F.array_distinct(grams), F.lit(bias).cast("long"), lambda a, g: a + F.get(table, g))


def _ruled_in_plan(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):  # a longer rule wraps the shorter ones
        host, sep, tail = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(sep + tail)
        rule, by_rule = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(by_rule)
    return df.withColumns({"rule": rule, "__by_rule": by_rule})


def _ruled_by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule`` and ``__by_rule`` from a table ``rule, verdict``.

    Every distinct (host, path) once: a hot page is one row before it is spread to its
    host's suffixes, and only suffixes with a rule are kept.
    """
    r = rules.where(F.col("rule").isNotNull()).withColumn("__n", F.monotonically_increasing_id())
    r = r.select(F.substring_index("rule", "/", 1).alias("r_host"), F.expr("substr(rule, char_length(substring_index(rule, '/', 1)) + 1)").alias("r_path"), F.col("rule").alias("r_rule"), F.col("verdict").alias("r_verdict"), "__n")
    # only suffixes of so many labels as a rule has can meet one
    most = r.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 1
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)))
    places = df.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(suffixes).alias("suffix")).join(r, (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
    best = met.groupBy("host", "path").agg(F.min_by(F.struct("r_rule", "r_verdict"), F.struct(-F.length("r_rule"), "__n")).alias("b"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("b.r_rule").alias("rule"), F.col("b.r_verdict").alias("__by_rule"))
    return df.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").drop("b_host", "b_path")


def filter_urls(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] | DataFrame = RULES, labelled: Sequence[tuple[str, int]] = LABELLED_URLS) -> DataFrame:
    """Add ``host, path, rule, score, verdict`` to every row.

    A rule is host + path and fits its host and all subdomains if the url's path
    starts with the rule's; the longest fitting rule decides (ties: the first).
    Elsewhere the model does: a positive score means block. ``rules`` are pairs, or a table
    ``rule, verdict``; a table, and more than MAX_RULES pairs, are joined.

    Defined cases: a null url or one without ``://`` has empty host and path, fits no
    rule that names a host, and is judged by the model; long urls are read whole;
    repeated rows get equal verdicts; columns named like an added one are replaced;
    an empty table gives none.
    """
    weights, bias = train(labelled)
    url = F.col(url_col)
    df = df.withColumns({"host": host_of(url), "path": path_of(url)}).drop("rule", "score", "verdict")
    if isinstance(rules, DataFrame):
        df = _ruled_by_join(df, rules)
    elif len(rules) > MAX_RULES:
        table = df.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
        df = _ruled_by_join(df, table.coalesce(1))
    else:
        df = _ruled_in_plan(df, rules)
    df = df.withColumn("score", score_of(F.col("host"), F.col("path"), weights, bias))
    return df.withColumn("verdict", F.coalesce(F.col("__by_rule"), F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))).drop("__by_rule")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_sql() -> str:
    """The same judgement in DuckDB SQL, trained weights included."""
    weights, bias = train()
    cases = {w: " ".join(f"WHEN (host = '{n.partition('/')[0]}' OR host LIKE '%.{n.partition('/')[0]}') AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n if w == 'rule' else v}'" for n, v in sorted(RULES, key=lambda r: -len(r[0]))) for w in ("rule", "verdict")}
    gram = " + ".join(f"CAST(cp[i + {d}] AS BIGINT) * {31 ** (NGRAM - 1 - d)}" for d in range(NGRAM))
    return f"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), c AS (
  SELECT *, list_transform(string_split('^' || host || ' ' || path || '$', ''), lambda x: unicode(x)) AS cp FROM p
), s AS (
  SELECT *, {bias} + coalesce(list_sum(list_transform(
    list_distinct(list_transform(range(1, len(cp) - {NGRAM - 2}), lambda i: ({gram}) % {BUCKETS})),
    lambda g: ([{",".join(map(str, weights))}])[g + 1])), 0) AS score
  FROM c
)
SELECT page_id, host, path, CASE {cases["rule"]} END AS rule,
       coalesce(CASE {cases["verdict"]} END, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM s
"""
