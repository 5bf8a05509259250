"""URL filter [native]: host and path rules, then logistic regression on hashed character n-grams.

The model is trained here, from a small labelled URL table that ``labelled`` builds from ordinary words of unwanted
and wanted sites (at most ``MAX_LABELLED`` rows are used, in order of url), by full-batch gradient descent with
momentum, written as one SQL aggregate over that table; only its ``DIMENSIONS`` weights reach the driver, and
every url is scored by an expression.

Defined cases: a url that is null or has no ``://`` has an empty host and path, which no rule fits, and is
judged by the model's bias; repeated rows are judged alike; empty table: no rows, and a model trained on no rows
allows all; columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

DIMENSIONS, STEPS, RATE, MOMENTUM, DECAY, MAX_LABELLED = 8192, 80, 12.0, 0.9, 1e-4, 2400
GRAMS = (3, 4)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Words that name unwanted sites.
UNWANTED = [
    "casino", "poker", "bets", "betting", "slots", "jackpot", "lottery", "roulette", "pills", "meds", "viagra", "loans", "payday", "replica", "warez", "crack", "keygen", "adult",
    "xxx", "cams", "escort", "hookup", "spam", "ads", "adserver", "clicks", "tracker", "tracking", "popup", "banner", "linkfarm", "giveaway", "prizes", "coupons", "bonus", "deals",
]
#: What unwanted names are put together with.
LURES = ["free", "best", "cheap", "win", "hot", "mega", "fast", "easy", "online", "vip", "lucky", "instant"]
#: Words that name wanted sites.
WANTED = [
    "news", "library", "university", "museum", "garden", "history", "science", "travel", "recipes", "weather", "school", "music", "theatre", "health", "football", "council", "river",
    "mountain", "book", "film", "radio", "journal", "kitchen", "hospital", "archive", "forum", "encyclopedia", "maps", "research", "language", "dictionary", "chemistry", "physics",
    "biology", "gallery", "craft", "bicycle", "railway", "airport", "hotel", "farming", "weaving", "poetry", "philosophy", "astronomy", "ocean", "forest", "village", "parliament",
    "economics", "statistics", "engineering", "orchestra", "painting", "sailing", "climbing", "gardening", "northern", "southern", "eastern", "western", "thesis", "theory",
    "nation", "station", "action", "lesson", "hearing", "thunder", "whether", "another", "together", "through", "thinking", "shelter", "winter", "summer", "autumn", "spring",
]
#: What wanted names are put together with.
PLACES = ["city", "old", "open", "north", "local", "daily", "green", "royal", "new", "public", "lake", "home"]
#: Names that measure the model and are no part of the table, in either order of their words.
HELD_OUT = {"free-bets", "cheap-pills", "casino-win", "win-casino", "best-casino", "spam-farm", "ads-track", "adult-x", "museum-guide", "garden-walk"}
#: Urls at which every name is seen, so that none of their parts tells wanted from unwanted.
SHAPES = ("http://www.{}.com/{}", "https://{}.net/page/{}.html", "https://m.{}.org/{}/", "http://blog.{}.example.com/de/{}?page=2", "https://www.{}.example.com/en/{}#top")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null."""
    found = verdict = None
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return found, verdict


def features(host: Column, path: Column, dimensions: int = DIMENSIONS) -> Column:
    """Distinct hashed n-grams of the two fields, each field with its ends marked; all digits count alike."""

    def grams(field: str, text: Column) -> list[Column]:
        text = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        return [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i, n=n: F.pmod(F.xxhash64(F.lit(field), F.substring(text, i, F.lit(n))), F.lit(dimensions)).cast("int"))).otherwise(F.array().cast("array<int>")) for n in GRAMS]

    return F.array_distinct(F.concat(*grams("host", host), *grams("path", path)))


def names(words: list[str], others: list[str], each: int) -> list[str]:
    """Every word alone, and with ``each`` of the others before or behind it."""
    out = list(words)
    for k, word in enumerate(words):
        for j in range(each):
            other = others[(k + len(others) // each * j) % len(others)]
            out.append(f"{other}-{word}" if (k + j) % 2 else f"{word}-{other}")
    return [n for n in out if n not in HELD_OUT]


def labelled(spark: SparkSession) -> DataFrame:
    """url, bad (1 or 0): every name at each shape of url."""
    urls = [(shape.format(name, 37 * k % 991), bad) for bad, some in ((1, names(UNWANTED, LURES, 5)), (0, names(WANTED, PLACES, 2))) for k, name in enumerate(some) for shape in SHAPES]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {bad})" for u, bad in urls) + " AS t(url, bad)")


def train(table: DataFrame, dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = RATE, momentum: float = MOMENTUM, decay: float = DECAY) -> list[float]:
    """Weights, the last one the bias. A feature of a url with n features counts 1 / sqrt(n)."""
    rows = table.where("url IS NOT NULL AND bad IS NOT NULL").orderBy("url", "bad").limit(MAX_LABELLED)
    rows = rows.select(features(*parts(F.col("url")), dimensions).alias("f"), F.col("bad").cast("double").alias("y"))
    # Seen by rows, and by features as lists of (row, value); kept as a table, else each step would make it anew.
    seen = rows.sparkSession.sql(
        f"""
        WITH numbered AS (SELECT f, y, CAST(row_number() OVER (ORDER BY y, f) - 1 AS INT) AS r, 1 / sqrt(CAST(size(f) AS DOUBLE)) AS v FROM {{url_rows}}),
        fwd AS (SELECT array_sort(collect_list(struct(r, f, y, v))) AS rows FROM numbered),
        flat AS (SELECT d, sort_array(collect_list(struct(r, v))) AS at FROM numbered LATERAL VIEW explode(f) AS d GROUP BY d),
        inv AS (SELECT map_from_entries(collect_list(struct(d, at))) AS m FROM flat)
        SELECT rows, transform(sequence(0, {dimensions - 1}), d -> coalesce(try_element_at(m, d), CAST(array() AS ARRAY<STRUCT<r: INT, v: DOUBLE>>))) AS by FROM fwd CROSS JOIN inv""",
        url_rows=rows,
    )
    # One step fills the residuals, the next moves the weights; m is what is left of the last move.
    found = stash(seen, "labelled").selectExpr(f"""
        aggregate(sequence(1, {2 * steps}),
            named_struct('w', transform(sequence(0, {dimensions}), d -> 0D), 'm', transform(sequence(0, {dimensions}), d -> 0D), 'e', transform(rows, x -> 0D)),
            (a, s) -> IF(s % 2 = 1,
                named_struct('w', zip_with(a.w, a.m, (w, m) -> w + m), 'm', a.m,
                    'e', transform(rows, x -> x.y - 1 / (1 + exp(-(aggregate(x.f, a.w[{dimensions}] + a.m[{dimensions}], (t, d) -> t + x.v * (a.w[d] + a.m[d]))))))),
                named_struct('w', a.w, 'm', concat(
                    transform(by, (at, d) -> IF(size(at) = 0, 0D, {momentum}D * a.m[d] + {rate}D * (aggregate(at, 0D, (t, p) -> t + p.v * a.e[p.r]) / greatest(size(rows), 1) - {decay}D * a.w[d]))),
                    array({momentum}D * a.m[{dimensions}] + {rate}D * aggregate(a.e, 0D, (t, e) -> t + e) / greatest(size(rows), 1))), 'e', a.e))
        ) AS a""").selectExpr("zip_with(a.w, a.m, (w, m) -> w + m) AS w").first()
    return list(found.w) if found.w else [0.0] * (dimensions + 1)


def score(found: Column, weights: list[float]) -> Column:
    """Log-odds that a url with these features is unwanted."""
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one constant, folded when the query is planned
    return F.lit(weights[-1]) + F.aggregate(found, F.lit(0.0), lambda t, d: t + F.get(w, d)) / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def judge_urls(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.withColumn("score", score(features(F.col("host"), F.col("path")), weights))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
