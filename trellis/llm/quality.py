"""Quality rules with host verdicts [native].

Each document is measured and held against document rules; the failures of every rule are then summed by
host (a document's ``source``), each host's failure rate is shrunk towards a beta prior fitted to all hosts
by moments, and a host of which some shrunk rate exceeds one half is distrusted as a whole.

Defined cases: a null or empty text has no words (and so fails the base rules); a null source is a host of
its own; repeated rows count as often as they occur; an empty table gives no rows; columns other than
``doc_id, text, source`` are ignored by ``measure`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, stash, text_of

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host is distrusted if a shrunk failure rate of one of its rules is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)
SYMBOLS = "#*$%&|<>"
#: rule -> SQL condition under which a document fails it.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 25 * n_words",
}


def _follows(array: str, fn) -> Column:
    """fn(item, next item or null) over an array column."""
    return F.zip_with(F.col(array), F.slice(F.col(array), F.lit(2), F.greatest(F.size(array), F.lit(1))), fn)


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source and the measurements of each whole text; ``keep``: further expressions to carry.

    Words that lie in a repeated five-word window are found inside the row: 64-bit hashes of all windows are
    built from word hashes; only where some hash occurs twice are they sorted with their places. A filter on
    the measurements should also ask for ``_seq >= 0``: no filter is pushed below that column, which would
    evaluate what is computed once here over and over.
    """
    carried = [F.expr(x) for x in keep or []]
    names = docs.select(*carried).columns if carried else []
    base = docs.select("doc_id", "source", *carried, text_of().alias("_t"))
    kept = ["doc_id", "source", *names]
    words = base.select(*kept, "_t", F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "").alias("_l"))
    plain = words.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"),
    )
    kept += ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    window = lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + k) for k in range(WINDOW)])
    hashed = plain.select(*kept, F.when(F.size("_wh") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_wh") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    ordered = hashed.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"))
    equal = ordered.select(*kept, "_s", _follows("_s", lambda a, b: F.coalesce(a.h == b.h, F.lit(False))).alias("_e"))
    twice = equal.select(*kept, F.sort_array(F.filter(F.transform("_s", lambda s, i: F.when(F.get(F.col("_e"), i) | F.coalesce(F.get(F.col("_e"), i - 1), F.lit(False)), s.i)), lambda x: x.isNotNull())).alias("_p"))
    out = twice.select(*kept, F.aggregate(_follows("_p", lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"), F.monotonically_increasing_id().alias("_seq"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """source, host_rate (largest shrunk failure rate), host_ok for each host."""
    sums = measured.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(sql)).alias(f"_{k}") for k, sql in RULES.items()])
    rows = sums.select("source", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"_{k}").alias("failed")) for k in RULES])).alias("_r")).select("source", "n", "_r.*", (F.col("_r.failed") / F.col("n")).alias("rate"))
    prior = rows.groupBy("rule").agg((F.sum("failed") / F.sum("n")).alias("_m"), F.coalesce(F.var_pop("rate"), F.lit(0.0)).alias("_v"))
    weight = F.when(F.col("_v") <= 0, PRIOR_WEIGHT[1]).otherwise(F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1)
    prior = prior.select("rule", "_m", F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(F.lit(PRIOR_WEIGHT[1]), weight)).alias("_k"))
    shrunk = rows.join(prior, "rule").select("source", ((F.col("failed") + F.col("_m") * F.col("_k")) / (F.col("n") + F.col("_k"))).alias("_s"))
    return shrunk.groupBy("source").agg(F.max("_s").alias("host_rate")).withColumn("host_ok", F.col("host_rate") <= MAX_HOST_RATE)


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measurements, base_failed, host_rate and kept for every row of ``docs``."""
    measured = stash(measure(docs, keep).drop("_seq"), "measured")
    hosts = stash(host_verdicts(measured), "hosts").withColumnRenamed("source", "_host")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).drop("_host", "host_ok")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Each text is measured once: rows and measurements are written,
    hosts are judged from the measurements alone, and no text is shuffled."""
    measured = stash(measure(docs, ["struct(*) AS _row"]).drop("_seq"), "measured")
    hosts = stash(host_verdicts(measured), "hosts").where(~F.col("host_ok")).select(F.col("source").alias("_host"))
    passed = measured.where(~F.col("base_failed")).select("source", "_row")
    return passed.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left_anti").select("_row.*")
