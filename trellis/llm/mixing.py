"""Mixing sources to target weights by Pareto order sampling [native].

Sources get word targets by weight, water-filled under a cap of ``MAX_COPIES`` times their words. A source
that needs r times its words takes floor(r) whole copies of every document for certain; the rest is a
sample with unequal probabilities. A document's inclusion probability is proportional to its weight (``ODDS``: by
length, as long documents are worth more to a model of long contexts), normalised so that the expected words of the
sample are those still wanted; a weight class whose probability would exceed one is taken whole, for certain, and
the others share what is left. Documents are then ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the lowest are taken until the words still wanted are reached (the sample's size
is fixed in words; the last document is in if at least half of it fits). u comes from a digest of doc_id
and seed, so reruns agree.

Weights count in classes of ``STEP`` of an octave from 2**-8 to 2**8, so a source has a bounded number of them.
Sources are numbered by a range sort and the level of the targets is found from sums over sources, so that no
task needs all sources. The rank's running sum never needs a source in one task: ranks are cut into cells, the
cells' sums are accumulated, and only the one cell of each source in which the sample ends is sorted.

Defined cases: null text: size 0; null source: the last source; sources without words: target 0; repeated
rows are documents of their own; equal ranks: by doc_id, size and text hash; a null or non-positive weight counts
as the least; empty table: no rows. Only doc_id, text, source (and what ``odds`` names) are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, stash, text_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
CELLS = 4096
#: A document's weight against the others of its source, by its number of words.
ODDS = "CASE WHEN size < 64 THEN 1D WHEN size < 512 THEN 2D ELSE 4D END"
#: Classes of weight: this many to an octave.
STEP = 64


def numbered(by: DataFrame) -> DataFrame:
    """``by`` with _place, the number of its source by code point, null last: a range sort whose partitions' row
    counts (one for each shuffle partition) give the first numbers."""
    order = F.col("source").asc_nulls_last()
    ranged = by.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stash(ranged.select(*by.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth")), "sources")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return ranged.join(first, "_part").withColumn("_place", F.col("_first") + F.col("_nth")).drop("_part", "_first", "_nth")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target; one row per source."""
    by = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    by = stash(by.select("source", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_place") % len(weights) + 1).cast("int")).alias("_w")), "weights")
    # A source is full if the level gives it its cap. Filling sources up raises the level for the rest, so the set of
    # full ones only grows; once a level fills no more sources it is the one.
    level, full = 0.0, None
    while True:
        is_full = F.lit(level) * F.col("_w") >= cap * F.col("source_size")
        sums = by.agg(F.sum("source_size"), F.sum(F.when(is_full, F.col("source_size")).otherwise(0)), F.sum(F.when(~is_full, F.col("_w")).otherwise(0.0)), F.count_if(is_full)).first()
        if sums[3] == full or not sums[2]:
            break
        level, full = float((sums[0] or 0) - cap * (sums[1] or 0)) / sums[2], sums[3]
    target = F.when(F.lit(level) * F.col("_w") >= cap * F.col("source_size"), (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("_w"))
    return by.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, seed: str, odds: str, row: bool) -> DataFrame:
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # the weight may name any column, and size, the number of words
    weighed = docs.select(whole.alias("_row"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "_row")], count_words(text_of()).alias("size"))
    weight = F.expr(odds).cast("double")
    octave = F.when(weight > 0, F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.log2(weight)))).otherwise(-8.0)
    return weighed.select("doc_id", "source", "size", u.alias("_u"), F.round(octave * STEP).cast("int").alias("_class"), F.xxhash64("text").alias("_text"), *["_row"] * row)


def chances(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, _class, _p, _more, _rest: for every weight class of a source its inclusion probability in the sample,
    whether it is taken whole (1 or 0), and the words that are wanted of the source's other classes."""
    by = sized.groupBy("source", "_class").agg(F.sum("size").alias("_words"))
    goal = goals.select(F.col("source").alias("_source"), "_rest")
    by = by.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_x", F.pow(F.lit(2.0), F.col("_class") / F.lit(float(STEP))))
    heavy = W.partitionBy("source").orderBy(F.desc("_class"))
    by = by.withColumn("_above", F.coalesce(F.sum("_words").over(heavy.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("_open", F.sum(F.col("_words") * F.col("_x")).over(heavy.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("_c", F.when(F.col("_open") > 0, (F.col("_rest") - F.col("_above")) / F.col("_open")).otherwise(0.0))
    by = by.withColumn("_whole_class", F.col("_c") * F.col("_x") >= 1)
    of = W.partitionBy("source")
    level = F.max(F.when(~F.col("_whole_class"), F.col("_c"))).over(of)
    taken = F.sum(F.when(F.col("_whole_class"), F.col("_words")).otherwise(0)).over(of)
    return by.select("source", "_class", F.when(F.col("_whole_class"), 0.0).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("_x")).alias("_p"), F.col("_whole_class").cast("long").alias("_more"), (F.col("_rest") - taken).alias("_rest"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, odds: str = ODDS, cells: int = CELLS, row: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    ``odds``: SQL over the columns of ``docs`` and size for a document's weight against the others of its
    source; ``row``: carry the whole row as the struct ``_row`` (it is read again, not shuffled).
    """
    sized = stash(_sized(docs, seed, odds, False), "sized")
    goals = targets(sized, weights, cap)
    goals = goals.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = stash(goals.withColumn("_rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0)), "goals")
    class_ = chances(sized, goals).withColumnRenamed("source", "_s")
    goal = stash(class_.join(goals.drop("_rest"), F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumnsRenamed({"source": "_source", "_class": "_of"}), "chances")
    rank = F.when(F.col("_p") > 0, F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p"))))

    def ranked(rows: DataFrame) -> DataFrame:
        out = rows.join(goal, rows.source.eqNullSafe(goal._source) & (rows["_class"] == goal["_of"]), "left").drop("_source", "_of").withColumn("_q", rank)
        return out.withColumn("_cell", F.floor(F.lit(cells) * F.col("_q") / (1 + F.col("_q"))).cast("int"))

    # cells' running sums, then the cell of each source in which the sample ends
    sums = ranked(sized).where("_cell IS NOT NULL").groupBy("source", "_cell", "_rest").agg(F.sum("size").alias("_cell_size"))
    before = W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_cell_size").over(before), F.lit(0)))
    ends = sums.where("_before <= _rest").groupBy("source").agg(F.max(F.struct("_cell", "_before")).alias("_m"))
    ends = stash(ends.select(F.col("source").alias("_source"), F.col("_m._cell").alias("_end"), F.col("_m._before").alias("_before")), "ends")
    rows = ranked(_sized(docs, seed, odds, True) if row else sized)
    placed = rows.join(ends, rows.source.eqNullSafe(ends._source), "left").drop("_source")
    order = W.partitionBy("source").orderBy("_q", "doc_id", "size", "_text").rowsBetween(W.unboundedPreceding, 0)
    inside = placed.where("_cell = _end").withColumn("_sum", F.sum("size").over(order))
    inside = inside.withColumn("_in", (F.col("_before") + F.col("_sum") - F.col("size") / 2 <= F.col("_rest")).cast("long")).drop("_sum")
    outside = placed.where("NOT coalesce(_cell = _end, false)").withColumn("_in", F.coalesce(F.col("_cell") < F.col("_end"), F.lit(False)).cast("long"))
    copies = F.col("_whole") + F.col("_more") + F.col("_in")
    return outside.unionByName(inside).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *["_row"] * row)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all columns of ``docs``.

    A document without words adds nothing to a mix by words; it is taken like any other of its source.
    """
    taken = mix(docs, row=True, **options).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))), "_row").select("_row.*")
