"""Token counts with a digest cache.

The cache is a table (content, tokenizer, n_tokens) in a folder that outlives a run: content is the SHA-256
of the normalised text (null becomes empty; the tokenizer's own normaliser leaves texts alone, so nothing
else may change), tokenizer that of the model file. A run joins the documents' digests to it, encodes each
distinct miss once, appends what it has counted, and joins again. With all digests known no text is encoded.

Defined cases: null text: as empty, 0 tokens; repeated rows: counted once, returned each; null or repeated
doc_id: kept; empty table: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stash, text_of

LIMIT = 4096
CACHE = "content binary, tokenizer binary, n_tokens bigint"
_loaded: dict = {}


def counter(path: str):
    """The tokenizer of a file, loaded once a process. Executors find public files by name, at their own path."""
    if path not in _loaded:
        from .tokens import Pieces

        _loaded[path] = Pieces(path)
    return _loaded[path]


def count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(content, _t) batches to (content, n_tokens)."""
    count = counter(path).count
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([count(t.as_py()) for t in batch.column("_t")], pa.int64())], ["content", "n_tokens"])


def cached(spark: SparkSession, folder: str, version: bytes) -> DataFrame:
    """What the cache holds for a tokenizer; repeated entries (of runs at one time) are equal and count once."""
    try:
        known = spark.read.schema(CACHE).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE)
    return known.where(F.col("tokenizer") == F.lit(version)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache_dir: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``. ``path``: a sentencepiece model."""
    from .tokens import version_of

    spark, version = docs.sparkSession, version_of(path)
    cache_dir = cache_dir or new_path(spark, "token_cache")
    content = F.unhex(F.sha2(text_of(), 256))
    slim = stash(docs.select("doc_id", content.alias("content"), F.octet_length(text_of()).cast("long").alias("n_bytes")), "digests")
    # of each distinct digest one document, the one of the least doc_id, and how many rows repeat that: the copies of a
    # text are added up in the tasks that read them, so that but one row of each task is dealt by the digest
    firsts = slim.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("m"))
    firsts = firsts.select(F.col("content").alias("_c"), F.col("m.doc_id").alias("_d"))
    misses = firsts.join(cached(spark, cache_dir, version), F.col("_c") == F.col("content"), "left_anti")
    again = slim.groupBy("content", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("content").alias("_again"), F.col("doc_id").alias("_id"), "n")
    misses = misses.join(again, (F.col("_c") == F.col("_again")) & F.col("_d").eqNullSafe(F.col("_id")), "left").select("_c", "_d", F.coalesce("n", F.lit(1)).alias("n"))
    misses = stash(misses, "misses")
    if not misses.isEmpty():
        # dealt by (content, id), so copies do not meet; the narrow side is hashed, so texts are not sorted
        rows = docs.select(content.alias("content"), F.col("doc_id").alias("_first"), text_of().alias("_t"))
        of = lambda part: rows.join(part.hint("shuffle_hash"), (F.col("content") == F.col("_c")) & F.col("_first").eqNullSafe(F.col("_d")), "left_semi")
        texts, repeated = of(misses.where("n = 1")), misses.where("n > 1")
        if not repeated.isEmpty():
            texts = texts.unionByName(of(repeated).dropDuplicates(["content"]))
        counted = texts.select("content", "_t").mapInArrow(lambda batches: count_tokens(batches, path), "content binary, n_tokens bigint")
        counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    known = stash(cached(spark, cache_dir, version), "known")
    return slim.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content")
