"""Readers. Strict ones fail on the first bad row, permissive ones return (rows, errors).

Every rule of the kind "first wins" needs the input's own order: text readers carry line numbers.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class BadInput(ValueError):
    """Input that breaks its contract."""


def jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank lines skipped; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def jsonl_permissive(spark: SparkSession, paths: str | list[str], schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors with file and line text): broken JSON and absent required fields go aside."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", T.StructType.fromDDL(schema).add("_corrupt", "string"), {"columnNameOfCorruptRecord": "_corrupt"}))
    lacking = F.array_compact(F.array(*[F.when(F.col("r")[c].isNull(), F.lit(f"{c} is absent")) for c in required]))
    told = parsed.withColumn("error", F.when(F.col("r._corrupt").isNotNull(), F.lit("not a JSON object")).when(F.size(lacking) > 0, F.array_join(lacking, "; ")))
    return told.where("error IS NULL").select("r.*").drop("_corrupt"), told.where("error IS NOT NULL").select("file", "line", "error")


def json_array(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated with quoted cells over several lines; the header must be exactly ``columns``."""
    head = spark.read.text(path).first()
    found = [] if head is None else [c.strip('"') for c in head[0].lstrip("﻿").split("\t")]
    if found != columns:
        raise BadInput(f"{path}: header is {found}, not {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("multiLine", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)


def parquet_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise BadInput(f"{path}: lacks {missing}")
    return df


def numbered_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no (from 1), line: whole files are split inside their row, so numbers are the files' own."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def decoded_books(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, text: UTF-8 where valid, else GB18030, what cannot be read replaced."""

    @F.pandas_udf("string")
    def gb(content):  # noqa: ANN001, ANN202
        return content.map(lambda b: bytes(b).decode("gb18030", "replace"))

    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.when(utf8, "utf-8").otherwise("gb18030").alias("encoding"), F.when(utf8, F.regexp_replace(F.col("content").cast("string"), "^﻿", "")).otherwise(gb("content")).alias("text"), F.sha2("content", 256).alias("sha256"))


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").option("path", file).option("table", name)``: read-only, in ranges of rowid."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        with self._connect() as db:
            rows = db.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        if not rows:
            raise BadInput(f"no table {self.options['table']}")
        return T.StructType([T.StructField(n, kinds.get(k.upper(), T.StringType())) for n, k in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema], int(self.options.get("rows", 100_000)))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        quote = lambda x: '"' + x.replace('"', '""') + '"'
        self.path, self.table, self.columns, self.rows = path, quote(table), ", ".join(map(quote, columns)), rows

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            last = db.execute(f"SELECT max(rowid) FROM {self.table}").fetchone()[0] or 0
        return [InputPartition(a) for a in range(0, last + 1, self.rows)]

    def read(self, partition: InputPartition):  # noqa: ANN201
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {self.columns} FROM {self.table} WHERE rowid > ? - 1 AND rowid < ? ORDER BY rowid", (partition.value, partition.value + self.rows))


READERS: dict[str, Callable[..., DataFrame]] = {".jsonl": jsonl, ".json": json_array}


def reader_for(path: str) -> Callable[..., DataFrame]:
    """By suffix, as importers are chosen."""
    for suffix, reader in READERS.items():
        if path.endswith(suffix):
            return reader
    raise BadInput(f"no reader for {path}")
