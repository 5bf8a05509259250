"""What the corpus operators share: intermediate tables in the shared folder and text conventions.

Words are ``[^\\x20\\x09-\\x0D]+``: only the six ASCII white-space characters separate them, which is
also how Python's ``bytes.split()`` divides UTF-8.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 read this alike.
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where unset, a local run gets one of its
    own; on a cluster there is no folder to fall back on."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trellis-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trellis/{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and rereads it: lineage ends there, later jobs survive lost
    executors, and the table's true size is known to the planner (which alone decides on broadcasts)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    # its shuffle files are of no more use once the table is written
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a stashed table that no later result reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words; only a first and a last part of the split can be empty."""
    parts = F.split(text, SPACE)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    return (F.size(parts) - F.when(first == "", 1).otherwise(0) - F.when((last == "") & (F.size(parts) > 1), 1).otherwise(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
