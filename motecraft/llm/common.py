"""Helpers that the text operators share: words, hashes, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="motecraft-"))
    return f"file://{_own_folder[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    It cuts the lineage and, unlike a cached table, outlives lost executors.
    """
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """`materialize` with the rows of a key in one bucket, so that a join on it needs no shuffle of them."""
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    path = f"{scratch_folder(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    made = spark.table(name)
    made.written_to = path
    spark.sql(f"DROP TABLE {name}")  # only its name: the files stay, and `made` knows them
    return made


def discard(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote for these very tables, once nothing reads them any more."""
    for made in tables:
        java = made.sparkSession._jvm.org.apache.hadoop.fs.Path(made.written_to)
        java.getFileSystem(made.sparkSession._jsc.hadoopConfiguration()).delete(java, True)


def as_given(rows: DataFrame, column: str, like: DataFrame) -> DataFrame:
    """`rows` with a column that went through pandas as text in the type it has in `like`: pandas makes long ids doubles where one is null."""
    return rows.withColumn(column, F.col(column).cast(like.schema[column].dataType))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_number(text: Column, digits: int) -> Column:
    """The first hex digits of a string's MD5 as a long: a hash that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def fold_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, which may use it inside other lambdas.

    Written out, it would be evaluated for each element of those lambdas.
    """
    return F.transform(F.array(value), body)[0]
