"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import count_below, let, running
from ..session import shared_path

__all__ = ["LOWER", "UPPER", "ascii_lower", "bucket_count", "count_below", "forget", "hash_bucket", "let", "running", "shared_path", "table", "written"]

#: The ASCII letters that the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bucket(hex_digest: Column, buckets: int) -> Column:
    """Even bucket 0..buckets-1 that grows with the digest's order."""
    first = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(first * F.lit(buckets).cast("bigint"), 32).cast("int")


def bucket_count(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))
