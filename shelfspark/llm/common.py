"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import checkpoint_dir

#: ASCII white space, the separator of every contract here.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there,
    later readers do not compute it again, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(col: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty text has none."""
    return F.filter(F.split(F.lower(col), SPACES), lambda w: w != "")


def hash_bucket(col: Column, bits: int = 20) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(1 << bits))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, bits: int = 20) -> DataFrame:
    """Rows of `df` whose `key` may be one of `keys` (a superset, exact when few).

    Broadcasts at most 2**bits distinct bucket numbers, whatever the size of
    `keys`; the exact join or grouping that follows then shuffles less."""
    buckets = keys.select(hash_bucket(F.col(key), bits).alias("__bucket")).distinct()
    return (df.withColumn("__bucket", hash_bucket(F.col(key), bits))
            .join(F.broadcast(buckets), "__bucket", "left_semi").drop("__bucket"))


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, at most `most` of them: counts fall into
    steps of an eighth power of two, and whole steps are taken from the top, so
    that what is collected stays below `most` rows however large the table."""
    step = F.floor(F.log2(F.col(count)) * 8)
    sizes = counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # at most 504 rows
    least, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["n"]
        if total > most:
            break
        least = row["step"]
    return counted.filter(step >= least) if least is not None else counted.limit(0)
